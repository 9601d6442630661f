"""Writing systems by code point range."""

from __future__ import annotations

import numpy as np

# First and last code point of the main blocks of each writing system
RANGES = [
    ("Latin", 0x0041, 0x005A), ("Latin", 0x0061, 0x007A), ("Latin", 0x00AA, 0x00AA), ("Latin", 0x00BA, 0x00BA),
    ("Latin", 0x00C0, 0x00D6), ("Latin", 0x00D8, 0x00F6), ("Latin", 0x00F8, 0x024F), ("Greek", 0x0370, 0x03FF),
    ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0531, 0x058F), ("Hebrew", 0x0591, 0x05F4), ("Arabic", 0x0600, 0x06FF),
    ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Tamil", 0x0B80, 0x0BFF),
    ("Telugu", 0x0C00, 0x0C7F), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3041, 0x30FF), ("Han", 0x3400, 0x4DBF),
    ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x2FA1F),
]
NAMES = sorted({name for name, _, _ in RANGES}) + ["Other"]
OTHER = len(NAMES) - 1
_FIRST = np.array([first for _, first, _ in RANGES])
_LAST = np.array([last for _, _, last in RANGES])
_CODE = np.array([NAMES.index(name) for name, _, _ in RANGES])


def script_codes(points: np.ndarray) -> np.ndarray:
    """Index into NAMES for each code point of a letter."""
    at = np.searchsorted(_FIRST, points, "right") - 1
    inside = (at >= 0) & (points <= _LAST[at])
    return np.where(inside, _CODE[at], OTHER)
