"""Personal data: fixed patterns, and a BiLSTM-CRF tagger over characters for other ways to write them.

The tagger learns from the spans that the patterns find in a bounded sample, and from the same
spans written otherwise. Overlapping windows lie over the whole text. A span counts if it is sure enough and passes
the check of its kind, and each check asks for a digit (of any script) or a way to write "at" outside the pattern
spans; a window without one can report nothing and is not decoded. A span that touches a window's edge inside the text
is read again in a longer window until it ends. Of spans that overlap the set with the highest total is kept.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossquote.llm.bilstm_crf import Tagger
from crossquote.llm.words import chunks, documents

KINDS = ("email", "ip", "card", "phone")
# The patterns of the kinds (the part of an address after its sign; an ip is not entered inside a number)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

AT = r"\s*(?:[\[({<]\s*at\s*[\])}>]|[@\uff20])\s*|\s+at\s+"
DOT = r"\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+|\."
#: What a span that passes its check has: a digit, or a sign for "at"; the plain word only before a name with a dot.
SIGNS = re.compile(r"[\d@\uff20]|[\[({<]\s*at\s*[\])}>]|(?<=\s)at\s+(?=[A-Za-z0-9\uff10-\uff5a-]+(?:" + DOT.replace("\\.", "[.\uff0e]")
                   + r")[A-Za-z0-9\uff10-\uff5a-])", re.IGNORECASE)
MOST_DIGITS = {"ip": 12, "card": 19, "phone": 15}
#: ASCII for full-width characters and for the digits of all scripts
FOLDED = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {
    c: 48 + d for c in range(128, sys.maxunicode + 1) if (d := unicodedata.decimal(chr(c), None)) is not None}
_FOLDED = np.array(sorted(FOLDED))
_PLAIN = np.array([FOLDED[c] for c in _FOLDED.tolist()])
WINDOW, STRIDE = 128, 64
SAMPLE = 3_000  # documents, about, that training windows come from
WINDOWS = 3_000  # training windows, at most
STEPS, BATCH = 120, 32
SURE = 0.9
TAGS = 1 + 2 * len(KINDS)  # outside, then the first and the further characters of each kind
OTHER, PAD = 96, 97
SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_added long")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns: per kind leftmost and without overlap, by start and then kind."""
    found: list[Span] = []
    done = sign = 0  # end of the last address, and the place after the last sign
    at = text.find("@")
    while at >= 0:
        lead = text[max(done, sign):at]
        start = at - (len(lead) - len(lead.rstrip(LOCAL)))
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append(("email", start, match.end()))
            done = match.end()
        sign = at + 1
        at = text.find("@", sign)
    if not re.search("[0-9]", text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def plausible(kind: str, text: str) -> bool:
    """The check that a tagged span must pass."""
    text = text.translate(FOLDED)
    digits = digits_of(text)
    if kind == "email":
        plain = re.sub(DOT, ".", re.sub(AT, "@", text, flags=re.IGNORECASE), flags=re.IGNORECASE)
        return base_spans(plain) == [("email", 0, len(plain))]
    if kind == "ip":
        parts = re.split(r"[^0-9]+", text)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", text)
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9()/. \x2d]*[0-9]", text)) and digits != text


def rewritten(kind: str, text: str) -> list[str]:
    """Other ways to write a span, to learn from."""
    if kind == "email":
        name, _, domain = text.partition("@")
        return [f"{name} [at] {domain}", f"{name} @ {domain}", f"{name}(at){domain}", f"{name}{{at}}{domain}",
                f"{name} at {domain.replace('.', ' dot ')}"]
    if kind == "phone":
        plain = text.lstrip("+")
        return [f"00{plain}", re.sub(r"[() ]+", "-", plain), re.sub(r"[()-]+", " ", plain).replace("  ", " ")]
    if kind == "ip":
        return [text.replace(".", "[.]"), text.replace(".", " . ")]
    return [re.sub(r"(?<=[0-9])(?=(?:[0-9]{4})+$)", ".", digits_of(text))]


def symbols(text: str) -> np.ndarray:
    """Character classes: printable ASCII (full-width forms too) as itself with all digits alike, anything else as one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if not text.isascii():
        at = np.minimum(np.searchsorted(_FOLDED, codes), len(_FOLDED) - 1)
        codes = np.where(_FOLDED[at] == codes, _PLAIN[at], codes)
    ids = np.where((codes > 31) & (codes < 127), codes - 31, np.where(codes < 32, 0, OTHER))
    return np.where((codes > 47) & (codes < 58), 48 - 31, ids)


def tag_rules() -> tuple[np.ndarray, np.ndarray]:
    allowed = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inner = 2 * k + 2
        allowed[:, inner] = False
        allowed[[inner - 1, inner], inner] = True
    opening = np.ones(TAGS, bool)
    opening[2::2] = False
    return allowed, opening


def windows(text: str, known: list[Span] = []) -> list[tuple[int, int]]:  # noqa: B006
    """Windows over the whole text, without those that hold no sign outside the ``known`` spans."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))  # the window that reaches the end
    ends, starts, reach = [], [], 0
    for _, a, b in sorted(known, key=lambda s: s[1]):
        starts.append(a)
        ends.append(reach := max(reach, b))
    out, then = [], 0
    for m in SIGNS.finditer(text):
        if starts and (at := bisect_right(starts, m.start()) - 1) >= 0 and m.start() < ends[at]:
            continue
        first = max(then, -(-(m.start() + 1 - WINDOW) // STRIDE))
        then = max(then, min(m.start() // STRIDE, last) + 1)
        out += [(k * STRIDE, min(k * STRIDE + WINDOW, len(text))) for k in range(first, then)]
    return out


def training_windows(docs: DataFrame, sample: int = SAMPLE, most: int = WINDOWS) -> list[str]:
    """Texts to learn from: windows around signs, and one plain window per document, from a bounded sample."""
    share = min(1.0, sample / max(docs.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            found = []
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                found += [text[a:b] for a, b in windows(text)][:64] + [text[:WINDOW]]
            yield pa.RecordBatch.from_arrays([pa.array([f for f in found if f], pa.string())], ["window"])

    signed = docs.where(F.col("text").rlike("[0-9@]"))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20))
    plain = chosen.select("text").mapInArrow(run, "window string").distinct().orderBy(F.xxhash64("window"), "window").limit(most // 3)
    share = min(1.0, sample / max(signed.count(), 1))
    chosen = signed.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 20)) < share * (1 << 20))
    around = chosen.select("text").mapInArrow(run, "window string").distinct().where(F.col("window").rlike("[0-9@]")) \
        .orderBy(F.xxhash64("window"), "window").limit(most - most // 3)
    return [r.window for r in plain.unionByName(around).collect()]


def labelled(text: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        if not tags[a:b].any():
            tags[a:b] = 2 * KINDS.index(kind) + 2
            tags[a] -= 1
    return symbols(text)[:WINDOW], tags[:WINDOW]


def varied(text: str, rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with its spans written otherwise, and where they are then."""
    out, spans, at = "", [], 0
    for kind, a, b in base_spans(text):
        if a < at:
            continue
        forms = rewritten(kind, text[a:b])
        new = forms[rng.integers(len(forms))]
        out += text[at:a]
        spans.append((kind, len(out), len(out) + len(new)))
        out += new
        at = b
    return out + text[at:], spans


def fit(texts: list[str], steps: int = STEPS, seed: int = 7) -> Tagger | None:
    """A tagger trained on the given texts, whose labels are their pattern spans; None if there are no spans."""
    rng = np.random.default_rng(seed)
    found = [(t, base_spans(t)) for t in texts]
    examples = [labelled(t, s) for t, s in found]
    with_spans = [t for t, s in found if s]
    if not with_spans:
        return None
    examples += [labelled(*varied(t, rng)) for t in with_spans]
    rich = [i for i, (_, tags) in enumerate(examples) if tags.any()]
    tagger = Tagger.start(PAD + 1, *tag_rules(), seed=seed)

    def batches():
        for _ in range(steps):
            picked = [*rng.choice(rich, BATCH // 2), *rng.integers(0, len(examples), BATCH - BATCH // 2)]
            yield padded([examples[i] for i in picked])

    tagger.train(batches())
    return tagger


def padded(rows: list[tuple[np.ndarray, np.ndarray]]):
    longest = max(1, max(len(s) for s, _ in rows))
    ids, tags = np.full((longest, len(rows)), PAD), np.zeros((longest, len(rows)), np.int64)
    mask = np.zeros((longest, len(rows)), bool)
    for i, (s, t) in enumerate(rows):
        ids[:len(s), i], tags[:len(s), i], mask[:len(s), i] = s, t, True
    return ids, mask, tags


def tagged(tagger: Tagger, texts: list[str], cells: int = 256 * WINDOW) -> list[list[tuple[float, Span]]]:
    """Spans that the tagger decodes in each window text, with their mean probability."""
    out: list[list[tuple[float, Span]]] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    while order:
        rows = max(1, cells // max(1, len(texts[order[-1]])))
        own, order = order[-rows:], order[:-rows]
        ids, mask, _ = padded([(s := symbols(texts[i]), np.zeros(len(s), np.int64)) for i in own])
        scores = tagger.emissions(ids, mask)
        tags = tagger.decode(scores, mask)
        if not (tags[mask] > 0).any():
            continue
        sure = np.take_along_axis(tagger.marginals(scores, mask), tags[..., None].astype(np.int64), 2)[..., 0]
        for col, i in enumerate(own):
            line = tags[:len(texts[i]), col]
            for start in np.flatnonzero(line % 2 == 1).tolist():
                end, inner = start + 1, line[start] + 1
                while end < len(line) and line[end] == inner:
                    end += 1
                out[i].append((float(sure[start:end, col].mean()), (KINDS[(inner - 2) // 2], start, end)))
    return out


def best_set(spans: list[tuple[float, Span]]) -> list[tuple[float, Span]]:
    """Spans without overlap with the highest total of probability times length; equal totals keep the later-starting end."""
    spans = sorted(spans, key=lambda s: (s[1][2], s[1][1], s[1][0]))
    ends = [s[1][2] for s in spans]
    total, taken = [0.0], [None] * len(spans)
    for i, (sure, (_, a, b)) in enumerate(spans):
        before = bisect_right(ends, a, 0, i)
        gain = total[before] + sure * (b - a)
        taken[i] = before if gain > total[i] else None
        total.append(max(total[i], gain))
    out, i = [], len(spans)
    while i:
        if taken[i - 1] is None:
            i -= 1
        else:
            out.append(spans[i - 1])
            i = taken[i - 1]
    return out[::-1]


def may_go_on(span: Span, text: str, base: list[Span]) -> bool:
    """Whether a span cut by a window's edge can be reported when it is whole: not over a pattern span or with too many digits."""
    kind, a, b = span
    if any(x < b and a < y for _, x, y in base):
        return False
    return kind not in MOST_DIGITS or len(digits_of(text[a:b].translate(FOLDED))) <= MOST_DIGITS[kind]


def grown(span: Span, text: str) -> Span:
    """The span with the rest of the name, domain or number that it begins or ends in, so that no part of it stays behind."""
    kind, a, b = span
    own = LOCAL if kind == "email" else "0123456789"
    while a and text[a - 1].translate(FOLDED) in own:
        a -= 1
    own = LOCAL[:-5] + "-" if kind == "email" else own
    while b < len(text) and (text[b].translate(FOLDED) in own or kind == "email" and text[b].translate(FOLDED) == "."
                             and text[b + 1:b + 2].translate(FOLDED) in tuple(own)):
        b += 1
    return kind, a, b


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of stretches, so that what many windows ask for is read once."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def added_spans(tagger: Tagger | None, texts: list[str], base: list[list[Span]], sure: float = SURE) -> list[list[Span]]:
    """What the tagger finds beside the pattern spans of each text."""
    out: list[list[Span]] = [[] for _ in texts]
    if tagger is None:
        return out
    asked = [(i, *w) for i, text in enumerate(texts) for w in windows(text, base[i])]
    held: dict[int, dict[Span, float]] = {}
    while asked:
        longer: dict[int, list[tuple[int, int]]] = {}
        for at in range(0, len(asked), 4096):
            part = asked[at:at + 4096]
            for (i, a, b), spans in zip(part, tagged(tagger, [texts[i][a:b] for i, a, b in part])):
                for p, (kind, s, e) in spans:
                    span = (kind, a + s, a + e)
                    before, after = a > 0 and s == 0, b < len(texts[i]) and e == b - a
                    if not (before or after):
                        own, span = held.setdefault(i, {}), grown(span, texts[i])
                        own[span] = max(p, own.get(span, 0.0))
                    elif may_go_on(span, texts[i], base[i]):
                        step = max(STRIDE, b - a)
                        longer.setdefault(i, []).append((max(0, a - step * before), min(len(texts[i]), b + step * after)))
        asked = [(i, a, b) for i, own in longer.items() for a, b in merged(own)]
    for i, spans in held.items():
        out[i] = [(p, s) for s, p in spans.items()]
    for i, spans in enumerate(out):
        taken = np.zeros(len(texts[i]) + 1 if spans else 0, bool)
        for _, a, b in base[i] if spans else []:
            taken[a:b] = True
        # what may not be reported must not win a place from what may
        fit = [(p, s) for p, s in spans if p >= sure and not taken[s[1]:s[2]].any() and plausible(s[0], texts[i][s[1]:s[2]])]
        out[i] = [s for _, s in best_set(fit)]
    return out


def joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Per row of ``docs`` the pattern counts, the digest of the pattern spans, all spans, and how many were added.

    Offsets are code points of the whole text, ends exclusive. A null text counts as empty: no spans, and the
    digest of the empty text. Without a tagger only the patterns are there.
    """
    known = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunks(batches):
            texts = [t.decode("utf-8", "replace") for t in raw]
            base = [base_spans(t) for t in texts]
            more = added_spans(known.value, texts, base)
            count = [[sum(s[0] == k for s in own) for own in base] for k in KINDS]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in count],
                pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]),
                pa.array([joined(b + m) for b, m in zip(base, more)]), pa.array(list(map(len, more)), pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redact_text(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; overlapping spans are replaced together, by the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs`` with all spans of their texts replaced and n_chars made good. Null texts stay null."""
    known = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in chunks(batches):
            texts = [t.decode("utf-8", "replace") for t in raw]
            base = [base_spans(t) for t in texts]
            more = added_spans(known.value, texts, base)
            clean = [redact_text(t, b + m) for t, b, m in zip(texts, base, more)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, pa.string(), mask=np.array(
                batch.column(at).is_null().to_pylist(), bool)).cast(batch.schema.field(at).type))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def op5_bilstm_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find(docs, fit(training_windows(docs.select("doc_id", "text"))))
