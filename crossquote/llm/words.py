"""Helpers the operators share: Arrow batches of texts, words, and per-word features.

A word is a maximal run of bytes outside space, tab, LF, VT, FF and CR. ``bytes.split()``
cuts at exactly these six, so texts stay UTF-8 bytes and are never decoded to find words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20  # text that is worked on at a time inside a task
CACHE_WORDS = 250_000  # words whose features a task remembers
BATCH_ROWS = 1_000  # rows that a task hands to Python at once; ten thousand texts take up to 100 MB on either side
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keep_batches_small(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most, or fewer if the session has it so. A result is read later, so the session keeps them."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def id_remainder(mod: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
           size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``size`` bytes of text each, and their texts (null: empty).

    ``text`` names a column of texts, or of structs with a field of that name. One text is never
    cut: a slice holds at least one row, however long.
    """
    for batch in batches:
        values = batch.column(text)
        if pa.types.is_struct(values.type):
            values = values.field("text")
        if pa.types.is_string(values.type):
            values = values.cast(pa.binary())
        lengths = pc.fill_null(pc.binary_length(values), 0).to_pylist()
        start, held = 0, 0
        for at, length in enumerate([*lengths, None]):
            if at == len(lengths) or held and held + length > size:
                if at > start:  # only the texts of a slice become Python objects
                    yield batch.slice(start, at - start), [v or b"" for v in values.slice(start, at - start).to_pylist()]
                start, held = at, 0
            held += (length or 0) + 64


class _Numbers(dict):
    """Gives each unknown word the next number."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Rows:
    """A growing array of rows."""

    def __init__(self, dtype, width: int | None = None):
        self._data = np.empty((1024,) if width is None else (1024, width), dtype)
        self._size = 0

    def extend(self, rows: np.ndarray) -> None:
        need = self._size + len(rows)
        if need > len(self._data):
            grown = np.empty((max(need, 2 * len(self._data)), *self._data.shape[1:]), self._data.dtype)
            grown[:self._size] = self._data[:self._size]
            self._data = grown
        self._data[self._size:need] = rows
        self._size = need

    @property
    def values(self) -> np.ndarray:
        return self._data[:self._size]


class WordTable:
    """Numbers words and keeps the features of those seen; forgets all between chunks once it is full.

    ``features`` gets the new words of a chunk and returns one array per feature; ``spec`` lists
    the (dtype, width) of each. The memory is bounded by ``limit`` words plus those of one chunk.
    """

    def __init__(self, features: Callable[[list[bytes]], Sequence[np.ndarray]], spec, limit: int = CACHE_WORDS):
        self._features, self._spec, self._limit = features, spec, limit
        self._clear()

    def _clear(self) -> None:
        self._numbers, self._rows = _Numbers(), [Rows(d, w) for d, w in self._spec]

    def number(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and the offsets at which each text starts (one more at the end)."""
        if len(self._numbers) > self._limit:
            self._clear()
        known, give = len(self._numbers), self._numbers.__getitem__
        found = [np.fromiter(map(give, words), np.int64, len(words)) for words in map(bytes.split, texts)]
        offsets = np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(f) for f in found], out=offsets[1:])
        if len(self._numbers) > known:
            # a dict keeps the order in which its words came, so the new ones are its last
            new = list(self._numbers)[known:] if known else list(self._numbers)
            for rows, values in zip(self._rows, self._features(new), strict=True):
                rows.extend(values)
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), offsets

    def __getitem__(self, feature: int) -> np.ndarray:
        return self._rows[feature].values


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


class RaggedTable:
    """Per-word lists of numbers, such as token ids, behind a WordTable."""

    def __init__(self, lists: Callable[[list[bytes]], list[list[int]]], limit: int = CACHE_WORDS):
        self._lists = lists
        self.words = WordTable(self._new, [(np.int64, None), (np.int32, None)], limit)
        self._flat = Rows(np.int32)

    def _new(self, words: list[bytes]):
        if not len(self.words[0]):
            self._flat = Rows(np.int32)
        lists = self._lists(words)
        lengths = np.fromiter(map(len, lists), np.int32, len(lists))
        starts = len(self._flat.values) + np.cumsum(lengths, dtype=np.int64) - lengths
        self._flat.extend(np.fromiter((x for one in lists for x in one), np.int32, int(lengths.sum())))
        return starts, lengths

    def expand(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All list entries of the numbered words in a row, and how many each word has."""
        lengths = self.words[1][numbers]
        return self._flat.values[ragged(self.words[0][numbers], lengths)], lengths


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), wrapping around."""
    v = np.asarray(values).astype(np.uint64)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


FEW_ROWS = 100_000  # narrow rows that are sent to all tasks, at most


def few(table: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A written table of few rows as one to broadcast, so that a hot key on the other side stays where it is; a longer one as it is."""
    return F.broadcast(table) if table.count() <= most else table
