"""Language-model scoring from a log-frequency Bloom filter.

The filter holds quantised counts of words and word pairs, those seen once too: an entry whose count has
level q is put in once for each level 1 to q, and a query probes level after level until one is missing.
Errors are one-sided and rare, and no n-gram is stored.

    p(w | h) = (c*(h w) + weight * p(w)) / (c*(h) + weight),    p(w) = (c*(w) + 0.1) / (N + 0.1 (V + 1))

where c* is the count that a level stands for. Every token has one follower (the end of a text stands before its
first word), so c(h) is the total over all followers of h. Words and pairs go by 64-bit hashes.

The filter is built in segments, each by the task that has summed its counts, and sized by them; only the counts of words
are kept beside it. It is broadcast in shards of at most ``SHARD_BYTES``. A task cuts a group of texts into words once, gathers the different words
and pairs and looks them up shard by shard, with one shard in memory; texts are read once, however many shards there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossquote.llm.substrings import stored
from crossquote.llm.words import WordTable, chunks, documents, id_remainder, keep_batches_small, mixed, word_hashes

SEGMENTS = 1024
BITS_PER_ENTRY, PROBES = 12, 8  # a missing level is taken for present in about 0.3 % of cases
STEP = 1.3  # neighbouring levels differ by this factor, or by one where that is more
TOP = 64  # levels
WEIGHT = 50.0
SHARD_BYTES = 64 << 20
FREQUENT_WORDS = 1 << 23  # words whose exact counts are broadcast, at most: 128 MB
FLUSH = 1_000_000
TOKEN_BYTES, SLICE_KEYS = 3, 1 << 21  # a word makes two keys and has six bytes, about; a slice of the key space has so many keys
GROUP_BYTES = 8 << 20  # text whose different words and pairs are looked up together
LOT = 1 << 16  # codes probed at a time
FEWER = 0.7  # codes that missed a probe go on with the others until less than this share is left
SPREAD = np.uint64(0x9E3779B97F4A7C15)
ONE = np.uint64(1)
END = np.uint64(0x5851F42D4C957F2C)  # stands for the end of a text, and before its first word


def levels_of_counts() -> np.ndarray:
    """The smallest count of each level."""
    edges = [1]
    while len(edges) < TOP:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * STEP))))
    return np.array(edges)


EDGES = levels_of_counts()
#: The count that a level stands for; level 0 is none.
MEANT = np.concatenate([[0.0], np.sqrt(EDGES * np.append(EDGES[1:] - 1, EDGES[-1] * STEP))])


def unigrams(words: np.ndarray) -> np.ndarray:
    return words & ~ONE


def pairs(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of word pairs: half of each hash, odd where those of words are even."""
    return (before & np.uint64(0xFFFFFFFF00000000)) | (mixed(words) >> np.uint64(32)) | ONE


class Tokens:
    """Token hashes of texts and further features of each different word, remembered while a task runs.

    ``features`` gets hashes and returns arrays; the end of a text has features as a word has.
    """

    def __init__(self, features=lambda hashes: [], kinds: tuple = ()):
        self._table = WordTable(lambda words: [h := word_hashes(words), *features(h)], [(np.uint64, None), *((k, None) for k in kinds)])
        self._end = [np.array([END]), *features(np.array([END]))]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Offsets of the texts, and the hash and features of all their tokens, each text closed by its end."""
        numbers, offsets = self._table.number([t.lower() for t in texts])
        offsets = offsets + np.arange(len(offsets))
        inner = np.ones(offsets[-1], bool)
        inner[offsets[1:] - 1] = False
        out = []
        for kind, end in enumerate(self._end):
            values = np.full(offsets[-1], end[0])
            values[inner] = self._table[kind][numbers]
            out.append(values)
        return offsets, out


def shifted(values: np.ndarray) -> np.ndarray:
    """Of each token's predecessor; the first word of a text comes after an end, and so does the first of all."""
    return np.concatenate([values[-1:], values[:-1]])


def unmixed(values: np.ndarray) -> np.ndarray:
    """The values that ``mixed`` was given: each of its steps undone."""
    def apart(v: np.ndarray, shift: int) -> np.ndarray:
        return v ^ (v >> np.uint64(shift)) ^ (v >> np.uint64(2 * shift))

    v = apart(values, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    v = apart(v, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return apart(v, 30)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


PACKED = "segment int, slice long, gaps binary, wide binary, n_wide int, n binary"


def packed(keys: list[np.ndarray], n: list[np.ndarray], slices: int) -> pa.RecordBatch:
    """Summed counts of mixed keys, sorted: a row is one slice of the key space, its keys as differences of six bytes."""
    key, total = _sums(np.concatenate(keys), np.concatenate(n))
    bits = (slices - 1).bit_length()
    part = (key >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(key) else np.zeros(1, np.int64)
    gaps = np.diff(key, prepend=np.uint64(0))
    gaps[at[:-1]] = key[at[:-1]]
    wide = np.flatnonzero(gaps >> np.uint64(48))
    cuts = np.searchsorted(wide, at)
    six = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    total = total.astype("<u4").tobytes()
    rows = []
    for a, b, c, d in zip(at[:-1].tolist(), at[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
        where = wide[c:d]
        rows.append((int(part[a]) // (slices // SEGMENTS), int(part[a]), six[6 * a:6 * b],
                     (where - a).astype("<u4").tobytes() + gaps[where].astype("<u8").tobytes(), d - c, zlib.compress(total[4 * a:4 * b], 1)))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        zip(*rows) if rows else [[]] * 6, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))],
        ["segment", "slice", "gaps", "wide", "n_wide", "n"])


def unpacked(gaps: bytes, wide: bytes, n_wide: int, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    full = np.zeros((len(gaps) // 6, 8), np.uint8)
    full[:, :6] = np.frombuffer(gaps, np.uint8).reshape(-1, 6)
    values = full.reshape(-1).view("<u8").copy()
    values[np.frombuffer(wide[:4 * n_wide], "<u4")] = np.frombuffer(wide[4 * n_wide:], "<u8")
    return np.cumsum(values, dtype=np.uint64), np.frombuffer(zlib.decompress(n), "<u4").astype(np.int64)


def count_ngrams(training: DataFrame, slices: int) -> DataFrame:
    """Packed counts of all words and all pairs: tasks sum what they have read, up to FLUSH keys at a time."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys, n, held = Tokens(), [], [], 0
        for _, texts in chunks(batches):
            _, (words,) = table(texts)
            both = mixed(np.concatenate([unigrams(words), pairs(shifted(words), words)]))
            key, total = _sums(both, np.ones(len(both), np.int64))
            keys.append(key)
            n.append(total)
            held += len(key)
            if held > FLUSH:
                yield packed(keys, n, slices)
                keys, n, held = [], [], 0
        if held:
            yield packed(keys, n, slices)

    return training.select("text").mapInArrow(count, PACKED)


class Filter:
    """Some segments of the filter."""

    def __init__(self, segments: dict[int, bytes]):
        self._bits = np.frombuffer(b"".join(segments.values()), np.uint8)
        self._size = np.zeros(SEGMENTS, np.uint64)
        self._start = np.zeros(SEGMENTS, np.uint64)
        at = 0
        for segment, bits in segments.items():
            self._size[segment], self._start[segment] = 8 * len(bits), at
            at += len(bits)

    @staticmethod
    def segment(codes: np.ndarray) -> np.ndarray:
        return (mixed(codes) >> np.uint64(64 - (SEGMENTS - 1).bit_length())).astype(np.int64)

    @staticmethod
    def halves(codes: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of a code's level begin, and their distance."""
        base = mixed(codes + np.asarray(level).astype(np.uint64) * SPREAD)
        return base & np.uint64(0xFFFFFFFF), base >> np.uint64(32) | ONE

    @staticmethod
    def place(low: np.ndarray, high: np.ndarray, size: np.ndarray, probe: int) -> np.ndarray:
        """A bit below ``size`` (less than 2 ** 32): the share of the size that a 32-bit value is of all."""
        return ((low + np.uint64(probe) * high & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)

    def levels(self, codes: np.ndarray) -> np.ndarray:
        """The level of each code: probes go on while a level is present."""
        found = np.zeros(len(codes), np.uint8)
        segment = self.segment(codes)
        at = np.flatnonzero(self._size[segment])
        codes, size, start = codes[at], self._size[segment[at]], self._start[segment[at]]
        for level in range(1, TOP + 1):
            low, step = (x.astype(np.uint32) for x in self.halves(codes, level))
            present = None
            for probe in range(PROBES):
                place = (low * size) >> np.uint64(32)
                byte = self._bits[start + (place >> np.uint64(3))]
                hit = byte >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)
                present = hit if present is None else present & hit
                if probe == PROBES - 1 or np.count_nonzero(present) < FEWER * len(present):
                    left = np.flatnonzero(present)
                    at, codes, size, start = at[left], codes[left], size[left], start[left]
                    low, step, present = low[left], step[left], None
                low += step  # of 32 bits, as a place takes
            if not len(at):
                break
            found[at] = level
        return found


def filled(codes: np.ndarray, n: np.ndarray) -> bytes:
    """The bits of a segment with the levels of its codes."""
    top = np.searchsorted(EDGES, n, "right")
    each = np.repeat(codes, top)
    level = np.arange(1, len(each) + 1) - np.repeat(np.cumsum(top) - top, top)
    size = max(64, (len(each) * BITS_PER_ENTRY + 7) // 8 * 8)
    bits = np.zeros(size, bool)
    low, high = Filter.halves(each, level)
    for probe in range(PROBES):
        bits[Filter.place(low, high, np.uint64(size), probe)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def summed(counts: DataFrame) -> DataFrame:
    """(segment, bits) of the filter's parts and (key, n) of words, from packed counts, as one stored table.

    A segment is a range of mixed keys, so the task that sums its slices has all of its entries.
    """
    schema = pa.schema([("segment", pa.int32()), ("bits", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])

    def part(slices: list) -> tuple[np.ndarray, np.ndarray]:
        key, n = _sums(np.concatenate([k for k, _ in slices]), np.concatenate([n for _, n in slices]))
        return unmixed(key), n

    def done(segment: int, parts: list) -> Iterator[pa.RecordBatch]:
        key, n = (np.concatenate(x) for x in zip(*parts))
        words = key & ONE == 0
        none = int(words.sum())
        yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()), pa.array(key[words].view(np.int64)),
                                          pa.array(n[words])], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([filled(key, n)], pa.binary()),
                                          pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, slices, parts = None, [], []
        for batch in batches:
            for segment, number, *row in zip(*(batch.column(c).to_pylist() for c in ("segment", "slice", "gaps", "wide", "n_wide", "n"))):
                if own and own != (segment, number):
                    parts.append(part(slices))
                    slices = []
                    if own[0] != segment:
                        yield from done(own[0], parts)
                        parts = []
                own = segment, number
                slices.append(unpacked(*row))
        if own:
            yield from done(own[0], [*parts, part(slices)])

    return stored(counts.repartition("segment").sortWithinPartitions("segment", "slice").mapInArrow(
        merge, "segment int, bits binary, key long, n long"))


def build_filter(counts: DataFrame) -> DataFrame:
    """(segment, bits): the parts of the filter of (key, n), as a stored table."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n"))
            yield packed([mixed(key.view(np.uint64))], [np.minimum(n, EDGES[-1])], SEGMENTS)  # more has no level of its own

    return summed(counts.select("key", "n").mapInArrow(pack, PACKED)).where("bits is not null").select("segment", "bits")


def shards(table: DataFrame, most: int) -> list[list[int]]:
    """Segments in groups of at most ``most`` bytes together (one segment at least)."""
    out, held = [[]], 0
    for segment, size in sorted((r.segment, r.size) for r in table.select("segment", F.length("bits").alias("size")).collect()):
        if out[-1] and held + size > most:
            out.append([])
            held = 0
        out[-1].append(segment)
        held += size
    return out


class Shards:
    """The filter as broadcast variables, of which a task holds one at a time."""

    def __init__(self, spark: SparkSession, table: DataFrame, most: int):
        groups = shards(table, most)
        self._of = np.zeros(SEGMENTS, np.int32)
        for number, group in enumerate(groups):
            self._of[group] = number
        self._parts = [spark.sparkContext.broadcast(Filter({
            r.segment: r.bits for r in table.where(F.col("segment").isin(group)).toLocalIterator()})) for group in groups]

    def levels(self, codes: np.ndarray) -> np.ndarray:
        """Levels of codes, shard by shard. Of several shards none stays in memory.

        Codes go in order of their segment, so that their probes meet a small part of the filter at a time.
        """
        segment = Filter.segment(codes).astype(np.uint16)
        order = np.argsort(segment, kind="stable")
        sorted_codes, own = codes[order], self._of[segment[order]]
        cuts = np.searchsorted(own, np.arange(len(self._parts) + 1))
        levels = np.zeros(len(codes), np.uint8)
        for part, a, b in zip(self._parts, cuts[:-1], cuts[1:]):
            if a < b:
                levels[a:b] = self._in(part.value, sorted_codes[a:b])
                if len(self._parts) > 1:
                    del part._value  # it is read again from the executor's copy when needed
        found = np.empty_like(levels)
        found[order] = levels
        return found

    @staticmethod
    def _in(part: Filter, codes: np.ndarray) -> np.ndarray:
        """A probe has several numbers for each code, so many codes go one lot after the other."""
        lots = np.split(codes, range(LOT, len(codes), LOT))
        return np.concatenate([part.levels(lot) for lot in lots])


def grouped(slices: Iterator, size: int) -> Iterator[list]:
    """Slices of text together until they have ``size`` bytes."""
    held, total = [], 0
    for batch, texts in slices:
        held.append((batch, texts))
        total += sum(map(len, texts))
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def score_texts(docs: DataFrame, training: DataFrame, weight: float = WEIGHT, shard_bytes: int = SHARD_BYTES,
                frequent: int = FREQUENT_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    Both tables have doc_id and text, ``docs`` also held_out. A null or empty text is its end alone. Without
    training texts every word is unknown. ``base_score`` takes exact counts: those of frequent words (each more than
    a 1 / ``frequent`` of all, so that many at most) are broadcast, the others joined. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    keep_batches_small(spark)
    size = training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(SEGMENTS, 1 << (size // (TOKEN_BYTES * SLICE_KEYS)).bit_length())
    counts = summed(count_ngrams(training, slices))
    words = counts.where("key is not null").select("key", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    table = counts.where("bits is not null").select("segment", "bits")
    floor = n / frequent
    top = words.where(F.col("n") > floor).toArrow()
    order = np.argsort(top.column("key").to_numpy().view(np.uint64))
    head = spark.sparkContext.broadcast((top.column("key").to_numpy().view(np.uint64)[order], top.column("n").to_numpy()[order]))
    below = n + 0.1 * (v + 1)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    parts = Shards(spark, table, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, exact = head.value

        def counted(hashes: np.ndarray) -> list[np.ndarray]:
            """Exact counts of frequent words, 0 for others."""
            place = np.minimum(np.searchsorted(known, unigrams(hashes)), max(len(known) - 1, 0))
            return [np.where(known[place] == unigrams(hashes), exact[place], 0) if len(known) else np.zeros(len(hashes), np.int64)]

        table = Tokens(counted, (np.int64,))
        at = TaskContext.get().partitionId() << 33

        def scored(batch, raw, offsets, words, seen, single, total, pair) -> Iterator[pa.RecordBatch]:
            """Sums of texts, and their words whose exact counts are elsewhere."""
            nonlocal at
            single, total, pair = MEANT[single], MEANT[total], MEANT[np.minimum(pair, np.minimum(total, single))]
            p = (pair + weight * (single + 0.1) / below) / (total + weight)
            key, inside = unigrams(words), seen > 0
            value = np.where(inside, np.log10((seen + 0.1) / below), 0.0)
            ids = np.arange(at, at + len(raw))
            at += len(raw)
            n_tokens = np.diff(offsets)
            add = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731  each text has its END at least
            rows = np.repeat(np.arange(len(raw)), n_tokens)[~inside]
            rare = key[~inside]
            order = np.lexsort((rare, rows))
            rows, rare = rows[order], rare[order]
            first = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (rows[1:] != rows[:-1])]) if len(rare) else np.zeros(0, int)
            many = np.diff(np.r_[first, len(rare)])
            blank = pa.nulls(len(first), pa.float64())
            of_docs = [pa.array(mixed(ids.astype(np.uint64)).view(np.int64)), pa.array(ids), pa.array(np.zeros(len(raw), np.int64)),
                       batch.column("doc_id"), batch.column("held_out"), pa.array(n_tokens), pa.array(add(inside.astype(np.int64))),
                       pa.array(add(value)), pa.array(add(np.log10(p)))]
            of_words = [pa.array(rare[first].view(np.int64)), pa.array(ids[rows[first]]), pa.array(many),
                        pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.bool_()), pa.nulls(len(first), pa.int64()),
                        pa.nulls(len(first), pa.int64()), blank, blank]
            for columns in (of_docs, of_words):
                yield pa.RecordBatch.from_arrays(columns, ["key", "row", "times", "doc_id", "held_out", "n_tokens", "known", "base", "score"])

        for group in grouped(chunks(batches), group_bytes):
            tokens, codes = [], []
            for batch, raw in group:
                offsets, (words, seen) = table(raw)
                # the first word of a slice follows the end that closes it
                own, place = np.unique(np.concatenate([unigrams(words), pairs(shifted(words), words)]), return_inverse=True)
                tokens.append((batch, raw, offsets, words, seen, place.astype(np.uint32)))
                codes.append(own)
            levels = np.split(parts.levels(np.concatenate(codes)), np.cumsum([len(c) for c in codes])[:-1])
            for (batch, raw, offsets, words, seen, place), level in zip(tokens, levels):
                single, pair = np.split(level[place], 2)
                yield from scored(batch, raw, offsets, words, seen, single, shifted(single), pair)

    found = texts.mapInArrow(run, "key long, row long, times long, doc_id long, held_out boolean, n_tokens long, "
                                  "known long, base double, score double")
    rare = words.where(F.col("n") <= floor).select("key", F.col("n").alias("seen"))
    joined = found.join(rare, "key", "left")
    value = F.col("times") * F.log10((F.coalesce("seen", F.lit(0)) + 0.1) / F.lit(below))
    known = F.coalesce("known", F.lit(0)) + F.when(F.col("seen").isNotNull(), F.col("times")).otherwise(0)
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(known).alias("n_known"), F.sum(F.coalesce("base", F.lit(0.0)) + value).alias("base_score"),
        F.max("score").alias("score")).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", id_remainder(10) == 0)
    return score_texts(docs, docs.where("not held_out"))
