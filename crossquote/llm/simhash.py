"""SimHash fingerprints and their neighbours within a Hamming radius.

The terms of a text are its distinct pairs of neighbouring words (the word itself in a text of
one word). Each votes on every bit of the fingerprint, up or down by the bits of its
hash, with a whole weight that grows with the logarithm of its count; a bit is set if the votes for it
are above zero. A text without words has no votes and the fingerprint 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossquote.llm.words import WordTable, chunks, documents, mixed, word_hashes
from crossquote.session import materialize

BITS = 64
PAIRED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.int64()),
    ("edited", pa.int64()), ("following", pa.int64()), ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
PAIRED_SQL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint long, edited long, following long, "
              "part int, edge string, text string")


class Fingerprints:
    """Fingerprints of texts; the hashes of words are remembered while a task runs."""

    def __init__(self) -> None:
        self._table = WordTable(lambda words: [word_hashes(words)], [(np.uint64, None)])

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        numbers, offsets = self._table.number(texts)
        hashes = self._table[0][numbers]
        return np.array([self._vote(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.uint64).view(np.int64)

    @staticmethod
    def _vote(words: np.ndarray) -> np.uint64:
        if not len(words):
            return np.uint64(0)
        pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] if len(words) > 1 else words
        terms, counts = np.unique(mixed(pairs), return_counts=True)
        weights = np.rint(16 * (1 + np.log(counts)))
        bits = np.unpackbits(terms.view(np.uint8).reshape(-1, 8), axis=1)
        votes = 2 * (weights @ bits.astype(np.float64)) - weights.sum()
        return np.packbits(votes > 0).view(np.uint64)[0]


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal bits."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return 1 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def as_hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), BITS // 4, "0"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) per row of ``docs``; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints(texts))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def neighbours(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All pairs (a, b, distance) of different fingerprints at most ``radius`` bits apart, a < b.

    The bits are cut into ``blocks`` (radius + 3 by default). Of two such fingerprints
    blocks - radius blocks agree, so each choice of that many blocks is a table keyed by them, in
    which equal keys meet. A pair that meets in several tables counts in the first. Equal
    fingerprints are one: join the result back on the value for their documents. Nulls have none.
    """
    blocks = blocks or radius + 3
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges[:-1], edges[1:])]
    signed = lambda m: F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long")
    tables = [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    distinct = prints.where("fingerprint is not null").select("fingerprint").distinct()
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fingerprint").bitwiseAND(signed(m)).alias("key"))
                     for t, m in enumerate(tables)])
    filed = distinct.select("fingerprint", F.inline(keys))
    a = filed.select(F.col("fingerprint").alias("a"), "table", "key")
    b = filed.select(F.col("fingerprint").alias("b"), "table", "key")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(signed(m)) == 0, t) for t, m in enumerate(tables)])
    met = a.join(b, ["table", "key"]).where(F.col("a") < F.col("b"))
    return met.withColumn("distance", F.bit_count(differ)).where(
        (F.col("distance") <= radius) & (F.col("table") == first)).select("a", "b", "distance")


def edit(text: str, following: str) -> str:
    """The last half of the characters (rounded down) replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the document that follows, going down by id.

    Documents are range-sorted once; each task pairs neighbours as they stream by. A task sends
    the texts of its first and last document along, and those few open pairs are closed afterwards by joining
    the ends of neighbouring tasks. The first document follows the last. Equal ids stand in order of
    text hash and text, null ids last, null texts are empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, part = Fingerprints(), TaskContext.get().partitionId()
        held = None  # (doc_id, text, fingerprint) of the last row, which waits for its next one

        def ends(edge, doc_id, text, own):
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                (doc_id, None, None, own, None, None, part, edge, text), PAIRED)], schema=PAIRED)

        for batch, raw in chunks(batches, size=2 << 20):
            own, ids = prints(raw), batch.column("doc_id").to_pylist()
            texts = [t.decode("utf-8", "replace") for t in raw]
            if held is None:
                yield ends("first", ids[0], texts[0], own[0])
                rows = list(zip(ids, texts, own))
            else:
                rows = [held, *zip(ids, texts, own)]
            held = rows[-1]
            if len(rows) < 2:
                continue
            changed = [edit(t, nxt).encode() for (_, t, _), (_, nxt, _) in zip(rows, rows[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows[:-1]], pa.int64()), pa.array([len(r[1]) for r in rows[:-1]], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed]), pa.array([r[2] for r in rows[:-1]], pa.int64()),
                pa.array(prints(changed)), pa.array([r[2] for r in rows[1:]], pa.int64()),
                pa.array([part] * len(changed), pa.int32()), pa.nulls(len(changed), pa.string()),
                pa.nulls(len(changed), pa.string())], schema=PAIRED)
        if held is not None:
            yield ends("last", *held)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("tie", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), F.col("tie")]
    ranged = own.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("tie")
    rows = materialize(ranged.mapInArrow(run, PAIRED_SQL))
    return rows.where("edge is null").drop("part", "edge", "text").unionByName(_close(rows.where("edge is not null")))


def _close(ends: DataFrame) -> DataFrame:
    """Pairs of a task's last row and the next task's first; two rows per task, their texts only in the join."""
    parts = ends.where("edge = 'first'").select("part")
    every = Window.partitionBy(F.lit(0))
    following = parts.withColumn("next", F.coalesce(F.lead("part").over(every.orderBy("part")), F.min("part").over(every)))
    first = ends.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"),
                                                F.col("fingerprint").alias("following"))
    pairs = ends.where("edge = 'last'").drop("following").join(following, "part").join(first, "next")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints()
        for batch in batches:
            table = batch.to_pydict()
            changed = [edit(t, n).encode() for t, n in zip(table["text"], table["next_text"])]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(t) for t in table["text"]], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()), batch.column("fingerprint"),
                pa.array(prints(changed)), batch.column("following")],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited", "following"])

    return pairs.select("doc_id", "text", "fingerprint", "following", "next_text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint long, edited long, following long")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", "edited_sha256", as_hex("fingerprint").alias("fingerprint"),
        as_hex("edited").alias("edited_fingerprint"), likeness("fingerprint", "edited").alias("near_edited"),
        likeness("fingerprint", "following").alias("near_next"))
