"""Scores of named pairs of vectors, without joining a vector to every pair.

Ids of either side fall into blocks by hash, and a pair into the tile of its two blocks. A block's vectors are sent to the
tiles of its row (or column), so a vector is copied once per block and not once per pair. A tile with many pairs, as
of a pair that is named very often, is cut into slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIRS_PER_TILE = 500_000
VECTORS_PER_BLOCK = 32_768
CHUNK = 1 << 16

def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components by rows of the place in the vector, sizes with -1 for null, whether a component is null)."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(missing, -1, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()
    holes = flat.is_null().to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    lengths = np.maximum(sizes, 0)
    row = np.repeat(np.arange(len(sizes)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((int(lengths.max(initial=0)), len(sizes)), np.float32)
    out[place, row] = values
    return out, sizes, np.bincount(row, holes, len(sizes)) > 0


def _meet(asked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``asked``, place in ``ids``, which ascend) of all equal ones."""
    first = np.searchsorted(ids, asked, "left")
    times = np.searchsorted(ids, asked, "right") - first
    at = np.repeat(np.arange(len(asked)), times)
    return at, np.repeat(first, times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)


def _score_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).combine_chunks()
    has_a, has_b = (table.column(c).is_valid().to_numpy() for c in "ab")  # a vector has one id, a pair both

    def rows(own: np.ndarray, key: str):
        part = table.take(pa.array(np.flatnonzero(own)))
        part = part.take(pa.array(np.argsort(part.column(key).to_numpy(), kind="stable"))).combine_chunks()
        vectors = part.column("vector").combine_chunks()
        return part.column(key).to_numpy(), part.column("tag").combine_chunks(), _padded(vectors)

    ids_a, label_a, (vec_a, size_a, hole_a) = rows(has_a & ~has_b, "a")
    ids_b, label_b, (vec_b, size_b, hole_b) = rows(has_b & ~has_a, "b")
    pairs = table.take(pa.array(np.flatnonzero(has_a & has_b))).combine_chunks()
    a, b, tag = pairs.column("a").to_numpy(), pairs.column("b").to_numpy(), pairs.column("tag").combine_chunks()
    depth = min(len(vec_a), len(vec_b))
    for start in range(0, len(a), CHUNK):
        at, i = _meet(a[start:start + CHUNK], ids_a)
        again, j = _meet(b[start:start + CHUNK][at], ids_b)
        at, i = at[again], i[again]
        for lo in range(0, len(at), CHUNK):
            x, y = i[lo:lo + CHUNK], j[lo:lo + CHUNK]
            total = np.zeros(len(x))
            for d in range(depth):  # summed in the order of the components, as ``vectors.dot`` does
                total += vec_a[d][x].astype(np.float64) * vec_b[d][y]
            fit = (size_a[x] == size_b[y]) & (size_a[x] > 0)
            score = pa.array(np.where(fit, total, 0.0), mask=fit & (hole_a[x] | hole_b[y]))
            same = pc.equal(label_a.take(pa.array(x)), label_b.take(pa.array(y)))
            yield pa.RecordBatch.from_arrays([tag.take(pa.array(at[lo:lo + CHUNK] + start)), score, same], ["tag", "score", "is_match"])


def scored_pairs(asked: DataFrame, vectors: DataFrame, tag: str, id_col: str = "market_id", label: str = "label",
                 vector: str = "vector") -> DataFrame:
    """(tag, score, is_match) per row of ``asked`` (tag, a, b: whole-number ids) and rows of ``vectors`` with these ids.

    As an inner join on either side, then ``vectors.dot`` and the comparison of the labels; ids that are null meet nothing.
    """
    pairs, known = asked.where("a IS NOT NULL AND b IS NOT NULL"), vectors.where(F.col(id_col).isNotNull())
    blocks = max(1, math.ceil(known.count() / VECTORS_PER_BLOCK), math.ceil(math.sqrt(pairs.count() / PAIRS_PER_TILE)))
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(blocks)).cast("int")
    tile = (block("a") * blocks + block("b")).alias("tile")
    loads = pairs.groupBy(tile).agg(F.count("*").alias("n"))  # at most blocks x blocks rows
    slices = F.broadcast(loads.select("tile", F.ceil(F.col("n") / PAIRS_PER_TILE).cast("int").alias("slices")))
    null = lambda kind: F.lit(None).cast(kind)

    place = F.col("tile").cast("long") * (1 << 31) + F.col("slice")  # few columns: Spark sizes up each of them row by row

    def sent(n: int) -> DataFrame:
        own = F.floor(F.col("tile") / blocks).cast("int") if n == 1 else F.col("tile") % blocks
        to = F.broadcast(slices.select("tile", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), own.alias("_block")))
        key: Column = F.col(id_col).cast("long")
        rows = known.withColumn("_block", block(id_col)).join(to, "_block")
        return rows.select(place.alias("place"), *[(key if n == k else null("long")).alias(c) for k, c in ((1, "a"), (2, "b"))],
                           F.col(label).cast("string").alias("tag"), F.col(vector).cast("array<float>").alias("vector"))

    dealt = pairs.withColumn("tile", tile).join(slices, "tile").withColumn("slice", F.floor(F.rand(7) * F.col("slices")).cast("int")).select(
        place.alias("place"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col(tag).cast("string").alias("tag"),
        null("array<float>").alias("vector"))
    routed = dealt.unionByName(sent(1)).unionByName(sent(2))
    found = routed.groupBy("place").applyInArrow(_score_tile, "tag string, score double, is_match boolean")
    return found.select(F.col("tag").cast(dict(asked.dtypes)[tag]).alias(tag), "score", "is_match")
