"""Nearest neighbours: one query vector, or a whole table of query vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossquote.functions.vectors import hash_embed, metric
from crossquote.operators.simjoin import BLOCK_SCORES, _matrix, tile_side


def top_matches(corpus: DataFrame, query: Sequence[float], k: int = 10, by: str = "cosine",
                where=None, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """The k most similar rows with score and 1-based rank; ties go to the smaller id."""
    rows = corpus if where is None else corpus.where(where)
    probe = F.array(*[F.lit(float(x)) for x in query])
    best = (rows.withColumn("score", metric(by)(F.col(vector), probe))
            .orderBy(F.desc("score"), id_col).limit(k))
    # at most k rows remain, so ranking them in one place is cheap
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def text_matches(corpus: DataFrame, text: str, k: int = 10, dims: int = 128, **options) -> DataFrame:
    """Embed the text with the hash embedder, then ``top_matches``."""
    vector = corpus.sparkSession.range(1).select(hash_embed(F.lit(text), dims)).first()[0]
    return top_matches(corpus, vector, k, **options)


BESTS = 64  # columns of which the best one bounds the k-th score from below


def _shortlist(near: np.ndarray, k: int) -> np.ndarray:
    """Per row a score that k columns at least reach; -inf if there are not more than k."""
    wide = near.shape[1] // BESTS
    if wide > 2 * k:
        near = near[:, :wide * BESTS].reshape(len(near), wide, BESTS).max(axis=2)
    if near.shape[1] <= k:
        return np.full(len(near), -np.inf, near.dtype)
    return np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]


def _top_in_tile(k: int, cosine: bool):
    """Best k corpus rows of one tile for each query row of the tile: float32 product to shortlist, float64 dot to decide."""
    def work(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy()
        vectors = _matrix(table.column("vector")).astype(np.float64)
        if cosine:
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            vectors = vectors / np.where(norms > 0, norms, 1.0)[:, None]
        narrow = vectors.astype(np.float32)
        ids = np.asarray(table.column("id").to_pylist(), dtype=object)
        q, c = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        c = c[np.argsort(ids[c], kind="stable")]
        out_q, out_c, out_s = [], [], []
        others = narrow[c]
        wide_others = float(np.abs(others).sum(axis=1).max(initial=0.0))
        step = max(1, BLOCK_SCORES // max(1, len(c)))
        for start in range(0, len(q) if len(c) else 0, step):
            block = q[start:start + step]
            near = narrow[block] @ others.T
            if cosine:
                near = np.clip(near, 0.0, 1.0)
            slack = 1e-5 * max(1.0, float(np.abs(narrow[block]).max(initial=0.0)) * wide_others)
            i, j = np.nonzero(~(near < _shortlist(near, k)[:, None] - slack))
            scores = np.empty(len(i))
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                scores[part] = np.einsum("nd,nd->n", vectors[block[i[part]]], vectors[c[j[part]]])
            if cosine:
                scores = np.clip(scores, 0.0, 1.0)
            scores = np.round(scores, 12)
            order = np.lexsort((j, -scores, i))  # ids ascend with j
            i, j, scores = i[order], j[order], scores[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            out_q.append(ids[block[i[best]]])
            out_c.append(ids[c[j[best]]])
            out_s.append(scores[best])
        joined = lambda parts: np.concatenate(parts) if parts else []
        return pa.table({"query_id": pa.array(joined(out_q), pa.string()), "id": pa.array(joined(out_c), pa.string()),
                         "score": pa.array(joined(out_s), pa.float64())})
    return work


def batch_matches(queries: DataFrame, corpus: DataFrame, k: int, by: str = "cosine", *,
                  id_col: str = "id", vector: str = "vector", tile_rows: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): exact k nearest corpus rows for every query row.

    Both sides are dealt into bounded slices; a tile (query slice x corpus slice) keeps only k
    rows per query, so the merge sees k rows per query and slice. Ids compare as strings. Slices grow with
    the tables up to a bound (``simjoin.tile_side``), so that few copies are made.
    """
    n_q, n_c = queries.count(), corpus.count()
    q_slices, c_slices = (max(1, -(-n // (tile_rows or tile_side(n)))) for n in (n_q, n_c))
    salt = lambda n: F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = [F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector")]
    left = queries.select(salt(q_slices).alias("qs"), span(c_slices).alias("cs"), F.lit(True).alias("is_query"), *row)
    right = corpus.select(span(q_slices).alias("qs"), salt(c_slices).alias("cs"), F.lit(False).alias("is_query"), *row)
    parts = left.unionByName(right).groupBy("qs", "cs").applyInArrow(
        _top_in_tile(k, by != "dot"), "query_id string, id string, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

