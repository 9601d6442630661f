"""Vector arithmetic and hash embedding as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _comparable(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(a) == F.size(b))


def _products(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def norm(v) -> Column:
    return F.sqrt(_total(F.transform(_c(v), lambda x: x.cast("double") * x.cast("double"))))


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(_comparable(a, b), _total(_products(a, b))).otherwise(F.lit(0.0))


def cosine(a, b) -> Column:
    """Cosine clamped to [0, 1]; 0 for empty, unequal or zero vectors."""
    a, b = _c(a), _c(b)
    raw = F.try_divide(_total(_products(a, b)), norm(a) * norm(b))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return F.when(_comparable(a, b) & raw.isNotNull(), clamped).otherwise(F.lit(0.0))


def euclidean(a, b) -> Column:
    a, b = _c(a), _c(b)
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.when(_comparable(a, b), F.sqrt(_total(squares))).otherwise(F.lit(0.0))


def l2_normalise(v) -> Column:
    v = _c(v)
    # the norm is bound to a variable: inside the inner lambda it would be computed for every component
    return F.get(F.transform(F.array(norm(v)), lambda size: F.transform(
        v, lambda x: F.coalesce(F.try_divide(x.cast("double"), size), F.lit(0.0)))), F.lit(0))


METRICS = {"cosine": cosine, "dot": dot}


def metric(name: str):
    """Similarity by name; unknown names mean cosine."""
    return METRICS.get(name, cosine)


# Token alphabet of the hash embedder.
EMBED_TOKEN = r"[a-zA-Z0-9_#+.\-]+"


def embed_tokens(text) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(EMBED_TOKEN), F.lit(0))


def token_slot(token: Column, dims: int) -> Column:
    """Coordinate of a token: the first 32 bits of its SHA-256 modulo ``dims``."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dims


def token_weight(token: Column) -> Column:
    """Signed weight: sign by parity of the fifth digest byte, size by token length."""
    odd = F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 1
    size = F.lit(1.0) + F.length(token) / F.lit(20.0)
    return F.when(odd, -size).otherwise(size)


def hash_embed(text, dims: int = 128) -> Column:
    """Dense unit vector of a short text in one expression; zeros for blank text."""
    parts = F.transform(embed_tokens(text), lambda t: F.struct(
        token_slot(t, dims).alias("slot"), token_weight(t).alias("w")))
    # a value used inside a lambda is computed again in each call, so it is bound to a variable first
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    raw = once(parts, lambda own: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(
        F.filter(own, lambda p: p["slot"] == i), F.lit(0.0), lambda acc, p: acc + p["w"])))
    return F.when(F.coalesce(F.length(F.trim(_c(text))), F.lit(0)) > 0, once(raw, l2_normalise)) \
        .otherwise(F.array_repeat(F.lit(0.0), dims))


def hash_embed_sparse(df: DataFrame, id_col: str, text_col: str, dims: int = 128) -> DataFrame:
    """(id, slot, weight) rows for texts of any length; unit length per id.

    Tokens are counted per id before hashing, so repeated words are hashed once and the
    shuffle carries one row per distinct (id, token).
    """
    counted = (df.select(id_col, F.explode(embed_tokens(text_col)).alias("token"))
               .groupBy(id_col, "token").agg(F.count("*").alias("n")))
    summed = (counted.groupBy(id_col, token_slot(F.col("token"), dims).alias("slot"))
              .agg(F.sum(F.col("n") * token_weight(F.col("token"))).alias("raw")))
    # at most ``dims`` rows per id, so a window is enough
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return (summed.where(F.col(id_col).isNotNull()).withColumn("len", length)
            .select(id_col, "slot",
                    F.coalesce(F.try_divide("raw", "len"), F.lit(0.0)).alias("weight")))


def hash_embed_dense(df: DataFrame, id_col: str, text_col: str, dims: int = 128,
                     out: str = "vector") -> DataFrame:
    """Dense vectors assembled from the sparse rows (at most ``dims`` rows per id).

    Spark takes a vector made by ``transform`` for a few bytes and would broadcast the whole table, so the join is a merge.
    """
    packed = (hash_embed_sparse(df, id_col, text_col, dims).groupBy(id_col)
              .agg(F.map_from_entries(F.collect_list(F.struct("slot", "weight"))).alias("m")))
    # the map is bound to a variable: inside the lambda it would be built again for every component
    dense = F.get(F.transform(F.array("m"), lambda m: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(
        F.try_element_at(m, i.cast("long")), F.lit(0.0)))), F.lit(0))
    zeros = F.array_repeat(F.lit(0.0), dims)
    return (df.join(packed.select(id_col, dense.alias(out)).hint("merge"), id_col, "left")
            .withColumn(out, F.coalesce(out, zeros)))
