"""Keyed writes on plain Parquet: upsert, delete, append, vector collections.

Rows are filed under a hash bucket of their key. A write reads, merges and replaces only the
buckets its batch touches (dynamic partition overwrite), so its cost follows the batch, and
running the same batch again gives the same table. A delete writes tombstone rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossquote.functions.vectors import hash_embed
from crossquote.session import materialize


def merge_latest(current: DataFrame | None, incoming: DataFrame, keys: Sequence[str],
                 version: str | None = None, oldest_first: bool = False) -> DataFrame:
    """Keyed union: incoming rows replace current ones; within the batch the highest version wins.

    With ``oldest_first`` the highest version wins over current rows as well, so batches may come in any order.
    One aggregate with map-side combine; no window over a key's rows.
    """
    rank = F.col(version) if version else F.lit(0)
    rows = incoming.select(F.struct(*incoming.columns).alias("_r"), F.lit(1).alias("_new"),
                           rank.alias("_ver"), F.xxhash64(*incoming.columns).alias("_tie"), *keys)
    if current is not None:
        old = current.select(*incoming.columns)
        rows = old.select(F.struct(*incoming.columns).alias("_r"), F.lit(0).alias("_new"),
                          rank.alias("_ver"), F.lit(0).cast("long").alias("_tie"), *keys).unionByName(rows)
    order = ["_ver", "_new", "_tie"] if oldest_first else ["_new", "_ver", "_tie"]
    newest = rows.groupBy(*keys).agg(F.max_by("_r", F.struct(*order)).alias("_r"))
    return newest.select("_r.*")


def remove_keys(current: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return current.join(doomed.select(*keys).distinct(), list(keys), "left_anti")


def deleted_count(current: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    hit = current.join(doomed.select(*keys).distinct(), list(keys), "left_semi")
    return hit.agg(F.count("*").alias("deleted"))


def update_vectors(questions: DataFrame, vectors: DataFrame, key: str = "market_id",
                   stamp: Column | None = None) -> DataFrame:
    """New vectors on existing rows only; null vectors are ignored."""
    fresh = vectors.where(F.col("vector").isNotNull()).select(
        F.col(key), F.col("vector").cast("array<float>").alias("_v"))
    joined = questions.join(fresh, key, "left")
    out = joined.withColumn("vector", F.coalesce("_v", F.col("vector").cast("array<float>")))
    if stamp is not None:
        old = F.col("vector_embedded_at") if "vector_embedded_at" in questions.columns else F.lit(None)
        out = out.withColumn("vector_embedded_at", F.when(F.col("_v").isNotNull(), stamp).otherwise(
            old.cast("timestamp")))
    return out.drop("_v")


def check_dimensions(vectors: DataFrame, column: str = "vector", current: DataFrame | None = None) -> int | None:
    """Common vector length of a batch (and an existing table); raises when lengths differ."""
    def bounds(df):
        return df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    low, high = bounds(vectors)
    if low != high:
        raise ValueError(f"vectors in the batch differ in length: {low} to {high}")
    if current is not None and low is not None:
        old_low, old_high = bounds(current)
        if old_low is not None and (old_low != low or old_high != low):
            raise ValueError(f"batch vectors have length {low}, stored ones {old_low}")
    return low


BUCKET, GONE = "_bucket", "_deleted"


class KeyedTable:
    """A Parquet table with keyed upsert and delete; ``buckets`` must stay fixed for a path.

    A bucket is rewritten by up to ``writers`` tasks, so a large one is not the work of a single task.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64, writers: int = 8):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets
        self.writers = writers

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def read(self) -> DataFrame | None:
        stored = self._stored()
        return None if stored is None else stored.where(~F.col(GONE)).drop(BUCKET, GONE)

    def _apply(self, rows: DataFrame, version: str | None = None, oldest_first: bool = False) -> None:
        # read twice below, and its input may be a whole join
        filed = materialize(rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")))
        stored = self._stored()
        if stored is not None:
            touched = [r[0] for r in filed.select(BUCKET).distinct().collect()]  # at most ``buckets``
            stored = stored.where(F.col(BUCKET).isin(touched))
        merged = merge_latest(stored, filed, self.keys, version, oldest_first)
        # The merge reads the folder it replaces, so it is written elsewhere first.
        frozen = materialize(merged.repartition(F.col(BUCKET), F.pmod(F.hash(*self.keys), F.lit(self.writers))))
        (frozen.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET).parquet(self.path))

    def upsert(self, incoming: DataFrame, version: str | None = None, oldest_first: bool = False) -> None:
        self._apply(incoming.withColumn(GONE, F.lit(False)), version, oldest_first)

    def delete(self, doomed: DataFrame) -> int:
        """Remove rows by key; returns how many existed."""
        current = self.read()
        if current is None:
            return 0
        hit = materialize(current.join(doomed.select(*self.keys).distinct(), self.keys, "left_semi"))
        n = hit.count()
        if n:
            self._apply(hit.withColumn(GONE, F.lit(True)))
        return n


class VectorCollection(KeyedTable):
    """Vectors (namespace, id, vector, text, metadata) with one vector length per namespace."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path, ["namespace", "id"], buckets)

    def upsert(self, incoming: DataFrame, version: str | None = None, oldest_first: bool = False) -> None:
        current = self.read()
        length = F.size("vector")
        sizes = incoming.groupBy("namespace").agg(F.min(length).alias("lo"), F.max(length).alias("hi"))
        clash = F.col("lo") != F.col("hi")
        if current is not None:
            sizes = sizes.join(current.groupBy("namespace").agg(F.max(length).alias("have")),
                               "namespace", "left")
            clash = clash | F.coalesce(F.col("lo") != F.col("have"), F.lit(False))
        bad = [r[0] for r in sizes.where(clash).select("namespace").limit(5).collect()]
        if bad:
            raise ValueError(f"vector length mismatch in namespaces {bad}")
        super().upsert(incoming.withColumn("vector", F.col("vector").cast("array<float>")), version, oldest_first)

    def add_texts(self, texts: DataFrame, dims: int) -> None:
        """Texts (namespace, id, text, ...) with their hash embeddings of ``dims`` components as vectors."""
        super().upsert(texts.withColumn("vector", hash_embed(F.coalesce("text", F.lit("")), dims).cast("array<float>")))

    def counts(self) -> DataFrame | None:
        current = self.read()
        return None if current is None else namespace_counts(current)

    def clear(self, namespace: str | None = None) -> int:
        current = self.read()
        if current is None:
            return 0
        return self.delete(current if namespace is None else current.where(F.col("namespace") == namespace))


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Plain append (snapshots)."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def namespace_counts(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("namespace").agg(F.count("*").alias("n"))


def write_summary(row: DataFrame, path: str) -> None:
    """One-row summary as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)
