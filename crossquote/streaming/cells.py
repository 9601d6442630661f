"""A stored index of vectors by cell, for pairing new vectors with all earlier ones.

Pivots are chosen once, far apart in a bounded part of the first batch, and stored. Every vector is filed on disk under the cell of its nearest
pivot. Per batch and cell a row of statistics has the angle that covers the cell's vectors and their largest norm, so a
new vector x can only match a vector of a cell if

    |x| * maxnorm(cell) * cos(max(0, angle(x, pivot) - radius(cell))) >= threshold

A batch reads the cells that this leaves for one of its rows and no others; the pairs are those of a comparison with
everything. An updated vector's old place is noted, so that it is not met again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossquote.operators import simjoin
from crossquote.session import materialize
from crossquote.sources.upserts import KeyedTable

SAMPLE = 16  # rows looked at for each pivot
STATS = "cell int, radius double, reach double, n long"


class CellIndex:
    """Vectors (key columns, ``vector``, ...) in cells below ``path``; ``pivots`` bounds the cells, and so what the driver holds."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], pivots: int = 256, buckets: int = 64):
        self.spark, self.path, self.keys, self.wanted = spark, path.rstrip("/"), keys, min(pivots, simjoin.MAX_PIVOTS)
        self.places = KeyedTable(spark, f"{self.path}/places", keys, buckets)

    def _read(self, part: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(f"{self.path}/{part}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise

    def _pivots(self, batch: DataFrame) -> np.ndarray:
        stored = self._read("pivots")
        if stored is None:
            chosen = self._far_apart(batch)
            self.spark.createDataFrame([(v.tolist(),) for v in chosen], "vector array<double>").coalesce(1).write.parquet(f"{self.path}/pivots")
            return chosen
        return np.array(sorted(r[0] for r in stored.collect()))  # at most ``pivots`` rows

    def _far_apart(self, batch: DataFrame) -> np.ndarray:
        """Unit vectors, each the farthest in angle from those before it, of ``SAMPLE`` rows for each that is wanted."""
        rows = batch.orderBy(F.xxhash64(*self.keys), *self.keys).limit(SAMPLE * self.wanted).select("vector").collect()
        points = np.array([r[0] for r in rows], float)
        norms = np.sqrt((points ** 2).sum(1))
        points = points[norms > 0] / norms[norms > 0, None]
        if not len(points):
            return np.eye(1, len(rows[0][0]))
        chosen, near = [points[0]], points @ points[0]
        while len(chosen) < self.wanted and near.min() < 1 - 1e-9:
            chosen.append(points[int(near.argmin())])
            near = np.maximum(near, points @ chosen[-1])
        return np.array(sorted(map(tuple, chosen)))

    def _stats(self, pivots: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
        radius, reach = np.full(len(pivots), -1.0), np.zeros(len(pivots))
        stats = self._read("stats", STATS + ", batch int")
        if stats is not None:
            earlier = stats.where(F.col("batch") < before).groupBy("cell").agg(F.max("radius"), F.max("reach"))
            for cell, angle, norm in earlier.collect():  # at most a row per pivot
                radius[cell], reach[cell] = angle, norm
        return radius, reach

    def placed(self, rows: DataFrame, pivots: np.ndarray) -> DataFrame:
        """Rows with ``cell``, ``angle`` to its pivot and ``norm``."""
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                angles, norms = simjoin._angles(simjoin._matrix(batch.column("vector")), pivots)
                cell = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(
                    angles[np.arange(len(cell)), cell]), pa.array(norms)], [*names, "cell", "angle", "norm"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{schema}, cell int, angle double, norm double")

    def visited(self, rows: DataFrame, pivots: np.ndarray, threshold: float, before: int) -> list[int]:
        """Cells that a row of the batch may match in: at most ``pivots`` numbers."""
        radius, reach = self._stats(pivots, before)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                angles, norms = simjoin._angles(simjoin._matrix(batch.column("vector")), pivots)
                best = np.cos(np.minimum(np.maximum(0.0, angles - radius - 1e-6), np.pi)) * norms[:, None] * reach
                near = (best >= threshold - 1e-6) if threshold > 0 else np.ones_like(angles, bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero((near & (radius >= 0)).any(0)), pa.int32())], ["cell"])

        return sorted(r[0] for r in rows.select("vector").mapInArrow(run, "cell int").distinct().collect())

    def stored(self, cells: list[int], before: int) -> DataFrame | None:
        """Current vectors of these cells from earlier batches; other cells' files are not listed for reading."""
        vectors = self._read("vectors")
        if vectors is None or not cells:
            return None
        rows = vectors.where(F.col("cell").isin(cells) & (F.col("batch") < before))
        gone = self._read("gone")
        if gone is not None:
            gone = gone.where(F.col("by") <= before).select(*self.keys, "cell", F.col("old").alias("batch"))
            rows = rows.join(gone, [*self.keys, "cell", "batch"], "left_anti")
        return rows

    def update(self, batch: DataFrame, number: int, threshold: float, match) -> DataFrame:
        """File a batch and return ``match`` of it (``fresh``) with what its bounds leave of the rest. A batch may be run again."""
        rows = materialize(batch.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).dropDuplicates(self.keys))
        if rows.isEmpty():
            return match(rows.withColumn("fresh", F.lit(True)))
        pivots = self._pivots(rows)
        known = self.places.read()
        if known is not None:
            moved = known.where(F.col("batch") < number).join(rows.select(*self.keys), self.keys, "left_semi").select(
                *self.keys, "cell", F.col("batch").alias("old"), F.lit(number).alias("by"))
            moved.write.mode("overwrite").parquet(f"{self.path}/gone/batch={number}")
        old = self.stored(self.visited(rows, pivots, threshold, number), number)
        both = rows.withColumn("fresh", F.lit(True))
        if old is not None:
            both = both.unionByName(old.select(*rows.columns).withColumn("fresh", F.lit(False)))
        pairs = materialize(match(both))
        placed = materialize(self.placed(rows, pivots))
        placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.max("norm").alias("reach"), F.count("*").alias("n")).write.mode(
            "overwrite").parquet(f"{self.path}/stats/batch={number}")
        filed = placed.drop("angle", "norm").withColumn("batch", F.lit(number))
        (filed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("cell", "batch").parquet(f"{self.path}/vectors"))
        self.places.upsert(filed.select(*self.keys, "cell", "batch"), "batch", oldest_first=True)
        return pairs
