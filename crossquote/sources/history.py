"""Price history laid out for its reads: bucketed and sorted by market.

A scan of one market reads the files of one bucket, and its row groups by their statistics; work per market and
joins of markets on their key need no shuffle of the history. The bucket count is fixed when the table is made;
choose it so that a bucket of the largest expected table is a few hundred megabytes. A bucket that grows beyond
that is still split by file size when one market is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "market_key"  # buckets are chosen, and pruned, by a single column


def market_key(platform: Column, market_id: Column) -> Column:
    return F.concat_ws("\x1f", platform, market_id.cast("string"))


class History:
    """A bucketed table of ticks (platform, market_id, ts, seq, yes_price, ...) with their ``market_key``."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 256):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def append(self, ticks: DataFrame) -> None:
        """Add ticks; each bucket is written by one task, so a batch makes at most ``buckets`` files."""
        keyed = ticks.withColumn(KEY, market_key(F.col("platform"), F.col("market_id")))
        (keyed.repartition(self.buckets, KEY).write.mode("append").format("parquet").option("path", self.path)
         .bucketBy(self.buckets, KEY).sortBy(KEY, "ts", "seq").saveAsTable(self.name))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def market(self, platform: str, market_id: str) -> DataFrame:
        """All ticks of one market; other buckets are not opened."""
        return self.read().where(F.col(KEY) == market_key(F.lit(platform), F.lit(market_id)))

    def hourly(self) -> DataFrame:
        """(market_key, platform, market_id, hour, price, points): last price per market and hour, without a shuffle.

        Joined on ``market_key`` it is not shuffled either.
        """
        return self.read().groupBy(KEY, "platform", "market_id", F.date_trunc("hour", "ts").alias("hour")).agg(
            F.max_by("yes_price", F.struct("ts", "seq")).alias("price"), F.count("*").alias("points"))
