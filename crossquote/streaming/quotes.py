"""Structured Streaming forms of the quote operators.

These keep their state in Spark's state store, which the watermark clears; ``latest_quotes`` keeps one row per
market for as long as it runs. Rules that walk a pair's rows in order are in ``carried``. Times must be
TIMESTAMP (not the zone-less type) for watermarks.
"""

from __future__ import annotations

from collections.abc import Callable
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STARTING = Lock()


def unique_events(stream: DataFrame, delay: str = "10 minutes", key: str = "event_id") -> DataFrame:
    """First arrival per id within the watermark; later or too late copies are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def latest_quotes(stream: DataFrame, value: str = "yes_price") -> DataFrame:
    """Latest value per market for update mode; older events never replace newer ones."""
    return stream.groupBy("platform", "market_id").agg(
        F.max("ts").alias("ts"), F.max_by(value, F.struct("ts", "seq")).alias(value))


def hourly_spreads(stream: DataFrame, pairs: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Spread per pair and hour: both legs are folded into one windowed aggregate.

    ``pairs`` is a static table; a tick is routed to every pair it belongs to.
    """
    routed = routed_ticks(stream.withWatermark("ts", delay), pairs)
    last = lambda s: F.max_by("yes_price", F.when(F.col("side") == s, F.struct("ts", "seq")))
    both = routed.groupBy(F.window("ts", "1 hour"), "pair_id").agg(
        last("a").alias("price_a"), last("b").alias("price_b"))
    return both.where(F.col("price_a").isNotNull() & F.col("price_b").isNotNull()).select(
        "pair_id", F.col("window.start").alias("hour"), (F.col("price_a") - F.col("price_b")).alias("spread"))


def routed_ticks(stream: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every tick once for each pair and side (``a`` or ``b``) it belongs to; ``pairs`` is a static table."""
    legs = None
    for side in "ab":
        keyed = pairs.select("pair_id", F.col(f"platform_{side}").alias("platform"),
                             F.col(f"id_{side}").alias("market_id"), F.lit(side).alias("side"))
        legs = keyed if legs is None else legs.unionByName(keyed)
    return stream.join(legs, ["platform", "market_id"])


def fresh_pairs(ticks: DataFrame, quotes: DataFrame, tolerance: str, delay: str = "10 minutes") -> DataFrame:
    """Each tick with every quote of its pair's other side from the last ``tolerance`` before it.

    Both inputs are streams of ``routed_ticks`` (pair_id, side, ts, seq, yes_price) with a watermark of ``delay``. The time range in the join
    condition lets Spark drop quotes older than watermark less tolerance, and ticks as soon as no quote
    can match them, from its state. A tick without a fresh quote gives no row: a stale quote is no quote.
    ``latest_fresh`` picks a tick's newest quote from the rows seen so far.
    """
    tick = ticks.select("pair_id", "side", "ts", "seq", F.col("yes_price").alias("price")).withWatermark("ts", delay)
    quote = quotes.select(F.col("pair_id").alias("_pair"), F.col("side").alias("_side"), F.col("ts").alias("quote_ts"),
                          F.col("seq").alias("quote_seq"), F.col("yes_price").alias("quote_price")).withWatermark("quote_ts", delay)
    met = tick.join(quote, (F.col("pair_id") == F.col("_pair")) & (F.col("side") != F.col("_side"))
                    & (F.col("quote_ts") <= F.col("ts")) & (F.col("quote_ts") >= F.col("ts") - F.expr(f"interval {tolerance}")))
    earlier = (F.col("quote_ts") < F.col("ts")) | (F.col("quote_seq") < F.col("seq"))
    return met.where(earlier).drop("_pair", "_side")


def latest_fresh(rows: DataFrame) -> DataFrame:
    """The newest quote of each tick and pair, with both prices by side; ``version`` orders it against those of other batches."""
    newest = rows.groupBy("pair_id", "seq").agg(
        F.first("side").alias("side"), F.first("ts").alias("ts"), F.first("price").alias("price"),
        F.max(F.struct(F.col("quote_ts").alias("ts"), F.col("quote_seq").alias("seq"), F.col("quote_price").alias("price"))).alias("_q"))
    on_a = F.col("side") == "a"
    side = lambda own: F.when(on_a == F.lit(own), F.col("price")).otherwise(F.col("_q.price"))
    return newest.select("pair_id", "seq", "ts", F.col("_q.ts").alias("quote_ts"), side(True).alias("price_a"),
                         side(False).alias("price_b"), F.struct("_q.ts", "_q.seq").alias("version"))


# ---------------------------------------------------------------- sinks

def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
               mode: str = "append"):
    """Start a query that hands every micro-batch to ``write`` and stops when input is used up."""
    conf, kind = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    with _STARTING:  # a query keeps the setting it started with, and two must not see each other's
        given = conf.get(kind)
        conf.set(kind, STATE_STORE)
        try:
            return (stream.writeStream.outputMode(mode).foreachBatch(write)
                    .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        finally:
            conf.set(kind, given)


def upsert_sink(table, prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch,
                version: str | None = None) -> Callable[[DataFrame, int], None]:
    """Keyed upsert of every micro-batch into a ``KeyedTable``; replays of a batch are harmless.

    With ``version`` a row only replaces one of a lower version, whichever batch comes first.
    """
    def write(batch: DataFrame, _: int) -> None:
        table.upsert(prepare(batch), version, oldest_first=version is not None)
    return write


def incremental_pairing(index, threshold: float, match: Callable[[DataFrame], DataFrame], found) -> Callable[[DataFrame, int], None]:
    """Match each batch of new questions against stored ones and each other, and store both.

    ``index`` is a ``CellIndex`` of the questions, ``found`` a ``KeyedTable`` of the pairs. ``match(questions)`` gets the batch and
    the stored questions within reach of ``threshold``, with a ``fresh`` flag, and returns the pairs that have a fresh side.
    """
    def write(batch: DataFrame, number: int) -> None:
        found.upsert(index.update(batch, number, threshold, match))
    return write
