"""Per-key rules over a stream, one micro-batch at a time, with carried state.

Inside a micro-batch the batch operators do the work: rows are range-sorted into runs with one carry per run, so a pair
with most of the rows is many tasks and no row is visited in Python. Between batches a state table
carries one row per key. The low-water mark of a batch, the highest time seen so far less ``delay``, plays
the part of event-time timers: it expires open episodes without a further row of their pair, and it removes keys
that can no longer matter.

A batch that is run again gives the same results: it reads the state that the batch before it left, and
replaces its own. State lives in two slots that take turns, so its size follows the live keys, not the batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from crossquote.plans import decay
from crossquote.session import materialize

Sink = Callable[[DataFrame, int], None]


def numbered_folder(path: str) -> Sink:
    """A sink with one folder per batch; a batch that is run again replaces its own."""
    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return write


class CarriedState:
    """A table of one row per key that micro-batch n reads as batch n - 1 left it."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _slot(self, number: int) -> str:
        return f"{self.path}/slot={number % 2}"

    def before(self, number: int) -> DataFrame:
        if number == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._slot(number - 1))

    def after(self, number: int) -> DataFrame:
        return self.before(number + 1)

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(self._slot(number))


# ---------------------------------------------------------------- late rows

class LateSplit:
    """Splits every micro-batch into on-time and late rows; none is lost.

    A row is late when an earlier batch had a row of its key more than ``delay_seconds`` after it. Both parts go to their sinks,
    late ones with ``behind_seconds``. The counts are taken while the rows pass by and written
    per batch, also when they are zero. A null time or key part counts as a value of its own: null times are late,
    with an unknown delay.
    """

    COUNTS = "on_time long, late long"

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], delay_seconds: float, on_time: Sink, late: Sink):
        """``keys`` maps key columns to their types; state and counts live below ``path``."""
        self.spark, self.keys, self.delay = spark, list(keys), int(delay_seconds * 1_000_000)
        schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", clock timestamp"
        self.clock, self.counts = CarriedState(spark, f"{path}/clock", schema), f"{path}/counts"
        self.on_time, self.late = on_time, late

    def __call__(self, batch: DataFrame, number: int) -> None:
        clock = self.clock.before(number)
        same = F.lit(True)
        for key in self.keys:
            same = same & batch[key].eqNullSafe(clock[key])
        ahead = batch.join(clock, same, "left").drop(*[clock[k] for k in self.keys])
        behind = F.unix_micros("clock") - F.unix_micros("ts")
        passed = Observation()
        flagged = ahead.withColumn("_late", F.col("ts").isNull() | F.coalesce(behind > self.delay, F.lit(False))).withColumn(
            "behind_seconds", behind / F.lit(1e6)).drop("clock").observe(
            passed, F.count_if("_late").alias("late"), F.count_if(~F.col("_late")).alias("on_time")).persist()
        try:
            flagged.count()
            self.late(flagged.where("_late").drop("_late"), number)
            self.on_time(flagged.where("not _late").select(*batch.columns), number)
            newest = flagged.where("ts is not null").groupBy(*self.keys).agg(F.max("ts").alias("clock")).unionByName(clock)
            self.clock.write(newest.groupBy(*self.keys).agg(F.max("clock").alias("clock")), number)
            seen = passed.get
            self.spark.createDataFrame([(seen["on_time"], seen["late"])], self.COUNTS).coalesce(1).write.mode(
                "overwrite").parquet(f"{self.counts}/batch={number}")
        finally:
            flagged.unpersist()

    def counted(self) -> DataFrame:
        """(batch, on_time, late) of all batches so far."""
        return self.spark.read.schema(self.COUNTS + ", batch int").parquet(self.counts)


# ---------------------------------------------------------------- low-water mark

class LowWater:
    """The highest time of all batches so far, less a delay; one row of state."""

    def __init__(self, spark: SparkSession, path: str, delay_seconds: float):
        self.state, self.delay = CarriedState(spark, path, "ts timestamp"), int(delay_seconds * 1_000_000)

    def advance(self, batch: DataFrame, number: int) -> int | None:
        """The mark after this batch in microseconds, or None before any row."""
        seen = self.state.before(number).unionByName(batch.select(F.col("ts").cast("timestamp").alias("ts"))).agg(F.max("ts").alias("ts"))
        top = seen.select(F.unix_micros("ts")).first()[0]
        self.state.write(self.state.spark.createDataFrame([(top,)], "us long").select(
            F.timestamp_micros("us").alias("ts")).coalesce(1), number)
        return None if top is None else top - self.delay


# ---------------------------------------------------------------- throttle

class ThrottleStream:
    """Streaming form of ``decay.throttle``: a pair's next row is kept ``seconds`` after its last kept one.

    State is the last kept time per pair. Rows must not be late (see ``LateSplit``), so once the low-water mark is ``seconds`` past
    that time the pair starts anew anyway, and its state goes without changing any result.
    """

    def __init__(self, spark: SparkSession, path: str, kept: Sink, seconds: float = decay.MIN_INTERVAL_SECONDS,
                 delay_seconds: float = 0.0):
        self.kept, self.seconds, self.gap = kept, seconds, int(seconds * 1_000_000)
        self.state = CarriedState(spark, f"{path}/last", "pair_id string, last timestamp")
        self.mark = LowWater(spark, f"{path}/mark", delay_seconds)

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = batch.select("pair_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "raw_spread")
        known, mark = self.state.before(number), self.mark.advance(rows, number)
        out = materialize(decay.throttle(rows, self.seconds, known))
        self.kept(out, number)
        last = out.select("pair_id", F.col("ts").alias("last")).unionByName(known).groupBy("pair_id").agg(F.max("last").alias("last"))
        self.state.write(last.where(F.unix_micros("last") + self.gap > F.lit(mark)), number)


# ---------------------------------------------------------------- episodes

class EpisodeStream:
    """Streaming form of ``decay.episodes``: every finished episode is sent to ``finished`` once, when it ends.

    An open episode expires when the low-water mark passes ``max_seconds`` after its start, with or without a further row of its
    pair. Rows must not be late (see ``LateSplit``). With ``idle_seconds`` a pair that has sent nothing for so long and has no
    running episode leaves the state; if it comes back, its episodes are numbered from one again.
    """

    STATE = ("pair_id string, last timestamp, raw double, side int, number long, start timestamp, opening double, "
             "peak double, current double, count long, expired boolean")

    def __init__(self, spark: SparkSession, path: str, finished: Sink, open_above: float = decay.OPEN_ABOVE,
                 close_below: float = decay.CLOSE_BELOW, max_seconds: float = decay.MAX_SECONDS, delay_seconds: float = 0.0,
                 idle_seconds: float | None = None):
        self.finished, self.open_above, self.close_below = finished, open_above, close_below
        self.limit, self.idle = int(max_seconds * 1_000_000), idle_seconds
        self.state = CarriedState(spark, f"{path}/pairs", self.STATE)
        self.mark = LowWater(spark, f"{path}/mark", delay_seconds)

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = batch.select("pair_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "raw_spread")
        known, mark = self.state.before(number), self.mark.advance(rows, number)
        marked = self._marked(rows, known)
        episodes = materialize(self._advanced(marked, known, mark))
        self.finished(episodes.where("status <> 'open' and not told").select(
            "pair_id", F.col("number").alias("episode_no"), F.col("start").alias("start_time"), F.col("stop").alias("end_time"),
            F.col("opening").alias("opening_spread"), F.col("peak").alias("peak_spread"), F.col("current").alias("current_spread"),
            "status", F.col("count").alias("snapshot_count")), number)
        at = F.struct("ts", "seq")
        last = marked.groupBy("pair_id").agg(F.max("ts").alias("last"), F.max_by("raw_spread", at).alias("raw"),
                                             F.max_by("state", at).alias("side"), F.max_by("episode_no", at).alias("number"))
        running = episodes.select("pair_id", "number", "start", "opening", "peak", "current", "count",
                                  (F.col("told") | (F.col("status") == "expired")).alias("expired"))
        carried = last.join(running, ["pair_id", "number"], "left")
        if self.idle is not None and mark is not None:
            done = (F.col("side") == 0) | F.coalesce("expired", F.lit(False))
            carried = carried.where(~(done & (F.unix_micros("last") < mark - int(self.idle * 1_000_000))))
        self.state.write(carried.select(*[f.split()[0] for f in self.STATE.split(", ")]), number)

    def _marked(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """Rows with state and number, behind one row per known pair that stands for all its earlier ones."""
        told = rows.withColumn("_carried", F.lit(None).cast("int"))
        stand_in = known.select("pair_id", F.col("last").alias("ts"), F.lit(-(1 << 63)).cast("long").alias("seq"),
                                F.col("raw").alias("raw_spread"), F.col("side").alias("_carried"))
        marked = decay.mark_episodes(told.unionByName(stand_in), self.open_above, self.close_below, carried="_carried")
        # the row of a running episode counts as its opening, so numbers go on from the one before
        shift = known.select("pair_id", (F.col("number") - (F.col("side") != 0).cast("long")).alias("_shift"))
        return materialize(marked.join(shift, "pair_id", "left").withColumn(
            "episode_no", F.col("episode_no") + F.coalesce("_shift", F.lit(0))).drop("_shift"))

    def _advanced(self, marked: DataFrame, known: DataFrame, mark: int | None) -> DataFrame:
        """Episodes that run or end in this batch, what they had before taken in. ``told``: their end is known already."""
        keys, at = ["pair_id", "number"], F.struct("ts", "seq")
        own = marked.where(F.col("_carried").isNull() & (F.col("episode_no") > 0)).withColumnRenamed("episode_no", "number")
        before = known.where("side <> 0").select(
            *keys, *[F.col(c).alias(f"_{c}") for c in ("start", "opening", "peak", "current", "count", "expired")])
        zero = F.col("state") == 0
        opened = own.groupBy(*keys).agg(
            F.min("ts").alias("_first"), F.min_by("raw_spread", at).alias("_first_raw"), F.min_by("state", at).alias("_first_state"),
            F.min(F.when(zero, F.col("ts"))).alias("_zero"), F.min_by("raw_spread", F.when(zero, at)).alias("_zero_raw"),
            F.max("ts").alias("_latest"))
        both = opened.join(before, keys, "full")
        # rows after the end of an episode that an earlier batch has closed bear its number still
        both = both.where(F.col("_start").isNotNull() | (F.col("_first_state") != 0))
        following = opened.where("_first_state <> 0").select(
            "pair_id", (F.col("number") - 1).alias("number"), F.col("_first").alias("_next"), F.col("_first_raw").alias("_next_raw"))
        ends = both.join(following, keys, "left").withColumns({
            "start": F.coalesce("_start", "_first"), "_stop": F.coalesce("_zero", "_next"),
            "_stop_raw": F.when(F.col("_zero").isNotNull(), F.col("_zero_raw")).otherwise(F.col("_next_raw"))})
        ends = ends.withColumn("_limit", F.timestamp_micros(F.unix_micros("start") + self.limit))
        size = F.abs("raw_spread")
        stats = own.where("state <> 0").join(ends.select(*keys, "_limit"), keys).groupBy(*keys).agg(
            F.min_by(size, at).alias("_size"), F.max(F.when(F.col("ts") < F.col("_limit"), size)).alias("_top"),
            F.max_by(size, F.when(F.col("ts") < F.col("_limit"), at)).alias("_now"),
            F.count_if(F.col("ts") < F.col("_limit")).alias("_n"))
        passed = F.lit(False) if mark is None else F.unix_micros("_limit") <= mark
        over = F.coalesce(F.col("_stop") >= F.col("_limit"), F.lit(False)) | (
            F.col("_stop").isNull() & (F.coalesce(F.col("_latest") >= F.col("_limit"), F.lit(False)) | passed))
        status = (F.when(over, "expired").when(F.col("_stop").isNull(), "open")
                  .when(F.abs("_stop_raw") < self.close_below, "closed").otherwise("reversed"))
        return ends.join(stats, keys, "left").select(
            *keys, "start", F.when(over, F.col("_limit")).otherwise(F.col("_stop")).alias("stop"), status.alias("status"),
            F.coalesce("_opening", "_size").alias("opening"), F.greatest("_peak", "_top").alias("peak"),
            F.coalesce("_now", "_current").alias("current"),
            (F.coalesce("_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("count"),
            F.coalesce("_expired", F.lit(False)).alias("told"))

