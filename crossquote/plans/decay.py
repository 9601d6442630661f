"""How spreads open and decay: snapshots, throttling, episodes, metrics, baselines, signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossquote.operators import runs as rn
from crossquote.session import materialize

# ---------------------------------------------------------------- fixed values
OPEN_ABOVE = 0.02
CLOSE_BELOW = 0.005
MAX_SECONDS = 24 * 3600
MIN_INTERVAL_SECONDS = 60
BASELINE_MIN_EPISODES = 3
TIME_WEIGHT, SPREAD_WEIGHT = 0.4, 0.6
# ----------------------------------------------------------- end of fixed values

ORDER = ["ts", "seq"]


def snapshots(rows: DataFrame) -> DataFrame:
    """Adds signed and absolute spread to rows with price_a and price_b."""
    raw = F.col("price_a") - F.col("price_b")
    return rows.withColumns({"raw_spread": F.round(raw, 6), "abs_spread": F.round(F.abs(raw), 6)})


def read_snapshots(table: DataFrame, pair_id: str, since: Column | None = None,
                   limit: int | None = None) -> DataFrame:
    """A pair's rows in time order; all of them, or the first ``limit``."""
    rows = table.where(F.col("pair_id") == pair_id)
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    rows = rows.orderBy(*ORDER)
    return rows if limit is None else rows.limit(limit)


# ---------------------------------------------------------------- throttle

def _jump(times: np.ndarray, gap: int) -> np.ndarray:
    """For every row, the first row at least ``gap`` later (len = none)."""
    return np.searchsorted(times, times + gap, side="left")


def _run_exits(gap: int):
    """Where a run's kept chain ends, for every row it could start at.

    Earlier runs can delay the first kept row by less than one gap, so only rows within one gap
    of the run's first row (and the next one) can start the chain. Neighbouring starts with the
    same end are merged.
    """
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "seq"])
        times = pdf["us"].to_numpy()
        n, nxt = len(times), _jump(times, gap)
        last = times.copy()
        for i in range(n - 1, -1, -1):
            if nxt[i] < n:
                last[i] = last[nxt[i]]
        starts = np.arange(min(n, int(np.searchsorted(times, times[0] + gap, side="left")) + 1))
        change = np.append(last[starts][1:] != last[starts][:-1], True)
        keep = starts[change]  # last start of each group with one common end
        return pd.DataFrame({"pair_id": pdf["pair_id"].iloc[0], "run": int(pdf[rn.RUN].iloc[0]),
                             "upto": times[keep], "end": last[keep], "tail": times[-1]})
    return work


def _chain_starts(gap: int):
    """Walk one pair's run summaries in order and tell each run the earliest time it may keep."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out, allowed = [], int(pdf["since"].iloc[0])
        for run, part in pdf.sort_values(["run", "upto"]).groupby("run", sort=True):
            out.append((part["pair_id"].iloc[0], int(run), allowed))
            hit = part["upto"].to_numpy() >= allowed
            if part["tail"].iloc[0] >= allowed and hit.any():
                allowed = int(part["end"].to_numpy()[hit.argmax()]) + gap
        return pd.DataFrame(out, columns=["pair_id", "run", "allowed"])
    return work


def _keep_rows(gap: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "seq"])
        times = pdf["us"].to_numpy()
        i, kept = int(np.searchsorted(times, pdf["allowed"].iloc[0], side="left")), []
        while i < len(times):
            kept.append(i)
            i = int(np.searchsorted(times, times[i] + gap, side="left"))
        return pdf.iloc[kept][["pair_id", "us", "seq"]]
    return work


def throttle(rows: DataFrame, seconds: float = MIN_INTERVAL_SECONDS, last_kept: DataFrame | None = None) -> DataFrame:
    """Keep a pair's row when at least ``seconds`` passed since its last kept row.

    ``last_kept`` (pair_id, last) tells of rows kept before these.

    The rule is sequential per pair, but a sorted run only needs one number from the runs before
    it. So every run reports where its chain would end for each possible start, the (few) run
    summaries of a pair are chained, and then all runs select their rows independently. A pair
    holding most of the rows is thus spread over many runs.
    """
    gap = int(seconds * 1_000_000)
    keyed = rn.sorted_runs(rows, ["pair_id"], ORDER)
    slim = keyed.select("pair_id", F.unix_micros("ts").alias("us"), "seq", rn.RUN)
    exits = slim.groupBy("pair_id", rn.RUN).applyInPandas(
        _run_exits(gap), "pair_id string, run long, upto long, end long, tail long")
    if last_kept is not None:
        exits = exits.join(last_kept.select("pair_id", (F.unix_micros("last") + gap).alias("since")), "pair_id", "left")
    else:
        exits = exits.withColumn("since", F.lit(None).cast("long"))
    exits = exits.withColumn("since", F.coalesce("since", F.lit(-(1 << 63))))
    starts = exits.groupBy("pair_id").applyInPandas(
        _chain_starts(gap), "pair_id string, run long, allowed long")
    walked = slim.join(starts.withColumnRenamed("run", rn.RUN), ["pair_id", rn.RUN])
    kept = walked.groupBy("pair_id", rn.RUN).applyInPandas(
        _keep_rows(gap), "pair_id string, us long, seq long")
    return keyed.drop(rn.RUN).join(
        kept.select("pair_id", F.timestamp_micros("us").alias("ts"), "seq"), ["pair_id", "ts", "seq"], "left_semi")


# ---------------------------------------------------------------- episodes

def crossing(raw: Column, previous: Column, open_above: float = OPEN_ABOVE,
             close_below: float = CLOSE_BELOW) -> Column:
    """+1/-1 opens an episode in that direction, 0 ends it, null leaves it as it is.

    Between the two thresholds a change of sign ends an episode.
    """
    flipped = (F.signum(raw) != F.signum(previous)) & previous.isNotNull()
    return (F.when(raw > open_above, 1).when(raw < -open_above, -1)
            .when(F.abs(raw) < close_below, 0).when(flipped, 0))


def mark_episodes(rows: DataFrame, open_above: float = OPEN_ABOVE,
                  close_below: float = CLOSE_BELOW, carried: str | None = None) -> DataFrame:
    """Rows (pair_id, ts, seq, raw_spread) with ``state`` (-1, 0, 1) and running ``episode_no``.

    A value in the column ``carried`` is a row's state, whatever its spread; it stands for rows before it.
    """
    keys = ["pair_id"]
    marked = rn.sorted_runs(rows, keys, ORDER)
    marked = rn.scan_last(marked, keys, ORDER, {}, before={"_prev": F.col("raw_spread")})
    cross = crossing(F.col("raw_spread"), F.col("_prev"), open_above, close_below)
    marked = marked.withColumn("_cross", cross if carried is None else F.coalesce(carried, cross))
    marked = rn.scan_last(marked, keys, ORDER, {"_state": F.col("_cross")}, before={"_before": F.col("_cross")})
    marked = materialize(marked.withColumns({  # each scan reads its input twice
        "state": F.coalesce("_state", F.lit(0)), "_before": F.coalesce("_before", F.lit(0))}))
    fresh = (F.col("state") != 0) & (F.col("state") != F.col("_before"))
    marked = rn.scan_sum(marked, keys, ORDER, {"episode_no": fresh.cast("long")})
    return marked.drop("_prev", "_cross", "_state", "_before", rn.RUN)


def episodes(rows: DataFrame, open_above: float = OPEN_ABOVE, close_below: float = CLOSE_BELOW,
             max_seconds: float = MAX_SECONDS) -> DataFrame:
    """One row per spread episode.

    An episode starts when |spread| exceeds ``open_above`` and ends when it falls below
    ``close_below`` (closed) or changes sign (reversed); after ``max_seconds`` it is expired and
    later rows do not count. Everything after the marking is a keyed aggregate.
    """
    return episodes_of(mark_episodes(rows, open_above, close_below), close_below, max_seconds)


def episodes_of(marked: DataFrame, close_below: float = CLOSE_BELOW, max_seconds: float = MAX_SECONDS) -> DataFrame:
    """The episodes of rows that ``mark_episodes`` has marked."""
    marked = marked.where(F.col("episode_no") > 0)
    keys = ["pair_id", "episode_no"]
    at = F.struct(*ORDER)
    opened = marked.groupBy(*keys).agg(
        F.min("ts").alias("start_time"), F.min_by("state", at).alias("side"),
        F.min(F.when(F.col("state") == 0, at)).alias("_end"),
        F.min_by("raw_spread", F.when(F.col("state") == 0, at)).alias("_end_raw"),
        F.min_by("raw_spread", at).alias("_first_raw"))
    following = opened.select("pair_id", (F.col("episode_no") - 1).alias("episode_no"),
                              F.col("start_time").alias("_next"), F.col("_first_raw").alias("_next_raw"))
    bounds = opened.join(following, keys, "left").select(
        *keys, "start_time", "side", F.coalesce("_end.ts", "_next").alias("_stop"),
        F.coalesce("_end_raw", "_next_raw").alias("_stop_raw"))
    limit = F.col("start_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(max_seconds)))
    size = F.abs("raw_spread")
    counts = F.col("ts") < limit
    inside = marked.where(F.col("state") != 0).join(bounds.select(*keys, "start_time"), keys)
    stats = inside.groupBy(*keys).agg(
        F.min_by(size, at).alias("opening_spread"), F.max(F.when(counts, size)).alias("peak_spread"),
        F.min(F.when(counts, F.struct((-size).alias("d"), F.col("ts").alias("t")))).alias("_peak"),
        F.max_by(size, F.when(counts, at)).alias("current_spread"), F.max(F.when(counts, F.col("ts"))).alias("_seen"),
        F.count_if(counts).alias("snapshot_count"), F.max("ts").alias("_latest"))
    joined = bounds.join(stats, keys)
    expired = F.coalesce(F.col("_stop") >= limit, F.lit(False)) | (
        F.col("_stop").isNull() & (F.col("_latest") >= limit))
    status = (F.when(expired, "expired").when(F.col("_stop").isNull(), "open")
              .when(F.abs("_stop_raw") < close_below, "closed").otherwise("reversed"))
    end = F.when(expired, limit).otherwise(F.col("_stop"))
    return joined.withColumns({"status": status, "end_time": end}).select(
        *keys, F.concat_ws("#", "pair_id", "episode_no").alias("episode_id"), "side", "start_time", "end_time",
        "opening_spread", "peak_spread", F.col("_peak.t").alias("peak_time"), "current_spread",
        F.when(F.col("status").isin("closed", "reversed"), F.abs("_stop_raw")).alias("closing_spread"),
        ((F.unix_micros(F.coalesce("end_time", "_seen")) - F.unix_micros("start_time")) / F.lit(1e6))
        .alias("duration_seconds"), "status", "snapshot_count")


def episode_metrics(marked: DataFrame, found: DataFrame, max_seconds: float = MAX_SECONDS) -> DataFrame:
    """Decay, velocity, persistence and half-life per episode. ``marked`` are the rows of ``mark_episodes``.

    percent_decay is the share of the peak that is gone; velocity the spread change per hour;
    persistence blends elapsed time with the remaining share of the opening spread; half-life
    is the time from the peak to the first snapshot at or below half of it.
    """
    keys = ["pair_id", "episode_no"]
    span = found.select(*keys, "peak_time", "peak_spread",
                        F.coalesce("end_time", F.lit("9999-12-31").cast("timestamp")).alias("_to"))
    halved = (marked.join(span, keys)
              .where((F.col("ts") >= F.col("peak_time")) & (F.col("ts") <= F.col("_to"))
                     & (F.abs("raw_spread") <= F.col("peak_spread") / 2))
              .groupBy(*keys).agg(F.min("ts").alias("_seen_half")))
    # the row that reverses an episode carries the number of the next one
    closing = F.when(F.col("closing_spread") <= F.col("peak_spread") / 2, F.col("end_time"))
    joined = found.join(halved, keys, "left").withColumn("_half", F.least("_seen_half", closing))
    seconds = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)
    last = F.coalesce("closing_spread", "current_spread")
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    hours = F.col("duration_seconds") / 3600.0
    return joined.select(
        "episode_id", "pair_id", "episode_no", "status", "opening_spread", "peak_spread",
        last.alias("current_spread"), "duration_seconds",
        F.coalesce(F.try_divide(F.col("peak_spread") - last, "peak_spread"), F.lit(0.0)).alias("percent_decay"),
        seconds("peak_time", "start_time").alias("time_to_peak_seconds"),
        F.coalesce(F.try_divide(last - F.col("opening_spread"), hours), F.lit(0.0)).alias("decay_velocity"),
        (TIME_WEIGHT * clamp(F.col("duration_seconds") / float(max_seconds)) + SPREAD_WEIGHT * clamp(
            F.coalesce(F.try_divide(last, "opening_spread"), F.lit(0.0)))).alias("persistence_score"),
        seconds("_half", "peak_time").alias("half_life_seconds"), "start_time", "snapshot_count")


def decay_after(marked: DataFrame, found: DataFrame, minutes: tuple[int, ...] = (5, 15, 30)) -> DataFrame:
    """(pair_id, episode_no, decay_5m, ...): share of the opening spread gone after so many minutes.

    Null when the episode ended earlier. ``marked`` are the rows of ``mark_episodes``; only rows of
    the episode itself count, which are all there are before its end.
    """
    later = lambda m: F.col("start_time") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m))
    span = found.where(F.col("end_time").isNotNull()).select(
        "pair_id", "episode_no", "start_time", "end_time", "opening_spread")
    seen = marked.join(span, ["pair_id", "episode_no"]).where(F.col("ts") <= later(max(minutes)))
    at = F.struct(*ORDER)
    decay = lambda m: F.when(
        F.max(F.col("end_time") >= later(m)),
        1.0 - F.max_by(F.abs("raw_spread"), F.when(F.col("ts") <= later(m), at)) / F.max("opening_spread"))
    return seen.groupBy("pair_id", "episode_no").agg(*[decay(m).alias(f"decay_{m}m") for m in minutes])


def baselines(marked: DataFrame, found: DataFrame, metrics: DataFrame,
              min_episodes: int = BASELINE_MIN_EPISODES) -> DataFrame:
    """Typical decay per pair from its finished episodes (exact quantiles, skew-safe)."""
    ended = materialize(metrics.where(F.col("status") == "closed"))
    base = ended.groupBy("pair_id").agg(F.count("*").alias("episode_count")).where(
        F.col("episode_count") >= min_episodes)
    wanted = {"opening_spread": {"median_opening_spread": 0.5},
              "half_life_seconds": {"median_half_life_seconds": 0.5},
              "duration_seconds": {"median_time_to_close_seconds": 0.5},
              "persistence_score": {"persistence_p25": 0.25, "persistence_p50": 0.5, "persistence_p75": 0.75},
              "peak_spread": {"typical_peak_spread": 0.5}}
    out = base.join(rn.exact_quantiles(ended, ["pair_id"], wanted), "pair_id", "left")
    minutes = (5, 15, 30)
    after = decay_after(marked, found.where(F.col("status") == "closed"), minutes).groupBy("pair_id").agg(
        *[F.avg(f"decay_{m}m").alias(f"avg_percent_decay_{m}m") for m in minutes])
    return out.join(after, "pair_id", "left")


def decay_signals(metrics: DataFrame, base: DataFrame) -> DataFrame:
    """Status class, urgency and abnormality of running episodes against their pair's baseline."""
    live = metrics.where(F.col("status") == "open").join(base, "pair_id", "left")
    decay, velocity = F.col("percent_decay"), F.col("decay_velocity")
    kind = (F.when(decay >= 0.8, "mostly_closed").when(F.col("snapshot_count") < 3, "opening")
            .when(velocity > 0.01, "re_widening").when(velocity <= -0.05, "actively_decaying")
            .when(velocity < -0.005, "slow_decay").otherwise("stalled"))
    percentile = (F.when(F.col("persistence_p50").isNull(), None)
                  .when(F.col("persistence_score") >= F.col("persistence_p75"), 0.75)
                  .when(F.col("persistence_score") >= F.col("persistence_p50"), 0.5)
                  .when(F.col("persistence_score") >= F.col("persistence_p25"), 0.25).otherwise(0.0))
    size = F.least(F.col("current_spread") / 0.10, F.lit(1.0))
    return live.select(
        "episode_id", "pair_id", "current_spread", "opening_spread", "peak_spread", "percent_decay",
        "half_life_seconds", "duration_seconds", "persistence_score", percentile.alias("persistence_percentile"),
        kind.alias("decay_status"), F.round(0.6 * size + 0.4 * F.greatest(F.lit(0.0), 1.0 - decay), 6).alias("urgency_score"),
        F.try_divide("peak_spread", "typical_peak_spread").alias("relative_abnormality"), "start_time", "snapshot_count")
