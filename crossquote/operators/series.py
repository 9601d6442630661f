"""Price history: hourly alignment of two markets, spread features, labels, correlation.

History is reduced to one row per market and hour before any per-pair window, with map-side
combine. A pair then has at most 24 * lookback_days rows, so windows per pair stay small
whatever share of the raw history one market holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossquote.functions.pricing import days_to_close, volume_ratio

# ---------------------------------------------------------------- fixed values
LOOKBACK_DAYS = 30
RECENT_POINTS = 5
MIN_FEATURE_POINTS = 3
ZERO_STD = 0.01
LOOKAHEAD = 24
CONVERGED_SHARE = 0.50
MIN_CORRELATION_POINTS = 10
# ----------------------------------------------------------- end of fixed values


def hourly_last(history: DataFrame, as_of: Column | None = None,
                lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """(platform, market_id, hour, price, points): last price per market and hour.

    Ties inside an hour go to the later timestamp, then the higher ``seq``.
    """
    scoped = history
    if as_of is not None:
        scoped = scoped.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(lookback_days)))
    return (scoped.groupBy("platform", "market_id", F.date_trunc("hour", "ts").alias("hour"))
            .agg(F.max_by("yes_price", F.struct("ts", "seq")).alias("price"),
                 F.count("*").alias("points")))


def _sides(pairs: DataFrame, hourly: DataFrame) -> DataFrame:
    wanted = (pairs.select(F.col("platform_a").alias("platform"), F.col("id_a").alias("market_id"))
              .union(pairs.select("platform_b", "id_b")).distinct())
    return hourly.join(wanted, ["platform", "market_id"], "left_semi")


def aligned_prices(pairs: DataFrame, hourly: DataFrame) -> DataFrame:
    """(pair_id, hour, price_a, price_b) for every hour both markets traded."""
    side = lambda s: hourly.select(
        F.col("platform").alias(f"platform_{s}"), F.col("market_id").alias(f"id_{s}"), "hour",
        F.col("price").alias(f"price_{s}"))
    keyed = pairs.select("pair_id", "platform_a", "id_a", "platform_b", "id_b")
    return (keyed.join(side("a"), ["platform_a", "id_a"])
            .join(side("b"), ["platform_b", "id_b", "hour"])
            .select("pair_id", "hour", "price_a", "price_b"))


def hourly_spread(pairs: DataFrame, history: DataFrame, as_of: Column,
                  lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """(pair_id, hour, spread) with the single-point rules for pairs that share no hour.

    ``pairs`` needs pair_id, platform_a, id_a, platform_b, id_b, price_a, price_b. Without a
    common hour the last known prices give one point; without history on a side, the pair's
    own prices do.
    """
    hourly = _sides(pairs, hourly_last(history, as_of, lookback_days))
    aligned = aligned_prices(pairs, hourly).select(
        "pair_id", "hour", (F.col("price_a") - F.col("price_b")).alias("spread"))
    latest = hourly.groupBy("platform", "market_id").agg(F.max_by("price", "hour").alias("last"))
    rest = pairs.join(aligned.select("pair_id").distinct(), "pair_id", "left_anti")
    for s in "ab":
        rest = rest.join(latest.select(
            F.col("platform").alias(f"platform_{s}"), F.col("market_id").alias(f"id_{s}"),
            F.col("last").alias(f"last_{s}")), [f"platform_{s}", f"id_{s}"], "left")
    single = rest.select("pair_id", as_of.cast("timestamp").alias("hour"), F.coalesce(
        F.col("last_a") - F.col("last_b"), F.col("price_a") - F.col("price_b")).alias("spread"))
    return aligned.unionByName(single)


def spread_features(pairs: DataFrame, spreads: DataFrame, as_of: Column,
                    abs_features: bool = False) -> DataFrame:
    """One feature row per pair that has at least one spread point.

    ``pairs`` may carry volume_a, volume_b and close_date. With fewer than three points the
    trend features take neutral values. ``abs_features`` uses |spread| as the current value.
    """
    latest_first = Window.partitionBy("pair_id").orderBy(F.desc("hour"))
    ranked = spreads.withColumn("rn", F.row_number().over(latest_first))
    recent = F.col("rn") <= RECENT_POINTS
    pick = lambda agg: agg("spread", F.when(recent, F.col("hour")))
    grouped = ranked.groupBy("pair_id").agg(
        F.count("*").alias("points"), F.max_by("spread", "hour").alias("current"),
        F.avg("spread").alias("mean"), F.stddev_pop("spread").alias("std0"),
        F.max(F.abs("spread")).alias("max_abs"), F.count(F.when(recent, 1)).alias("m"),
        pick(F.max_by).alias("newest"), pick(F.min_by).alias("oldest"))
    have = set(pairs.columns)
    opt = lambda n, d: F.coalesce(F.col(n), d) if n in have else d
    joined = grouped.join(pairs.select(
        "pair_id", opt("volume_a", F.lit(0.0)).cast("double").alias("va"),
        opt("volume_b", F.lit(0.0)).cast("double").alias("vb"),
        (F.col("close_date") if "close_date" in have else F.lit(None)).cast("timestamp").alias("close")),
        "pair_id")
    full = F.col("points") >= MIN_FEATURE_POINTS
    std = F.when(F.col("std0") > 0, F.col("std0")).otherwise(ZERO_STD)
    current = F.abs("current") if abs_features else F.col("current")
    velocity = F.try_divide(F.col("newest") - F.col("oldest"), (F.col("m") - 1).cast("double"))
    pick_full = lambda value, default: F.when(full, value).otherwise(F.lit(default))
    return joined.select(
        "pair_id", "points", current.alias("current_spread"), F.col("mean").alias("mean_spread"),
        pick_full(F.coalesce(velocity, F.lit(0.0)), 0.0).alias("velocity"),
        pick_full(std, ZERO_STD).alias("volatility"),
        pick_full(volume_ratio(F.col("va"), F.col("vb")), 1.0).alias("volume_ratio"),
        pick_full(days_to_close(F.col("close"), as_of), 365.0).alias("days_to_close"),
        pick_full(F.round((F.col("current") - F.col("mean")) / std, 4), 0.0).alias("z_score"),
        F.col("max_abs").alias("max_spread"))


FEATURE_COLUMNS = ["current_spread", "mean_spread", "velocity", "volatility", "volume_ratio",
                   "days_to_close", "z_score", "max_spread"]


def convergence_labels(spreads: DataFrame, lookahead: int = LOOKAHEAD,
                       share: float = CONVERGED_SHARE) -> DataFrame:
    """Adds label 1/0 where the point ``lookahead`` rows later exists; later rows are dropped."""
    ahead = F.abs(F.lead("spread", lookahead).over(Window.partitionBy("pair_id").orderBy("hour")))
    now = F.abs("spread")
    return (spreads.withColumn("_ahead", ahead).where(F.col("_ahead").isNotNull())
            .withColumn("label", ((now > 0) & (F.col("_ahead") <= now * (1 - share))).cast("int"))
            .drop("_ahead"))


def running_features(spreads: DataFrame) -> DataFrame:
    """Feature rows for every point in time, from the points up to and including it."""
    order = Window.partitionBy("pair_id").orderBy("hour")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(order)
    recent = F.least(n, F.lit(RECENT_POINTS)) - 1
    oldest = F.first("spread").over(order.rowsBetween(-(RECENT_POINTS - 1), 0))
    staged = spreads.select(
        "pair_id", "hour", "spread", n.alias("points"), F.avg("spread").over(past).alias("mean_spread"),
        F.stddev_pop("spread").over(past).alias("s"), F.max(F.abs("spread")).over(past).alias("max_spread"),
        F.try_divide(F.col("spread") - oldest, recent.cast("double")).alias("v"))
    full = F.col("points") >= MIN_FEATURE_POINTS
    std = F.when(full & (F.col("s") > 0), F.col("s")).otherwise(ZERO_STD)
    return staged.select(
        "pair_id", "hour", "points", F.col("spread").alias("current_spread"), "mean_spread",
        F.when(full, F.col("v")).otherwise(0.0).alias("velocity"), std.alias("volatility"),
        F.lit(1.0).alias("volume_ratio"), F.lit(365.0).alias("days_to_close"),
        F.when(full, F.round((F.col("spread") - F.col("mean_spread")) / std, 4)).otherwise(0.0)
        .alias("z_score"), "max_spread")


def _correlation(x: str, y: str) -> Column:
    """Pearson correlation of complete pairs; 0 with fewer than two or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.coalesce(F.try_divide(F.covar_pop(a, b), spread), F.lit(0.0))


def price_correlation(pairs: DataFrame, history: DataFrame, as_of: Column,
                      min_points: int = MIN_CORRELATION_POINTS) -> DataFrame:
    """(pair_id, correlation, correlation_ok): do two markets move like the same event?

    Too little history gives (0, true). The score blends levels, hourly changes, the better
    of the two one-step lags and the share of equal directions.
    """
    hourly = _sides(pairs, hourly_last(history, as_of))
    order = Window.partitionBy("pair_id").orderBy("hour")
    moves = aligned_prices(pairs, hourly)
    for s in "ab":
        moves = moves.withColumn(f"r_{s}", F.col(f"price_{s}") - F.lag(f"price_{s}").over(order))
    for s in "ab":
        moves = moves.withColumn(f"p_{s}", F.lag(f"r_{s}").over(order))
    same = F.when(F.col("r_a").isNotNull(),
                  (F.signum("r_a") == F.signum("r_b")).cast("double"))
    stats = moves.groupBy("pair_id").agg(
        F.count("*").alias("n"), _correlation("price_a", "price_b").alias("level"),
        _correlation("r_a", "r_b").alias("change"), _correlation("r_a", "p_b").alias("lag_b"),
        _correlation("p_a", "r_b").alias("lag_a"), F.avg(same).alias("agree"))
    totals = hourly.groupBy("platform", "market_id").agg(F.sum("points").alias("points"))
    out = pairs.select("pair_id", "platform_a", "id_a", "platform_b", "id_b")
    for s in "ab":
        out = out.join(totals.select(
            F.col("platform").alias(f"platform_{s}"), F.col("market_id").alias(f"id_{s}"),
            F.col("points").alias(f"n_{s}")), [f"platform_{s}", f"id_{s}"], "left")
    out = out.join(stats, "pair_id", "left")
    enough = ((F.coalesce("n_a", F.lit(0)) >= min_points) & (F.coalesce("n_b", F.lit(0)) >= min_points)
              & (F.coalesce("n", F.lit(0)) >= min_points))
    score = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (
        0.45 * F.col("level") + 0.30 * F.col("change") + 0.15 * F.greatest("lag_a", "lag_b")
        + 0.10 * (2.0 * F.col("agree") - 1.0)))), 4)
    valid = (score >= 0.60) & (F.col("level") >= 0.40) & (F.col("agree") >= 0.55)
    return out.select("pair_id", F.when(enough, score).otherwise(0.0).alias("correlation"),
                      F.when(enough, valid).otherwise(True).alias("correlation_ok"))


def exact_mean(value: Column) -> Column:
    """Mean over exact decimals: a sum of doubles depends on the order of its rows."""
    return F.avg(value.cast("decimal(28,12)")).cast("double")


def series_summary(aligned: DataFrame) -> DataFrame:
    """Current, mean, min and max spread and mean leg prices per pair."""
    spread = F.abs(F.col("price_a") - F.col("price_b"))
    return aligned.groupBy("pair_id").agg(
        F.max_by(spread, "hour").alias("current_spread"), exact_mean(spread).alias("avg_spread"),
        F.min(spread).alias("min_spread"), F.max(spread).alias("max_spread"),
        exact_mean(F.col("price_a")).alias("avg_price_a"), exact_mean(F.col("price_b")).alias("avg_price_b"))
