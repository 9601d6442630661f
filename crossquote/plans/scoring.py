"""From matched pairs to ranked signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossquote.functions import pricing as px
from crossquote.functions.filters import platform_name
from crossquote.operators.barrier import compute_once

NEUTRAL = {"points": 1, "velocity": 0.0, "volatility": 0.01, "volume_ratio": 1.0,
           "days_to_close": 365.0, "z_score": 0.0}


def matched_pairs(accepted: DataFrame) -> DataFrame:
    """Accepted pairs (structs a, b) as flat pricing rows."""
    a, b = F.col("a"), F.col("b")
    yes = {s: px.yes_price(F.col(s)["prices"]) for s in "ab"}
    return accepted.select(
        F.col("candidate_id").alias("pair_id"),
        platform_name(a["platform"]).alias("platform_a"), a["market_id"].alias("id_a"),
        platform_name(b["platform"]).alias("platform_b"), b["market_id"].alias("id_b"),
        yes["a"].alias("price_a"), px.no_price(a["prices"], yes["a"]).alias("no_a"),
        yes["b"].alias("price_b"), px.no_price(b["prices"], yes["b"]).alias("no_b"),
        F.coalesce(a["close_time"], b["close_time"]).alias("close_date"), "similarity")


def _heuristic(df: DataFrame) -> DataFrame:
    return df.withColumn("base_probability", px.convergence_heuristic(
        F.col("current_spread"), F.col("velocity"), F.col("z_score"), F.col("days_to_close"),
        F.col("volume_ratio")))


def score_pairs(pairs: DataFrame, features: DataFrame | None = None, *,
                bankroll: float = px.BANKROLL, min_spread: float = px.MIN_SPREAD,
                model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Signals of all pairs worth trading (unordered; see ``rank_signals``).

    ``pairs``: pair_id, price_a, price_b, similarity, optional no_a, no_b and further columns,
    which pass through. ``features``: rows of ``series.spread_features``; pairs without them get
    neutral values. ``model`` adds ``base_probability``; the rule heuristic is the default.
    """
    have = set(pairs.columns)
    a, b = F.col("price_a"), F.col("price_b")
    no = lambda s: F.col(f"no_{s}") if f"no_{s}" in have else F.lit(1.0) - F.col(f"price_{s}")
    spread = pairs.withColumns({
        "raw_spread": px.raw_spread(a, b), "direction": px.direction(a, b),
        "guaranteed_spread": px.guaranteed_spread(a, no("a"), b, no("b"))}
    ).where(F.col("raw_spread") >= min_spread)
    if features is not None:
        spread = spread.join(features.drop("mean_spread", "max_spread"), "pair_id", "left")
    known = set(spread.columns)
    fill = lambda n, d: F.coalesce(F.col(n), d) if n in known else d
    spread = spread.withColumns({
        **{n: fill(n, F.lit(d)) for n, d in NEUTRAL.items()},
        "current_spread": fill("current_spread", a - b)})

    based = (model or _heuristic)(spread)
    raw, sure = F.col("raw_spread"), F.col("guaranteed_spread")
    sim, prob = F.col("similarity"), F.col("probability")
    trend = [F.col(c) for c in ("velocity", "volatility", "z_score", "days_to_close")]
    sized = (
        based.withColumn("quality", px.match_quality(sim, sure, raw))
        .withColumn("probability", px.convergence_probability(F.col("base_probability"), F.col("quality")))
        .withColumns({"capture": px.capture_amount(raw, sure, prob, sim, *trend),
                      "risk": px.adverse_move(raw, sim, trend[0], trend[1], trend[3])})
        .withColumn("_f", px.kelly_fraction(prob, raw, F.col("capture"), F.col("risk"),
                                            F.col("quality"), bankroll))
        .withColumns({"kelly_fraction": F.round("_f", 6), "size_usd": F.round(F.col("_f") * bankroll, 2)})
        .withColumns({
            "expected_profit": px.expected_value(prob, raw, F.col("size_usd"), F.col("capture"), F.col("risk")),
            "confidence": px.signal_confidence(prob, raw, sure, sim, F.col("points"))}))
    return compute_once(sized).where((F.col("capture") > 0) & (F.col("size_usd") > 0) & (F.col("expected_profit") > 0)
                       & (F.col("confidence") >= px.MIN_CONFIDENCE)).drop("_f")


def rank_signals(signals: DataFrame) -> DataFrame:
    return signals.orderBy(F.desc("expected_profit"), "pair_id")


def spread_table(pairs: DataFrame) -> DataFrame:
    """Spread, direction and guaranteed spread of every pair, without filters."""
    a, b = F.col("price_a"), F.col("price_b")
    return pairs.select("pair_id", px.raw_spread(a, b).alias("raw_spread"),
                        px.direction(a, b).alias("direction"),
                        px.guaranteed_spread(a, 1.0 - a, b, 1.0 - b).alias("guaranteed_spread"))


