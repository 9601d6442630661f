"""Live re-check of scored signals against current prices, liquidity and co-movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossquote.functions import pricing as px
from crossquote.operators.barrier import compute_once


def latest_prices(ticks: DataFrame) -> DataFrame:
    """(platform, market_id, live_price): newest tick per market, combined before the shuffle."""
    return ticks.groupBy("platform", "market_id").agg(
        F.max_by("yes_price", F.struct("ts", "seq")).alias("live_price"))


def attach_live(signals: DataFrame, live: DataFrame | None, liquidity: DataFrame | None,
                correlation: DataFrame | None = None) -> DataFrame:
    """Left-joins live_a/b, liquidity_a/b (missing = 0) and the correlation verdict.

    The lookup tables hold one row per market; a market used by very many signals is split
    by the adaptive skew join.
    """
    out = signals
    for s in "ab":
        on = [f"platform_{s}", f"id_{s}"]
        for source, value in ((live, "live"), (liquidity, "liquidity")):
            if source is not None:
                renamed = source.select(
                    F.col("platform").alias(on[0]), F.col("market_id").alias(on[1]),
                    F.col("live_price" if value == "live" else "liquidity").alias(f"{value}_{s}"))
                out = out.join(renamed, on, "left")
    if correlation is not None:
        out = out.join(correlation, "pair_id", "left")
    return out


def _actions(side: Column, half: Column) -> Column:
    leg = lambda s, kind: F.struct(
        F.lit(s).alias("leg"), F.lit(kind).alias("side"), half.alias("amount_usd"),
        F.round((F.col(f"_live_{s}") if kind == "yes" else 1.0 - F.col(f"_live_{s}"))
                + px.LIMIT_STEP, 4).alias("limit_price"))
    return F.when(side == px.BUY_B, F.array(leg("b", "yes"), leg("a", "no"))).otherwise(
        F.array(leg("a", "yes"), leg("b", "no")))


def validate(signals: DataFrame, min_spread: float = px.MIN_SPREAD) -> DataFrame:
    """Adds the live verdict columns to signals that went through ``attach_live``.

    A missing live price falls back to the scored price and is noted as a reason, but does not
    block. A correlation of exactly 0 means unknown and passes.
    """
    have = set(signals.columns)
    opt = lambda n, d: F.coalesce(F.col(n), F.lit(d)) if n in have else F.lit(d)
    known = {s: (F.col(f"live_{s}") if f"live_{s}" in have else F.lit(None).cast("double")) for s in "ab"}
    base = signals.withColumns({
        **{f"_known_{s}": known[s].isNotNull() for s in "ab"},
        **{f"_live_{s}": F.coalesce(known[s], F.col(f"price_{s}")) for s in "ab"},
        **{f"_liq_{s}": opt(f"liquidity_{s}", 0.0).cast("double") for s in "ab"},
        "_corr": opt("correlation", 0.0), "_corr_ok": opt("correlation_ok", True)})
    gap = F.abs(F.col("_live_a") - F.col("_live_b"))
    now = px.direction(F.col("_live_a"), F.col("_live_b"))
    size, corr = F.col("size_usd"), F.col("_corr")
    checked = base.withColumns({
        "live_spread": F.round(gap, 6), "spread_ok": gap >= min_spread,
        "direction_ok": now == F.col("direction"),
        "_issues": px.liquidity_issues(F.col("_liq_a"), F.col("_liq_b"), size),
        "adjusted_size": px.liquidity_size(size, F.col("_liq_a"), F.col("_liq_b"))})
    corr_pass = F.col("_corr_ok") | (corr == 0.0)
    executable = (F.col("spread_ok") & F.col("direction_ok") & (F.size("_issues") == 0) & corr_pass
                  & (F.col("adjusted_size") > 0))
    missing = lambda s: F.when(~F.col(f"_known_{s}"), F.lit(f"no live price for side {s}"))
    reasons = F.filter(F.array(
        missing("a"), missing("b"),
        F.when(~F.col("spread_ok"), F.concat(
            F.lit("Spread vanished: "), F.format_string("%.4f", F.col("live_spread")),
            F.lit(f" < {min_spread:.4f}"))),
        F.when(~F.col("direction_ok"), F.concat(
            F.lit("Direction reversed live: scored="), F.col("direction"), F.lit(", live="), now)),
        F.when(F.size("_issues") > 0, F.concat(F.lit("Liquidity: "), F.concat_ws("; ", "_issues"))),
        F.when(~corr_pass, F.concat(F.lit("Low price correlation: "), F.format_string("%.3f", corr)))),
        lambda r: r.isNotNull())
    half = F.round(F.col("adjusted_size") / 2, 2)
    done = checked.withColumns({
        "liquidity_ok": F.size("_issues") == 0, "executable": executable, "reasons": reasons,
        "live_price_a": F.col("_live_a"), "live_price_b": F.col("_live_b"),
        "price_correlation": corr, "actions": F.when(executable, _actions(F.col("direction"), half))})
    return compute_once(done.drop("_corr", "_corr_ok", "_issues", "live_a", "live_b",
                     *[f"_{p}_{s}" for p in ("known", "live", "liq") for s in "ab"]))


def action_rows(validated: DataFrame) -> DataFrame:
    """One row per trade action of executable signals."""
    return (validated.where("executable").select("pair_id", F.posexplode("actions").alias("no", "act"))
            .select("pair_id", "no", "act.*"))
