"""Replay of quote events against validated pairs as one batch DAG."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossquote.operators import fills as fl
from crossquote.operators import opportunities as op
from crossquote.operators import replay as rp
from crossquote.plans import portfolio as pf
from crossquote.session import materialize


def greedy_strategy(size: float = 10.0, min_net: float = 0.005) -> Callable[[DataFrame], DataFrame]:
    """Take every opportunity with enough net edge at a fixed size per leg.

    A strategy maps opportunity intervals to the same rows plus ``requested_size``.
    """
    def decide(intervals: DataFrame) -> DataFrame:
        return intervals.where(F.col("net_edge") >= min_net).withColumn("requested_size", F.lit(size))
    return decide


def leg_rows(actions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two buy legs per action, with the quote each leg is filled against."""
    def leg(s: str) -> Column:
        quote, label = F.col(s), F.col(f"outcome_{s}")
        snap = quote["snapshot"]
        return F.struct(
            F.lit(s).alias("leg_no"), F.col(f"platform_{s}").alias("platform"),
            F.col(f"id_{s}").alias("market_id"), label.alias("outcome"), F.lit("buy").alias("side"),
            F.try_element_at(snap["best_ask"], label).alias("best_price"),
            F.try_element_at(snap["last_traded"], label).alias("last_price"),
            F.try_element_at(snap["asks"], label).alias("levels"), quote["fees"].alias("platform_fee"),
            F.coalesce(F.lower(snap["status"]), F.lit("active")).alias("market_status"))

    keyed = actions.join(pairs.select("pair_id", "platform_a", "id_a", "platform_b", "id_b"), "pair_id")
    return keyed.select(
        "pair_id", F.col("from_ts").alias("entry_time"), "observations", "requested_size",
        F.explode(F.array(leg("a"), leg("b"))).alias("leg")).select(
        "pair_id", "entry_time", "observations", "requested_size", "leg.*")


def order_rejections(orders: DataFrame, events: DataFrame, min_size: float = fl.MIN_TRADE_SIZE,
                     max_size: float = fl.MAX_BASKET_SIZE) -> DataFrame:
    """Orders (order_id, platform, market_id, ts, requested_size) with ``market_status`` at their time and the first reason against them.

    A market is unknown (null status) until its first snapshot or resolution; events at an order's time count.
    """
    asked = orders.withColumnRenamed("order_id", "probe_id")
    states = rp.state_as_of(events, asked, prints=False).select(
        F.col("probe_id").alias("order_id"),
        F.when(F.col("quote").isNotNull() | (F.col("status") == "resolved"), F.col("status")).alias("market_status"))
    return orders.join(states, "order_id").withColumn(
        "rejection", fl.action_rejection(orders, min_size, max_size))


def attempts(intervals: DataFrame, pairs: DataFrame, *modes: str,
             strategy: Callable[[DataFrame], DataFrame] | None = None,
             min_profit: float = fl.MIN_PROFIT, **overrides) -> tuple[DataFrame, DataFrame]:
    """(filled legs, basket fills) of every opportunity interval and mode."""
    legs = leg_rows((strategy or greedy_strategy())(intervals), pairs)
    valid = legs.where(fl.action_rejection(legs).isNull())
    filled = fl.fill_legs(fl.per_mode(valid, *modes, **overrides))
    keys = ["mode", "pair_id", "entry_time", "observations"]
    return filled, fl.fill_baskets(filled, keys, min_profit)


def entries(basket_fills: DataFrame) -> DataFrame:
    """First accepted fill per mode and pair.

    An open basket blocks its pair until both markets resolve, after which the pair cannot pay
    any more, so at most one basket per pair exists and a minimum is enough.
    """
    accepted = basket_fills.where(F.col("fill_status") != "rejected")
    return accepted.groupBy("mode", "pair_id").agg(
        F.min_by(F.struct("*"), "entry_time").alias("e")).select("e.*").withColumn(
        "basket_id", F.concat_ws(":", "mode", "pair_id"))


def attempt_counts(basket_fills: DataFrame, entered: DataFrame) -> DataFrame:
    """Per mode: orders sent. A rejected interval is retried at every observation in it."""
    first = entered.select("mode", "pair_id", F.col("entry_time").alias("_at"))
    joined = basket_fills.join(first, ["mode", "pair_id"], "left")
    before = F.col("_at").isNull() | (F.col("entry_time") < F.col("_at"))
    sent = F.when(before, F.col("observations")).when(F.col("entry_time") == F.col("_at"), 1).otherwise(0)
    rejected = F.when(before, F.col("observations")).otherwise(0)
    return joined.groupBy("mode").agg(F.sum(sent).alias("attempted"), F.sum(rejected).alias("rejected"))


def run(events: DataFrame, pairs: DataFrame, *modes: str, initial: float = 10_000.0,
        strategy: Callable[[DataFrame], DataFrame] | None = None,
        min_profit: float = fl.MIN_PROFIT, tolerance_seconds: float = op.STALE_SECONDS,
        **overrides) -> dict[str, DataFrame]:
    """All result tables of a backtest, one set of rows per execution mode.

    ``events`` are normalised event rows with a snapshot struct, ``pairs`` the validated pairs.
    """
    states = op.pair_states(op.quotes_of(events), pairs, keep=["snapshot"])
    intervals = materialize(op.with_observations(
        op.opportunity_intervals(states, tolerance_seconds), events).where(F.col("observations") > 0))
    legs, basket_fills = attempts(intervals, pairs, *modes, strategy=strategy,
                                  min_profit=min_profit, **overrides)
    entered = materialize(entries(basket_fills))  # few rows: at most one basket per pair and mode
    baskets = entered.withColumn("open_time", F.when(F.col("fill_status") == "filled", F.col("entry_time"))) \
        .withColumn("arb_type", F.lit("binary_pair"))
    basket_legs = legs.join(baskets.select("mode", "pair_id", "entry_time", "basket_id"),
                            ["mode", "pair_id", "entry_time"])
    positions = pf.positions_from_legs(basket_legs)
    settlements = pf.settle(positions, pf.first_resolutions(
        events.withColumns({"resolution_value": F.col("resolution_value").cast("double")})))
    closed = pf.close_baskets(baskets, positions, settlements)
    final_states = rp.latest_state(events)
    last = events.agg(F.max(F.unix_micros("ts"))).first()[0]
    forced = pf.value_open_baskets(baskets, closed, positions, final_states,
                                   F.timestamp_micros(F.lit(last).cast("long")))
    done = closed.unionByName(forced, allowMissingColumns=True)
    return {"intervals": intervals, "fills": basket_fills, "baskets": baskets, "legs": basket_legs,
            "positions": positions, "settlements": settlements, "closed": done,
            "attempts": attempt_counts(basket_fills, entered),
            "opportunities": intervals.agg(F.coalesce(F.sum("observations"), F.lit(0)).alias("opportunities")),
            "metrics": pf.basket_metrics(done, ["mode"]).withColumn(
                "final_equity", F.lit(initial) + F.col("total_realized_pnl"))}
