"""Settlement, basket profit, performance metrics and curves.

Tables: positions (position_id, basket_id, platform, market_id, outcome, side, size,
entry_price, entry_time), resolutions (platform, market_id, outcome, value, time), baskets
(basket_id, locked_capital, total_fees, open_time), closed baskets (+ realized_pnl, close_time),
fills (fill_status, total_fees, total_slippage, locked_capital, fill_time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossquote.operators import runs as rn

MIN_SHARPE_ROWS = 3  # fixed value


def positions_from_legs(legs: DataFrame) -> DataFrame:
    """Open position per filled or partially filled leg."""
    keep = (F.col("leg_status").isin("filled", "partial") & F.col("fill_price").isNotNull()
            & (F.col("filled_size") > 0))
    return legs.where(keep).select(
        F.concat_ws("/", "basket_id", "leg_no").alias("position_id"), "basket_id", "platform",
        "market_id", "outcome", "side", F.col("filled_size").alias("size"),
        F.col("fill_price").alias("entry_price"), "entry_time", "leg_status")


def first_resolutions(events: DataFrame) -> DataFrame:
    """First resolution per market, by aggregation."""
    row = F.struct(F.col("resolution_outcome").alias("outcome"),
                   F.coalesce(F.col("resolution_value").cast("double"), F.lit(0.0)).alias("value"),
                   F.col("ts").alias("time"))
    return (events.where(F.col("event_type") == "market_resolved").groupBy("platform", "market_id")
            .agg(F.min_by(row, F.struct("ts", "seq")).alias("r"))
            .select("platform", "market_id", "r.*"))


def settle(positions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Payout rows of positions in resolved markets: value on the named outcome, else 1 - value."""
    won = F.col("outcome") == F.col("resolution_outcome")
    per_share = F.when(won, F.col("resolution_value")).otherwise(1.0 - F.col("resolution_value"))
    named = resolutions.select("platform", "market_id", F.col("outcome").alias("resolution_outcome"),
                               F.col("value").alias("resolution_value"),
                               F.col("time").alias("settlement_time"))
    return (positions.join(named, ["platform", "market_id"])
            .withColumn("payout_per_share", per_share)
            .withColumn("net_payout", F.col("payout_per_share") * F.col("size")))


def close_baskets(baskets: DataFrame, positions: DataFrame, settlements: DataFrame) -> DataFrame:
    """Baskets whose every position has settled, with realised profit and closing time."""
    paid = settlements.groupBy("basket_id").agg(
        F.sum("net_payout").alias("payout"), F.max("settlement_time").alias("close_time"),
        F.count("*").alias("_settled"))
    held = positions.groupBy("basket_id").agg(F.count("*").alias("_held"))
    done = paid.join(held, "basket_id").where(F.col("_settled") == F.col("_held"))
    pnl = F.col("payout") - F.col("locked_capital") - F.col("total_fees")
    return (baskets.join(done.drop("_settled", "_held"), "basket_id")
            .withColumn("realized_pnl", pnl).withColumn("status", F.lit("closed")))


def mid_price(snapshot: Column, outcome: Column) -> Column:
    bid, ask = F.try_element_at(snapshot["best_bid"], outcome), F.try_element_at(snapshot["best_ask"], outcome)
    return F.coalesce((bid + ask) / 2, F.try_element_at(snapshot["last_traded"], outcome))


def visible_size(levels: Column, outcome: Column) -> Column:
    return F.aggregate(F.coalesce(F.try_element_at(levels, outcome), F.array().cast(
        "array<struct<price:double,size:double>>")), F.lit(0.0), lambda acc, lv: acc + lv["size"])


def unrealised(positions: DataFrame, states: DataFrame) -> DataFrame:
    """Positions marked at the current mid price (entry price when the market has no quote)."""
    quotes = states.select("platform", "market_id", F.col("quote.snapshot").alias("_s"))
    marked = positions.join(quotes, ["platform", "market_id"], "left").withColumn(
        "current_price", F.coalesce(mid_price(F.col("_s"), F.col("outcome")), F.col("entry_price")))
    move = F.col("current_price") - F.col("entry_price")
    return marked.withColumn("unrealized_pnl", F.col("size") * F.when(
        F.col("side") == "sell", -move).otherwise(move)).drop("_s")


def value_open_baskets(baskets: DataFrame, closed: DataFrame, positions: DataFrame,
                       states: DataFrame, at: Column) -> DataFrame:
    """Still-open baskets closed at mid price of their fully filled legs."""
    quotes = states.select("platform", "market_id", F.col("quote.snapshot").alias("_s"))
    legs = positions.where(F.col("leg_status") == "filled").join(
        quotes, ["platform", "market_id"], "left")
    mark = F.when(F.col("_s").isNotNull(), F.coalesce(mid_price(F.col("_s"), F.col("outcome")), F.lit(0.0))) \
        .otherwise(F.col("entry_price"))
    worth = legs.groupBy("basket_id").agg(F.sum(mark * F.col("size")).alias("payout"))
    still = baskets.join(closed.select("basket_id"), "basket_id", "left_anti").join(worth, "basket_id", "left")
    value = F.coalesce("payout", F.lit(0.0))
    return (still.withColumn("payout", value).withColumn("close_time", at.cast("timestamp"))
            .withColumn("realized_pnl", value - F.col("locked_capital") - F.col("total_fees"))
            .withColumn("status", F.lit("closed")))


# ---------------------------------------------------------------- metrics

def fill_metrics(fills: DataFrame) -> DataFrame:
    status = F.col("fill_status")
    n, full = F.count("*"), F.count_if(status == "filled")
    return fills.agg(
        n.alias("attempted"), full.alias("filled"), F.count_if(status == "partial").alias("partial"),
        F.coalesce(F.try_divide(full, n), F.lit(0.0)).alias("fill_rate"),
        F.coalesce(F.sum("total_slippage"), F.lit(0.0)).alias("total_slippage"),
        F.coalesce(F.max(F.when(status == "filled", F.col("locked_capital"))), F.lit(0.0))
        .alias("max_locked_capital"))


def basket_metrics(closed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Win rate, average profit, holding hours and Sharpe ratio of closed baskets."""
    pnl, locked = F.coalesce("realized_pnl", F.lit(0.0)), F.col("locked_capital")
    ret = F.when(locked > 0, pnl / locked)
    hours = (F.unix_micros(F.col("close_time").cast("timestamp"))
             - F.unix_micros(F.col("open_time").cast("timestamp"))) / F.lit(3_600_000_000.0)
    n = F.count("*")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    spread = F.stddev_pop(ret)
    return closed.groupBy(*(by or [])).agg(
        n.alias("closed_baskets"), zero(F.sum(pnl)).alias("total_realized_pnl"),
        zero(F.avg(F.when(pnl > 0, 1.0).otherwise(0.0))).alias("win_rate"),
        zero(F.avg(pnl)).alias("avg_profit"), zero(F.avg(hours)).alias("avg_holding_hours"),
        F.when((F.count(ret) >= MIN_SHARPE_ROWS) & (spread > 0), F.try_divide(F.avg(ret), spread))
        .alias("sharpe"))


def profit_by_type(closed: DataFrame, only_closed_status: bool = False) -> DataFrame:
    rows = closed.where(F.col("status") == "closed") if only_closed_status else closed
    return rows.where(F.col("realized_pnl").isNotNull()).groupBy("arb_type").agg(
        F.sum("realized_pnl").alias("realized_pnl"))


def fill_status_counts(fills: DataFrame) -> DataFrame:
    return fills.groupBy("fill_status").agg(F.count("*").alias("n"))


def holding_hours(closed: DataFrame) -> DataFrame:
    seconds = F.unix_micros(F.col("close_time").cast("timestamp")) - F.unix_micros(
        F.col("open_time").cast("timestamp"))
    return closed.select("basket_id", F.round(seconds / F.lit(3_600_000_000.0), 2).alias("hours")).where(
        F.col("hours").isNotNull())


def holding_bins(closed: DataFrame, width_hours: float = 24.0) -> DataFrame:
    start = F.floor(F.col("hours") / width_hours) * width_hours
    return holding_hours(closed).groupBy(start.cast("double").alias("bin_start")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- curves

_CURVE = ["close_time", "basket_id"]


def _closed_runs(closed: DataFrame) -> DataFrame:
    rows = closed.where(F.col("close_time").isNotNull()).select(
        *_CURVE, F.coalesce("realized_pnl", F.lit(0.0)).alias("pnl"))
    return rn.sorted_runs(rows, [], _CURVE)


def equity_curve(closed: DataFrame, initial: float) -> DataFrame:
    """(close_time, basket_id, equity) after every close in closing order."""
    curve = rn.scan_sum(_closed_runs(closed), [], _CURVE, {"total": F.col("pnl")})
    return curve.select(*_CURVE, (F.lit(initial) + F.col("total")).alias("equity"))


def equity_chart(closed: DataFrame, initial: float, start: Column, end: Column) -> DataFrame:
    """(step, at, equity): start point, every close, end point; steps order the points."""
    runs = rn.scan_index(_closed_runs(closed), [], _CURVE, "step")
    curve = rn.scan_sum(runs, [], _CURVE, {"total": F.col("pnl")}).select(
        "step", F.col("close_time").cast("timestamp").alias("at"),
        F.round(F.lit(initial) + F.col("total"), 4).alias("equity"))
    ends = closed.agg(F.coalesce(F.sum("realized_pnl"), F.lit(0.0)).alias("t"), F.count("close_time").alias("n"))
    first = ends.select(F.lit(0).cast("long").alias("step"), start.cast("timestamp").alias("at"),
                        F.lit(initial).alias("equity"))
    last = ends.select((F.col("n") + 1).alias("step"), end.cast("timestamp").alias("at"),
                       F.round(F.lit(initial) + F.col("t"), 4).alias("equity"))
    return first.unionByName(curve).unionByName(last)


def drawdown(closed: DataFrame, initial: float) -> DataFrame:
    """Running equity, peak (never below the start capital) and relative drawdown per close."""
    runs = rn.scan_sum(_closed_runs(closed), [], _CURVE, {"total": F.col("pnl")})
    runs = runs.withColumn("equity", F.lit(initial) + F.col("total"))
    peaked = rn.scan_max(runs, [], _CURVE, {"top": F.col("equity")})
    peak = F.greatest(F.col("top"), F.lit(initial))
    fall = F.when(peak > 0, (peak - F.col("equity")) / peak).otherwise(0.0)
    return peaked.select(*_CURVE, "equity", peak.alias("peak"), fall.alias("drawdown"))


def max_drawdown(closed: DataFrame, initial: float) -> DataFrame:
    return drawdown(closed, initial).agg(
        F.coalesce(F.max("drawdown"), F.lit(0.0)).alias("max_drawdown"))


def cumulative_fees(fills: DataFrame, id_col: str = "basket_id") -> DataFrame:
    """(fill_time, id, cumulative_fees) in fill order."""
    order = ["fill_time", id_col]
    runs = rn.sorted_runs(fills.select(*order, "total_fees"), [], order)
    return rn.scan_sum(runs, [], order, {"total": F.col("total_fees")}).select(
        *order, F.round("total", 6).alias("cumulative_fees"))


def sampled_equity(curve: DataFrame, order: list[str], every: int = 10) -> DataFrame:
    """Every ``every``-th point of a step panel, starting with the first."""
    runs = rn.scan_index(rn.sorted_runs(curve, [], order), [], order, "_step")
    return runs.where((F.col("_step") - 1) % every == 0).drop("_step", rn.RUN)


def ledger(fills: DataFrame, closed: DataFrame, initial: float) -> DataFrame:
    """Cash and locked capital after every booking: (at, basket_id, kind, cash, locked).

    A fill moves its cost from cash to locked; a close releases it, pays out and charges the fees.
    """
    opened = fills.where(F.col("fill_status") != "rejected").select(
        F.col("fill_time").cast("timestamp").alias("at"), "basket_id", F.lit("fill").alias("kind"),
        (-F.col("locked_capital")).alias("d_cash"), F.col("locked_capital").alias("d_locked"))
    ended = closed.select(
        F.col("close_time").cast("timestamp").alias("at"), "basket_id", F.lit("settle").alias("kind"),
        (F.col("payout") - F.col("total_fees")).alias("d_cash"),
        (-F.col("locked_capital")).alias("d_locked"))
    order = ["at", "basket_id", "kind"]
    runs = rn.sorted_runs(opened.unionByName(ended), [], order)
    booked = rn.scan_sum(runs, [], order, {"_cash": F.col("d_cash"), "locked": F.col("d_locked")})
    return booked.select(*order, (F.lit(initial) + F.col("_cash")).alias("cash"), "locked")


def open_counts(baskets: DataFrame, limit: int | None = None) -> DataFrame:
    """Open baskets after every open or close; ``over_limit`` reports a concurrency cap."""
    opened = baskets.select(F.col("open_time").alias("at"), "basket_id", F.lit(1).alias("change"))
    ended = baskets.where(F.col("close_time").isNotNull()).select(
        F.col("close_time").alias("at"), "basket_id", F.lit(-1).alias("change"))
    order = ["at", "change", "basket_id"]  # closings first within one instant
    runs = rn.sorted_runs(opened.unionByName(ended), [], order)
    out = rn.scan_sum(runs, [], order, {"open_baskets": F.col("change").cast("long")}).drop(rn.RUN)
    return out.withColumn("over_limit", F.col("open_baskets") > limit) if limit else out


def summary(fill_row: DataFrame, basket_row: DataFrame, drawdown_row: DataFrame,
            initial: float) -> DataFrame:
    """One flat rounded row of all metrics (three one-row inputs)."""
    keyed = [row.withColumn("_one", F.lit(1)) for row in (fill_row, basket_row, drawdown_row)]
    joined = keyed[0].join(keyed[1], "_one").join(keyed[2], "_one").drop("_one")
    digits = {"fill_rate": 4, "total_slippage": 4, "max_locked_capital": 4, "total_realized_pnl": 4,
              "win_rate": 4, "avg_profit": 6, "avg_holding_hours": 2, "sharpe": 4, "max_drawdown": 4}
    return joined.withColumn("final_equity", F.round(F.lit(initial) + F.col("total_realized_pnl"), 4)) \
        .withColumns({c: F.round(c, d) for c, d in digits.items()})
