"""Order fills: book walks, slippage and fee rules, basket roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# mode -> fee bps, slippage bps, latency ms, filled fraction
MODES = {
    "optimistic": (50.0, 0.0, 0.0, 1.0),
    "realistic": (100.0, 50.0, 200.0, 0.9),
    "pessimistic": (200.0, 150.0, 500.0, 0.7),
}
MIN_TRADE_SIZE = 1.0
MAX_BASKET_SIZE = 500.0
MIN_PROFIT = 0.005
# ----------------------------------------------------------- end of fixed values


def mode_params(*modes: str, fee_bps: float | None = None, slippage_bps: float | None = None,
                latency_ms: float | None = None) -> Column:
    """array<struct> of execution parameters; explode it instead of joining a table."""
    rows = []
    for mode in modes or MODES:
        fee, slip, delay, part = MODES[mode]
        pick = lambda given, default: F.lit(float(default if given is None else given))
        rows.append(F.struct(
            F.lit(mode).alias("mode"), pick(fee_bps, fee).alias("fee_bps"),
            pick(slippage_bps, slip).alias("slippage_bps"), pick(latency_ms, delay).alias("latency_ms"),
            F.lit(part).alias("fill_fraction")))
    return F.array(*rows)


def per_mode(df: DataFrame, *modes: str, **overrides) -> DataFrame:
    """Each row once per execution mode, with the parameters as columns."""
    exploded = df.withColumn("_m", F.explode(mode_params(*modes, **overrides)))
    return exploded.select(*df.columns, "_m.*")


def book_walk(levels: DataFrame, leg: str = "leg_id", price: str = "price", size: str = "size",
              requested: str = "requested") -> DataFrame:
    """Fill of each leg against its book rows: (leg, filled, avg_price, cost).

    Levels of equal price are merged first (map-side), so a leg enters its window with one
    row per price tick, however many rows its book has.
    """
    ticks = levels.groupBy(leg, price).agg(F.sum(size).alias("_size"), F.max(requested).alias("_want"))
    before = Window.partitionBy(leg).orderBy(price).rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum("_size").over(before), F.lit(0.0))
    take = F.greatest(F.least(F.col("_want") - depth, F.col("_size")), F.lit(0.0))
    walked = ticks.withColumn("_take", take)
    return walked.groupBy(leg).agg(
        F.sum("_take").alias("filled"),
        F.try_divide(F.sum(F.col("_take") * F.col(price)), F.sum("_take")).alias("avg_price"),
        F.sum(F.col("_take") * F.col(price)).alias("cost"))


def walk_levels(levels: Column, wanted: Column, selling: Column) -> Column:
    """struct(filled, cost) of one order against a short array of (price, size) levels."""
    asc = F.array_sort(F.transform(levels, lambda lv: F.struct(lv["price"].alias("price"), lv["size"].alias("size"))))
    start = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("cost"))

    def step(acc, lv):
        take = F.greatest(F.least(wanted - acc["filled"], lv["size"]), F.lit(0.0))
        return F.struct((acc["filled"] + take).alias("filled"),
                        (acc["cost"] + take * lv["price"]).alias("cost"))

    return F.aggregate(F.when(selling, F.reverse(asc)).otherwise(asc), start, step)


def _truthy(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def fill_legs(legs: DataFrame) -> DataFrame:
    """Adds fill_price, filled_size, slippage_cost, fee and leg_status.

    ``legs``: side (buy/sell), requested_size, best_price, last_price, levels
    (array<struct<price,size>>, may be empty), platform_fee and the parameters of ``per_mode``.
    The fee is charged on the requested size.
    """
    sell = F.col("side") == "sell"
    want = F.col("requested_size")
    slip = F.col("slippage_bps") / 10_000.0

    def worse(price, rate):
        return F.when(sell, F.greatest(F.lit(0.001), price * (1.0 - rate))).otherwise(
            F.least(F.lit(0.999), price * (1.0 + rate)))

    base = F.coalesce(_truthy(F.col("best_price")), _truthy(F.col("last_price")), F.lit(0.5))
    depth = F.coalesce(F.size("levels"), F.lit(0)) > 0
    staged = legs.withColumn("_base", base).withColumn(
        "_walk", F.when(depth, walk_levels(F.col("levels"), want, sell)))
    filled, b = F.col("_walk.filled"), F.col("_base")
    staged = staged.withColumns({
        "_price": F.when(F.col("_walk").isNull(), worse(b, slip)).otherwise(
            F.coalesce(F.try_divide(F.col("_walk.cost"), filled), b)),
        "_size": F.when(F.col("_walk").isNull(), want).otherwise(filled)})
    staged = staged.withColumn("_cost", F.abs(F.col("_price") - b) * F.col("_size"))
    harsh = worse(F.col("_price"), slip * 2.0)
    harsh_size = F.col("_size") * F.col("fill_fraction")
    unit = F.when(want > 0, F.try_divide(F.col("_cost"), want)).otherwise(harsh)
    by_mode = lambda easy, normal, hard: F.when(F.col("mode") == "optimistic", easy).when(
        F.col("mode") == "realistic", normal).otherwise(hard)
    done = staged.withColumns({
        "fill_price": by_mode(b, F.col("_price"), harsh),
        "filled_size": by_mode(want, F.col("_size"), harsh_size),
        "slippage_cost": by_mode(F.lit(0.0), F.col("_cost"),
                                 F.col("_cost") + F.abs(harsh - unit) * harsh_size)})
    rate = F.greatest(F.coalesce("platform_fee", F.lit(0.0)), F.col("fee_bps") / 10_000.0)
    none = F.col("filled_size") <= 0
    return done.withColumns({
        "fee": F.when(none, 0.0).otherwise(F.round(rate * (F.col("fill_price") * want), 6)),
        "slippage_cost": F.when(none, 0.0).otherwise(F.col("slippage_cost")),
        "leg_status": F.when(none, "rejected").when(
            F.abs(F.col("filled_size") - want) < 1e-6, "filled").otherwise("partial"),
    }).drop("_base", "_walk", "_price", "_size", "_cost")


def action_rejection(legs: DataFrame, min_size: float = MIN_TRADE_SIZE,
                     max_size: float = MAX_BASKET_SIZE) -> Column:
    """First reason a leg cannot be sent: unknown or inactive market, size out of range."""
    key = F.concat_ws("::", "platform", "market_id")
    size = F.col("requested_size")
    return (F.when(F.col("market_status").isNull(), F.concat(F.lit("Unknown market: "), key))
            .when(F.col("market_status") != "active", F.concat(F.lit("Market not active: "), key))
            .when(size < min_size, F.lit("size below minimum"))
            .when(size > max_size, F.lit("size exceeds maximum")))


def fill_baskets(legs: DataFrame, keys: list[str], min_profit: float = MIN_PROFIT) -> DataFrame:
    """Roll filled legs up to one row per basket (a handful of legs each).

    A fully filled basket whose expected profit is below ``min_profit`` of its locked capital
    is rejected; so is a basket without any filled leg when a leg failed.
    """
    status = F.col("leg_status")
    got = status != "rejected"
    cost = F.sum(F.when(got, F.col("fill_price") * F.col("filled_size")).otherwise(0.0))
    rolled = legs.groupBy(*keys).agg(
        F.count("*").alias("legs"), F.count_if(status == "filled").alias("_full"),
        F.count_if(status == "partial").alias("_part"), F.count_if(~got).alias("_none"),
        cost.alias("locked_capital"), F.sum("fee").alias("total_fees"),
        F.sum("slippage_cost").alias("total_slippage"),
        F.coalesce(F.max(F.when(status == "filled", F.col("filled_size"))), F.lit(0.0)).alias("_payout"))
    profit = F.col("_payout") - F.col("locked_capital") - F.col("total_fees")
    overall = (F.when((F.col("_none") > 0) & (F.col("_full") == 0), "rejected")
               .when((F.col("_none") > 0) | (F.col("_part") > 0), "partial").otherwise("filled"))
    low = (overall == "filled") & (profit < min_profit * F.col("locked_capital"))
    return (rolled.withColumn("expected_profit", profit)
            .withColumn("fill_status", F.when(low, "rejected").otherwise(overall))
            .withColumn("rejection", F.when(low, "profit below threshold")
                        .when(overall == "rejected", "no liquidity"))
            .drop("_full", "_part", "_none", "_payout"))


def basket_state(fill_status: Column) -> Column:
    """Basket status right after its fill; null when nothing was opened."""
    return F.when(fill_status == "partial", "partial").when(fill_status == "filled", "open")
