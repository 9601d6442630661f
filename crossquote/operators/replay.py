"""Time-ordered event tables: de-duplication, windows, latest state, as-of state.

An event row has seq (arrival number), platform, market_id, ts, event_type; quote events carry
a ``snapshot`` struct, resolution events resolution_outcome and resolution_value, trade prints
trade_outcome and trade_price.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossquote.operators import runs as rn

# Event vocabulary.
SNAPSHOT_EVENTS = ["market_created", "market_updated", "orderbook_snapshot"]
EVENT_TYPES = [*SNAPSHOT_EVENTS, "trade_print", "market_resolved"]
MARKET_STATUSES = ["active", "suspended", "resolved", "cancelled"]

KEY = ["platform", "market_id"]
ORDER = ["ts", "seq"]


def deduplicate(events: DataFrame, key: str = "event_id", arrival: str = "seq") -> DataFrame:
    """First arrival per id; an aggregate, so copies of one id combine before the shuffle."""
    row = F.struct("*")
    return (events.groupBy(key).agg(F.min_by(row, F.col(arrival)).alias("_r")).select("_r.*"))


def in_window(events: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Events with start <= ts <= end; a missing bound is open."""
    out = events
    if start is not None:
        out = out.where(F.col("ts") >= start)
    if end is not None:
        out = out.where(F.col("ts") <= end)
    return out


def replay_stream(events: DataFrame, start: Column | None = None, end: Column | None = None,
                  unique: bool = True) -> DataFrame:
    """De-duplicated, then windowed, then in time order (ties by arrival)."""
    first = deduplicate(events) if unique else events
    return in_window(first, start, end).orderBy(*ORDER)


def time_bounds(events: DataFrame) -> DataFrame:
    return events.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _is_quote() -> Column:
    return F.col("event_type").isin(SNAPSHOT_EVENTS)


def _state_parts(snapshot: Column, outcomes: Sequence[str], prints: bool) -> dict[str, Column]:
    parts = {
        "quote": F.when(_is_quote(), F.struct(
            F.col("ts").alias("snapshot_time"), F.col("seq").alias("snapshot_seq"),
            snapshot.alias("snapshot"))),
        "settled": F.when(F.col("event_type") == "market_resolved", F.struct(
            F.col("resolution_outcome").alias("outcome"),
            F.coalesce(F.col("resolution_value").cast("double"), F.lit(0.0)).alias("value"),
            F.col("ts").alias("time")))}
    if prints:
        for i, outcome in enumerate(outcomes):
            hit = ((F.col("event_type") == "trade_print") & (F.col("trade_outcome") == outcome)
                   & (F.col("trade_price") != 0))
            parts[f"print_{i}"] = F.when(hit, F.struct(
                "ts", "seq", F.col("trade_price").cast("double").alias("price")))
    return parts


def _state_columns(outcomes: Sequence[str], prints: bool) -> dict[str, Column]:
    columns = {
        "status": F.when(F.col("settled").isNotNull(), "resolved").otherwise("active"),
        "resolution_outcome": F.col("settled.outcome"), "resolution_value": F.col("settled.value"),
        "resolution_time": F.col("settled.time")}
    if prints:  # a print patches the standing snapshot; the next snapshot replaces it
        for i, outcome in enumerate(outcomes):
            printed = F.col(f"print_{i}")
            newer = F.struct(printed["ts"], printed["seq"]) > F.struct(
                F.col("quote.snapshot_time"), F.col("quote.snapshot_seq"))
            columns[f"last_{outcome.lower()}"] = F.when(F.col("quote").isNotNull(), F.coalesce(
                F.when(newer, printed["price"]),
                F.try_element_at(F.col("quote.snapshot.last_traded"), F.lit(outcome))))
    return columns


def latest_state(events: DataFrame, snapshot: str = "snapshot", outcomes: Sequence[str] = ("Yes", "No"),
                 prints: bool = True) -> DataFrame:
    """One row per market after all events, by aggregation only (no ordering of histories)."""
    parts = _state_parts(F.col(snapshot), outcomes, prints)
    at = F.struct(*ORDER)
    newest = [F.max_by(v, F.when(v.isNotNull(), at)).alias(n) for n, v in parts.items()]
    state = events.groupBy(*KEY).agg(*newest, F.max("ts").alias("last_update"),
                                     F.count("*").alias("events"))
    return (state.withColumns(_state_columns(outcomes, prints))
            .drop("settled", *[n for n in parts if n.startswith("print_")]))


def state_history(events: DataFrame, snapshot: str = "snapshot", outcomes: Sequence[str] = ("Yes", "No"),
                  prints: bool = True) -> DataFrame:
    """Every event row with the market's state right after it (skew-safe fill-forward)."""
    parts = _state_parts(F.col(snapshot), outcomes, prints)
    filled = rn.scan_last(rn.sorted_runs(events, KEY, ORDER), KEY, ORDER, parts)
    return (filled.withColumns(_state_columns(outcomes, prints))
            .drop(rn.RUN, "settled", *[n for n in parts if n.startswith("print_")]))


def state_as_of(events: DataFrame, probes: DataFrame, snapshot: str = "snapshot",
                outcomes: Sequence[str] = ("Yes", "No"), prints: bool = True) -> DataFrame:
    """State of a market at each probe (probe_id, platform, market_id, ts): events at ts count."""
    rows = events.withColumn("probe_id", F.lit(None).cast(probes.schema["probe_id"].dataType))
    asked = probes.select("probe_id", *KEY, "ts").withColumn("seq", F.lit((1 << 63) - 1))
    both = rows.unionByName(asked, allowMissingColumns=True).withColumn("_ask", F.coalesce(
        F.col("probe_id").cast("string"), F.lit("")))
    parts = _state_parts(F.col(snapshot), outcomes, prints)
    order = [*ORDER, "_ask"]
    filled = rn.scan_last(rn.sorted_runs(both, KEY, order), KEY, order, parts)
    return (filled.where(F.col("probe_id").isNotNull()).withColumns(_state_columns(outcomes, prints))
            .select("probe_id", *KEY, "ts", "quote", *_state_columns(outcomes, prints)))


def visible(states: DataFrame, now: Column, tolerance_seconds: float = 7 * 86400.0) -> DataFrame:
    """States a strategy may see at ``now``: quoted, not from the future, not stale while active."""
    quoted_at = F.col("quote.snapshot_time")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(quoted_at)) / F.lit(1e6)
    return states.where((quoted_at <= now) & ~((age > tolerance_seconds) & (F.col("status") == "active")))


def active_markets(states: DataFrame) -> DataFrame:
    return states.where(F.col("status") == "active")


def asof_pair_quotes(pairs: DataFrame, history: DataFrame) -> DataFrame:
    """(pair_id, ts, seq, price_a, price_b) at every tick of either market once both have a price."""
    ticks = history.select("platform", "market_id", "ts", "seq", "yes_price")
    sides = []
    for s in "ab":
        keyed = pairs.select("pair_id", F.col(f"platform_{s}").alias("platform"),
                             F.col(f"id_{s}").alias("market_id"))
        sides.append(ticks.join(keyed, KEY).select(
            "pair_id", "ts", "seq", F.lit(s).alias("side"), "yes_price"))
    both = sides[0].unionByName(sides[1])
    order = ["ts", "seq", "side"]
    filled = rn.scan_last(rn.sorted_runs(both, ["pair_id"], order), ["pair_id"], order, {
        f"price_{s}": F.when(F.col("side") == s, F.col("yes_price")) for s in "ab"})
    return (filled.where(F.col("price_a").isNotNull() & F.col("price_b").isNotNull())
            .select("pair_id", "ts", "seq", "side", "price_a", "price_b"))
