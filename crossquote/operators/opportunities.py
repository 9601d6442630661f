"""Opportunity intervals of validated pairs.

The state of a pair changes only when one of its two markets gets an event, so an
opportunity is kept as one interval row instead of one row per observation time; the number
of observation times inside it comes from a running count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossquote.operators import runs as rn
from crossquote.operators.replay import KEY, SNAPSHOT_EVENTS
from crossquote.session import materialize

# Fixed values.
MIN_NET_EDGE = 0.005
STALE_SECONDS = 7 * 86400.0


def ask(quotes: Column, outcome: str) -> Column:
    """Ask under the label, or under its lower-case form when missing or zero."""
    exact = F.try_element_at(quotes, F.lit(outcome))
    return F.coalesce(F.nullif(exact, F.lit(0.0)), F.try_element_at(quotes, F.lit(outcome.lower())))


def quotes_of(events: DataFrame) -> DataFrame:
    """Flat quote rows (ask_yes, ask_no, fees, quote_status) of events with a snapshot struct."""
    snap = F.col("snapshot")
    return events.select(
        "seq", *KEY, "ts", "event_type", ask(snap["best_ask"], "Yes").alias("ask_yes"),
        ask(snap["best_ask"], "No").alias("ask_no"), snap["fees"].alias("fees"),
        snap["status"].alias("quote_status"), snap.alias("snapshot"))


def pair_states(events: DataFrame, pairs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """State of both sides after every distinct event time of either market of a pair.

    One row per (pair_id, ts) with a, b (latest quote structs incl. ``keep`` columns), done_a,
    done_b (resolved) and ``until`` = the pair's next event time (null for the last).
    """
    kinds = [*SNAPSHOT_EVENTS, "market_resolved"]
    columns = ["ask_yes", "ask_no", "fees", "quote_status", *(keep or [])]
    useful = events.where(F.col("event_type").isin(kinds))
    sides = []
    for s in "ab":
        keyed = pairs.select("pair_id", F.col(f"platform_{s}").alias("platform"),
                             F.col(f"id_{s}").alias("market_id"))
        sides.append(useful.join(keyed, KEY).select(
            "pair_id", "ts", "seq", F.lit(s).alias("side"), "event_type",
            F.struct(F.col("ts").alias("snapshot_time"), *columns).alias("quote")))
    order = ["ts", "seq", "side"]
    runs = rn.sorted_runs(sides[0].unionByName(sides[1]), ["pair_id"], order)
    resolved = F.col("event_type") == "market_resolved"
    filled = rn.scan_last(runs, ["pair_id"], order, {
        **{s: F.when((F.col("side") == s) & ~resolved, F.col("quote")) for s in "ab"},
        **{f"done_{s}": F.when((F.col("side") == s) & resolved, F.lit(True)) for s in "ab"}})
    at = F.struct("seq", "side")
    settled = materialize(filled.groupBy("pair_id", "ts").agg(  # the next scan reads it twice
        *[F.max_by(c, at).alias(c) for c in ("a", "b", "done_a", "done_b")],
        F.max(rn.RUN).alias(rn.RUN)))
    return rn.scan_next(settled, ["pair_id"], ["ts"], {"until": F.col("ts")}).drop(rn.RUN)


def opportunity_intervals(states: DataFrame, tolerance_seconds: float = STALE_SECONDS,
                          min_net: float = MIN_NET_EDGE) -> DataFrame:
    """Intervals in which buying Yes on one side and No on the other pays.

    The first orientation (Yes on a, No on b) wins when it pays; both markets must be active.
    ``visible_until`` is the last instant at which neither quote is stale.
    """
    a, b = F.col("a"), F.col("b")
    fees = a["fees"] + b["fees"]
    net1 = 1.0 - (a["ask_yes"] + b["ask_no"]) - fees
    net2 = 1.0 - (a["ask_no"] + b["ask_yes"]) - fees
    first, second = F.coalesce(net1 > min_net, F.lit(False)), F.coalesce(net2 > min_net, F.lit(False))
    live = (a.isNotNull() & b.isNotNull() & F.col("done_a").isNull() & F.col("done_b").isNull()
            & (a["quote_status"] == "active") & (b["quote_status"] == "active"))
    age = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(tolerance_seconds))
    pick = lambda x, y: F.when(first, x).otherwise(y)
    return (states.where(live & (first | second)).select(
        "pair_id", F.col("ts").alias("from_ts"), "until",
        (F.least(a["snapshot_time"], b["snapshot_time"]) + age).alias("visible_until"),
        pick(F.lit("Yes"), F.lit("No")).alias("outcome_a"),
        pick(a["ask_yes"], a["ask_no"]).alias("price_a"),
        pick(F.lit("No"), F.lit("Yes")).alias("outcome_b"),
        pick(b["ask_no"], b["ask_yes"]).alias("price_b"),
        fees.alias("estimated_fees"), pick(net1, net2).alias("net_edge"), "a", "b")
        .where(F.col("from_ts") <= F.col("visible_until")))


def with_observations(intervals: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``observations``: distinct replay times inside the interval.

    A replay observes after every distinct event time except the last one.
    """
    times = events.select("ts").distinct()
    total = events.select("ts").distinct().count()
    edges = (intervals.select(F.col("from_ts").alias("ts"))
             .union(intervals.select("until")).union(intervals.select("visible_until")))
    counted = rn.count_until(times, edges, "ts")
    out = intervals
    for name in ("from_ts", "until", "visible_until"):
        out = out.join(counted.select(F.col("ts").alias(name), F.col("n_until").alias(f"_{name}")),
                       name, "left")
    end = F.least(F.coalesce(F.col("_until") - 1, F.lit(total)), F.col("_visible_until"), F.lit(total - 1))
    return (out.withColumn("observations", F.greatest(end - F.col("_from_ts") + 1, F.lit(0).cast("long")))
            .drop("_from_ts", "_until", "_visible_until"))


def exhaustive_baskets(outcome_asks: DataFrame, group: str, expected: str | None = None,
                       fee: float = 0.0) -> DataFrame:
    """Groups of mutually exclusive outcomes whose best asks plus fees cost less than 1.

    ``outcome_asks``: group, outcome, ask. The best ask per outcome is taken first. With
    ``expected`` (a column holding the outcome count) incomplete groups are excluded.
    """
    best = outcome_asks.groupBy(group, "outcome").agg(
        F.min("ask").alias("ask"), *([F.max(expected).alias("_need")] if expected else []))
    total = best.groupBy(group).agg(
        F.count("*").alias("outcomes"), F.sum(F.col("ask") * (1.0 + fee)).alias("cost"),
        *([F.max("_need").alias("_need")] if expected else []))
    if expected:
        total = total.where(F.col("outcomes") == F.col("_need")).drop("_need")
    return total.where(F.col("cost") < 1.0).withColumn("edge", 1.0 - F.col("cost"))
