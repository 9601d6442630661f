"""Read queries over stored candidates, signals and opportunities."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from crossquote.functions import pricing as px
from crossquote.functions.text import topic_words
from crossquote.session import materialize, stored

# ---------------------------------------------------------------- fixed values
DIVERSITY = 0.65
ENTRY_LOOKBACK_DAYS = 30
CURVE_DAYS = 365
SCORE_BANDS = (0.80, 0.85, 0.90)
FIRST_REACH = 1 / 16  # of the signals; each further reach takes twice as many at least
# ----------------------------------------------------------- end of fixed values


def top_candidates(pairs: DataFrame, min_score: float = 0.70, *, limit: int) -> DataFrame:
    return pairs.where(F.col("similarity") >= min_score).orderBy(
        F.desc("similarity"), "candidate_id").limit(limit)


def top_signals(signals: DataFrame, texts: DataFrame | None = None, *, min_ev: float = 0.0,
                min_confidence: float = 0.0, platform: str | None = None, limit: int,
                diversity: float | None = None, pool: int | None = None) -> DataFrame:
    """Best signals by expected profit, with question texts; with a ``diversity`` diversified among the ``pool`` best (None: all).

    ``texts``: pair_id, text_a, text_b. The limit, or the pool, is applied before the text join.
    """
    rows = signals
    if min_ev > 0:
        rows = rows.where(F.col("expected_profit") >= min_ev)
    if min_confidence > 0:
        rows = rows.where(F.col("confidence") >= min_confidence)
    if platform:
        rows = rows.where((F.col("platform_a") == platform) | (F.col("platform_b") == platform))
    if diversity is not None:
        return diversify(rows, limit, pool=pool, weight=diversity, texts=texts)
    best = rows.orderBy(F.desc("expected_profit"), "pair_id").limit(limit)
    if texts is not None:
        best = best.join(texts.select("pair_id", "text_a", "text_b"), "pair_id", "left").fillna(
            "", ["text_a", "text_b"])
    return best.orderBy(F.desc("expected_profit"), "pair_id")


def top_validated(validated: DataFrame, executable_only: bool = False, *, limit: int) -> DataFrame:
    rows = validated.where("executable") if executable_only else validated
    return rows.orderBy(F.desc("expected_profit"), "pair_id").limit(limit)


def _id_order(pair: str | None) -> tuple:
    """Null ids first, as Spark orders them."""
    return pair is not None, pair


def _greedy(block: Sequence[Row], wanted: int, weight: float, next_best: tuple | None, floor: float) -> tuple[list[Row], list[float]]:
    """(picks, scores of the others) from ``block``, rows with their overlap with earlier picks, while no row outside can be better.

    Scores only fall as more is picked, so ``next_best``, the key of the best row that was scored but is not in the block, bounds all of
    those, and ``floor`` those that were not scored.
    """
    words = [set(r["words"]) for r in block]
    overlap = [r["overlap"] for r in block]
    place = {pair: n for n, pair in enumerate(sorted((r["pair_id"] for r in block), key=_id_order))}
    left, chosen = set(range(len(block))), []
    score = lambda i: block[i]["gain"] - (1.0 - weight) * overlap[i]
    while left and len(chosen) < wanted:
        best = max(left, key=lambda i: (score(i), block[i]["expected_profit"], -place[block[i]["pair_id"]]))
        row = block[best]
        if score(best) < floor:
            break
        if next_best is not None:
            mine = (score(best), row["expected_profit"])
            if mine < next_best[:2] or mine == next_best[:2] and _id_order(row["pair_id"]) > _id_order(next_best[2]):
                break
        chosen.append(row)
        left.discard(best)
        for i in left:
            overlap[i] = max(overlap[i], len(words[i] & words[best]) / len(words[i] | words[best]))
    return chosen, sorted(map(score, left), reverse=True)


def diversify(signals: DataFrame, limit: int, *, pool: int | None, weight: float = DIVERSITY, block: int = 1000,
              texts: DataFrame | None = None) -> DataFrame:
    """Adds ``pick`` (1..limit) by maximal marginal relevance over topic words, among the ``pool`` best signals (None: all).

    Lazy greedy: without any overlap a signal scores its gain, a share of its profit, and while more is picked scores can only fall. A round
    scores in Spark, against the picks so far, the signals whose gain reaches what the signals at hand still score, and takes the ``block`` best of
    them to the driver; picks go on there as long as they beat the best signal outside. Each round picks at least one, usually many.
    Texts (pair_id, text_a, text_b; else columns of ``signals``) are joined once to a signal, when its gain comes within reach, and its words are
    written: the first reach is ``FIRST_REACH`` of the signals, each further one twice as many, so texts are joined a few times at most, not in
    every round. Equal scores go by profit, then by pair_id. Signals without a profit are never picked.
    """
    have = [c for c in ("text_a", "text_b") if c in signals.columns]
    rows = signals if pool is None else signals.orderBy(F.desc("expected_profit"), "pair_id").limit(pool)
    # what a choice needs is written once; the other columns are looked up for the picks
    rows = rows if pool is None else materialize(rows)
    narrow = materialize(rows.select("pair_id", "expected_profit", *have))
    total, top = narrow.agg(F.count("expected_profit"), F.max("expected_profit")).first()
    gain = F.lit(weight) * F.col("expected_profit") / F.lit(float(top) if top is not None and top > 0 else 1.0)
    keyed = narrow.select("pair_id", "expected_profit", *have, gain.alias("gain"))
    lowest = float("-inf")

    def texts_of(some: DataFrame) -> DataFrame:
        """The semi join goes below the joins that make ``texts``, so that other signals' texts are not made or moved."""
        return texts.select("pair_id", "text_a", "text_b").join(some, "pair_id", "left_semi")

    def with_words(some: DataFrame) -> DataFrame:
        if texts is not None:
            some = some.drop(*have).join(texts_of(some.select("pair_id")), "pair_id", "left")
        named = [F.col(c) for c in ("text_a", "text_b") if c in some.columns] or [F.lit("")]
        words = topic_words(*named)
        return some.select("pair_id", "expected_profit", "gain", F.when(F.size(words) > 0, words).otherwise(F.array("pair_id")).alias("words"))

    share, cuts = max(FIRST_REACH, 16 * block / max(total, 1)), []  # gains at which a reach may end, from high to low
    while share < 1:
        cuts.append(1 - share)
        share *= 2
    cuts = keyed.agg(F.percentile_approx("gain", cuts)).first()[0] if cuts else []
    further = lambda floor: max((c for c in cuts if c <= floor), default=lowest)
    reached, reach = [], None

    def in_reach(floor: float) -> DataFrame:
        """Signals with a gain of ``floor`` or more, with their words."""
        nonlocal reach
        if reach is None or floor < reach:
            low = further(floor)
            new = keyed.where(F.col("gain") >= low) if reach is None else keyed.where((F.col("gain") >= low) & (F.col("gain") < reach))
            reached.append(stored(with_words(stored(new))))
            reach = low
        return functools.reduce(DataFrame.unionByName, reached).where(F.col("gain") >= floor)

    spark, picked, floor = signals.sparkSession, [], further(float("inf"))
    while len(picked) < limit:
        near = in_reach(floor)
        if not picked:
            scored = near.withColumns({"overlap": F.lit(0.0), "score": F.col("gain")})
        else:
            sets = F.broadcast(spark.createDataFrame([([r["words"] for r in picked], [r["pair_id"] for r in picked])],
                                                     "sets array<array<string>>, gone array<string>"))  # at most ``limit`` sets
            shared = lambda w: F.size(F.array_intersect("words", w)) / F.size(F.array_union("words", w))
            near = near.crossJoin(sets).where(~F.exists("gone", lambda g: g.eqNullSafe(F.col("pair_id"))))
            scored = near.withColumn("overlap", F.array_max(F.transform("sets", shared)))
            scored = scored.withColumn("score", F.col("gain") - F.lit(1.0 - weight) * F.col("overlap"))
        best = scored.select("pair_id", "expected_profit", "words", "gain", "overlap", "score").orderBy(
            F.desc("score"), F.desc("expected_profit"), "pair_id").limit(block + 1).collect()
        rest = best[block] if len(best) > block else None
        chosen, others = _greedy(best[:block], limit - len(picked), weight, rest and (rest["score"], rest["expected_profit"], rest["pair_id"]), floor)
        picked += chosen
        if chosen and others:
            # with as many signals at hand as are wanted, no signal below the last of them is needed yet
            floor = others[max(min(limit - len(picked), len(others)) - 1, 0)]
        elif not chosen:
            if floor == lowest:
                break  # none are left
            floor = max((c for c in cuts if c < floor), default=lowest)
    order = spark.createDataFrame([(r["pair_id"], n) for n, r in enumerate(picked, 1)], "pair_id string, pick int")
    out = rows.join(F.broadcast(order), "pair_id")
    return out if texts is None else out.drop(*have).join(texts_of(F.broadcast(order.select("pair_id"))), "pair_id", "left").fillna("", ["text_a", "text_b"])


def signal_stats(signals: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return signals.agg(
        F.count("*").alias("total"), F.round(zero(F.sum("expected_profit")), 2).alias("total_ev"),
        F.round(zero(F.max("expected_profit")), 2).alias("top_ev"),
        F.round(zero(F.avg("confidence")), 4).alias("avg_confidence"),
        F.round(zero(F.avg("raw_spread")), 4).alias("avg_spread"))


def funnel(**stages: DataFrame) -> DataFrame:
    """(stage, n) of each named table, in the given order of columns."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        row = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("status", F.when(F.col("n") > 0, "done").otherwise("pending"))


def score_distribution(pairs: DataFrame, bands: Sequence[float] = SCORE_BANDS,
                       by: Sequence[str] = ()) -> DataFrame:
    """Count, min, max, counts above each band, negation and price-gap counts."""
    have = set(pairs.columns)
    extra = []
    if "has_negation" in have:
        extra.append(F.count_if("has_negation").alias("negated"))
    if {"price_a", "price_b"} <= have:
        extra.append(F.count_if(F.abs(F.col("price_a") - F.col("price_b")) > 0.05).alias("wide_price_gap"))
    return pairs.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.min("similarity").alias("min_score"),
        F.max("similarity").alias("max_score"),
        *[F.count_if(F.col("similarity") >= b).alias(f"at_least_{round(b * 100)}") for b in bands], *extra)


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 per threshold of rows (score, is_match), optionally per group.

    One pass: every threshold is a conditional count, then the counts are unpivoted.
    """
    positive = F.count_if("is_match")
    counts = scored.groupBy(*by).agg(positive.alias("_pos"), *[
        c for i, t in enumerate(thresholds) for c in (
            F.count_if((F.col("score") >= t) & F.col("is_match")).alias(f"tp{i}"),
            F.count_if((F.col("score") >= t) & ~F.col("is_match")).alias(f"fp{i}"))])
    rows = counts.select(*by, "_pos", F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
        for i, t in enumerate(thresholds)])).alias("r")).select(*by, "_pos", "r.*")
    fn = F.col("_pos") - F.col("tp")
    staged = rows.select(
        *by, "threshold", "tp", "fp", fn.alias("fn"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("_pos")), F.lit(0.0)).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return staged.withColumn("f1", F.coalesce(
        F.try_divide(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0)))


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lowest threshold with the best F1."""
    return sweep.groupBy(*by).agg(
        F.max_by("threshold", F.struct("f1", (-F.col("threshold")).alias("low"))).alias("best_threshold"),
        F.max("f1").alias("best_f1"))


def separation(scored: DataFrame) -> DataFrame:
    pos = F.avg(F.when(F.col("is_match"), F.col("score")))
    neg = F.avg(F.when(~F.col("is_match"), F.col("score")))
    return scored.agg(F.coalesce(pos, F.lit(0.0)).alias("mean_match"), F.coalesce(neg, F.lit(0.0)).alias("mean_other"),
                      F.coalesce(pos - neg, F.lit(0.0)).alias("separation"))


def pair_membership(markets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Markets with the number of candidate pairs they occur in (0 when none)."""
    sides = pairs.select(F.col("platform_a").alias("platform"), F.col("id_a").alias("market_id")).union(
        pairs.select("platform_b", "id_b"))
    counts = sides.groupBy("platform", "market_id").agg(F.count("*").alias("candidates"))
    return markets.join(counts, ["platform", "market_id"], "left").withColumn(
        "candidates", F.coalesce("candidates", F.lit(0)))


# ---------------------------------------------------------------- resolved trades

def last_price_in(history: Column, current: Column) -> Column:
    """Newest price of an array of (timestamp, yes_price) structs in any order, else ``current``."""
    newest = F.array_max(F.transform(history, lambda h: F.struct(
        h["timestamp"].alias("t"), h["yes_price"].alias("p"))))
    return F.when(F.coalesce(F.size(history), F.lit(0)) > 0, newest["p"]).otherwise(current)


def final_prices(history: DataFrame) -> DataFrame:
    """(platform, market_id, last_price) of a price-history table."""
    return history.groupBy("platform", "market_id").agg(
        F.max_by("yes_price", F.struct("ts", "seq")).alias("last_price"))


def resolved_trades(signals: DataFrame, markets: DataFrame, start: Column,
                    as_of: Column | None = None) -> DataFrame:
    """Signals with both sides' end dates, resolutions, entry and exit date, outcome and profit.

    ``markets``: platform, market_id, end_date (text), last_price. ``as_of`` keeps trades whose
    markets were still open on that ISO date (unknown end counts as open).
    """
    out = signals
    for s in "ab":
        out = out.join(markets.select(
            F.col("platform").alias(f"platform_{s}"), F.col("market_id").alias(f"id_{s}"),
            F.nullif(F.left(F.col("end_date").cast("string"), F.lit(10)), F.lit("")).alias(f"end_{s}"),
            px.resolution(F.col("last_price")).alias(f"resolution_{s}")),
            [f"platform_{s}", f"id_{s}"], "left")
    exit_date = F.coalesce("end_a", "end_b")
    pnl = px.resolved_pnl(F.col("resolution_a"), F.col("resolution_b"), F.col("direction"), F.col("price_a"),
                          F.col("price_b"), F.col("raw_spread"), F.col("size_usd"))
    entry = F.coalesce(F.date_sub(F.try_to_date(exit_date, "yyyy-MM-dd"), ENTRY_LOOKBACK_DAYS).cast("string"),
                       start.cast("string"))
    same = F.col("resolution_a") == F.col("resolution_b")
    done = out.withColumns({"exit_date": exit_date, "entry_date": entry, "realized_pnl": pnl}).withColumn(
        "outcome", F.when(F.col("realized_pnl").isNull(), "UNKNOWN")
        .when(same | (F.col("realized_pnl") >= 0), "WIN").otherwise("LOSS"))
    if as_of is not None:
        still = lambda s: F.coalesce(f"end_{s}", F.lit("9999")) >= as_of
        done = done.where(still("a") & still("b"))
    return done


def daily_pnl(trades: DataFrame, start: Column, end: Column) -> DataFrame:
    """(date, daily_pnl, cumulative_pnl) for every calendar day; earlier exits count on day one.

    Trades are summed per day before anything is ordered, so the running sum sees one row per
    calendar day of the report.
    """
    exit_day = F.try_to_date("exit_date", "yyyy-MM-dd")
    day = F.greatest(exit_day, start)
    sums = trades.where(exit_day.isNotNull()).groupBy(day.alias("date")).agg(
        F.sum(F.coalesce("realized_pnl", F.lit(0.0))).alias("pnl"))
    days = trades.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("date"))
    dense = days.join(sums, "date", "left").select("date", F.coalesce("pnl", F.lit(0.0)).alias("pnl"))
    total = F.sum("pnl").over(Window.orderBy("date"))  # one row per day of the report
    return dense.select("date", F.round("pnl", 2).alias("daily_pnl"), F.round(total, 2).alias("cumulative_pnl"))


def cohorts(trades: DataFrame, day: Column) -> DataFrame:
    """Entered, resolved, open and resolved-so-far counts of one ISO date, wins, losses, profit."""
    entry, exit_ = F.col("entry_date"), F.col("exit_date")
    closed = F.coalesce(exit_ <= day, F.lit(False))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return trades.agg(
        count(entry == day).alias("entered"), count((exit_ == day) & (entry <= day)).alias("resolved"),
        count((entry <= day) & (exit_.isNull() | (exit_ > day))).alias("open"),
        count(closed).alias("resolved_so_far"),
        count(closed & (F.col("outcome") == "WIN")).alias("wins"),
        count(closed & (F.col("outcome") == "LOSS")).alias("losses"),
        F.coalesce(F.sum(F.when(closed, F.col("realized_pnl"))), F.lit(0.0)).alias("total_pnl"))


def execution_totals(executions: DataFrame) -> DataFrame:
    """Profit of confirmed executions and the number of live ones."""
    return executions.agg(
        F.coalesce(F.sum(F.when(F.col("status") == "CONFIRMED", F.col("net_pnl"))), F.lit(0.0)).alias("confirmed_pnl"),
        F.count_if(F.col("status") == "live").alias("live"))
