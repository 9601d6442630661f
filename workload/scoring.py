"""Spread, signal, live-check, price-series and decay queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crossquote.functions import pricing as px
from crossquote.functions.text import TOPIC_STOPWORDS
from crossquote.operators import replay, series
from crossquote.plans import decay, learning, live, scoring, serving
from crossquote.session import materialize, shared_dir
from crossquote.sources import history
from workload.registry import micros, query, quoted
from workload.views import view, where_they_lie, with_views

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# ---------------------------------------------------------------- signals over v_pair

_SIGNALS = """s0 AS (SELECT *, round(abs(price_a - price_b), 6) AS raw, price_a - price_b AS cur,
  CASE WHEN price_a >= price_b THEN 'buy_b_sell_a' ELSE 'buy_a_sell_b' END AS direction,
  round(greatest(1.0 - least(price_b + (1.0 - price_a), price_a + (1.0 - price_b)), 0.0), 6) AS sure FROM v_pair),
s1 AS (SELECT *, round(0.75 * greatest(0.0, least(1.0, similarity)) + 0.25 * greatest(0.0, least(1.0, sure / raw)), 6) AS q,
  0.45 + 0.05 + CASE WHEN cur > 0.10 THEN 0.15 WHEN cur > 0.05 THEN 0.08 ELSE 0 END AS base FROM s0 WHERE raw >= 0.02),
s2 AS (SELECT *, round(greatest(0.01, least(0.99, round(base, 4) * (0.55 + 0.45 * q))), 6) AS p FROM s1),
s3 AS (SELECT *, greatest(0.05, least(0.95, (0.35 + 0.45 * p - 0.08 * least(0.01 / greatest(raw, 1e-6), 2.0) - 0.10)
   * (0.60 + 0.40 * greatest(0.0, least(1.0, similarity))))) AS ratio FROM s2),
s4 AS (SELECT *, round(least(greatest(raw * ratio, CASE WHEN sure > 0 THEN 0.90 * sure ELSE 0 END), raw), 6) AS capture,
  round(least(0.5 * raw + 0.15 * raw + CASE WHEN 0.01 > raw THEN 0.15 * raw ELSE 0 END
    + (1.0 - greatest(0.0, least(1.0, similarity))) * raw * 0.75, greatest(1.0 - raw, 0.25 * raw)), 6) AS risk FROM s3),
s5 AS (SELECT *, (capture - 0.02) / greatest(risk, 1e-6) AS b, greatest(0.0, least(0.99, p * (0.5 + 0.5 * q))) AS pk FROM s4),
s6 AS (SELECT *, CASE WHEN capture - 0.02 > 0 THEN least(greatest((pk * b - (1.0 - pk)) / b, 0.0) * 0.5, 0.10) ELSE 0 END AS f FROM s5),
s7 AS (SELECT *, round(f, 6) AS kelly, round(f * 10000.0, 2) AS size FROM s6),
s8 AS (SELECT *, round(p * greatest(capture - 0.02, 0.0) * size - (1.0 - p) * risk * size, 4) AS ev,
  round(greatest(0.0, least(1.0, 0.35 * p + 0.25 * CASE WHEN sure > 0 THEN least(sure / 0.10, 1.0) ELSE least(raw / 0.12, 0.7) END
    + 0.25 * similarity + 0.15 * 0.01)), 4) AS confidence FROM s7),
sig AS (SELECT * FROM s8 WHERE capture > 0 AND size > 0 AND ev > 0 AND confidence >= 0.35)"""
_SIG = with_views("v_pair", also=_SIGNALS)


def signals(spark, sf_dir):
    return scoring.score_pairs(view(spark, sf_dir, "v_pair", spread=True))


@query("spread_direction", _SIG + "SELECT pair_id, raw AS raw_spread, direction, sure AS guaranteed_spread FROM s0")
def spread_direction(spark, sf_dir):
    return scoring.spread_table(view(spark, sf_dir, "v_pair"))


@query("signals", _SIG + """
SELECT pair_id, raw AS raw_spread, direction, p AS probability, capture, risk, kelly AS kelly_fraction, size AS size_usd,
       ev AS expected_profit, confidence FROM sig""")
def signal_rows(spark, sf_dir):
    return signals(spark, sf_dir).select("pair_id", "raw_spread", "direction", "probability", "capture", "risk",
                                         "kelly_fraction", "size_usd", "expected_profit", "confidence")


@query("signal_stats", _SIG + """
SELECT count(*) AS total, round(coalesce(sum(ev), 0), 2) AS total_ev, round(coalesce(max(ev), 0), 2) AS top_ev,
       round(coalesce(avg(confidence), 0), 4) AS avg_confidence, round(coalesce(avg(raw), 0), 4) AS avg_spread FROM sig""")
def signal_stats(spark, sf_dir):
    return serving.signal_stats(signals(spark, sf_dir))


@query("top_signals", _SIG + """
SELECT pair_id, ev AS expected_profit, confidence FROM sig WHERE ev >= 1 AND confidence >= 0.5
ORDER BY ev DESC, pair_id LIMIT 100""")
def top_signals(spark, sf_dir):
    best = serving.top_signals(signals(spark, sf_dir), min_ev=1.0, min_confidence=0.5, limit=100)
    return best.select("pair_id", "expected_profit", "confidence")


@query("ranked_signals", _SIG + "SELECT pair_id, ev AS expected_profit FROM sig")
def ranked_signals(spark, sf_dir):
    return scoring.rank_signals(signals(spark, sf_dir)).select("pair_id", "expected_profit")


def signal_texts(spark, sf_dir):
    """Question texts of a pair: those of its order and of the following one."""
    q = view(spark, sf_dir, "v_question").select(F.col("market_id"), "question")
    p = view(spark, sf_dir, "v_pair").select("pair_id", F.split_part("pair_id", F.lit("-"), F.lit(1)).cast("long").alias("k"))
    return (p.join(q.select(F.col("market_id").alias("k"), F.col("question").alias("text_a")), "k")
            .join(q.select((F.col("market_id") - 1).alias("k"), F.col("question").alias("text_b")), "k", "left"))


@query("signal_texts", _SIG.rstrip() + """,
v_q AS (""" + with_views("v_question").split("v_question AS (", 1)[1].rstrip()[:-1] + """),
best AS (SELECT pair_id, ev FROM sig ORDER BY ev DESC, pair_id LIMIT 50)
SELECT b.pair_id, b.ev AS expected_profit, coalesce(x.question, '') AS text_a, coalesce(y.question, '') AS text_b
FROM best b LEFT JOIN v_q x ON x.market_id = CAST(split_part(pair_id, '-', 1) AS BIGINT)
LEFT JOIN v_q y ON y.market_id = CAST(split_part(pair_id, '-', 1) AS BIGINT) + 1""")
def signals_with_texts(spark, sf_dir):
    best = serving.top_signals(signals(spark, sf_dir), signal_texts(spark, sf_dir), limit=50)
    return best.select("pair_id", "expected_profit", "text_a", "text_b")


@query("mmr_signals", _SIG.rstrip() + """,
v_q AS (""" + with_views("v_question").split("v_question AS (", 1)[1].rstrip()[:-1] + f"""),
txt AS (SELECT pair_id, ev, coalesce(x.question, '') AS text_a, coalesce(y.question, '') AS text_b
  FROM sig LEFT JOIN v_q x ON x.market_id = CAST(split_part(pair_id, '-', 1) AS BIGINT)
  LEFT JOIN v_q y ON y.market_id = CAST(split_part(pair_id, '-', 1) AS BIGINT) + 1),
wrd AS (SELECT *, list_filter(list_distinct(regexp_extract_all(lower(concat(text_a, ' ', text_b)), '[a-z0-9]+')),
  lambda w: length(w) > 2 AND NOT list_contains([{quoted(TOPIC_STOPWORDS)}], w)) AS w0 FROM txt),
pl AS (SELECT pair_id, ev, text_a, text_b, CASE WHEN len(w0) > 0 THEN w0 ELSE [pair_id] END AS words,
  CAST(0.65 AS DOUBLE) * ev / (SELECT CASE WHEN max(ev) > 0 THEN max(ev) ELSE 1.0 END FROM sig) AS gain FROM wrd),
pk AS (
  SELECT 0 AS step, pair_id, ev, words, gain, CAST(0.0 AS DOUBLE) AS overlap, 0 AS pick FROM pl
  UNION ALL
  SELECT step + 1, pair_id, ev, words, gain,
    greatest(overlap, len(list_intersect(words, newest)) / CAST(len(list_distinct(list_concat(words, newest))) AS DOUBLE)), CASE WHEN n = 1 THEN step + 1 ELSE pick END
  FROM (SELECT *, row_number() OVER o AS n, first_value(words) OVER o AS newest FROM pk WHERE step < 40
    WINDOW o AS (ORDER BY pick > 0, gain - (CAST(1.0 AS DOUBLE) - CAST(0.65 AS DOUBLE)) * overlap DESC, ev DESC, pair_id)))
SELECT pick, pair_id, pl.ev AS expected_profit, text_a, text_b FROM pl JOIN pk USING (pair_id) WHERE step = 40 AND pick > 0""")
def mmr_signals(spark, sf_dir):
    """Among all signals. Many pairs are scored where they lie: dealt out, all of them would go to disk."""
    rows = scoring.score_pairs(where_they_lie(view(spark, sf_dir, "v_pair")))
    best = serving.top_signals(rows, signal_texts(spark, sf_dir), limit=40, diversity=serving.DIVERSITY)
    return best.select("pick", "pair_id", "expected_profit", "text_a", "text_b")


# ---------------------------------------------------------------- live checks

_LIVE = _SIGNALS + """,
l0 AS (SELECT *, CASE WHEN CAST(split_part(pair_id, '-', 1) AS BIGINT) % 9 = 0 THEN NULL
   ELSE greatest(0.0, least(1.0, price_a + CAST(CAST(split_part(pair_id, '-', 1) AS BIGINT) % 21 - 10 AS DOUBLE) / 100.0)) END AS live0 FROM sig),
l1 AS (SELECT *, coalesce(live0, price_a) AS la, price_b AS lb, least(liquidity_a, liquidity_b) AS thin FROM l0),
l2 AS (SELECT *, abs(la - lb) >= 0.02 AS spread_ok,
  CASE WHEN la >= lb THEN 'buy_b_sell_a' ELSE 'buy_a_sell_b' END = direction AS direction_ok,
  liquidity_a > 0 AND liquidity_b > 0 AND NOT (size > thin * 0.10) AS liquidity_ok,
  CASE WHEN liquidity_a > 0 AND liquidity_b > 0 THEN round(least(size, thin * 0.10), 2) ELSE 0 END AS adjusted FROM l1),
l3 AS (SELECT *, spread_ok AND direction_ok AND liquidity_ok AND adjusted > 0 AS executable FROM l2)"""
_LIV = with_views("v_pair", also=_LIVE)


def validated(spark, sf_dir):
    k = F.split_part("pair_id", F.lit("-"), F.lit(1)).cast("long")
    moved = px.clamp(F.col("price_a") + (k % 21 - 10).cast("double") / 100.0, 0.0, 1.0)
    rows = signals(spark, sf_dir).withColumns({
        "live_a": F.when(k % 9 != 0, moved), "live_b": F.col("price_b")})
    return live.validate(rows)


@query("liquidity_check", with_views("v_pair") + """
SELECT pair_id, liquidity_b > 0 AND liquidity_a > 0 AND NOT (1500.0 > least(liquidity_a, liquidity_b) * 0.10) AS ok,
       CAST(CASE WHEN liquidity_a > 0 AND liquidity_b > 0 THEN round(least(1500.0, least(liquidity_a, liquidity_b) * 0.10), 2) ELSE 0 END AS DOUBLE) AS size
FROM v_pair""")
def liquidity_check(spark, sf_dir):
    a, b, size = F.col("liquidity_a"), F.col("liquidity_b"), F.lit(1500.0)
    return view(spark, sf_dir, "v_pair").select(
        "pair_id", (F.size(px.liquidity_issues(a, b, size)) == 0).alias("ok"),
        px.liquidity_size(size, a, b).alias("size"))


@query("live_validation", _LIV + """
SELECT pair_id, round(abs(la - lb), 6) AS live_spread, spread_ok, direction_ok, liquidity_ok, CAST(adjusted AS DOUBLE) AS adjusted_size,
  executable, CAST((live0 IS NULL)::INT + (NOT spread_ok)::INT + (NOT direction_ok)::INT + (NOT liquidity_ok)::INT AS BIGINT) AS n_reasons FROM l3""")
def live_validation(spark, sf_dir):
    return validated(spark, sf_dir).select(
        "pair_id", "live_spread", "spread_ok", "direction_ok", "liquidity_ok", "adjusted_size", "executable",
        F.size("reasons").cast("long").alias("n_reasons"))


@query("trade_actions", _LIV + """
SELECT pair_id, CASE WHEN (direction = 'buy_b_sell_a') = (side = 'yes') THEN 'b' ELSE 'a' END AS leg, side,
  CAST(round(adjusted / 2, 2) AS DOUBLE) AS amount_usd,
  round(CASE WHEN side = 'yes' THEN CASE WHEN direction = 'buy_b_sell_a' THEN lb ELSE la END
        ELSE 1.0 - CASE WHEN direction = 'buy_b_sell_a' THEN la ELSE lb END END + 0.01, 4) AS limit_price
FROM l3, (SELECT unnest(['yes', 'no']) AS side) t WHERE executable""")
def trade_actions(spark, sf_dir):
    return live.action_rows(validated(spark, sf_dir)).select("pair_id", "leg", "side", "amount_usd", "limit_price")


@query("top_validated", _LIV + """
SELECT pair_id, ev AS expected_profit FROM l3 WHERE executable ORDER BY ev DESC, pair_id LIMIT 60""")
def top_validated(spark, sf_dir):
    return serving.top_validated(validated(spark, sf_dir), True, limit=60).select("pair_id", "expected_profit")


@query("funnel", _LIV + """
SELECT 0 AS step, 'pairs' AS stage, count(*) AS n, 'done' AS status FROM v_pair
UNION ALL SELECT 1, 'signals', count(*), 'done' FROM sig
UNION ALL SELECT 2, 'executable', count(*), CASE WHEN count(*) > 0 THEN 'done' ELSE 'pending' END FROM l3 WHERE executable""")
def funnel(spark, sf_dir):
    return serving.funnel(pairs=view(spark, sf_dir, "v_pair"), signals=signals(spark, sf_dir),
                          executable=validated(spark, sf_dir).where("executable"))


@query("live_lookup", with_views("v_price", also="""
ticks AS (SELECT market_id, topic, any_value(platform) AS platform, arg_max(yes_price, (ts, seq)) AS live FROM v_price GROUP BY 1, 2),
liq AS (SELECT concat(event_type, '-', user_id % 2) AS market_id, sum(value) AS liquidity FROM events WHERE event_type <> 'error' GROUP BY 1)""") + """
SELECT x.market_id AS id_a, y.market_id AS id_b, round(x.live, 6) AS live_a, round(y.live, 6) AS live_b,
  round(coalesce(la.liquidity, 0), 2) AS liquidity_a, round(coalesce(lb.liquidity, 0), 2) AS liquidity_b
FROM ticks x JOIN ticks y ON x.topic = y.topic AND x.platform = 'alpha' AND y.platform = 'beta'
LEFT JOIN liq la ON la.market_id = x.market_id LEFT JOIN liq lb ON lb.market_id = y.market_id""")
def live_lookup(spark, sf_dir):
    history = view(spark, sf_dir, "v_price")
    pairs = price_pairs(spark, sf_dir)
    # the error markets stand for markets without known liquidity
    liquidity = history.where("market_id NOT LIKE 'error-%'").join(
        spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), "value"), "seq") \
        .groupBy("platform", "market_id").agg(F.sum("value").alias("liquidity"))
    out = live.attach_live(pairs, live.latest_prices(history), liquidity)
    return out.select("id_a", "id_b", F.round("live_a", 6).alias("live_a"), F.round("live_b", 6).alias("live_b"),
                      F.round(F.coalesce("liquidity_a", F.lit(0.0)), 2).alias("liquidity_a"),
                      F.round(F.coalesce("liquidity_b", F.lit(0.0)), 2).alias("liquidity_b"))


# ---------------------------------------------------------------- price series

def price_pairs(spark, sf_dir):
    """Alpha and beta markets on the same topic."""
    history = view(spark, sf_dir, "v_price")
    last = live.latest_prices(history).withColumn("topic", F.substring_index("market_id", "-", -1))
    side = lambda p, s: last.where(F.col("platform") == p).select(
        "topic", F.col("platform").alias(f"platform_{s}"), F.col("market_id").alias(f"id_{s}"),
        F.col("live_price").alias(f"price_{s}"))
    pairs = side("alpha", "a").join(side("beta", "b"), "topic").drop("topic")
    return pairs.withColumn("pair_id", F.concat_ws("~", "id_a", "id_b"))


_PRICE = """recent AS (SELECT * FROM v_price WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY),
hr AS (SELECT platform, market_id, topic, date_trunc('hour', ts) AS hour, arg_max(yes_price, (ts, seq)) AS price, count(*) AS points
  FROM recent GROUP BY ALL),

al AS (SELECT concat(a.market_id, '~', b.market_id) AS pair_id, a.hour, a.price AS pa, b.price AS pb, a.price - b.price AS spread
  FROM hr a JOIN hr b ON a.hour = b.hour AND a.topic = b.topic WHERE a.platform = 'alpha' AND b.platform = 'beta')"""
_SERIES = with_views("v_price", also=_PRICE)


def spreads(spark, sf_dir):
    return series.hourly_spread(price_pairs(spark, sf_dir), view(spark, sf_dir, "v_price"), as_of())


@query("hourly_spread", _SERIES + "SELECT pair_id, epoch_us(hour) AS hour_us, round(spread, 6) AS spread FROM al")
def hourly_spread(spark, sf_dir):
    return spreads(spark, sf_dir).select("pair_id", micros("hour").alias("hour_us"), F.round("spread", 6).alias("spread"))


def stored_history(spark, sf_dir):
    """The ticks as a bucketed table."""
    name = "ticks_" + uuid.uuid4().hex[:12]
    out = history.History(spark, name, f"{shared_dir(spark)}/{name}", buckets=8)
    out.append(view(spark, sf_dir, "v_tick"))
    return out


@query("market_history", with_views("v_tick") + """
SELECT seq, epoch_us(ts) AS us, round(yes_price, 6) AS yes_price FROM v_tick
WHERE market_id = (SELECT max(market_id) FROM v_tick WHERE platform = 'alpha')""")
def market_history(spark, sf_dir):
    """One market's ticks, out of the one bucket that holds them."""
    market = view(spark, sf_dir, "v_tick").where("platform = 'alpha'").agg(F.max("market_id")).first()[0] or ""
    rows = stored_history(spark, sf_dir).market("alpha", market)
    return rows.select("seq", micros("ts").alias("us"), F.round("yes_price", 6).alias("yes_price"))


@query("history_hours", with_views("v_tick") + """
SELECT platform, market_id, epoch_us(date_trunc('hour', ts)) AS hour_us, round(arg_max(yes_price, (ts, seq)), 6) AS price, count(*) AS points FROM v_tick GROUP BY 1, 2, 3""")
def history_hours(spark, sf_dir):
    return stored_history(spark, sf_dir).hourly().select("platform", "market_id", micros("hour").alias("hour_us"),
                                                         F.round("price", 6).alias("price"), "points")


@query("hourly_spread_single", with_views("v_price", also="""odd AS (SELECT *, ts - CASE WHEN platform = 'beta' THEN INTERVAL 1 YEAR ELSE INTERVAL 0 DAY END AS shifted FROM v_price),
last AS (SELECT platform, market_id, topic, arg_max(yes_price, (ts, seq)) AS last FROM odd GROUP BY ALL)""") + """
SELECT concat(a.market_id, '~', b.market_id) AS pair_id, round(a.last - b.last, 6) AS spread FROM last a JOIN last b ON a.topic = b.topic
WHERE a.platform = 'alpha' AND b.platform = 'beta'""")
def hourly_spread_single(spark, sf_dir):
    """All beta quotes moved a year back, so that no pair shares an hour."""
    rows = view(spark, sf_dir, "v_price")
    moved = rows.withColumn("ts", F.when(F.col("platform") == "beta", F.col("ts") - F.expr("interval 1 year")).otherwise(F.col("ts")))
    out = series.hourly_spread(price_pairs(spark, sf_dir), moved, F.lit("2024-01-30 23:00:00").cast("timestamp"), lookback_days=1000)
    return out.select("pair_id", F.round("spread", 6).alias("spread"))


_FEATURES = _PRICE + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY hour DESC) AS rn FROM al),
ft AS (SELECT pair_id, count(*) AS points, arg_max(spread, hour) AS cur, avg(spread) AS mean, stddev_pop(spread) AS std,
  max(abs(spread)) AS max_abs, (max(spread) FILTER (rn = 1) - max(spread) FILTER (rn = 5)) / 4.0 AS velocity FROM rk GROUP BY 1)"""


@query("spread_features", with_views("v_price", also=_FEATURES) + """
SELECT pair_id, points, round(cur, 6) AS current_spread, round(mean, 6) AS mean_spread, round(velocity, 6) AS velocity,
  round(std, 6) AS volatility, round(round((cur - mean) / std, 4), 3) AS z_score, round(max_abs, 6) AS max_spread,
  CAST(40.5 AS DOUBLE) AS days_to_close, CAST(2.0 AS DOUBLE) AS volume_ratio FROM ft""")
def spread_features(spark, sf_dir):
    close = F.expr(f"timestamp '{AS_OF}' + interval '40 12' day to hour")
    pairs = price_pairs(spark, sf_dir).withColumns(
        {"volume_a": F.lit(10.0), "volume_b": F.lit(5.0), "close_date": close})
    out = series.spread_features(pairs, spreads(spark, sf_dir), as_of())
    exact = ["pair_id", "points", "days_to_close", "volume_ratio"]
    return out.select(*exact, F.round("z_score", 3).alias("z_score"), *[
        F.round(c, 6).alias(c) for c in ("current_spread", "mean_spread", "velocity", "volatility", "max_spread")])


@query("history_signals", with_views("v_price", also=_FEATURES + """,
h0 AS (SELECT pair_id, cur, points, velocity, std, (cur - mean) / std AS z FROM ft),
h1 AS (SELECT *, round(greatest(0.01, least(0.99, 0.5 + CASE WHEN cur > 0.10 THEN 0.15 WHEN cur > 0.05 THEN 0.08 ELSE 0 END
  + CASE WHEN abs(round(z, 4)) > 2 THEN 0.12 WHEN abs(round(z, 4)) > 1 THEN 0.06 ELSE 0 END
  + CASE WHEN velocity < -0.005 THEN 0.10 WHEN velocity > 0.005 THEN -0.08 ELSE 0 END - 0.05)), 4) AS base FROM h0)""") + """
SELECT pair_id, points, base AS base_probability FROM h1""")
def history_signals(spark, sf_dir):
    pairs = price_pairs(spark, sf_dir).withColumn("similarity", F.lit(0.9))
    features = series.spread_features(pairs, spreads(spark, sf_dir), as_of())
    scored = learning.predictor(None)(features)
    return scored.select("pair_id", "points", "base_probability")


@query("convergence_labels", with_views("v_price", also=_PRICE + """,
ld AS (SELECT *, lead(spread, 24) OVER (PARTITION BY pair_id ORDER BY hour) AS nxt FROM al)""") + """
SELECT pair_id, epoch_us(hour) AS hour_us, CASE WHEN abs(spread) > 0 AND abs(nxt) <= abs(spread) * 0.5 THEN 1 ELSE 0 END AS label
FROM ld WHERE nxt IS NOT NULL""")
def convergence_labels(spark, sf_dir):
    return series.convergence_labels(spreads(spark, sf_dir)).select("pair_id", micros("hour").alias("hour_us"), "label")


@query("running_features", with_views("v_price", also=_PRICE + """,
rf AS (SELECT pair_id, hour, spread, row_number() OVER w AS points, avg(spread) OVER p AS mean, stddev_pop(spread) OVER p AS std,
  max(abs(spread)) OVER p AS max_abs, first_value(spread) OVER (PARTITION BY pair_id ORDER BY hour ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS old
  FROM al WINDOW w AS (PARTITION BY pair_id ORDER BY hour), p AS (PARTITION BY pair_id ORDER BY hour ROWS UNBOUNDED PRECEDING))""") + """
SELECT pair_id, epoch_us(hour) AS hour_us, points, round(mean * points, 6) AS sum_spread, round(max_abs, 6) AS max_spread,
  round(CASE WHEN points >= 3 THEN (spread - old) / (least(points, 5) - 1) ELSE 0 END, 6) AS velocity FROM rf""")
def running_features(spark, sf_dir):
    out = series.running_features(spreads(spark, sf_dir))
    return out.select("pair_id", micros("hour").alias("hour_us"), F.col("points").cast("long").alias("points"),
                      F.round(F.col("mean_spread") * F.col("points"), 6).alias("sum_spread"),
                      *[F.round(c, 6).alias(c) for c in ("max_spread", "velocity")])


_CORR = lambda x, y: (f"coalesce(covar_pop({x}, {y}) / nullif(stddev_pop({x}) FILTER ({y} IS NOT NULL)"  # noqa: E731
                      f" * stddev_pop({y}) FILTER ({x} IS NOT NULL), 0), 0)")


@query("price_correlation", with_views("v_price", also=_PRICE + f""",
d1 AS (SELECT *, pa - lag(pa) OVER w AS ra, pb - lag(pb) OVER w AS rb FROM al WINDOW w AS (PARTITION BY pair_id ORDER BY hour)),
d2 AS (SELECT *, lag(ra) OVER w AS qa, lag(rb) OVER w AS qb FROM d1 WINDOW w AS (PARTITION BY pair_id ORDER BY hour)),
st AS (SELECT pair_id, count(*) AS n, {_CORR('pa', 'pb')} AS level, {_CORR('ra', 'rb')} AS chg,
  greatest({_CORR('ra', 'qb')}, {_CORR('qa', 'rb')}) AS lg, avg(CASE WHEN ra IS NOT NULL THEN (sign(ra) = sign(rb))::INT END) AS agree
  FROM d2 GROUP BY 1)""") + """
SELECT pair_id, CASE WHEN n >= 10 THEN round(0.45 * level + 0.30 * chg + 0.15 * lg + 0.10 * (2 * agree - 1), 4) ELSE 0 END AS correlation,
  CASE WHEN n >= 10 THEN 0.45 * level + 0.30 * chg + 0.15 * lg + 0.10 * (2 * agree - 1) >= 0.6 AND level >= 0.4 AND agree >= 0.55 ELSE true END AS correlation_ok
FROM st""")
def price_correlation(spark, sf_dir):
    return series.price_correlation(price_pairs(spark, sf_dir), view(spark, sf_dir, "v_price"), as_of())


@query("series_summary", _SERIES + """
SELECT pair_id, round(arg_max(abs(spread), hour), 6) AS current_spread, round(avg(CAST(abs(spread) AS DECIMAL(28, 12))), 6) AS avg_spread,
  round(min(abs(spread)), 6) AS min_spread, round(max(abs(spread)), 6) AS max_spread, round(avg(CAST(pa AS DECIMAL(28, 12))), 6) AS avg_price_a,
  round(avg(CAST(pb AS DECIMAL(28, 12))), 6) AS avg_price_b FROM al GROUP BY 1""")
def series_summary(spark, sf_dir):
    hourly = series.hourly_last(view(spark, sf_dir, "v_price"), as_of())
    out = series.series_summary(series.aligned_prices(price_pairs(spark, sf_dir), hourly))
    return out.select("pair_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "pair_id"])


@query("convergence_model")
def convergence_model(spark, sf_dir):
    rows = materialize(learning.training_rows(spreads(spark, sf_dir)))
    predicted = learning.predictor(learning.fit(rows))(rows)
    return predicted.select("pair_id", "hour", "label", F.round("base_probability", 6).alias("probability"))


# ---------------------------------------------------------------- decay

_ASOF = """pr AS (SELECT a.topic, a.market_id AS ia, b.market_id AS ib FROM (SELECT DISTINCT topic, market_id FROM v_price WHERE platform = 'alpha') a
  JOIN (SELECT DISTINCT topic, market_id FROM v_price WHERE platform = 'beta') b ON a.topic = b.topic),
tk AS (SELECT concat(ia, '~', ib) AS pair_id, v.ts, v.seq, CASE WHEN v.market_id = ia THEN yes_price END AS xa,
  CASE WHEN v.market_id = ib THEN yes_price END AS xb FROM v_price v JOIN pr ON v.topic = pr.topic AND (v.market_id = ia OR v.market_id = ib)),
ff AS (SELECT pair_id, ts, seq, last_value(xa IGNORE NULLS) OVER w AS pa, last_value(xb IGNORE NULLS) OVER w AS pb FROM tk
  WINDOW w AS (PARTITION BY pair_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
sn AS (SELECT pair_id, ts, seq, round(pa - pb, 6) AS raw, round(abs(pa - pb), 6) AS absd FROM ff WHERE pa IS NOT NULL AND pb IS NOT NULL)"""
_SNAP = with_views("v_price", also=_ASOF)


def pair_snapshots(spark, sf_dir):
    quotes = replay.asof_pair_quotes(price_pairs(spark, sf_dir), view(spark, sf_dir, "v_price"))
    return decay.snapshots(quotes)


@query("pair_snapshots", _SNAP + "SELECT pair_id, epoch_us(ts) AS us, seq, raw AS raw_spread, absd AS abs_spread FROM sn")
def snapshot_rows(spark, sf_dir):
    return pair_snapshots(spark, sf_dir).select("pair_id", micros("ts").alias("us"), "seq", "raw_spread", "abs_spread")


@query("read_snapshots", _SNAP + """
SELECT epoch_us(ts) AS us, seq, raw AS raw_spread FROM sn WHERE pair_id = 'view-1~purchase-1' AND ts >= TIMESTAMP '2024-01-05'""")
def read_snapshots(spark, sf_dir):
    rows = decay.read_snapshots(pair_snapshots(spark, sf_dir), "view-1~purchase-1", F.lit("2024-01-05").cast("timestamp"))
    return rows.select(micros("ts").alias("us"), "seq", "raw_spread")


_THROTTLED = """,
n0 AS (SELECT *, min((ts, seq)) OVER (PARTITION BY pair_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM sn),
nx AS MATERIALIZED (SELECT pair_id, ts, seq, struct_extract(nxt, 1) AS nts, struct_extract(nxt, 2) AS nseq FROM n0),
st AS (SELECT pair_id, min((ts, seq)) AS first FROM sn GROUP BY 1),
walk AS (SELECT pair_id, struct_extract(first, 1) AS ts, struct_extract(first, 2) AS seq FROM st
  UNION ALL SELECT w.pair_id, n.nts, n.nseq FROM walk w JOIN nx n ON n.pair_id = w.pair_id AND n.ts = w.ts AND n.seq = w.seq WHERE n.nts IS NOT NULL)"""


@query("throttled_snapshots", with_views("v_price", also=_ASOF + _THROTTLED) +
       "SELECT pair_id, epoch_us(ts) AS us, seq FROM walk")
def throttled_snapshots(spark, sf_dir):
    return decay.throttle(pair_snapshots(spark, sf_dir)).select("pair_id", micros("ts").alias("us"), "seq")


_EPISODES = """,
e0 AS (SELECT *, lag(raw) OVER w AS prev FROM sn WINDOW w AS (PARTITION BY pair_id ORDER BY ts, seq)),
e1 AS (SELECT *, CASE WHEN raw > 0.02 THEN 1 WHEN raw < -0.02 THEN -1 WHEN abs(raw) < 0.005 THEN 0
  WHEN prev IS NOT NULL AND sign(raw) <> sign(prev) THEN 0 END AS cross0 FROM e0),
e2 AS (SELECT *, coalesce(last_value(cross0 IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) AS state FROM e1),
e3 AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY pair_id ORDER BY ts, seq), 0) AS before FROM e2),
e4 AS (SELECT *, sum((state <> 0 AND state <> before)::INT) OVER (PARTITION BY pair_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS no FROM e3),
e5 AS (SELECT pair_id, no, min(ts) AS start_ts, arg_min(raw, (ts, seq)) AS first_raw, min(ts) FILTER (state = 0) AS zero_ts,
  arg_min(raw, (ts, seq)) FILTER (state = 0) AS zero_raw FROM e4 WHERE no > 0 GROUP BY 1, 2),
e6 AS (SELECT *, coalesce(zero_ts, lead(start_ts) OVER w) AS stop_ts, coalesce(zero_raw, lead(first_raw) OVER w) AS stop_raw FROM e5
  WINDOW w AS (PARTITION BY pair_id ORDER BY no)),
e7 AS (SELECT e6.pair_id, e6.no, any_value(start_ts) AS start_ts, any_value(stop_ts) AS stop_ts, any_value(stop_raw) AS stop_raw,
  arg_min(abs(raw), (ts, seq)) AS opening, max(abs(raw)) FILTER (ok) AS peak, arg_max(abs(raw), (ts, seq)) FILTER (ok) AS cur, max(ts) FILTER (ok) AS seen,
  count(*) FILTER (ok) AS n, min((-abs(raw), ts)) FILTER (ok) AS pk, coalesce(any_value(stop_ts), max(ts)) >= any_value(start_ts) + INTERVAL 24 HOUR AS late
  FROM e6 JOIN (SELECT * FROM e4 WHERE state <> 0) e4 ON e4.pair_id = e6.pair_id AND e4.no = e6.no, LATERAL (SELECT ts < start_ts + INTERVAL 24 HOUR AS ok) GROUP BY 1, 2),
ep AS (SELECT *, struct_extract(pk, 2) AS peak_ts, CASE WHEN late THEN 'expired' WHEN stop_ts IS NULL THEN 'open'
  WHEN abs(stop_raw) < 0.005 THEN 'closed' ELSE 'reversed' END AS status,
  CASE WHEN late THEN start_ts + INTERVAL 24 HOUR ELSE stop_ts END AS end_ts FROM e7),
em AS (SELECT *, coalesce(CASE WHEN status IN ('closed', 'reversed') THEN abs(stop_raw) END, cur) AS last,
  (epoch_us(coalesce(end_ts, seen)) - epoch_us(start_ts)) / 1e6 AS dur,
  (SELECT min(ts) FROM sn WHERE sn.pair_id = ep.pair_id AND ts >= peak_ts AND ts <= coalesce(end_ts, TIMESTAMP '9999-12-31') AND abs(raw) <= peak / 2) AS half_ts FROM ep)"""
_EP = with_views("v_price", also=_ASOF + _EPISODES)


def found(spark, sf_dir):
    marked = materialize(decay.mark_episodes(pair_snapshots(spark, sf_dir)))
    return marked, materialize(decay.episodes_of(marked))


@query("spread_episodes", _EP + """
SELECT concat(pair_id, '#', CAST(no AS BIGINT)) AS episode_id, epoch_us(start_ts) AS start_us, round(opening, 6) AS opening_spread,
  round(peak, 6) AS peak_spread, round(cur, 6) AS current_spread, round(dur, 3) AS duration_seconds, status, n AS snapshot_count FROM em""")
def spread_episodes(spark, sf_dir):
    _, out = found(spark, sf_dir)
    return out.select("episode_id", micros("start_time").alias("start_us"), "opening_spread", "peak_spread", "current_spread",
                      F.round("duration_seconds", 3).alias("duration_seconds"), "status", "snapshot_count")


@query("episode_metrics", _EP + """
SELECT concat(pair_id, '#', CAST(no AS BIGINT)) AS episode_id, round((peak - last) / peak, 6) AS percent_decay,
  round((epoch_us(peak_ts) - epoch_us(start_ts)) / 1e6, 3) AS time_to_peak_seconds,
  round(CASE WHEN dur > 0 THEN (last - opening) / (dur / 3600.0) ELSE 0 END, 6) AS decay_velocity,
  round(0.4 * least(dur / 86400.0, 1.0) + 0.6 * greatest(0.0, least(1.0, last / opening)), 6) AS persistence_score,
  round(coalesce((epoch_us(half_ts) - epoch_us(peak_ts)) / 1e6, -1.0), 3) AS half_life_seconds FROM em""")
def episode_metrics(spark, sf_dir):
    rows, out = found(spark, sf_dir)
    m = decay.episode_metrics(rows, out)
    return m.select("episode_id", F.round("percent_decay", 6).alias("percent_decay"),
                    F.round("time_to_peak_seconds", 3).alias("time_to_peak_seconds"),
                    F.round("decay_velocity", 6).alias("decay_velocity"), F.round("persistence_score", 6).alias("persistence_score"),
                    F.round(F.coalesce("half_life_seconds", F.lit(-1.0)), 3).alias("half_life_seconds"))


@query("decay_baseline", _EP + """
SELECT pair_id, count(*) AS episode_count, round(median(opening), 6) AS median_opening_spread, round(median(dur), 3) AS median_time_to_close_seconds,
  round(quantile_cont(0.4 * least(dur / 86400.0, 1.0) + 0.6 * greatest(0.0, least(1.0, last / opening)), 0.25), 6) AS persistence_p25,
  round(quantile_cont(0.4 * least(dur / 86400.0, 1.0) + 0.6 * greatest(0.0, least(1.0, last / opening)), 0.5), 6) AS persistence_p50,
  round(quantile_cont(0.4 * least(dur / 86400.0, 1.0) + 0.6 * greatest(0.0, least(1.0, last / opening)), 0.75), 6) AS persistence_p75,
  round(median((epoch_us(half_ts) - epoch_us(peak_ts)) / 1e6), 3) AS median_half_life_seconds, round(median(peak), 6) AS typical_peak_spread
FROM em WHERE status = 'closed' GROUP BY 1 HAVING count(*) >= 3""")
def decay_baseline(spark, sf_dir):
    rows, out = found(spark, sf_dir)
    base = decay.baselines(rows, out, decay.episode_metrics(rows, out))
    return base.select("pair_id", "episode_count", F.round("median_opening_spread", 6).alias("median_opening_spread"),
                       F.round("median_time_to_close_seconds", 3).alias("median_time_to_close_seconds"),
                       *[F.round(c, 6).alias(c) for c in ("persistence_p25", "persistence_p50", "persistence_p75")],
                       F.round("median_half_life_seconds", 3).alias("median_half_life_seconds"),
                       F.round("typical_peak_spread", 6).alias("typical_peak_spread"))


@query("decay_signals", with_views("v_price", also=_ASOF + _EPISODES + """,
ps AS (SELECT *, 0.4 * least(dur / 86400.0, 1.0) + 0.6 * greatest(0.0, least(1.0, last / opening)) AS pers, (peak - last) / peak AS gone,
  CASE WHEN dur > 0 THEN (last - opening) / (dur / 3600.0) ELSE 0 END AS vel FROM em),
bs AS (SELECT pair_id, quantile_cont(pers, 0.25) AS p25, quantile_cont(pers, 0.5) AS p50, quantile_cont(pers, 0.75) AS p75, median(peak) AS typ
  FROM ps WHERE status = 'closed' GROUP BY 1 HAVING count(*) >= 3)""") + """
SELECT concat(ps.pair_id, '#', CAST(no AS BIGINT)) AS episode_id, round(gone, 6) AS percent_decay, n AS snapshot_count,
  CASE WHEN gone >= 0.8 THEN 'mostly_closed' WHEN n < 3 THEN 'opening' WHEN vel > 0.01 THEN 're_widening' WHEN vel <= -0.05 THEN 'actively_decaying'
    WHEN vel < -0.005 THEN 'slow_decay' ELSE 'stalled' END AS decay_status,
  CAST(CASE WHEN p50 IS NULL THEN NULL WHEN pers >= p75 THEN 0.75 WHEN pers >= p50 THEN 0.5 WHEN pers >= p25 THEN 0.25 ELSE 0 END AS DOUBLE) AS persistence_percentile,
  round(0.6 * least(last / 0.10, 1.0) + 0.4 * greatest(0.0, 1.0 - gone), 6) AS urgency_score, round(peak / typ, 6) AS relative_abnormality
FROM ps LEFT JOIN bs ON ps.pair_id = bs.pair_id WHERE status = 'open'""")
def decay_signals(spark, sf_dir):
    rows, out = found(spark, sf_dir)
    m = decay.episode_metrics(rows, out)
    sig = decay.decay_signals(m, decay.baselines(rows, out, m))
    return sig.select("episode_id", F.round("percent_decay", 6).alias("percent_decay"), "snapshot_count", "decay_status",
                      "persistence_percentile", "urgency_score", F.round("relative_abnormality", 6).alias("relative_abnormality"))


