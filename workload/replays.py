"""Event replay, opportunity, fill, settlement and backtest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossquote.operators import fills, opportunities as op, replay, runs
from crossquote.plans import backtest, portfolio as pf, serving
from crossquote.session import materialize
from crossquote.sources.quotes import SNAPSHOT, normaliser
from workload.registry import micros, query
from workload.views import table, view, with_views

QUOTED = "('market_created', 'market_updated', 'orderbook_snapshot')"
FEE = 0.01


def events(spark, sf_dir):
    """The replay view as normalised event rows."""
    v = view(spark, sf_dir, "v_replay")
    yes, no = F.col("ask_yes"), F.col("ask_no")
    two = lambda a, b: F.create_map(F.lit("Yes"), a, F.lit("No"), b)
    levels = F.create_map().cast("map<string,array<struct<price:double,size:double>>>")
    snapshot = F.struct(
        F.lit("").alias("question"), F.lit(None).cast("string").alias("description"),
        F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"), two(yes - 0.02, no - 0.02).alias("best_bid"),
        two(yes, no).alias("best_ask"), two(yes - 0.01, no - 0.01).alias("last_traded"), levels.alias("bids"),
        levels.alias("asks"), F.lit(FEE).alias("fees"), F.lit("active").alias("status"),
        F.lit(None).cast("timestamp").alias("close_time")).cast(SNAPSHOT)
    kind = F.col("event_type")
    return v.select(
        F.col("seq").cast("string").alias("event_id"), kind, "platform",
        F.col("market_id").cast("string").alias("market_id"), "ts", "seq",
        F.when(kind.isin(replay.SNAPSHOT_EVENTS), snapshot).alias("snapshot"),
        F.when(kind == "market_resolved", F.col("resolution_outcome")).alias("resolution_outcome"),
        F.when(kind == "market_resolved", F.lit(1.0)).alias("resolution_value"),
        F.when(kind == "trade_print", F.lit("Yes")).alias("trade_outcome"),
        F.when(kind == "trade_print", yes).alias("trade_price"))


def replay_pairs(spark, sf_dir):
    """Validated pairs of the replay: every alpha market with the beta market next to it."""
    markets = view(spark, sf_dir, "v_replay").select("platform", "market_id").distinct()
    a, b = markets.where("platform = 'alpha'"), markets.where("platform = 'beta'")
    return a.select("platform", "market_id", (F.col("market_id") + 1).alias("n")).join(
        b.select(F.col("platform").alias("platform_b"), F.col("market_id").alias("n")), "n").select(
        F.concat_ws("~", "market_id", "n").alias("pair_id"), F.col("platform").alias("platform_a"),
        F.col("market_id").cast("string").alias("id_a"), "platform_b", F.col("n").cast("string").alias("id_b"))


# ---------------------------------------------------------------- events

@query("dedup_events", """
WITH two AS (SELECT event_id, ts, user_id, event_id AS seq FROM events UNION ALL SELECT event_id, ts + INTERVAL 1 SECOND, user_id, event_id + 100000000 FROM events WHERE event_type <> 'view')
SELECT event_id, arg_min(epoch_us(ts), seq) AS us, count(DISTINCT event_id) AS n FROM two GROUP BY 1""")
def dedup_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    first = rows.withColumn("seq", F.col("event_id"))
    late = rows.where("event_type <> 'view'").withColumns({
        "seq": F.col("event_id") + 100000000, "ts": F.expr("ts + interval 1 second")})
    unique = replay.deduplicate(first.unionByName(late))
    return unique.select("event_id", micros("ts").alias("us"), F.lit(1).cast("long").alias("n"))


@query("replay_window", with_views("v_replay") + """
SELECT seq, epoch_us(ts) AS us FROM v_replay WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'""")
def replay_window(spark, sf_dir):
    at = lambda t: F.lit(t).cast("timestamp")
    rows = replay.replay_stream(events(spark, sf_dir), at("2024-01-05"), at("2024-01-12 12:00:00"))
    return rows.select("seq", micros("ts").alias("us"))


@query("time_bounds", with_views("v_replay") + "SELECT epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM v_replay")
def time_bounds(spark, sf_dir):
    return replay.time_bounds(events(spark, sf_dir)).select(micros("first_ts").alias("first_us"), micros("last_ts").alias("last_us"))


_STATE = f"""st AS (SELECT *, CASE WHEN event_type IN {QUOTED} THEN seq END AS qs, CASE WHEN event_type = 'market_resolved' THEN seq END AS rs,
  CASE WHEN event_type = 'trade_print' THEN seq END AS ps FROM v_replay),
ff AS (SELECT *, last_value(qs IGNORE NULLS) OVER w AS q, last_value(rs IGNORE NULLS) OVER w AS r, last_value(ps IGNORE NULLS) OVER w AS p FROM st
  WINDOW w AS (PARTITION BY platform, market_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
hs AS (SELECT ff.platform, ff.market_id, ff.ts, ff.seq, q AS quote_seq, CASE WHEN r IS NULL THEN 'active' ELSE 'resolved' END AS status,
  round(CASE WHEN q IS NULL THEN NULL WHEN p > q THEN x.ask_yes ELSE y.ask_yes - 0.01 END, 6) AS last_yes
  FROM ff LEFT JOIN v_replay x ON x.seq = p LEFT JOIN v_replay y ON y.seq = q)"""


@query("state_history", with_views("v_replay", also=_STATE) + """
SELECT seq, coalesce(quote_seq, -1) AS quote_seq, status, coalesce(last_yes, -1.0) AS last_yes FROM hs""")
def state_history(spark, sf_dir):
    out = replay.state_history(events(spark, sf_dir))
    return out.select("seq", F.coalesce("quote.snapshot_seq", F.lit(-1)).alias("quote_seq"), "status",
                      F.coalesce(F.round("last_yes", 6), F.lit(-1.0)).alias("last_yes"))


@query("latest_state", with_views("v_replay", also=_STATE) + """
SELECT platform, CAST(market_id AS VARCHAR) AS market_id, coalesce(quote_seq, -1) AS quote_seq, status, coalesce(last_yes, -1.0) AS last_yes
FROM hs QUALIFY row_number() OVER (PARTITION BY platform, market_id ORDER BY ts DESC, seq DESC) = 1""")
def latest_state(spark, sf_dir):
    return replay.latest_state(events(spark, sf_dir)).select(
        "platform", "market_id", F.coalesce("quote.snapshot_seq", F.lit(-1)).alias("quote_seq"), "status",
        F.coalesce(F.round("last_yes", 6), F.lit(-1.0)).alias("last_yes"))


@query("market_counts", with_views("v_replay", also=_STATE + """,
fin AS (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY platform, market_id ORDER BY ts DESC, seq DESC) = 1)""") + """
SELECT count(*) AS markets, CAST(count_if(status = 'active') AS BIGINT) AS active FROM fin""")
def market_counts(spark, sf_dir):
    states = replay.latest_state(events(spark, sf_dir))
    return states.agg(F.count("*").alias("markets"), F.count_if(F.col("status") == "active").alias("active"))


@query("visible_markets", with_views("v_replay", also=_STATE + """,
fin AS (SELECT hs.*, y.ts AS qt FROM hs LEFT JOIN v_replay y ON y.seq = quote_seq
  QUALIFY row_number() OVER (PARTITION BY hs.platform, hs.market_id ORDER BY hs.ts DESC, hs.seq DESC) = 1)""") + """
SELECT platform, CAST(market_id AS VARCHAR) AS market_id FROM fin WHERE qt <= TIMESTAMP '2024-01-31' AND NOT (qt < TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR AND status = 'active')""")
def visible_markets(spark, sf_dir):
    states = replay.latest_state(events(spark, sf_dir))
    return replay.visible(states, F.lit("2024-01-31").cast("timestamp"), 36 * 3600.0).select("platform", "market_id")


@query("state_as_of", with_views("v_replay", also=_STATE + """,
pb AS (SELECT seq AS probe_id, CASE platform WHEN 'alpha' THEN 'beta' ELSE 'alpha' END AS platform, market_id + 1 AS market_id, ts FROM v_replay WHERE event_type = 'trade_print')""") + """
SELECT pb.probe_id, coalesce(hs.quote_seq, -1) AS quote_seq, coalesce(hs.status, 'active') AS status
FROM pb ASOF LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY platform, market_id, ts ORDER BY seq DESC) AS k FROM hs QUALIFY k = 1) hs
  ON hs.platform = pb.platform AND hs.market_id = pb.market_id AND hs.ts <= pb.ts""")
def state_as_of(spark, sf_dir):
    rows = events(spark, sf_dir)
    probes = view(spark, sf_dir, "v_replay").where("event_type = 'trade_print'").select(
        F.col("seq").alias("probe_id"), F.when(F.col("platform") == "alpha", "beta").otherwise("alpha").alias("platform"),
        (F.col("market_id") + 1).cast("string").alias("market_id"), "ts")
    out = replay.state_as_of(rows, probes)
    return out.select("probe_id", F.coalesce("quote.snapshot_seq", F.lit(-1)).alias("quote_seq"), "status")


@query("order_rejections", with_views("v_replay", also=_STATE + """,
od AS (SELECT seq AS order_id, platform, market_id + CASE WHEN seq % 4 = 0 THEN 1000000 ELSE 0 END AS market_id, ts, CAST(seq % 13 * 50 AS DOUBLE) AS requested_size
  FROM v_replay WHERE event_type = 'trade_print'),
sz AS (SELECT od.*, hs.quote_seq, hs.status, concat(od.platform, '::', od.market_id) AS key
  FROM od ASOF LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY platform, market_id, ts ORDER BY seq DESC) AS k FROM hs QUALIFY k = 1) hs
  ON hs.platform = od.platform AND hs.market_id = od.market_id AND hs.ts <= od.ts)""") + """
SELECT order_id, CASE WHEN coalesce(status, 'active') = 'active' AND quote_seq IS NULL THEN concat('Unknown market: ', key)
  WHEN status <> 'active' THEN concat('Market not active: ', key)
  WHEN requested_size < 1 THEN 'size below minimum' WHEN requested_size > 500 THEN 'size exceeds maximum' END AS rejection FROM sz""")
def order_rejections(spark, sf_dir):
    """An order at every trade print: some for markets that do not exist, some too small or too large."""
    prints = view(spark, sf_dir, "v_replay").where("event_type = 'trade_print'")
    orders = prints.select(
        F.col("seq").alias("order_id"), "platform",
        (F.col("market_id") + F.when(F.col("seq") % 4 == 0, 1000000).otherwise(0)).cast("string").alias("market_id"), "ts",
        (F.col("seq") % 13 * 50).cast("double").alias("requested_size"))
    return backtest.order_rejections(orders, events(spark, sf_dir)).select("order_id", "rejection")


@query("normalised_events", with_views("v_replay") + """
SELECT seq, CASE WHEN event_type = 'trade_print' THEN 'market_updated' ELSE event_type END AS event_type, epoch_us(ts) // 1000000 AS sec,
  CASE WHEN event_type <> 'market_resolved' THEN round(ask_yes, 4) ELSE -1.0 END AS ask_yes,
  CASE WHEN event_type = 'market_resolved' THEN resolution_outcome ELSE '' END AS outcome FROM v_replay""")
def normalised_events(spark, sf_dir):
    v = view(spark, sf_dir, "v_replay")
    kind = F.when(F.col("event_type") == "trade_print", "ODD_KIND").otherwise(F.upper("event_type"))
    data = F.when(F.col("event_type") == "market_resolved", F.to_json(F.struct("resolution_outcome", F.lit(1.0).alias("resolution_value")))) \
        .otherwise(F.to_json(F.struct(F.create_map(F.lit("Yes"), F.col("ask_yes"), F.lit("No"), F.col("ask_no")).alias("best_ask"))))
    raw = F.concat(F.lit('{"event_type":"'), kind, F.lit('","platform":"'), "platform", F.lit('","market_id":"'),
                   F.col("market_id").cast("string"), F.lit('","timestamp":'),
                   F.floor(micros("ts") / 1_000_000).cast("string"), F.lit(',"data":'), data, F.lit("}"))
    out = normaliser("Generic")(v.select(raw.alias("raw"), "seq"))
    return out.select("seq", "event_type", F.unix_seconds("ts").alias("sec"), F.coalesce(
        F.round(F.col("snapshot.best_ask")["Yes"], 4), F.lit(-1.0)).alias("ask_yes"),
        F.coalesce("resolution_outcome", F.lit("")).alias("outcome"))


@query("token_quotes", with_views("v_replay") + """
SELECT seq, 'polymarket' AS platform, round(greatest(0.01, ask_yes - 0.005), 6) AS bid, round(least(0.99, ask_yes + 0.005), 6) AS ask, 0.02 * CAST(1.0 AS DOUBLE) AS fees FROM v_replay""")
def token_quotes(spark, sf_dir):
    v = view(spark, sf_dir, "v_replay")
    token = lambda o, p: F.struct(F.lit(o).alias("outcome"), F.col(p).alias("price"))
    raw = F.to_json(F.struct(F.col("market_id").cast("string").alias("condition_id"),
                             F.array(token("Yes", "ask_yes"), token("No", "ask_no")).alias("tokens"),
                             F.unix_seconds("ts").alias("update_time")))
    out = normaliser("polymarket")(v.select(raw.alias("raw"), "seq"))
    s = F.col("snapshot")
    return out.select("seq", "platform", F.round(s["best_bid"]["Yes"], 6).alias("bid"),
                      F.round(s["best_ask"]["Yes"], 6).alias("ask"), s["fees"].alias("fees"))


@query("cents_quotes", with_views("v_replay") + """
SELECT seq, round(1.0 - floor(ask_yes * 100) / 100.0, 6) AS no_bid, round(1.0 - (floor(ask_yes * 100) - 2) / 100.0, 6) AS no_ask, CAST(0.01 AS DOUBLE) AS fees FROM v_replay""")
def cents_quotes(spark, sf_dir):
    v = view(spark, sf_dir, "v_replay")
    cents = F.floor(F.col("ask_yes") * 100)
    raw = F.to_json(F.struct(F.col("market_id").cast("string").alias("ticker"), (cents - 2).alias("yes_bid"),
                             cents.alias("yes_ask"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")))
    s = F.col("snapshot")
    out = normaliser("kalshi")(v.select(raw.alias("raw"), "seq"))
    return out.select("seq", F.round(s["best_bid"]["No"], 6).alias("no_bid"),
                      F.round(s["best_ask"]["No"], 6).alias("no_ask"), s["fees"].alias("fees"))


@query("event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, sf_dir):
    parsed = F.variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("k"))


# ---------------------------------------------------------------- opportunities

_OPP = f"""pr AS (SELECT DISTINCT concat(a.market_id, '~', b.market_id) AS pair_id, a.market_id AS ia, b.market_id AS ib
  FROM v_replay a JOIN v_replay b ON b.market_id = a.market_id + 1 WHERE a.platform = 'alpha'),
ev AS (SELECT pair_id, ts, seq, market_id = ia AS is_a, event_type, ask_yes, ask_no FROM v_replay JOIN pr ON market_id = ia OR market_id = ib
  WHERE event_type IN {QUOTED} OR event_type = 'market_resolved'),
fw AS (SELECT pair_id, ts, seq, last_value(CASE WHEN is_a AND event_type <> 'market_resolved' THEN {{'t': ts, 'y': ask_yes, 'n': ask_no}} END IGNORE NULLS) OVER w AS a,
  last_value(CASE WHEN NOT is_a AND event_type <> 'market_resolved' THEN {{'t': ts, 'y': ask_yes, 'n': ask_no}} END IGNORE NULLS) OVER w AS b,
  coalesce(max(CASE WHEN event_type = 'market_resolved' THEN 1 END) OVER w, 0) AS done,
  lead(ts) OVER (PARTITION BY pair_id ORDER BY ts, seq) AS nxt FROM ev WINDOW w AS (PARTITION BY pair_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
nt AS (SELECT *, 1.0 - (a.y + b.n) - (CAST(0.01 AS DOUBLE) + 0.01) AS n1, 1.0 - (a.n + b.y) - (CAST(0.01 AS DOUBLE) + 0.01) AS n2 FROM fw WHERE done = 0 AND a IS NOT NULL AND b IS NOT NULL),
iv AS (SELECT pair_id, ts AS from_ts, nxt AS until, least(a.t, b.t) + INTERVAL 7 DAY AS vis, CASE WHEN n1 > 0.005 THEN 'Yes' ELSE 'No' END AS outcome_a,
  CASE WHEN n1 > 0.005 THEN a.y ELSE a.n END AS price_a, CASE WHEN n1 > 0.005 THEN b.n ELSE b.y END AS price_b, CASE WHEN n1 > 0.005 THEN n1 ELSE n2 END AS net
  FROM nt WHERE (n1 > 0.005 OR n2 > 0.005) AND ts <= least(a.t, b.t) + INTERVAL 7 DAY),
tms AS (SELECT DISTINCT ts FROM v_replay), tmx AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM tms),
nn AS (SELECT count(*) AS total FROM tms),
ob AS (SELECT iv.*, greatest(0, least(coalesce(u.i - 1, total), v.i, total - 1) - f.i + 1) AS observations
  FROM iv JOIN tmx f ON f.ts = iv.from_ts LEFT JOIN tmx u ON u.ts = iv.until ASOF JOIN tmx v ON v.ts <= iv.vis CROSS JOIN nn)"""
_OP = with_views("v_replay", also=_OPP)


def intervals(spark, sf_dir):
    rows = events(spark, sf_dir)
    states = op.pair_states(op.quotes_of(rows), replay_pairs(spark, sf_dir), keep=["snapshot"])
    return op.with_observations(op.opportunity_intervals(states), rows)


@query("opportunities", _OP + """
SELECT pair_id, epoch_us(from_ts) AS from_us, outcome_a, round(price_a, 6) AS price_a, round(price_b, 6) AS price_b, round(net, 6) AS net_edge,
  CAST(observations AS BIGINT) AS observations FROM ob""")
def opportunities(spark, sf_dir):
    return intervals(spark, sf_dir).select(
        "pair_id", micros("from_ts").alias("from_us"), "outcome_a", F.round("price_a", 6).alias("price_a"),
        F.round("price_b", 6).alias("price_b"), F.round("net_edge", 6).alias("net_edge"), "observations")


_FILL = _OPP + """,
md AS (SELECT * FROM (VALUES ('optimistic', 50.0, 0.0, 1.0), ('realistic', 100.0, 50.0, 0.9), ('pessimistic', 200.0, 150.0, 0.7)) t(mode, fb, sb, fr)),
lg AS (SELECT mode, pair_id, from_ts, observations, side, CAST(CASE side WHEN 'a' THEN price_a ELSE price_b END AS DOUBLE) AS base,
  CAST(fb AS DOUBLE) AS fb, CAST(sb AS DOUBLE) / 10000.0 AS sl, CAST(fr AS DOUBLE) AS fr, CASE side WHEN 'a' THEN outcome_a WHEN 'b' THEN CASE outcome_a WHEN 'Yes' THEN 'No' ELSE 'Yes' END END AS outcome
  FROM ob, md, (SELECT unnest(['a', 'b']) AS side) s WHERE observations > 0),
l1 AS (SELECT *, least(CAST(0.999 AS DOUBLE), base * (1.0 + sl)) AS p1 FROM lg),
l2 AS (SELECT *, CASE mode WHEN 'optimistic' THEN base WHEN 'realistic' THEN p1 ELSE least(CAST(0.999 AS DOUBLE), p1 * (1.0 + sl * 2.0)) END AS fp,
  CASE mode WHEN 'pessimistic' THEN 10.0 * fr ELSE CAST(10.0 AS DOUBLE) END AS fs FROM l1),
l3 AS (SELECT *, round(greatest(CAST(0.01 AS DOUBLE), fb / 10000.0) * (fp * 10.0), 6) AS fee FROM l2),
bk AS (SELECT mode, pair_id, from_ts, any_value(observations) AS observations, sum(fp * fs) AS locked, sum(fee) AS fees, max(fs) AS fs FROM l3 GROUP BY 1, 2, 3),
b1 AS (SELECT *, CASE WHEN fs < 9.999999 THEN 'partial' WHEN 10.0 - locked - fees < 0.005 * locked THEN 'rejected' ELSE 'filled' END AS fill_status FROM bk),
en AS (SELECT * FROM b1 WHERE fill_status <> 'rejected' QUALIFY row_number() OVER (PARTITION BY mode, pair_id ORDER BY from_ts) = 1),
rs AS (SELECT market_id, arg_min(resolution_outcome, (ts, seq)) AS oc, min(ts) AS rt FROM v_replay WHERE event_type = 'market_resolved' GROUP BY 1),
lq AS (SELECT market_id, arg_max(ask_yes, (ts, seq)) AS y, arg_max(ask_no, (ts, seq)) AS n FROM v_replay WHERE event_type IN ('market_created', 'market_updated', 'orderbook_snapshot') GROUP BY 1),
ps AS (SELECT en.mode, en.pair_id, en.locked, en.fees, en.fill_status, l3.fs, l3.outcome, r.oc, r.rt,
  CASE l3.outcome WHEN 'Yes' THEN (q.y - 0.02 + q.y) / 2 ELSE (q.n - 0.02 + q.n) / 2 END AS mid
  FROM en JOIN l3 ON l3.mode = en.mode AND l3.pair_id = en.pair_id AND l3.from_ts = en.from_ts JOIN pr ON pr.pair_id = en.pair_id
  LEFT JOIN rs r ON r.market_id = CASE side WHEN 'a' THEN ia ELSE ib END LEFT JOIN lq q ON q.market_id = CASE side WHEN 'a' THEN ia ELSE ib END),
cl AS (SELECT mode, pair_id, any_value(locked) AS locked, any_value(fees) AS fees, any_value(fill_status) AS fill_status, count(rt) = 2 AS settled,
  sum(CASE WHEN outcome = oc THEN fs ELSE 0 END) AS payout, sum(CASE WHEN fill_status = 'filled' THEN mid * fs ELSE 0 END) AS worth FROM ps GROUP BY 1, 2),
pl AS (SELECT *, CASE WHEN settled THEN payout ELSE worth END - locked - fees AS pnl FROM cl)"""
_FI = with_views("v_replay", also=_FILL)


def backtest_tables(spark, sf_dir):
    return backtest.run(materialize(events(spark, sf_dir)), replay_pairs(spark, sf_dir))


@query("basket_fills", _FI + """
SELECT mode, pair_id, epoch_us(from_ts) AS from_us, round(locked, 6) AS locked_capital, round(fees, 6) AS total_fees, fill_status FROM b1""")
def basket_fills(spark, sf_dir):
    _, out = backtest.attempts(intervals(spark, sf_dir).where("observations > 0"), replay_pairs(spark, sf_dir))
    return out.select("mode", "pair_id", micros("entry_time").alias("from_us"), F.round("locked_capital", 6).alias("locked_capital"),
                      F.round("total_fees", 6).alias("total_fees"), "fill_status")


@query("entry_selection", _FI + """
SELECT mode, pair_id, epoch_us(from_ts) AS entry_us, fill_status FROM en""")
def entry_selection(spark, sf_dir):
    _, out = backtest.attempts(intervals(spark, sf_dir).where("observations > 0"), replay_pairs(spark, sf_dir))
    return backtest.entries(out).select("mode", "pair_id", micros("entry_time").alias("entry_us"), "fill_status")


@query("order_attempts", _FI + """
SELECT b1.mode, CAST(sum(CASE WHEN en.from_ts IS NULL OR b1.from_ts < en.from_ts THEN b1.observations WHEN b1.from_ts = en.from_ts THEN 1 ELSE 0 END) AS BIGINT) AS attempted,
  CAST(sum(CASE WHEN en.from_ts IS NULL OR b1.from_ts < en.from_ts THEN b1.observations ELSE 0 END) AS BIGINT) AS rejected
FROM b1 LEFT JOIN en ON en.mode = b1.mode AND en.pair_id = b1.pair_id GROUP BY 1""")
def order_attempts(spark, sf_dir):
    return backtest_tables(spark, sf_dir)["attempts"]


@query("backtest_baskets", _FI + """
SELECT mode, pair_id, fill_status, settled, round(locked, 6) AS locked_capital, round(pnl, 6) AS realized_pnl FROM pl""")
def backtest_baskets(spark, sf_dir):
    t = backtest_tables(spark, sf_dir)
    held = t["settlements"].groupBy("basket_id").agg(F.count("*").alias("n"))
    return t["closed"].join(held, "basket_id", "left").select(
        "mode", "pair_id", "fill_status", (F.coalesce("n", F.lit(0)) == 2).alias("settled"),
        F.round("locked_capital", 6).alias("locked_capital"), F.round("realized_pnl", 6).alias("realized_pnl"))


@query("mode_comparison", _FI + """
SELECT mode, count(*) AS closed_baskets, round(sum(pnl), 4) AS total_realized_pnl, round(avg((pnl > 0)::INT), 6) AS win_rate, round(10000.0 + sum(pnl), 4) AS final_equity
FROM pl GROUP BY 1""")
def mode_comparison(spark, sf_dir):
    return backtest_tables(spark, sf_dir)["metrics"].select(
        "mode", "closed_baskets", F.round("total_realized_pnl", 4).alias("total_realized_pnl"),
        F.round("win_rate", 6).alias("win_rate"), F.round("final_equity", 4).alias("final_equity"))


@query("opportunity_count", _OP + "SELECT CAST(sum(observations) AS BIGINT) AS opportunities FROM ob")
def opportunity_count(spark, sf_dir):
    return backtest_tables(spark, sf_dir)["opportunities"]


@query("settlements", with_views("v_replay", also="""rs AS (SELECT market_id, arg_min(resolution_outcome, (ts, seq)) AS oc, min(ts) AS rt FROM v_replay WHERE event_type = 'market_resolved' GROUP BY 1),
po AS (SELECT seq, market_id, CASE WHEN seq % 3 = 0 THEN 'Yes' ELSE 'No' END AS outcome, CAST(seq % 7 + 1 AS DOUBLE) AS size FROM v_replay WHERE event_type = 'orderbook_snapshot')""") + """
SELECT CAST(po.seq AS VARCHAR) AS position_id, epoch_us(rt) AS at_us, CASE WHEN outcome = oc THEN size ELSE 0.0 END AS net_payout FROM po JOIN rs USING (market_id)""")
def settlements(spark, sf_dir):
    rows = events(spark, sf_dir)
    positions = rows.where("event_type = 'orderbook_snapshot'").select(
        F.col("seq").cast("string").alias("position_id"), F.col("seq").cast("string").alias("basket_id"), "platform", "market_id",
        F.when(F.col("seq") % 3 == 0, "Yes").otherwise("No").alias("outcome"), (F.col("seq") % 7 + 1).cast("double").alias("size"))
    out = pf.settle(positions, pf.first_resolutions(rows))
    return out.select("position_id", micros("settlement_time").alias("at_us"), "net_payout")


@query("unrealised_pnl", with_views("v_replay", also="""lq AS (SELECT market_id, arg_max(ask_yes, (ts, seq)) AS y FROM v_replay WHERE event_type IN ('market_created', 'market_updated', 'orderbook_snapshot') GROUP BY 1)""") + """
SELECT CAST(seq AS VARCHAR) AS position_id, round(CAST(seq % 7 + 1 AS DOUBLE) * CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END * (coalesce((y - 0.02 + y) / 2, ask_yes) - ask_yes), 6) AS unrealized_pnl
FROM v_replay LEFT JOIN lq USING (market_id) WHERE event_type = 'orderbook_snapshot'""")
def unrealised_pnl(spark, sf_dir):
    rows = events(spark, sf_dir)
    positions = rows.where("event_type = 'orderbook_snapshot'").select(
        F.col("seq").cast("string").alias("position_id"), "platform", "market_id", F.lit("Yes").alias("outcome"),
        F.when(F.col("seq") % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("seq") % 7 + 1).cast("double").alias("size"),
        F.col("snapshot.best_ask")["Yes"].alias("entry_price"))
    out = pf.unrealised(positions, replay.latest_state(rows))
    return out.select("position_id", F.round("unrealized_pnl", 6).alias("unrealized_pnl"))


@query("exhaustive_baskets", """
WITH asks AS (SELECT o_custkey AS g, o_orderpriority AS outcome, min(o_totalprice) / 1000000.0 AS ask FROM orders GROUP BY 1, 2)
SELECT g, count(*) AS outcomes, round(sum(ask * 1.02), 6) AS cost FROM asks GROUP BY 1 HAVING count(*) = 5 AND sum(ask * 1.02) < 1""")
def exhaustive_baskets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("outcome"), (F.col("o_totalprice") / 1000000.0).alias("ask"),
        F.lit(5).alias("need"))
    return op.exhaustive_baskets(rows, "g", "need", 0.02).select("g", "outcomes", F.round("cost", 6).alias("cost"))


# ---------------------------------------------------------------- books and fees

@query("book_walk", with_views("v_book", also="""d AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY leg_id ORDER BY price, l_partkey, l_suppkey, l_linenumber
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM v_book),
t AS (SELECT *, greatest(least(requested - depth, size), 0) AS take FROM d)""") + """
SELECT leg_id, sum(take) AS filled, round(sum(take * price) / sum(take), 6) AS avg_price, round(sum(take * price), 6) AS cost FROM t GROUP BY 1""")
def book_walk(spark, sf_dir):
    out = fills.book_walk(view(spark, sf_dir, "v_book"))
    return out.select("leg_id", "filled", F.round("avg_price", 6).alias("avg_price"), F.round("cost", 6).alias("cost"))


_BOOK_LEGS = """d AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY leg_id ORDER BY price, l_partkey, l_suppkey, l_linenumber
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM v_book),
t AS (SELECT leg_id, sum(greatest(least(60.0 - depth, size), 0)) AS fs0, sum(greatest(least(60.0 - depth, size), 0) * price) AS cost, min(price) AS best FROM d GROUP BY 1),
u AS (SELECT *, cost / fs0 AS avgp, abs(cost / fs0 - best) * fs0 AS slip FROM t),
md AS (SELECT * FROM (VALUES ('optimistic', 0.005, 0.0, 1.0), ('realistic', 0.01, 0.005, 0.9), ('pessimistic', 0.02, 0.015, 0.7)) t(mode, fb, sl, fr)),
f AS (SELECT leg_id, mode, CAST(fb AS DOUBLE) AS fb, CASE mode WHEN 'optimistic' THEN best WHEN 'realistic' THEN avgp ELSE least(0.999, avgp * (1.0 + CAST(sl AS DOUBLE) * 2.0)) END AS fp,
  CASE mode WHEN 'optimistic' THEN 60.0 WHEN 'realistic' THEN fs0 ELSE fs0 * CAST(fr AS DOUBLE) END AS fs, slip FROM u, md)"""


@query("leg_fills", with_views("v_book", also=_BOOK_LEGS) + """
SELECT leg_id, mode, round(fp, 6) AS fill_price, round(fs, 6) AS filled_size, round(fb * (fp * 60.0), 6) AS fee,
  round(CASE mode WHEN 'optimistic' THEN 0 WHEN 'realistic' THEN slip ELSE slip + abs(fp - slip / 60.0) * fs END, 7) AS slippage_cost,
  CASE WHEN abs(fs - 60.0) < 1e-6 THEN 'filled' ELSE 'partial' END AS leg_status FROM f""")
def leg_fills(spark, sf_dir):
    # merged to price ticks first: a leg's level list is then as short as its tick range
    ticks = view(spark, sf_dir, "v_book").groupBy("leg_id", "price").agg(F.sum("size").alias("size"))
    books = ticks.groupBy("leg_id").agg(
        F.collect_list(F.struct("price", "size")).alias("levels"), F.min("price").alias("best_price"))
    legs = books.withColumns({"side": F.lit("buy"), "requested_size": F.lit(60.0), "last_price": F.lit(None).cast("double"),
                              "platform_fee": F.lit(0.0)})
    out = fills.fill_legs(fills.per_mode(legs))
    return out.select("leg_id", "mode", F.round("fill_price", 6).alias("fill_price"), F.round("filled_size", 6).alias("filled_size"),
                      "fee", F.round("slippage_cost", 7).alias("slippage_cost"), "leg_status")


# ---------------------------------------------------------------- portfolio over v_basket

INITIAL = 10_000.0


def baskets(spark, sf_dir):
    return view(spark, sf_dir, "v_basket").select(
        "basket_id", "locked_capital", "realized_pnl", F.col("open_date").cast("timestamp").alias("open_time"),
        F.col("close_date").cast("timestamp").alias("close_time"), "arb_type", F.lit("closed").alias("status"),
        (F.col("locked_capital") + F.col("realized_pnl")).alias("payout"), F.lit(0.0).alias("total_fees"))


def fill_log(spark, sf_dir):
    return view(spark, sf_dir, "v_basket").select(
        "basket_id", "locked_capital", F.when(F.col("fill_status") == "F", "filled").when(F.col("fill_status") == "P", "partial")
        .otherwise("rejected").alias("fill_status"), (F.col("locked_capital") * 0.1).alias("total_fees"),
        (F.col("locked_capital") * 0.001).alias("total_slippage"), F.col("open_date").cast("timestamp").alias("fill_time"))


_VB = with_views("v_basket")


@query("fill_metrics", _VB + """
SELECT count(*) AS attempted, CAST(count_if(fill_status = 'F') AS BIGINT) AS filled, CAST(count_if(fill_status = 'P') AS BIGINT) AS partial,
  round(count_if(fill_status = 'F') / count(*), 6) AS fill_rate, round(sum(locked_capital * 0.001), 4) AS total_slippage,
  round(max(locked_capital) FILTER (fill_status = 'F'), 4) AS max_locked_capital FROM v_basket""")
def fill_metrics(spark, sf_dir):
    out = pf.fill_metrics(fill_log(spark, sf_dir))
    return out.select("attempted", "filled", "partial", F.round("fill_rate", 6).alias("fill_rate"),
                      F.round("total_slippage", 4).alias("total_slippage"), F.round("max_locked_capital", 4).alias("max_locked_capital"))


@query("backtest_metrics", _VB + """
SELECT count(*) AS closed_baskets, round(sum(realized_pnl), 4) AS total_realized_pnl, round(avg((realized_pnl > 0)::INT), 6) AS win_rate,
  round(avg(realized_pnl), 6) AS avg_profit, round(avg(date_diff('day', open_date, close_date) * 24.0), 4) AS avg_holding_hours,
  round(avg(realized_pnl / locked_capital) / stddev_pop(realized_pnl / locked_capital), 6) AS sharpe FROM v_basket""")
def backtest_metrics(spark, sf_dir):
    out = pf.basket_metrics(baskets(spark, sf_dir))
    digits = {"total_realized_pnl": 4, "win_rate": 6, "avg_profit": 6, "avg_holding_hours": 4, "sharpe": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("pnl_by_type", _VB + "SELECT arb_type, round(sum(realized_pnl), 4) AS realized_pnl FROM v_basket GROUP BY 1")
def pnl_by_type(spark, sf_dir):
    return pf.profit_by_type(baskets(spark, sf_dir), True).withColumn("realized_pnl", F.round("realized_pnl", 4))


@query("fill_status_counts", _VB + """
SELECT CASE fill_status WHEN 'F' THEN 'filled' WHEN 'P' THEN 'partial' ELSE 'rejected' END AS fill_status, count(*) AS n FROM v_basket GROUP BY 1""")
def fill_status_counts(spark, sf_dir):
    return pf.fill_status_counts(fill_log(spark, sf_dir))


@query("holding_bins", _VB + """
SELECT CAST(floor(date_diff('day', open_date, close_date) * 24.0 / 48) * 48 AS DOUBLE) AS bin_start, count(*) AS n FROM v_basket GROUP BY 1""")
def holding_bins(spark, sf_dir):
    return pf.holding_bins(baskets(spark, sf_dir), 48.0)


_CURVE = """cv AS (SELECT basket_id, close_date, 10000.0 + sum(realized_pnl) OVER (ORDER BY close_date, basket_id ROWS UNBOUNDED PRECEDING) AS equity,
  row_number() OVER (ORDER BY close_date, basket_id) AS step FROM v_basket),
dd AS (SELECT *, greatest(10000.0, max(equity) OVER (ORDER BY close_date, basket_id ROWS UNBOUNDED PRECEDING)) AS peak FROM cv)"""
_CV = with_views("v_basket", also=_CURVE)


@query("equity_curve", _CV + "SELECT basket_id, round(equity, 2) AS equity FROM cv")
def equity_curve(spark, sf_dir):
    return pf.equity_curve(baskets(spark, sf_dir), INITIAL).select("basket_id", F.round("equity", 2).alias("equity"))


@query("equity_chart", _CV + """
SELECT step, equity FROM (SELECT step, round(equity, 2) AS equity FROM cv UNION ALL SELECT 0, 10000.0
UNION ALL SELECT (SELECT count(*) + 1 FROM v_basket), round(10000.0 + (SELECT sum(realized_pnl) FROM v_basket), 2)) t""")
def equity_chart(spark, sf_dir):
    at = lambda t: F.lit(t).cast("timestamp")
    return pf.equity_chart(baskets(spark, sf_dir), INITIAL, at("1990-01-01"), at("2005-01-01")).select(
        "step", F.round("equity", 2).alias("equity"))


@query("drawdown", _CV + "SELECT basket_id, round(peak, 2) AS peak, round((peak - equity) / peak, 6) AS drawdown FROM dd")
def drawdown(spark, sf_dir):
    return pf.drawdown(baskets(spark, sf_dir), INITIAL).select(
        "basket_id", F.round("peak", 2).alias("peak"), F.round("drawdown", 6).alias("drawdown"))


@query("max_drawdown", _CV + "SELECT round(max((peak - equity) / peak), 6) AS max_drawdown FROM dd")
def max_drawdown(spark, sf_dir):
    return pf.max_drawdown(baskets(spark, sf_dir), INITIAL).select(F.round("max_drawdown", 6).alias("max_drawdown"))


@query("sampled_equity", _CV + "SELECT basket_id, round(equity, 2) AS equity FROM cv WHERE (step - 1) % 10 = 0")
def sampled_equity(spark, sf_dir):
    curve = pf.equity_curve(baskets(spark, sf_dir), INITIAL)
    return pf.sampled_equity(curve, ["close_time", "basket_id"], 10).select("basket_id", F.round("equity", 2).alias("equity"))


@query("cumulative_fees", _VB + """
SELECT basket_id, round(sum(locked_capital * 0.1) OVER (ORDER BY open_date, basket_id ROWS UNBOUNDED PRECEDING), 6) AS cumulative_fees FROM v_basket""")
def cumulative_fees(spark, sf_dir):
    return pf.cumulative_fees(fill_log(spark, sf_dir)).select("basket_id", "cumulative_fees")


_BOOKED = """bo AS (SELECT basket_id, open_date AS t, 'fill' AS kind, -locked_capital AS dc, locked_capital AS dl FROM v_basket WHERE fill_status <> 'O'
  UNION ALL SELECT basket_id, close_date, 'settle', locked_capital + realized_pnl, -locked_capital FROM v_basket WHERE fill_status <> 'O'),
cs AS (SELECT basket_id, kind, 10000.0 + sum(dc) OVER w AS cash, sum(dl) OVER w AS locked FROM bo WINDOW w AS (ORDER BY t, basket_id, kind ROWS UNBOUNDED PRECEDING))"""


@query("ledger", with_views("v_basket", also=_BOOKED) + "SELECT basket_id, kind, round(cash, 5) AS cash, round(locked, 5) AS locked FROM cs")
def ledger(spark, sf_dir):
    log = fill_log(spark, sf_dir)
    closed = baskets(spark, sf_dir).join(log.where("fill_status <> 'rejected'").select("basket_id"), "basket_id", "left_semi")
    out = pf.ledger(log, closed, INITIAL)
    return out.select("basket_id", "kind", F.round("cash", 5).alias("cash"), F.round("locked", 5).alias("locked"))


@query("open_counts", with_views("v_basket", also="""ch AS (SELECT basket_id, open_date AS t, 1 AS c FROM v_basket UNION ALL SELECT basket_id, close_date, -1 FROM v_basket)""") + """
SELECT basket_id, c AS change, CAST(sum(c) OVER (ORDER BY t, c, basket_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open_baskets FROM ch""")
def open_counts(spark, sf_dir):
    return pf.open_counts(baskets(spark, sf_dir), 20).select("basket_id", "change", "open_baskets")


@query("backtest_summary", _CV + """
SELECT round(count_if(fill_status = 'F') / count(*), 4) AS fill_rate, count(*) AS closed_baskets, round(sum(realized_pnl), 4) AS total_realized_pnl,
  round(10000.0 + sum(realized_pnl), 4) AS final_equity, (SELECT round(max((peak - equity) / peak), 4) FROM dd) AS max_drawdown FROM v_basket""")
def backtest_summary(spark, sf_dir):
    closed = baskets(spark, sf_dir)
    out = pf.summary(pf.fill_metrics(fill_log(spark, sf_dir)), pf.basket_metrics(closed), pf.max_drawdown(closed, INITIAL), INITIAL)
    return out.select("fill_rate", "closed_baskets", "total_realized_pnl", "final_equity", "max_drawdown")


# ---------------------------------------------------------------- resolved trades

_TRADES = """mk AS (SELECT 'alpha' AS platform, CAST(p_partkey AS VARCHAR) AS id, strftime(DATE '1997-01-01' + CAST(p_size * 15 AS INT), '%Y-%m-%d') AS end_date,
  CAST(p_partkey % 101 AS DOUBLE) / 100.0 AS last_price FROM part UNION ALL
  SELECT 'beta', CAST(s_suppkey AS VARCHAR), CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE '1998-03-05' END, CAST((s_suppkey * 7) % 101 AS DOUBLE) / 100.0 FROM supplier),
sg AS (SELECT pair_id, price_a, price_b, round(abs(price_a - price_b), 6) AS raw, CASE WHEN price_a >= price_b THEN 1 ELSE 0 END AS buy_b FROM v_pair),
tr AS (SELECT sg.*, a.end_date AS ea, b.end_date AS eb, coalesce(a.end_date, b.end_date) AS exit_date,
  CASE WHEN a.last_price >= 0.8 THEN 1 WHEN a.last_price <= 0.2 THEN 0 END AS ra, CASE WHEN b.last_price >= 0.8 THEN 1 WHEN b.last_price <= 0.2 THEN 0 END AS rb
  FROM sg LEFT JOIN mk a ON a.platform = 'alpha' AND a.id = split_part(pair_id, '-', 3) LEFT JOIN mk b ON b.platform = 'beta' AND b.id = split_part(pair_id, '-', 4)),
t2 AS (SELECT *, round(CASE WHEN ra IS NULL OR rb IS NULL THEN NULL WHEN ra = rb THEN raw * 100.0
  WHEN buy_b = 1 THEN (CASE WHEN rb = 1 THEN 1.0 - price_b ELSE -price_b END + CASE WHEN ra = 0 THEN price_a ELSE price_a - 1.0 END) * 100.0
  ELSE (CASE WHEN ra = 1 THEN 1.0 - price_a ELSE -price_a END + CASE WHEN rb = 0 THEN price_b ELSE price_b - 1.0 END) * 100.0 END, 2) AS pnl FROM tr),
t3 AS (SELECT *, CASE WHEN pnl IS NULL THEN 'UNKNOWN' WHEN ra = rb OR pnl >= 0 THEN 'WIN' ELSE 'LOSS' END AS outcome,
  coalesce(strftime(CAST(exit_date AS DATE) - 30, '%Y-%m-%d'), '1997-06-01') AS entry_date FROM t2)"""
_TR = with_views("v_pair", also=_TRADES)


def trades(spark, sf_dir, as_of=None):
    part = table(spark, sf_dir, "part").select(
        F.lit("alpha").alias("platform"), F.col("p_partkey").cast("string").alias("market_id"),
        F.date_add(F.lit("1997-01-01").cast("date"), F.col("p_size") * 15).cast("string").alias("end_date"),
        ((F.col("p_partkey") % 101).cast("double") / 100.0).alias("last_price"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.lit("beta").alias("platform"), F.col("s_suppkey").cast("string").alias("market_id"),
        F.when(F.col("s_nationkey") % 5 != 0, "1998-03-05").alias("end_date"),
        ((F.col("s_suppkey") * 7 % 101).cast("double") / 100.0).alias("last_price"))
    a, b = F.col("price_a"), F.col("price_b")
    from crossquote.functions import pricing as px
    signals = view(spark, sf_dir, "v_pair").select(
        "pair_id", "price_a", "price_b", F.lit("alpha").alias("platform_a"), F.split_part("pair_id", F.lit("-"), F.lit(3)).alias("id_a"),
        F.lit("beta").alias("platform_b"), F.split_part("pair_id", F.lit("-"), F.lit(4)).alias("id_b"),
        px.raw_spread(a, b).alias("raw_spread"), px.direction(a, b).alias("direction"), F.lit(100.0).alias("size_usd"))
    return serving.resolved_trades(signals, part.unionByName(supplier), F.lit("1997-06-01"), as_of)


@query("resolved_trades", _TR + """
SELECT pair_id, coalesce(exit_date, '') AS exit_date, entry_date, outcome, coalesce(pnl, 0.0) AS realized_pnl FROM t3""")
def resolved_trades(spark, sf_dir):
    return trades(spark, sf_dir).select("pair_id", F.coalesce("exit_date", F.lit("")).alias("exit_date"), "entry_date", "outcome",
                                        F.coalesce("realized_pnl", F.lit(0.0)).alias("realized_pnl"))


@query("trades_as_of", _TR + """
SELECT outcome, count(*) AS n FROM t3 WHERE coalesce(ea, '9999') >= '1998-01-01' AND coalesce(eb, '9999') >= '1998-01-01' GROUP BY 1""")
def trades_as_of(spark, sf_dir):
    return trades(spark, sf_dir, F.lit("1998-01-01")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("daily_pnl", _TR + """
SELECT epoch_us(CAST(d AS TIMESTAMP)) AS day_us, round(coalesce(x, 0), 2) AS daily_pnl, round(sum(coalesce(x, 0)) OVER (ORDER BY d), 2) AS cumulative_pnl
FROM (SELECT CAST(unnest(generate_series(DATE '1997-06-01', DATE '1998-06-01', INTERVAL 1 DAY)) AS DATE) AS d) c
LEFT JOIN (SELECT greatest(CAST(exit_date AS DATE), DATE '1997-06-01') AS e, sum(coalesce(pnl, 0)) AS x FROM t3 WHERE exit_date IS NOT NULL GROUP BY 1) s ON e = d""")
def daily_pnl(spark, sf_dir):
    out = serving.daily_pnl(trades(spark, sf_dir), F.lit("1997-06-01").cast("date"), F.lit("1998-06-01").cast("date"))
    return out.select(micros("date").alias("day_us"), "daily_pnl", "cumulative_pnl")


@query("trade_cohorts", _TR + """
SELECT CAST(count_if(entry_date = '1998-02-03') AS BIGINT) AS entered, CAST(count_if(exit_date = '1998-02-03' AND entry_date <= '1998-02-03') AS BIGINT) AS resolved,
  CAST(count_if(entry_date <= '1998-02-03' AND (exit_date IS NULL OR exit_date > '1998-02-03')) AS BIGINT) AS open, CAST(count_if(exit_date <= '1998-02-03') AS BIGINT) AS resolved_so_far,
  CAST(count_if(exit_date <= '1998-02-03' AND outcome = 'WIN') AS BIGINT) AS wins, CAST(count_if(exit_date <= '1998-02-03' AND outcome = 'LOSS') AS BIGINT) AS losses,
  round(coalesce(sum(pnl) FILTER (exit_date <= '1998-02-03'), 0), 2) AS total_pnl FROM t3""")
def trade_cohorts(spark, sf_dir):
    return serving.cohorts(trades(spark, sf_dir), F.lit("1998-02-03")).withColumn("total_pnl", F.round("total_pnl", 2))


@query("last_prices", with_views("v_price") + """
SELECT market_id, round(arg_max(yes_price, (ts, seq)), 6) AS last_price, CASE WHEN arg_max(yes_price, (ts, seq)) >= 0.8 THEN 'YES' WHEN arg_max(yes_price, (ts, seq)) <= 0.2 THEN 'NO' ELSE '' END AS resolution
FROM v_price GROUP BY 1""")
def last_prices(spark, sf_dir):
    from crossquote.functions import pricing as px
    out = serving.final_prices(view(spark, sf_dir, "v_price"))
    return out.select("market_id", F.round("last_price", 6).alias("last_price"),
                      F.coalesce(px.resolution(F.col("last_price")), F.lit("")).alias("resolution"))


@query("history_array_price", """
SELECT user_id, round(arg_max(value, ts), 6) AS last FROM events GROUP BY 1""")
def history_array_price(spark, sf_dir):
    at = lambda pick: F.struct(pick("ts").alias("timestamp"), (
        F.max_by if pick is F.max else F.min_by)("value", "ts").alias("yes_price"))
    # a stored two-entry history per market, newest first
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array(at(F.max), at(F.min)).alias("h"))
    return rows.select("user_id", F.round(serving.last_price_in(F.col("h"), F.lit(0.5)), 6).alias("last"))


@query("execution_totals", """
SELECT round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS confirmed_pnl, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS live FROM orders""")
def execution_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("net_pnl"), F.when(
        F.col("o_orderstatus") == "F", "CONFIRMED").when(F.col("o_orderstatus") == "O", "live").otherwise("other").alias("status"))
    return serving.execution_totals(rows).withColumn("confirmed_pnl", F.round("confirmed_pnl", 2))


@query("running_quantiles", """
SELECT user_id, round(median(value), 6) AS mid, round(quantile_cont(value, 0.9), 6) AS high FROM events GROUP BY 1""")
def running_quantiles(spark, sf_dir):
    out = runs.exact_quantiles(table(spark, sf_dir, "events"), ["user_id"], {"value": {"mid": 0.5, "high": 0.9}})
    return out.select("user_id", F.round("mid", 6).alias("mid"), F.round("high", 6).alias("high"))


@query("loaded_csv", """
SELECT CAST(event_id AS VARCHAR) AS market_id, epoch_us(ts) AS us, round(value / 1000.0, 6) AS fees FROM events WHERE event_id % 50 <> 0
UNION ALL SELECT 'quarantined', count(*), NULL FROM events WHERE event_id % 50 = 0""")
def loaded_csv(spark, sf_dir):
    """The events written out as CSV, some with unreadable times, and loaded back: none is lost."""
    import uuid

    from crossquote.session import shared_dir
    from crossquote.sources import quotes
    from workload.views import table

    given = table(spark, sf_dir, "events").select(
        F.lit("market_updated").alias("event_type"), F.lit("alpha").alias("platform"), F.col("event_id").cast("string").alias("market_id"),
        F.when(F.col("event_id") % 50 == 0, "someday").otherwise(
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.to_json(F.struct((F.col("value") / 1000.0).alias("fees"))).alias("data_json"))
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    given.write.option("header", True).option("escape", '"').csv(path)
    events, bad = quotes.load_events(spark, path)
    return events.select("market_id", micros("ts").alias("us"), F.round("snapshot.fees", 6).alias("fees")).unionByName(
        bad.agg(F.count("*").alias("us")).select(F.lit("quarantined").alias("market_id"), "us", F.lit(None).cast("double").alias("fees")))
