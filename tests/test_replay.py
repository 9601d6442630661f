"""Replay, fills and the hand-checked backtest."""

import json

import pytest
from pyspark.sql import functions as F

from crossquote.operators import fills as fl, opportunities as op, replay as rp
from crossquote.plans import backtest, portfolio as pf, serving
from crossquote.sources import quotes


def record(kind, platform, market, ts, yes=None, no=None, fees=0.02, **data):
    body = dict(data)
    if yes is not None:
        body |= {"outcomes": ["Yes", "No"], "best_bid": {"Yes": round(yes - .02, 2), "No": round(no - .02, 2)},
                 "best_ask": {"Yes": yes, "No": no}, "last_traded": {"Yes": yes - .01, "No": no - .01}, "fees": fees}
    return json.dumps({"event_type": kind, "platform": platform, "market_id": market, "timestamp": ts, "data": body})


def toy(first=(0.40, 0.60), second=(0.57, 0.45), fees=0.02, resolve=True):
    start = ((0.46, 0.54), (0.42, 0.58)) if fees else ((0.60, 0.60), (0.60, 0.60))
    rows = [record("market_created", "p", "a", "2024-01-01T00:00:00Z", *start[0], fees),
            record("market_created", "k", "b", "2024-01-01T00:05:00Z", *start[1], fees),
            record("market_updated", "p", "a", "2024-01-02T10:00:00Z", *first, fees),
            record("market_updated", "k", "b", "2024-01-02T10:01:00Z", *second, fees),
            record("market_updated", "p", "a", "2024-06-01T00:00:00Z", 0.60, 0.42, fees)]
    if resolve:
        rows += [record("market_resolved", m, n, "2025-01-01T00:10:00Z", resolution_outcome="Yes", resolution_value=1.0)
                 for m, n in (("p", "a"), ("k", "b"))]
    return rows


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([("ab", "p", "a", "k", "b")],
                                 "pair_id string, platform_a string, id_a string, platform_b string, id_b string")


def run(spark, pairs, rows, *modes, **options):
    return backtest.run(quotes.events_from_records(spark, rows), pairs, *(modes or ("optimistic",)), **options)


def test_golden_profit(spark, pairs):
    t = run(spark, pairs, toy(), fee_bps=0.0)
    (b,) = t["closed"].collect()
    assert str(b.entry_time) == "2024-01-02 10:01:00" and round(b.locked_capital, 6) == 8.5
    assert round(b.total_fees, 6) == 0.17 and round(b.payout, 6) == 10.0 and round(b.realized_pnl, 6) == 1.33
    assert round(t["metrics"].first().final_equity, 6) == 10001.33
    a = t["attempts"].first()
    assert (a.attempted, a.rejected) == (1, 0)


@pytest.mark.parametrize("no,profit", [(0.45, 1.50), (0.50, 1.00)])
def test_profit_without_fees(spark, pairs, no, profit):
    rows = toy((0.40, 0.60), (0.60, no), fees=0.0)
    assert round(run(spark, pairs, rows, fee_bps=0.0)["closed"].first().realized_pnl, 6) == profit


@pytest.mark.parametrize("yes,no", [(0.50, 0.50), (0.55, 0.55)])
def test_no_edge_no_trade(spark, pairs, yes, no):
    t = run(spark, pairs, toy((yes, 0.60), (0.60, no), fees=0.0), fee_bps=0.0)
    assert t["closed"].count() == 0 and t["intervals"].count() == 0


def test_fee_blocks_fill(spark, pairs):
    t = run(spark, pairs, toy((0.49, 0.60), (0.60, 0.49), fees=0.0), fee_bps=200.0)
    assert t["intervals"].count() == 1 and t["baskets"].count() == 0
    assert t["attempts"].first().rejected == 1


def test_unresolved_is_valued_at_mid(spark, pairs):
    b = run(spark, pairs, toy(resolve=False), fee_bps=0.0)["closed"].collect()
    # the last update is never observed, but its quotes value the open legs: Yes .59, No .44
    assert len(b) == 1 and round(b[0].payout, 6) == round(10 * (0.59 + 0.44), 6)


def test_modes_order_profit(spark, pairs):
    t = run(spark, pairs, toy(), "optimistic", "realistic", "pessimistic")
    got = {r.mode: r for r in t["closed"].collect()}
    assert got["optimistic"].realized_pnl > got["realistic"].realized_pnl > got["pessimistic"].realized_pnl
    assert got["pessimistic"].fill_status == "partial"


def test_stale_quotes_are_invisible(spark, pairs):
    rows = toy()
    events = quotes.events_from_records(spark, rows)
    states = op.pair_states(op.quotes_of(events), pairs, keep=["snapshot"])
    assert op.opportunity_intervals(states, 86400.0).count() == 1
    assert op.opportunity_intervals(states, 30.0).count() == 0


def test_state_and_prints(spark):
    rows = toy()[:1] + [record("trade_print", "p", "a", "2024-01-01T01:00:00Z", outcome="Yes", price=0.9)] + toy()[5:6]
    events = quotes.events_from_records(spark, rows)
    (s,) = rp.latest_state(events).collect()
    assert (s.status, s.last_yes, s.resolution_outcome, s.resolution_value) == ("resolved", 0.9, "Yes", 1.0)
    history = [r.last_yes for r in rp.state_history(events).orderBy("seq").collect()]
    assert [round(x, 2) for x in history] == [0.45, 0.9, 0.9]
    assert rp.replay_stream(events, end=F.lit("2024-01-01 00:30:00").cast("timestamp")).count() == 1


def test_walk_levels(spark):
    levels = [(0.42, 4.0), (0.40, 4.0), (0.45, 2.0)]
    df = spark.createDataFrame([(levels, 10.0), (levels, 100.0), ([], 5.0)], "l array<struct<price:double,size:double>>, w double")
    got = df.select(fl.walk_levels(F.col("l"), F.col("w"), F.lit(False)).alias("r")).collect()
    assert round(got[0].r.cost / got[0].r.filled, 6) == 0.418 and got[1].r.filled == 10.0 and got[2].r.filled == 0.0


def test_rejections(spark):
    df = spark.createDataFrame([("p", "a", None, 5.0), ("p", "a", "resolved", 5.0), ("p", "a", "active", 0.5), ("p", "a", "active", 501.0), ("p", "a", "active", 500.0)],
                               "platform string, market_id string, market_status string, requested_size double")
    got = [r[0] for r in df.select(fl.action_rejection(df)).collect()]
    assert got[0].startswith("Unknown") and got[1].startswith("Market not active") and got[2] and got[3] and got[4] is None


def test_settlement_of_no_value(spark):
    pos = spark.createDataFrame([("1", "p", "a", "Yes", 2.0), ("2", "p", "a", "No", 3.0)], "position_id string, platform string, market_id string, outcome string, size double")
    res = spark.createDataFrame([("p", "a", "No", 0.0)], "platform string, market_id string, outcome string, value double").withColumn("time", F.current_timestamp())
    assert {r.position_id: r.net_payout for r in pf.settle(pos, res).collect()} == {"1": 2.0, "2": 0.0}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_mmr_matches_plain_greedy(spark, block):
    """Small blocks force many rounds; scores and profits tie."""
    rows = [(f"p{i:02d}", float(100 - i // 3), ["alpha beta", "alpha beta gamma", "delta", ""][i % 4] + f" topic{i % 6}", "") for i in range(30)]
    df = spark.createDataFrame(rows, "pair_id string, expected_profit double, text_a string, text_b string")
    got = [r.pair_id for r in serving.diversify(df, 10, pool=None, block=block).orderBy("pick").collect()]
    sets = [{w for w in r[2].split() if len(w) > 2} or {r[0]} for r in rows]
    picked, left = [0], list(range(1, 30))
    while len(picked) < 10:
        score = lambda i: 0.65 * rows[i][1] / 100 - (1.0 - 0.65) * max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in picked)
        best = max(left, key=lambda i: (score(i), rows[i][1], -i))
        picked.append(best)
        left.remove(best)
    assert got == [f"p{i:02d}" for i in picked]
    assert serving.diversify(df, 50, pool=7, block=block).count() == 7
    assert serving.diversify(df.limit(0), 5, pool=None).count() == 0
