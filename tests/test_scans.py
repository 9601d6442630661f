"""Skew-safe scans and the greedy throttle against plain sequential code, with one hot key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from crossquote.operators import runs as rn
from crossquote.plans import decay


@pytest.fixture(autouse=True)
def many_runs(spark):
    """Small inputs must stay in several runs here."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def series(n=1500, seed=5):
    """Two thirds of the rows belong to one key; many equal times."""
    rng, t0, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        key = "hot" if i % 3 else f"k{i % 7}"
        rows.append((key, t0 + timedelta(seconds=rng.randrange(0, 20_000)), i, rng.choice([None, rng.randrange(100)])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, ts timestamp, seq long, v long").repartition(5)


def test_scans_match_sequential(spark):
    rows = series()
    runs = rn.sorted_runs(frame(spark, rows), ["k"], ["ts", "seq"])
    assert runs.where("k = 'hot'").select(rn.RUN).distinct().count() > 1  # the hot key was split
    out = rn.scan_last(runs, ["k"], ["ts", "seq"], {"last": F.col("v")}, before={"prev": F.col("v")})
    out = rn.scan_sum(out, ["k"], ["ts", "seq"], {"total": F.coalesce("v", F.lit(0))})
    out = rn.scan_max(out, ["k"], ["ts", "seq"], {"top": F.col("v")})
    out = rn.scan_next(out, ["k"], ["ts", "seq"], {"next": F.col("v")})
    out = rn.scan_index(out, ["k"], ["ts", "seq"])
    got = {r.seq: (r.last, r.prev, r.total, r.top, r.next, r.idx) for r in out.collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        last, total, top = None, 0, None
        for i, (_, _, seq, v) in enumerate(mine):
            prev = last
            last = v if v is not None else last
            total += v or 0
            top = v if top is None else top if v is None else max(top, v)
            nxt = next((x[3] for x in mine[i + 1:] if x[3] is not None), None)
            assert got[seq] == (last, prev, total, top, nxt, i + 1)


def test_global_scan(spark):
    rows = series(300)
    runs = rn.sorted_runs(frame(spark, rows), [], ["ts", "seq"])
    out = {r.seq: r.n for r in rn.scan_index(runs, [], ["ts", "seq"], "n").collect()}
    assert [out[r[2]] for r in sorted(rows, key=lambda r: (r[1], r[2]))] == list(range(1, 301))


def test_throttle_matches_greedy(spark):
    for seed, span in ((1, 20_000), (2, 300), (3, 3_000_000)):
        rng, t0 = random.Random(seed), datetime(2024, 1, 1)
        rows = [("hot" if i % 4 else "cold", t0 + timedelta(milliseconds=rng.randrange(span * 10)), i, 0.1)
                for i in range(1200)]
        df = spark.createDataFrame(rows, "pair_id string, ts timestamp, seq long, raw_spread double").repartition(6)
        kept = {r.seq for r in decay.throttle(df, 60).collect()}
        want = set()
        for key in ("hot", "cold"):
            last = None
            for _, ts, seq, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
                if last is None or (ts - last).total_seconds() >= 60:
                    last = ts
                    want.add(seq)
        assert kept == want


def test_count_until(spark):
    t = spark.createDataFrame([(1,), (3,), (3,), (7,)], "x long")
    p = spark.createDataFrame([(0,), (3,), (5,), (9,)], "x long")
    got = {r.x: r.n_until for r in rn.count_until(t, p, "x").collect()}
    assert (got[0], got[3], got[5], got[9]) == (0, 2, 2, 3)


def test_episode_states(spark):
    t0 = datetime(2024, 1, 1)
    raws = [0.0, 0.03, 0.05, 0.01, 0.004, -0.03, 0.03, 0.01, -0.01, 0.01, 0.04]
    rows = [("p", t0 + timedelta(minutes=i), i, x) for i, x in enumerate(raws)]
    df = spark.createDataFrame(rows, "pair_id string, ts timestamp, seq long, raw_spread double")
    got = [(r.start_time.minute, r.status, round(r.peak_spread, 3), r.snapshot_count)
           for r in decay.episodes(df).orderBy("episode_no").collect()]
    assert got == [(1, "closed", 0.05, 3), (5, "reversed", 0.03, 1), (6, "reversed", 0.03, 2), (10, "open", 0.04, 1)]


def test_episode_expiry(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("p", t0 + timedelta(hours=h), h, 0.05) for h in range(0, 30, 2)]
    df = spark.createDataFrame(rows, "pair_id string, ts timestamp, seq long, raw_spread double")
    (r,) = decay.episodes(df).collect()
    assert (r.status, r.snapshot_count, r.duration_seconds) == ("expired", 12, 86400.0)
