import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from crossquote.plans import decay
from crossquote.sources.upserts import KeyedTable
from crossquote.streaming import carried
from crossquote.streaming import quotes as sq

START = datetime(2024, 1, 1)
ROWS = "pair_id string, ts timestamp, seq long, raw_spread double"


def walk(seed, pairs=4, n=150):
    rng = random.Random(seed)
    at, rows = 0, []
    for seq in range(n):
        at += rng.choice([0, 20, 1800, 7200, 40_000])
        rows.append((f"p{rng.choice([0, 0, 0, *range(pairs)])}", START + timedelta(seconds=at), seq,
                     round(rng.choice([0.001, 0.01, -0.01, 0.03, -0.03, 0.05]), 6)))
    return rows


def batches(spark, rows, cuts):
    edges = [0, *cuts, len(rows)]
    return [spark.createDataFrame(rows[a:b], ROWS) for a, b in zip(edges, edges[1:])]


def read(spark, path):
    try:
        return spark.read.parquet(path)
    except Exception:  # noqa: BLE001 - nothing was written
        return None


@pytest.mark.parametrize("seed,cuts", [(1, [40, 41, 100]), (2, [1, 2, 149])])
def test_episodes_over_batches_are_those_of_one_batch(spark, tmp_path, seed, cuts):
    rows = walk(seed)
    stream = carried.EpisodeStream(spark, f"{tmp_path}/s", carried.numbered_folder(f"{tmp_path}/out"))
    for n, batch in enumerate(batches(spark, rows, cuts)):
        stream(batch, n)
        stream(batch, n)  # a batch that is run again changes nothing
    key = lambda r: (r.pair_id, r.episode_no)
    got = {key(r): (r.start_time, r.end_time, r.opening_spread, r.peak_spread, r.current_spread, r.status, r.snapshot_count)
           for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    last, want = rows[-1][1], {}
    for r in decay.episodes(spark.createDataFrame(rows, ROWS)).collect():
        end, status = r.end_time, r.status
        if status == "open" and last >= r.start_time + timedelta(hours=24):
            end, status = r.start_time + timedelta(hours=24), "expired"
        if status != "open":
            want[key(r)] = (r.start_time, end, r.opening_spread, r.peak_spread, r.current_spread, status, r.snapshot_count)
    assert got == want and len(want) > 20


def test_an_episode_expires_without_a_further_row(spark, tmp_path):
    one = [("a", START, 0, 0.05), ("b", START, 1, 0.0)]
    later = [("b", START + timedelta(hours=23), 2, 0.0)]
    after = [("b", START + timedelta(hours=24), 3, 0.0)]
    stream = carried.EpisodeStream(spark, f"{tmp_path}/s", carried.numbered_folder(f"{tmp_path}/out"))
    told = []
    for n, rows in enumerate([one, later, after, [("b", START + timedelta(hours=30), 4, 0.0)], [("a", START + timedelta(hours=40), 5, 0.0)]]):
        stream(spark.createDataFrame(rows, ROWS), n)
        told.append(spark.read.parquet(f"{tmp_path}/out").count())
    assert told == [0, 0, 1, 1, 1]
    (row,) = spark.read.parquet(f"{tmp_path}/out").collect()
    assert (row.pair_id, row.status, row.end_time, row.snapshot_count) == ("a", "expired", START + timedelta(hours=24), 1)


def test_idle_pairs_leave_the_state(spark, tmp_path):
    stream = carried.EpisodeStream(spark, f"{tmp_path}/s", carried.numbered_folder(f"{tmp_path}/out"), idle_seconds=3600)
    stream(spark.createDataFrame([("a", START, 0, 0.0), ("open", START, 1, 0.05), ("b", START, 2, 0.05)], ROWS), 0)
    assert stream.state.after(0).count() == 3
    stream(spark.createDataFrame([("b", START + timedelta(hours=2), 3, 0.0)], ROWS), 1)
    assert {r.pair_id for r in stream.state.after(1).collect()} == {"open", "b"}  # one runs still
    stream(spark.createDataFrame([("b", START + timedelta(hours=60), 4, 0.0)], ROWS), 2)
    assert {r.pair_id for r in stream.state.after(2).collect()} == {"b"}


@pytest.mark.parametrize("cuts", [[50], [1, 2, 3, 90]])
def test_throttle_over_batches_keeps_no_finished_state(spark, tmp_path, cuts):
    rows = walk(5)
    stream = carried.ThrottleStream(spark, f"{tmp_path}/s", carried.numbered_folder(f"{tmp_path}/out"), 1800)
    parts = batches(spark, rows, cuts)
    for n, batch in enumerate(parts):
        stream(batch, n)
    got = sorted((r.pair_id, r.seq) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    last, want = {}, []
    for pair, ts, seq, _ in rows:
        if pair not in last or ts - last[pair] >= timedelta(seconds=1800):
            last[pair] = ts
            want.append((pair, seq))
    assert got == sorted(want)
    alive = {p for p, ts in last.items() if rows[-1][1] - ts < timedelta(seconds=1800)}
    assert {r.pair_id for r in stream.state.after(len(parts) - 1).collect()} == alive


def test_late_rows_are_counted_and_kept(spark, tmp_path):
    split = carried.LateSplit(spark, f"{tmp_path}/s", {"k": "string"}, 60, carried.numbered_folder(f"{tmp_path}/on"),
                              carried.numbered_folder(f"{tmp_path}/late"))
    at = lambda s: START + timedelta(seconds=s)
    schema = "k string, ts timestamp, n int"
    one = [("a", at(1000), 0), ("a", at(0), 1), (None, at(500), 2), ("b", None, 3)]
    two = [("a", at(940), 4), ("a", at(939), 5), (None, at(0), 6), ("b", at(1), 7), ("c", at(-9999), 8)]
    for n, rows in enumerate([one, two, []]):
        split(spark.createDataFrame(rows, schema), n)
        split(spark.createDataFrame(rows, schema), n)
    late = {r.n: r.behind_seconds for r in spark.read.parquet(f"{tmp_path}/late").collect()}
    assert late == {3: None, 5: 61.0, 6: 500.0}
    assert {r.n for r in spark.read.parquet(f"{tmp_path}/on").collect()} == {0, 1, 2, 4, 7, 8}
    assert sorted((r.batch, r.on_time, r.late) for r in split.counted().collect()) == [(0, 3, 1), (1, 3, 2), (2, 0, 0)]


def test_stale_quotes_are_none_and_leave_the_state(spark, tmp_path):
    pairs = spark.createDataFrame([("p", "x", "m", "y", "w")], "pair_id string, platform_a string, id_a string, platform_b string, id_b string")
    ticks = "platform string, market_id string, seq long, ts timestamp, yes_price double"
    at = lambda h: START + timedelta(hours=h)
    steps = [[("x", "m", 0, at(0), 0.1), ("y", "w", 1, at(1), 0.2), ("y", "w", 2, at(1), 0.3)],
             [("x", "m", 3, at(2), 0.4), ("x", "m", 4, at(20), 0.5)],
             [("y", "w", 5, at(21), 0.6), ("x", "m", 6, at(100), 0.7)], [("y", "w", 7, at(200), 0.8)]]
    table = KeyedTable(spark, f"{tmp_path}/table", ["pair_id", "seq"], buckets=2)
    held = []
    for rows in steps:
        spark.createDataFrame(rows, ticks).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ticks).parquet(f"{tmp_path}/in")
        met = sq.fresh_pairs(sq.routed_ticks(stream, pairs), sq.routed_ticks(stream, pairs), "5 hours", "1 minute")
        query = sq.each_batch(met, sq.upsert_sink(table, sq.latest_fresh, "version"), f"{tmp_path}/state")
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.seq, r.price_a, r.price_b) for r in table.read().collect())
    assert got == [(1, 0.1, 0.2), (2, 0.1, 0.3), (3, 0.4, 0.3), (5, 0.5, 0.6)]
    assert held[-1] <= 2  # all but the newest tick are gone from both sides


def test_an_older_version_never_replaces_a_newer_one(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["k"], buckets=2)
    for version in (3, 5, 4):
        table.upsert(spark.createDataFrame([(1, version)], "k int, version int"), "version", oldest_first=True)
    assert [r.version for r in table.read().collect()] == [5]
    table.upsert(spark.createDataFrame([(1, 1)], "k int, version int"), "version")
    assert [r.version for r in table.read().collect()] == [1]
