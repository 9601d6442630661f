import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossquote.operators import simjoin
from crossquote.sources import upserts
from crossquote.sources.history import History
from crossquote.streaming.cells import CellIndex

TICKS = "platform string, market_id string, ts timestamp, seq long, yes_price double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    out = History(spark, "h_" + uuid.uuid4().hex[:8], str(tmp_path_factory.mktemp("history")), buckets=16)
    ticks = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, "alpha").otherwise("beta").alias("platform"), F.concat(F.lit("m"), F.col("id") % 40).alias("market_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).alias("ts"), F.col("id").alias("seq"), (F.col("id") % 97 / 97).alias("yes_price"))
    out.append(ticks.where("seq < 3000"))
    out.append(ticks.where("seq >= 3000"))
    return out, ticks


def test_one_market_opens_one_bucket(history):
    stored, ticks = history
    one = stored.market("alpha", "m6")
    want = ticks.where("market_id = 'm6'")
    assert sorted(map(tuple, one.select("seq", "yes_price").collect())) == sorted(map(tuple, want.select("seq", "yes_price").collect()))
    # files are pruned by bucket also where the scan is split by size; only this way the plan tells
    one.sparkSession.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 16" in plan(stored.market("alpha", "m6"))
    finally:
        one.sparkSession.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")


def test_hours_and_market_joins_do_not_shuffle_the_history(history, spark):
    stored, ticks = history
    hours = stored.hourly()
    assert "Exchange" not in plan(hours)
    from crossquote.operators.series import hourly_last
    assert sorted(map(tuple, hours.drop("market_key").collect())) == sorted(map(tuple, hourly_last(ticks).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = hours.join(stored.read().groupBy("market_key").agg(F.count("*").alias("n")), "market_key")
        assert "Exchange" not in plan(both) and both.count() == hours.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def vectors(rng, ids, centres):
    noise = rng.normal(0, 0.02, (len(ids), 8))
    v = centres[[i % len(centres) for i in ids]] + noise
    return [(f"p{i % 3}", str(i), [float(x) for x in row / np.linalg.norm(row)]) for i, row in zip(ids, v)]


SCHEMA = "platform string, market_id string, vector array<float>"


def test_cells_find_what_a_comparison_with_all_finds(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(0, 1, (8, 8)))[0]
    index = CellIndex(spark, f"{tmp_path}/i", ["platform", "market_id"], pivots=8, buckets=2)
    batches = [vectors(rng, range(0, 80), centres), vectors(rng, range(80, 110), centres),
               vectors(rng, [200, 208, 216], centres),  # one cluster only
               vectors(rng, [3, 11, 207], centres[1:])]  # two of them are there already, and move
    visited, real = [], CellIndex.visited
    monkeypatch.setattr(CellIndex, "visited", lambda self, *a: visited.append(real(self, *a)) or visited[-1])
    match = lambda df: simjoin.similarity_pairs(df, 0.9, fresh=F.col("fresh"))
    now = {}
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA)
        got = {(r.id_a, r.id_b) for r in index.update(df, n, 0.9, match).collect()}
        again = {(r.id_a, r.id_b) for r in index.update(df, n, 0.9, match).collect()}
        now.update({(p, i): v for p, i, v in rows})
        fresh = {(p, i) for p, i, _ in rows}
        want = {(a[1], b[1]) for a in now for b in now if a[0] < b[0] and (a in fresh or b in fresh)
                and float(np.dot(np.float32(now[a]).astype(float), np.float32(now[b]).astype(float))) >= 0.9}
        assert got == want == again and want
    assert not visited[0] and 0 < len(visited[4]) <= 2 < 8  # of the third batch
    plan_of = index.stored(visited[4], 3)
    assert len({r.cell for r in plan_of.select("cell").distinct().collect()}) <= 2
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", plan(plan_of))


def test_texts_are_added_with_their_vectors(spark, tmp_path):
    collection = upserts.VectorCollection(spark, f"{tmp_path}/c", buckets=2)
    rows = [("a", "1", "will the cat win"), ("a", "2", "rain in spain"), ("b", "3", None)]
    collection.add_texts(spark.createDataFrame(rows, "namespace string, id string, text string"), 32)
    collection.add_texts(spark.createDataFrame([("a", "2", "will the cat lose")], "namespace string, id string, text string"), 32)
    from crossquote.operators.neighbours import text_matches
    best = text_matches(collection.read(), "will the cat win", 3, 32).orderBy("rank").collect()
    assert [r.id for r in best] == ["1", "2", "3"] and best[0].score == pytest.approx(1.0) and best[2].score == 0.0
    with pytest.raises(ValueError):
        collection.upsert(spark.createDataFrame([("a", "9", [1.0])], "namespace string, id string, vector array<float>").withColumn("text", F.lit("x")))
