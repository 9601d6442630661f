import random

import pytest
from pyspark.sql import functions as F

from crossquote.llm import mixing as mx
from tests.llm.conftest import ODD, SF
from workload.check import compare, oracle_connection


def fill(sizes):
    """Targets by filling again and again until no source is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(12)} | {None: 700}
    table = spark.createDataFrame([("~" if s is None else f"={s}", n) for s, n in sizes.items()],
                                  "_source string, source_size long")
    got = {r._source: r.target for r in mx.source_targets(table).collect()}
    for s, want in fill(sizes).items():
        assert got["~" if s is None else f"={s}"] == pytest.approx(want)


def test_against_oracle(spark):
    assert compare(mx.op6_weighted_mix(spark, SF), oracle_connection(SF), mx.ORACLE, 1e-12).startswith("ok")


def no_weights(spark):
    return spark.createDataFrame([], "doc_id long, weight double")


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_prefix_sums_do_not_depend_on_buckets(spark, buckets):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn(
        "source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = mx.mix(docs, no_weights(spark), buckets=buckets).collect()
    want = {r.doc_id: r.taken for r in mx.mix(docs, no_weights(spark)).collect()}
    assert {r.doc_id: r.taken for r in rows} == want
    sums = {}
    for r in rows:
        key = (r.source_size, r.target)
        sums[key] = sums.get(key, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken - target) < 1 for (_, target), taken in sums.items())


def test_weights_draw_earlier(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"),
                                    F.when(F.col("id") < 2000, "x").otherwise("y").alias("source"))
    weights = spark.range(0, 4000, 2).select(F.col("id").alias("doc_id"), F.lit(mx.GOOD * 2).alias("weight"))
    got = mx.mix(docs, weights).where("source_size = 4000 and taken > 0").join(weights, "doc_id", "left")
    counts = {r.good: r.n for r in got.groupBy(F.col("weight").isNotNull().alias("good")).agg(F.count("*").alias("n")).collect()}
    assert counts[True] > counts[False]


def test_odd_rows(spark, odd, empty):
    got = mx.mix(odd, no_weights(spark)).collect()
    assert len(got) == len(ODD)
    assert sorted((r.size, r.doc_id) for r in got if r.doc_id is not None) == sorted(
        (len((x[1] or "").split()), x[0]) for x in ODD if x[0] is not None)
    assert mx.mix(empty, no_weights(spark)).collect() == []
    assert mx.mixed_documents(empty, no_weights(spark)).collect() == []


def test_mixed_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_size", F.lit("clash"))
    out = mx.mixed_documents(docs, no_weights(spark))
    assert out.columns == docs.columns
    copies = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in mx.mix(docs, no_weights(spark)).collect():
        assert abs(copies.get(r.doc_id, 0) * r.size - r.taken) <= r.size / 2


