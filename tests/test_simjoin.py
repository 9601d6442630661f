import numpy as np
import pytest
from pyspark.sql import functions as F

from crossquote.operators import neighbours, simjoin


def make(spark, rows):
    return spark.createDataFrame(rows, "platform string, market_id string, vector array<float>, d date")


def brute(rows, threshold, fresh=None):
    out = set()
    for i, (p, a, v, _) in enumerate(rows):
        for j, (q, b, w, _) in enumerate(rows):
            if p < q and np.dot(np.float32(v).astype(float), np.float32(w).astype(float)) >= threshold:
                if fresh is None or fresh(a) or fresh(b):
                    out.add((p, a, q, b))
    return out


def clustered(n=240, dims=12, seed=3):
    """Clusters of similar unit vectors; a third of all rows are copies of one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[0] if i % 3 == 0 else centres[i % 6] + 0.25 * rng.normal(size=dims)
        v = v / np.linalg.norm(v) * (1.0 if i % 5 else 1.3)
        rows.append((["alpha", "beta", "gamma"][i % 7 % 3], f"m{i}", [float(x) for x in v], None))
    return rows


def found(df):
    return {(r.platform_a, r.id_a, r.platform_b, r.id_b) for r in df.collect()}


@pytest.mark.parametrize("per_pivot", [8192, 20])
@pytest.mark.parametrize("threshold", [0.9, 0.3, -0.2])
def test_equals_brute_force(spark, monkeypatch, per_pivot, threshold):
    monkeypatch.setattr(simjoin, "ROWS_PER_PIVOT", per_pivot)
    monkeypatch.setattr(simjoin, "TILE_ROWS", 32)
    rows = clustered()
    out = simjoin.similarity_pairs(make(spark, rows), threshold)
    assert out.count() == len(found(out))  # nothing twice
    assert found(out) == brute(rows, threshold)


@pytest.mark.parametrize("per_pivot", [8192, 20])
def test_fresh_rows_only(spark, monkeypatch, per_pivot):
    monkeypatch.setattr(simjoin, "ROWS_PER_PIVOT", per_pivot)
    rows = clustered()
    out = simjoin.similarity_pairs(make(spark, rows), 0.8, fresh=F.col("market_id").endswith("7"))
    assert out.count() == len(found(out))
    assert found(out) == brute(rows, 0.8, lambda m: m.endswith("7"))


def test_pruning_skips_far_cells():
    pivots = np.eye(3)
    mask = simjoin._visit_mask(*simjoin._angles(np.float32([[1, 0, 0]]), pivots), np.array([0]), np.array([True]),
                               np.array([0.1, 0.1, -1.0]), np.array([1.0, 1.0, 0.0]), 0.9)
    assert mask.tolist() == [[True, False, False]]


def test_close_date_rule(spark):
    from datetime import date
    v = [1.0, 0.0]
    rows = [("a", "1", v, date(2024, 1, 1)), ("b", "2", v, date(2024, 3, 31)), ("b", "3", v, date(2024, 4, 1)),
            ("b", "4", v, None)]
    out = simjoin.similarity_pairs(make(spark, rows), 0.5, close_day=F.col("d"), max_gap_days=90)
    assert {r.id_b for r in out.collect()} == {"2", "4"}


def test_one_platform_or_nothing(spark):
    rows = [("a", "1", [1.0, 0.0], None), ("a", "2", [1.0, 0.0], None)]
    assert simjoin.similarity_pairs(make(spark, rows), 0.5).count() == 0
    assert simjoin.similarity_pairs(make(spark, rows).where("false"), 0.5).count() == 0
    with pytest.raises(ValueError):
        simjoin.similarity_pairs(make(spark, rows + [("b", "3", [1.0], None)]), 0.5)


def test_batch_neighbours_with_many_tiles(spark):
    rows = clustered(90)
    df = make(spark, rows)
    out = neighbours.batch_matches(df, df, 3, by="dot", id_col="market_id", tile_rows=16)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for _, a, v, _ in rows:
        best = sorted(rows, key=lambda r: (-round(float(np.dot(np.float32(v).astype(float), np.float32(r[2]).astype(float))), 12), r[1]))
        assert got[a] == [r[1] for r in best[:3]]


def test_cosine_edge_cases(spark):
    from crossquote.functions import vectors as vf
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]),
                                  ([1.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(vf.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert rows.select(vf.l2_normalise("a")).collect()[2][0] == [0.0, 0.0]


def test_hash_embedding_forms_agree(spark):
    from crossquote.functions import vectors as vf
    df = spark.createDataFrame([(1, "Will Bitcoin reach $100k by 2025?"), (2, "  "), (3, "a a b")], "id long, t string")
    dense = {r.id: r.vector for r in vf.hash_embed_dense(df, "id", "t", 16).collect()}
    direct = {r.id: r.v for r in df.select("id", vf.hash_embed("t", 16).alias("v")).collect()}
    for key in dense:
        assert np.allclose(dense[key], direct[key])
    assert dense[2] == [0.0] * 16 and abs(np.linalg.norm(dense[1]) - 1) < 1e-9


def test_dense_vectors_are_not_broadcast(spark):
    """Spark takes a vector for a few bytes: a broadcast of many would not fit the driver."""
    from crossquote.functions import vectors as vf
    df = spark.createDataFrame([(1, "will btc rise"), (2, "no"), (2, "no"), (None, "lost")], "id long, t string")
    rows = vf.hash_embed_dense(df, "id", "t", 16)
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    got = [(r.id, any(r.vector)) for r in rows.collect()]
    assert sorted(got, key=str) == sorted([(1, True), (2, True), (2, True), (None, False)], key=str)


def test_copies_of_a_vector_are_bounded(spark, monkeypatch):
    """Vectors spread evenly at a low threshold: every cell is visited, but cells share tiles."""
    for name, value in (("ROWS_PER_PIVOT", 8), ("TILE_ROWS", 8), ("MAX_TILE_ROWS", 64), ("COPIES", 4)):
        monkeypatch.setattr(simjoin, name, value)
    rng = np.random.default_rng(4)
    rows = [(["alpha", "beta", "gamma"][i % 3], f"m{i}", [float(x) for x in rng.normal(size=12)], None) for i in range(240)]
    routed, real = [], simjoin._route
    monkeypatch.setattr(simjoin, "_route", lambda *a: routed.append(real(*a)) or routed[-1])
    out = simjoin.similarity_pairs(make(spark, rows), 0.3)
    assert out.count() == len(found(out)) and found(out) == brute(rows, 0.3)
    # 30 cells of 8 rows; by cells every vector would have about 60 copies
    assert routed[0].count() <= 240 * 2 * 2 * simjoin.COPIES


def test_nearest_of_many_copies(spark):
    """The shortlist keeps ties: copies, zero vectors and opposite ones; more are wanted than there are."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(5, 4))
    rows = [("a", f"m{i:03}", [float(x) for x in (base[i % 5] * (-1) ** (i % 2) if i % 11 else np.zeros(4))], None) for i in range(400)]
    df = make(spark, rows)
    ids, v = [r[1] for r in rows], np.float32([r[2] for r in rows]).astype(float)
    norms = np.linalg.norm(v, axis=1)
    unit = v / np.where(norms > 0, norms, 1)[:, None]
    scores = np.round(np.clip(unit @ unit.T, 0, 1), 12)
    for k, tile in ((2, None), (3, 150), (500, None)):
        got = {}
        for r in neighbours.batch_matches(df.where("market_id < 'm020'"), df, k, id_col="market_id", tile_rows=tile).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for q in range(20):
            assert got[ids[q]] == [ids[j] for j in sorted(range(400), key=lambda j: (-scores[q][j], ids[j]))[:k]]
    assert -(-720_000 // simjoin.tile_side(720_000)) <= 22  # copies of a vector on a side


def test_named_pairs_meet_without_a_vector_per_pair(spark, monkeypatch):
    """As a join with dot products: repeated ids, null and ragged vectors, null labels; one pair is named very often."""
    from crossquote.functions import vectors as vf
    from crossquote.operators import pairscores
    monkeypatch.setattr(pairscores, "PAIRS_PER_TILE", 40)
    monkeypatch.setattr(pairscores, "VECTORS_PER_BLOCK", 8)
    rng = np.random.default_rng(2)
    vec = [(i, i % 3 if i % 7 else None, [float(x) for x in rng.normal(size=4 if i % 5 else 3)]) for i in range(30)]
    vec += [(4, 1, [1.0, None, 0.0, 2.0]), (5, 2, None), (6, 0, []), (6, 0, [1.0, 2.0, 3.0, 4.0]), (None, 1, [1.0, 0.0, 0.0, 0.0])]
    rows = spark.createDataFrame(vec, "market_id long, label int, vector array<float>")
    named = [(i % 5 or None, i % 33, i * 7 % 33) for i in range(300)] + [(9, 1, 2)] * 200 + [(9, None, 2), (9, 2, None)]
    asked = spark.createDataFrame(named, "sector int, a long, b long")
    out = pairscores.scored_pairs(asked, rows, "sector")
    side = lambda s: rows.toDF(s, f"label_{s}", f"vector_{s}")
    plain = asked.join(side("a"), "a").join(side("b"), "b").select(
        "sector", vf.dot("vector_a", "vector_b").alias("score"), (F.col("label_a") == F.col("label_b")).alias("is_match"))
    assert out.schema["sector"].dataType == plain.schema["sector"].dataType
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect())) and plain.count() > 500


def test_diversification_writes_narrow_rows(spark, monkeypatch):
    from crossquote.plans import serving
    rows = spark.createDataFrame([(f"p{i}", 10.0 - i, "x" * 50) for i in range(6)], "pair_id string, expected_profit double, wide string")
    texts = spark.createDataFrame([(f"p{i}", f"cat number{i // 2}", "dog") for i in range(6)], "pair_id string, text_a string, text_b string")
    written, real = [], serving.materialize
    monkeypatch.setattr(serving, "materialize", lambda df: written.append(df.columns) or real(df))
    out = serving.diversify(rows, 3, pool=None, texts=texts).orderBy("pick").collect()
    assert written == [["pair_id", "expected_profit"]]
    assert len(out) == 3 and out[0].pair_id == "p0" and out[0].wide == "x" * 50 and out[0].text_a == "cat number0"


def test_diversification_joins_texts_once_to_a_signal(spark):
    from crossquote.plans import serving
    ids, made = [f"p{i:03d}" for i in range(200)], spark.sparkContext.accumulator(0)

    def text(pair):
        made.add(1)
        return pair, f"cat number{int(pair[1:]) // 4}", "dog"

    rows = spark.createDataFrame([(p, 200.0 - i) for i, p in enumerate(ids)], "pair_id string, expected_profit double")
    texts = spark.sparkContext.parallelize(ids, 2).map(text).toDF("pair_id string, text_a string, text_b string")
    out = serving.diversify(rows, 30, pool=None, weight=0.5, block=2, texts=texts)
    before = made.value  # of the rounds; two picks at most in each
    assert 200 <= before <= 5 * 200
    assert [r.pair_id for r in out.orderBy("pick").collect()] == [
        r.pair_id for r in serving.diversify(rows, 30, pool=None, weight=0.5, texts=texts).orderBy("pick").collect()]


def test_diversification_with_null_ids_and_profits(spark):
    """A pick without an id takes its place and joins with nothing, as in SQL; signals without a profit are never picked."""
    from crossquote.plans import serving
    rows = spark.createDataFrame([("a", 9.0), (None, 10.0), (None, 9.5), ("b", 8.0), ("c", None), (None, None)], "pair_id string, expected_profit double")
    texts = spark.createDataFrame([(p, f"word{p}", "") for p in "abc"], "pair_id string, text_a string, text_b string")
    for block in (1, 2, 1000):
        out = serving.diversify(rows, 3, pool=None, block=block, texts=texts)
        assert [(r.pair_id, r.pick, r.text_a) for r in out.orderBy("pick").collect()] == [("a", 2, "worda"), ("b", 3, "wordb")]


def test_mmr_scores_pairs_where_they_lie(spark, tmp_path):
    """With enough splits no pair is dealt out for scoring; one file gives the same picks."""
    from pyspark.sql import functions as F

    from workload import scoring
    lines = spark.range(400).select(
        (F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") * 7 % 101).alias("l_partkey"), (F.col("id") * 3 % 53).alias("l_suppkey"),
        (F.col("id") % 4).cast("int").alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), F.lit(900.0).alias("l_extendedprice"),
        (F.col("id") % 10 / 100).alias("l_discount"), F.lit("1996-01-02 00:00:00").cast("timestamp").alias("l_shipdate"))
    orders = spark.range(100).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), (F.col("id") * 1000.5).alias("o_totalprice"),
                                     F.lit("1996-01-02 00:00:00").cast("timestamp").alias("o_orderdate"))
    got = {}
    for files in (1, 8):
        lines.repartition(files).write.parquet(f"{tmp_path}/{files}/lineitem.parquet")
        orders.write.parquet(f"{tmp_path}/{files}/orders.parquet")
        out = scoring.mmr_signals(spark, f"{tmp_path}/{files}")
        got[files] = sorted(map(tuple, out.collect()))
        assert ("RoundRobinPartitioning" in out._jdf.queryExecution().toString()) == (files == 1)
    assert got[1] == got[8] and len(got[1]) == 40
