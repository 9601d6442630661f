import json

import pytest
from pyspark.sql import functions as F

from crossquote.operators import clusters
from crossquote.sources import markets, quotes, upserts


def test_load_directory(spark, tmp_path):
    rec = {"event_type": "market_created", "platform": "p", "market_id": "1", "timestamp": "2024-01-01T00:00:00Z",
           "data": {"best_ask": {"Yes": 0.4}, "asks": {"Yes": [[0.4, 5], {"price": 0.5, "size": 6}]}, "status": "odd"}}
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.jsonl").write_text(json.dumps(rec) + "\n\nnot json\n" + json.dumps(rec | {"timestamp": 1700000000}) + "\n")
    (tmp_path / "deep" / "b.json").write_text(json.dumps([rec, rec | {"event_type": "weird"}]))
    (tmp_path / "c.json").write_text(json.dumps(rec))
    (tmp_path / "d.csv").write_text('event_type,market_id,timestamp,data_json\nmarket_updated,9,2024-01-02,"{""fees"": 0.03}"\n'
                                    'market_updated,9,2024-01-02,broken{\n')
    (tmp_path / "skip.txt").write_text("x")
    events, bad = quotes.load_events(spark, str(tmp_path))
    rows = events.collect()
    assert len(rows) == 6 and bad.count() == 2
    assert sorted({r.event_type for r in rows}) == ["market_created", "market_updated"]
    full = [r for r in rows if r.market_id == "1"][0]
    assert [(x.price, x.size) for x in full.snapshot.asks["Yes"]] == [(0.4, 5.0), (0.5, 6.0)] and full.snapshot.status == "active"
    csv = [r for r in rows if r.market_id == "9"][0]
    assert csv.platform == "unknown" and csv.snapshot.fees == 0.03
    none, _ = quotes.load_events(spark, str(tmp_path / "missing"))
    assert none.count() == 0


def test_every_record_is_kept_or_quarantined(spark, tmp_path):
    rec = {"event_type": "market_updated", "market_id": "1", "timestamp": "2024-01-01T00:00:00Z", "data": {"fees": 0.1}}
    rows = [rec, rec | {"timestamp": "someday"}, {k: v for k, v in rec.items() if k != "timestamp"},
            rec | {"data": {"fees": "abc"}}, rec | {"data": {"price": "x"}}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    events, bad = quotes.load_events(spark, str(tmp_path))
    assert events.count() == 1 and bad.count() == 5
    (tmp_path / "cents").mkdir()
    (tmp_path / "cents" / "b.jsonl").write_text(json.dumps({"ticker": "T", "yes_bid": "abc", "yes_ask": 4, "timestamp": 1700000000}))
    events, bad = quotes.load_events(spark, str(tmp_path / "cents"), "kalshi")
    assert events.count() == 0 and bad.count() == 1


def test_token_source(spark):
    raw = json.dumps({"id": "x", "tokens": [{"outcome": "Yes", "price": 0.999}, {"outcome": "No"}, {"token_id": 1}], "update_time": 1700000000, "end_date_iso": "2025-12-31T00:00:00Z"})
    r = quotes.events_from_records(spark, [raw], "POLYMARKET").first()
    assert r.snapshot.best_ask == {"Yes": 0.99, "No": 0.505} and r.snapshot.fees == 0.02 and r.market_id == "x"
    assert str(r.ts) == "2023-11-14 22:13:20"


def test_cents_source(spark):
    raw = json.dumps({"ticker": "T", "yes_bid": 40, "yes_ask": 44, "timestamp": "2024-01-01T00:00:00", "status": "Suspended"})
    r = quotes.events_from_records(spark, [raw], "kalshi").first()
    assert round(r.snapshot.best_bid["No"], 6) == 0.56 and round(r.snapshot.last_traded["Yes"], 6) == 0.42
    assert r.snapshot.status == "suspended" and r.snapshot.fees == 0.01


def test_keyed_table(spark, tmp_path):
    table = upserts.KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    make = lambda rows: spark.createDataFrame(rows, "k string, v long, n long")
    assert table.read() is None and table.delete(make([("a", 1, 1)])) == 0
    table.upsert(make([("a", 1, 1), ("b", 2, 1), ("a", 5, 2)]), version="n")
    table.upsert(make([("b", 9, 1), ("c", 3, 1)]))
    table.upsert(make([("b", 9, 1), ("c", 3, 1)]))
    assert {r.k: r.v for r in table.read().collect()} == {"a": 5, "b": 9, "c": 3}
    assert table.delete(make([("a", 0, 0), ("zzz", 0, 0)])) == 1
    assert {r.k for r in table.read().collect()} == {"b", "c"}
    table.upsert(make([("a", 7, 1)]))
    assert table.read().count() == 3


def test_vector_collection(spark, tmp_path):
    store = upserts.VectorCollection(spark, str(tmp_path / "v"), buckets=2)
    make = lambda rows: spark.createDataFrame(rows, "namespace string, id string, vector array<double>, text string")
    store.upsert(make([("n", "1", [1.0, 0.0], "x"), ("m", "1", [1.0], "y")]))
    with pytest.raises(ValueError):
        store.upsert(make([("n", "2", [1.0], "x")]))
    with pytest.raises(ValueError):
        store.upsert(make([("z", "2", [1.0], "x"), ("z", "3", [1.0, 2.0], "x")]))
    store.upsert(make([("n", "1", [0.0, 1.0], "new")]))
    assert {(r.namespace, r.n) for r in store.counts().collect()} == {("n", 1), ("m", 1)}
    assert store.read().where("namespace = 'n'").first().text == "new"
    assert store.clear("n") == 1 and store.counts().count() == 1


def test_balanced_load_and_checks(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", f"{i:03d}", f"Question {i}", 0.5, [1.0] if i % 2 else None) for i in range(60)],
                               "platform string, market_id string, question string, price double, vector array<double>")
    got = markets.balanced_load(df, 5)
    assert {r["platform"]: r["count"] for r in got.groupBy("platform").count().collect()} == {"a": 5, "b": 5}
    assert got.where("vector is null").count() == 0
    assert markets.balanced_load(df, 100, "question 1$").count() == 1
    bad = df.limit(1).withColumn("price", F.lit(1.5))
    good, rejected = markets.split_valid(df.unionByName(bad))
    assert (good.count(), rejected.count()) == (60, 1)


def test_write_back_updates_existing_only(spark):
    q = spark.createDataFrame([("1", None), ("2", [5.0])], "market_id string, vector array<float>")
    v = spark.createDataFrame([("1", [1.0]), ("2", None), ("3", [9.0])], "market_id string, vector array<float>")
    assert {r.market_id: r.vector for r in upserts.update_vectors(q, v).collect()} == {"1": [1.0], "2": [5.0]}


def test_components_on_chain_and_star(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    star = [("s0000", f"t{i:04d}") for i in range(300)]
    df = spark.createDataFrame(chain + star + [("x", "x")], "id_a string, id_b string")
    got = {r.component: r.members for r in clusters.event_clusters(df).collect()}
    assert got == {"c0000": 301, "s0000": 301, "x": 1}
