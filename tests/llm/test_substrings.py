import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossquote.llm import substrings as sb
from tests.llm.conftest import ODD, SF
from workload.check import compare, oracle_connection


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept) judged on the input as it is."""
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for doc, w in words:
        for i in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[i:i + window])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, w in words:
        gone = {i + k for i in range(len(w) - window + 1) if doc is not None and first[tuple(w[i:i + window])] < doc
                for k in range(window)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=repr)


def passages(seed=0, docs=60):
    """Documents that share passages, repeat words and copy each other; ids repeat."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    shared = [" ".join(rng.choices(words, k=rng.randint(5, 30))) for _ in range(6)]
    rows = []
    for i in range(docs):
        parts = [rng.choice([rng.choice(shared), " ".join(rng.choices(words, k=rng.randint(0, 15))), "a a a a a a a a"])
                 for _ in range(rng.randint(0, 6))]
        rows.append((i // 2 if i % 5 == 0 else i, rng.choice([" ", "\n", " \t "]).join(parts)))
    return rows + [rows[3], (1000, rows[4][1]), (1001, rows[4][1]), (None, rows[4][1])]


@pytest.mark.parametrize("window,grain,hot", [(10, 3, 2_000), (10, 3, 3), (7, 7, 5), (4, 1, 0), (1, 1, 10)])
def test_against_brute_force(spark, window, grain, hot):
    rows = passages()
    got = sb.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window, grain, hot)
    assert rows_of(got) == brute(rows, window)


def test_against_oracle(spark):
    assert compare(sb.op9_super_kmers(spark, SF), oracle_connection(SF), sb.ORACLE).startswith("ok")


def test_odd_rows(spark, odd, empty):
    assert rows_of(sb.remove_repeats(odd)) == brute([(x[0], x[1]) for x in ODD], 50)
    assert sb.remove_repeats(empty).collect() == []
    late = odd.withColumn("doc_id", F.col("doc_id") + 100)
    twice = odd.unionByName(late)
    assert rows_of(sb.remove_repeats(twice)) == brute([(r.doc_id, r.text) for r in twice.collect()], 50)


def test_texts_are_dealt_out_once(spark, monkeypatch):
    """No text is written between the steps, and the packed strings come from the shuffle that the kept words come from."""
    name, written, own = "spark.sql.autoBroadcastJoinThreshold", [], sb.stored
    before = spark.conf.get(name)
    monkeypatch.setattr(sb, "stored", lambda df: written.append(df.columns) or own(df))
    spark.conf.set(name, "-1")
    try:
        got = sb.remove_repeats(spark.createDataFrame(passages(), "doc_id long, text string"), 10, 3, 3)
        assert rows_of(got) == brute(passages(), 10)
        got = got.select("doc_id", "kept_text")
        got.collect()
    finally:
        spark.conf.set(name, before)
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"ReusedExchange \[id#\w+, row#\w+, text#\w+\]", final)) >= 2  # packed strings, hot windows
    assert written and not {"text", "span", "digest"} & {c for columns in written for c in columns}


def test_super_kmers_cover_each_window_once():
    hashes = np.random.default_rng(1).integers(0, 40, 500).astype(np.uint64)
    mini, start, n = sb.super_kmers(hashes, 20, 4)
    assert np.concatenate([np.arange(s, s + k) for s, k in zip(start, n)]).tolist() == list(range(481))
    values = np.random.default_rng(2).integers(0, 99, 50)
    for width in (1, 2, 5, 8, 50):
        assert sb.sliding_minimum(values, width).tolist() == [values[i:i + width].min() for i in range(51 - width)]
