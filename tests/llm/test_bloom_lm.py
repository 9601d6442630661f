import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossquote.llm import bloom_lm as lm
from crossquote.llm.words import BATCH_CONF, BATCH_ROWS, id_remainder
from tests.llm.conftest import ODD, SF


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + [None]


def brute(rows, train, weight):
    """Expected values from exact tables; counts of the model as their levels mean them."""
    tokens = [(d, split(t)) for d, t in rows]
    c = Counter(w for t in train for w in split(t))
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip([None, *split(t)], split(t)))
    totals = Counter()
    for (h, _), k in pairs.items():
        totals[h] += k

    def meant(k):
        return lm.MEANT[np.searchsorted(lm.EDGES, k, "right")]

    out = []
    for d, t in tokens:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = 0.0
        for h, w in zip([None, *t], t):
            total = meant(totals[h])
            pair = min(meant(pairs[h, w]), total, meant(c[w]))
            score += math.log10((pair + weight * (meant(c[w]) + 0.1) / (n + 0.1 * (v + 1))) / (total + weight))
        out.append((d, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return out


def held(df):
    return df.withColumn("held_out", id_remainder(10) == 0)


def check(rows, want, off=0.02):
    rows = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows), key=repr)
    want = sorted(want, key=repr)
    assert [r[:4] for r in rows] == [r[:4] for r in want]
    assert [r[4] for r in rows] == pytest.approx([r[4] for r in want], rel=1e-9)
    # false positives of the filter can only lift counts; few scores move, and little
    moved = sum(abs(r[5] - w[5]) > 1e-6 * abs(w[5]) + 1e-9 for r, w in zip(rows, want))
    assert sum(r[5] for r in rows) == pytest.approx(sum(w[5] for w in want), rel=off)
    return moved


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 60_000, "frequent": 50}])
def test_against_exact_tables(spark, options):
    docs = held(spark.read.parquet(f"{SF}/documents.parquet")).where("doc_id < 60")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = [t for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    got = lm.score_texts(docs, docs.where("not held_out"), **options).collect()
    check(got, brute(rows, train, lm.WEIGHT))


def test_better_than_words_alone(spark):
    rows = lm.op7_bloom_lm(spark, SF).collect()
    unseen = [r for r in rows if r.held_out]
    assert len(rows) == 200 and unseen
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert all(r.score < 0 for r in rows)


def test_filter_levels(spark):
    counts = spark.range(1, 4000).select((F.xxhash64("id").bitwiseAND(F.lit(-2))).alias("key"),
                                         F.pmod("id", F.lit(300)).alias("n")).where("n > 0")
    own = lm.Filter({r.segment: r.bits for r in lm.build_filter(counts).collect()})
    rows = counts.collect()
    key, n = (np.array([r[c] for r in rows]) for c in ("key", "n"))
    level = own.levels(key.view(np.uint64))
    want = np.searchsorted(lm.EDGES, n, "right")
    assert (level >= want).all() and (level > want).mean() < 0.02
    unknown = own.levels(np.arange(20_000, dtype=np.uint64) * np.uint64(2))
    assert (unknown > 0).mean() < 0.02


def test_odd_rows(spark, odd, empty):
    rows = [(x[0], x[1]) for x in ODD]
    got = lm.score_texts(held(odd), odd).collect()
    check(got, brute(rows, [t for _, t in rows], lm.WEIGHT), off=0.1)
    assert lm.score_texts(held(empty), empty).collect() == []
    none = lm.score_texts(held(odd), empty).collect()
    assert len(none) == len(ODD) and all(r.n_known == 0 and r.train_tokens == 0 for r in none)


def whole(rows, train, weight):
    """Scores with the counts of all pairs, seen once or more, and with whole history totals."""
    c = Counter(w for t in train for w in split(t))
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for t in train for p in zip([None, *split(t)], split(t)))
    totals = Counter()
    for (h, _), k in pairs.items():
        totals[h] += k

    def meant(k):
        return lm.MEANT[np.searchsorted(lm.EDGES, k, "right")]

    return {d: sum(math.log10((meant(pairs[h, w]) + weight * (meant(c[w]) + 0.1) / (n + 0.1 * (v + 1)))
                              / (meant(totals[h]) + weight)) for h, w in zip([None, *split(t)], split(t))) for d, t in rows}


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 60_000, "frequent": 50}])
def test_pairs_seen_once_count(spark, options):
    docs = held(spark.read.parquet(f"{SF}/documents.parquet")).where("doc_id < 60")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = whole(rows, [t for d, t in rows if zlib.crc32(str(d).encode()) % 10], lm.WEIGHT)
    got = {r.doc_id: r.score for r in lm.score_texts(docs, docs.where("not held_out"), **options).collect()}
    assert got.keys() == want.keys()
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.005)


def test_near_copy_of_a_text_seen_once_beats_its_words(spark):
    words = [f"w{i}" for i in range(300)]
    train = [(1, " ".join(words))] + [(i, " ".join(np.random.default_rng(i).permutation(words))) for i in range(2, 5)]
    asked = [(10, " ".join([*words[:150], "new", *words[151:]])), (11, " ".join(np.random.default_rng(99).permutation(words)))]
    got = {r.doc_id: r for r in lm.score_texts(*(held(spark.createDataFrame(x, "doc_id long, text string")) for x in (asked, train))).collect()}
    want = whole(asked, [t for _, t in train], lm.WEIGHT)
    assert got[10].score > got[11].score + 100 and got[10].score == pytest.approx(want[10], rel=0.01)
    assert lm.PROBES == 8


@pytest.mark.parametrize("slices", [lm.SEGMENTS, 4 * lm.SEGMENTS])
def test_only_words_and_segments_leave_the_counting(spark, slices):
    """Pairs go from the packed counts into the filter without a row of their own, and the filter is that of exact counts."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.5, 300) % 500)) for i in range(40)] + [(40, None), (41, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = lm.summed(lm.count_ngrams(docs, slices))
    tokens = [lm.Tokens()([(t or "").encode()])[1][0] for _, t in rows]
    exact = Counter(k for w in tokens for k in np.concatenate([lm.unigrams(w), lm.pairs(lm.shifted(w), w)]).view(np.int64).tolist())
    words = {r.key: r.n for r in table.where("key is not null").collect()}
    assert words == {k: n for k, n in exact.items() if k % 2 == 0}
    bits = {r.segment: r.bits for r in table.where("bits is not null").collect()}
    assert table.count() == len(words) + len(bits) and len(exact) > 3 * len(words)
    counts = spark.createDataFrame(list(exact.items()), "key long, n long")
    assert bits == {r.segment: r.bits for r in lm.build_filter(counts).collect()}
    levels = lm.Filter(bits).levels(np.array(list(exact)).view(np.uint64))
    assert (levels >= np.searchsorted(lm.EDGES, list(exact.values()), "right")).all()


def test_mixing_can_be_undone():
    values = np.random.default_rng(4).integers(0, 1 << 64, 10_000, dtype=np.uint64)
    assert (lm.unmixed(lm.mixed(values)) == values).all()
    assert (lm.Filter.segment(values) == lm.mixed(values) // np.uint64((1 << 64) // lm.SEGMENTS)).all()


def test_texts_go_to_tasks_in_small_batches(spark, empty):
    own = spark.conf.get(BATCH_CONF)
    try:
        for given, want in ((10_000, BATCH_ROWS), (0, BATCH_ROWS), (300, 300)):
            spark.conf.set(BATCH_CONF, str(given))
            lm.score_texts(held(empty), empty)
            assert int(spark.conf.get(BATCH_CONF)) == want
    finally:
        spark.conf.set(BATCH_CONF, own)
