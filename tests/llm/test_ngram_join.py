import random
import re

import numpy as np
import pytest

from crossquote.llm import ngram_join as nj
from crossquote.llm.substrings import stored
from crossquote.llm.words import BATCH_ROWS
from pyspark.sql import functions as F
from tests.llm.conftest import ODD, SF
from workload.check import compare, oracle_connection


def shingles(text, n):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i:i + min(n, len(w))]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    """Components and links over all pairs; rows of one id are one document."""
    own = [(d, shingles(t, n)) for d, t in rows]
    up = {d: d for d, _ in own}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    links = set()
    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                links.add((min(a, b), max(a, b)))
                up[max(root(a), root(b))] = min(root(a), root(b))
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in own), key=repr), links


def near_copies(seed, docs=70):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    bases = [rng.choices(words, k=rng.randint(3, 60)) for _ in range(8)]
    common = rng.choices(words, k=25)
    rows = []
    for i in range(docs):
        text = list(rng.choice(bases)) if i % 3 else rng.choices(words, k=rng.randint(0, 30)) + common
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if text:
                text[rng.randrange(len(text))] = rng.choice(words).upper()
        rows.append((i, " ".join(text)))
    return rows + [rows[5], (2, rows[9][1]), (None, rows[9][1])]


@pytest.mark.parametrize("seed,n,percent,options", [
    (1, 4, 85, {}), (2, 4, 60, {"leaders": 1}), (3, 3, 100, {}), (5, 2, 50, {"leaders": 2}), (6, 3, 70, {"leaders": 3})])
def test_components(spark, seed, n, percent, options):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, nj.link_documents(df, n, percent, **options).collect()), key=repr)
    assert got == brute(rows, n, percent)[0]


def test_all_links(spark):
    rows = [(i, t) for i, (_, t) in enumerate(near_copies(4, 50))]
    rows = [(min(j for j, u in rows if shingles(u, 3) == shingles(t, 3)), t) for i, t in rows]
    rows = sorted({d: t for d, t in rows}.items())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = stored(nj.shingle_sets(df, 3, 60, nj.frequent_shingles(df, 3)))
    classes = sets.where("n_shingles > 0").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), "prefix", "sketch")
    texts = df.select(F.col("doc_id").alias("rep"), "text")
    links = nj.class_links(classes, texts, 3, 60, everything=True, leaders=2)
    assert {tuple(r) for r in links.collect()} == brute(rows, 3, 60)[1]


@pytest.mark.parametrize("copies", [100, 300])
def test_pairs_grow_with_the_groups(spark, monkeypatch, copies):
    """Several groups of near copies: the pairs looked at are in proportion to the group, not to its square."""
    rng = random.Random(11)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(200)]
        for i in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(200)] = f"x{rng.randrange(10_000)}"
            rows.append((g * copies + i, " ".join(text)))
    pairs, own = [], nj.sketch_passes
    monkeypatch.setattr(nj, "sketch_passes", lambda df, *a: pairs.append(df) or own(df, *a))
    got = nj.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0, copies, 2 * copies}
    assert sum(df.count() for df in pairs) <= 3 * len(rows)


def test_near_misses_make_no_pairs(spark, monkeypatch):
    """Copies that all differ a little too much from each other: pairs in proportion to the group; two that are close enough are found."""
    rng = random.Random(3)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(240):
        text = list(base)
        for at in rng.sample(range(5, 115), 2):
            text[at] = f"x{i}y{at}"
        rows.append((i, " ".join(text)))
    rows.append((240, rows[17][1] + " end"))
    pairs, own = [], nj.sketch_passes
    monkeypatch.setattr(nj, "sketch_passes", lambda df, *a: pairs.append(df) or own(df, *a))
    got = sorted(map(tuple, nj.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows, 4, 85)[0] and dict((d, c) for d, _, c in got)[240] == 17
    assert sum(df.count() for df in pairs) <= 10 * len(rows)


def test_short_sketches_are_folded_ones(spark):
    one = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 3000).astype(np.uint64))
    odd = np.bincount((one & np.uint64(64 * nj.WORDS - 1)).astype(np.int64), minlength=64 * nj.WORDS).astype(np.uint8) & 1
    df = spark.createDataFrame([(nj.parity_sketch(one).tolist(),)], "sketch array<long>")
    assert df.select(nj._short_sketch(F.col("sketch"))).first()[0] == np.packbits(odd).view(np.int64).tolist()


def test_first_leaders_of_a_list_are_few(spark):
    """A list of sets that nothing links yet: the first round that all of them lead makes a few pairs per set, and the rest waits."""
    rows = [(1, i, 100, 0, i, 299, 299) for i in range(300)]
    filed = spark.createDataFrame(rows, "token long, rep long, size long, at int, comp long, outside long, major long")
    pairs, rest = nj._all_pairs_outside(filed, nj.LEADERS, 85)
    assert 299 <= pairs.count() <= 10 * len(rows) and rest.count() >= 290


def test_against_oracle(spark):
    assert compare(nj.op10_ngram_jaccard(spark, SF), oracle_connection(SF), nj.ORACLE).startswith("ok")


def test_odd_rows(spark, odd, empty):
    got = sorted(map(tuple, nj.link_documents(odd).collect()), key=repr)
    assert got == brute([(x[0], x[1]) for x in ODD], 4, 85)[0]
    assert nj.link_documents(empty).collect() == []


def test_sketches_never_rule_out_a_link(spark):
    """Sets around the length at which sketches double, compared with their real difference."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1990, 2040, 2049, 2060, 4090, 4100)]
    sets += [np.unique(np.concatenate([s[:len(s) - k], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for s in sets for k in (20, 90)]
    rows = [(i, len(s), nj.parity_sketch(s).tolist()) for i, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "rep long, size long, sketch array<long>")
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    kept = {tuple(r) for r in nj.sketch_passes(spark.createDataFrame(pairs, "lead long, other long"), classes, 85).collect()}
    close = {(i, j) for i, j in pairs if nj.similar(sets[i], sets[j], 85)}
    assert len(close) >= 12 and close <= kept and len(kept) < len(pairs) / 2


def test_texts_go_to_tasks_in_small_batches(spark, monkeypatch):
    """While texts are read the session's Arrow batches are small; afterwards they have the session's own size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, own = spark.conf.get(name), [], nj.shingle_sets
    read = nj.verified
    monkeypatch.setattr(nj, "shingle_sets", lambda *a: seen.append(spark.conf.get(name)) or own(*a))
    monkeypatch.setattr(nj, "verified", lambda *a: seen.append(spark.conf.get(name)) or read(*a))
    nj.link_documents(spark.createDataFrame(near_copies(7), "doc_id long, text string"), 3, 70).collect()
    assert len(seen) > 1 and set(map(int, seen)) == {BATCH_ROWS} and spark.conf.get(name) == before


def test_most_frequent_shingles_come_last(spark):
    """Prefixes have rare shingles first, then the others by how frequent they are."""
    words = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join(words[:1 + i % 20])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    frequent = nj.frequent_shingles(df, 1)
    by_word = [int(nj.Shingles(1)([w.encode()])[0][0]) for w in words]
    assert [by_word.index(k) for k in frequent.tolist()] == list(range(19, -1, -1))
    (one,) = nj.shingle_sets(df.where("doc_id = 19"), 1, 10, frequent).collect()
    assert [by_word.index(k % (1 << 64)) for k in one.prefix] == list(range(19, 0, -1))


def test_components_of_few_links_stay_in_one_partition(spark, monkeypatch):
    from crossquote.operators import clusters

    made, own = [], clusters.materialize
    monkeypatch.setattr(clusters, "materialize", lambda df: made.append(x := own(df)) or x)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 10], "id_a long, id_b long").repartition(4)
    want = {(i, i - (i - 1) % 10) for i in range(1, 61)}
    assert {tuple(r) for r in clusters.connected_components(links).collect()} == want
    assert len(made) > 2 and all(df.rdd.getNumPartitions() == 1 for df in made[1:])
    made.clear()
    monkeypatch.setattr(clusters, "FEW_EDGES", 0)
    assert {tuple(r) for r in clusters.connected_components(links).collect()} == want
