import pytest

import corpus_pipeline as cp
from crossquote.llm import personal_data as pii
from crossquote.llm.substrings import stored
from tests.llm.conftest import SF
from tests.llm.test_mixing import fill
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, steps):
    docs, known, single, clean, mixture, packed = steps
    assert all(s.columns == docs.columns for s in steps[:-1])
    assert set(rows(known)) <= set(rows(docs)) and len(rows(known)) >= 0.97 * len(rows(docs))
    components = brute([(d, r.text) for d, r in rows(known).items()], cp.SHINGLE, cp.PERCENT)[0]
    assert set(rows(single)) == {c for _, _, c in components}
    before = rows(single)
    for d, r in rows(clean).items():
        assert not pii.base_spans(r.text) and len(r.text) == r.n_chars
        assert pii.SIGNS.search(before[d].text) or r.text == before[d].text
    sizes, taken = {}, {}
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in mixture.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    longest = max(len(r.text.split()) for r in clean.collect())
    for s, target in fill(sizes).items():
        assert abs(taken.get(s, 0) - target) <= longest
    copies = {}
    for r in mixture.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3
    assert packed.agg({"length": "sum"}).first()[0] > 0


def test_packed_texts(spark, steps):
    once = steps[3]
    check(cp.packed(spark, once, SF).collect(), {r.doc_id: r.text for r in once.collect()}, 2048)


def test_odd_and_empty(spark, odd, empty):
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0
        out = stored(stage(spark, odd, SF))
        assert out.columns == odd.columns
    assert cp.packed(spark, odd, SF).count() >= odd.count()
    assert cp.one_of_each_group(spark, odd, SF).where("doc_id = 4").count() == 1


def test_different_texts_of_one_id(spark):
    """One of them stays, the same one however the rows are dealt out."""
    rows = [(7, f"text number {i} of seven", "en", "a", i) for i in range(6)] + [(8, "another text", "en", "a", 1), (None, "x", "en", "a", 1)]
    kept = set()
    for parts in (1, 3, 8):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts, "n_chars")
        out = cp.one_of_each_group(spark, docs, SF)
        assert out.columns == docs.columns
        kept.add(tuple(sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr)))
    (only,) = kept
    assert [d for d, _, _ in only] == [7, 8, None]


def test_every_stage_has_small_batches(spark, empty):
    """Each stage hands texts to Python in small batches; a session with smaller ones keeps them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    try:
        for _, stage in cp.STAGES:
            for given, want in ((10_000, 1_000), (0, 1_000), (300, 300)):
                spark.conf.set(name, str(given))
                stage(spark, empty, SF)
                assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, own)
