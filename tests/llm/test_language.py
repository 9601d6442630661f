import itertools

import numpy as np
from pyspark.sql import functions as F

from crossquote.llm import language as lg
from crossquote.llm.words import id_remainder
from tests.llm.conftest import SF


def held(df):
    return df.withColumn("held_out", id_remainder(4) == 2)


def found(df, model):
    return lg.identify(df, model).select("doc.doc_id", "lang_pred", "score", "spans")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in lg.op2_language_spans(spark, SF).collect()}
    truth = [r for r in docs.collect()]
    assert len(got) == len(truth)
    assert {d for d, r in got.items() if r.held_out} == {r.doc_id for r in held(docs).where("held_out").collect()}
    unseen = [r for r in truth if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in unseen) >= 0.95 * len(unseen)
    assert all(0 <= r.score <= 1 for r in got.values())


def brute(scores, switch):
    best = max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=lambda p: (
        sum(scores[i, x] for i, x in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))))
    return sum(scores[i, x] for i, x in enumerate(best)) - switch * sum(a != b for a, b in zip(best, best[1:])), best


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(1)
    texts = [rng.normal(0, 2, (n, 3)) for n in (1, 2, 5, 7, 7, 6)]
    for scores, path in zip(texts, lg.viterbi(texts, 1.5)):
        value, best = brute(scores, 1.5)
        assert tuple(path) == best
        single = lg.one_language(scores, 1.5)
        assert single < 0 or set(best) == {single}


def test_spans_scripts_and_odd_rows(spark, odd, empty):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(
        [("the house and the garden of this old town", "en"), ("das haus und der garten dieser alten stadt", "de"),
         ("дом и сад этого старого города", "ru")] * 5)]
    model = lg.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = "the old town and the garden of the house " * 3 + "das haus der alten stadt und dieser garten " * 3
    docs = spark.createDataFrame([(1, mixed), (2, "сад the дом"), (3, "日本")], "doc_id long, text string")
    got = {r.doc_id: r for r in found(docs, model).collect()}
    assert got[1].spans == "en:0:27,de:27:51"
    assert got[2].lang_pred == "ru" and got[3].lang_pred in ("en", "de", "ru")
    rows = {r.doc_id: r for r in found(odd, model).collect()}
    assert {rows[i].lang_pred for i in (1, 2, 3)} == {"und"} and rows[1].score == 0
    assert found(odd, model).count() == odd.count()
    assert found(empty, model).collect() == []
    assert lg.fit(empty) is None
    assert {r.lang_pred for r in found(odd, None).collect()} == {"und"}
    assert lg.fit(odd.withColumn("lang", F.lit(None).cast("string"))) is None


THAI = "สวนของบ้านเก่าหลังนี้ในเมืองเล็กริมทะเล"
CHINESE = "这座老城的花园和房子都在河边每天早上有很多人来这里散步"
JAPANESE = "この古い町の庭と家は川のそばにあり毎朝たくさんの人が散歩に来ます"
ENGLISH = "the house and the garden of this old town by the river "


def by_script(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(
        [(ENGLISH, "en"), (CHINESE, "zh"), (JAPANESE, "ja"), (THAI, "th")] * 4)]
    return lg.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_pieces_lose_no_letter():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abéжя庭家のバกข々ə"), rng.integers(0, 200), p=[.3, .3] + [.4 / 11] * 11)) for _ in range(60)]
    words += ["x" * 1000, "", "庭" * 129, "word", "人々のhər"]
    parts, counts = lg.pieces(words)
    ends = np.cumsum(counts)
    assert ["".join(parts[e - n:e]) for n, e in zip(counts, ends)] == words
    assert max(map(len, parts)) <= lg.PIECE
    assert parts[ends[-2]:] == ["人々", "の", "hər"]
    for part in parts:
        assert len(set(lg.run_scripts(np.array([ord(c) for c in part], "u4")).tolist())) <= 1


def test_text_without_spaces_is_read_to_its_end(spark):
    model = by_script(spark)
    note = " " + ENGLISH * 2  # fewer letters than the run, more than 64
    docs = [(1, CHINESE * 20 + note), (2, JAPANESE * 20 + note), (3, THAI * 20 + note),
            (4, "the" + CHINESE * 20 + "house"), (5, "thehouseandthegardenofthisoldtown" * 3 + CHINESE * 20 + " " + ENGLISH),
            (6, ENGLISH * 9 + CHINESE)]
    got = {r.doc_id: r for r in found(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["zh", "ja", "th", "zh", "zh", "en"]
    n = len(CHINESE) * 20
    assert got[1].spans == f"zh:0:1,en:1:{1 + 2 * len(ENGLISH.split())}"
    assert got[5].spans == f"en:0:0+99,zh:0+99:1,en:1:{1 + len(ENGLISH.split())}"
    letters = sum(map(str.isalpha, note))
    assert got[1].score <= n / (n + letters) < got[1].score + 1e-6


def test_one_language_agrees_with_all_paths():
    narrow = np.array([[0, 7, -20], [0, -20, 7]], np.float64)
    assert brute(narrow, 8.0)[1] == (1, 2) and lg.one_language(narrow, 8.0) < 0
    rng = np.random.default_rng(2)
    taken = 0
    for _ in range(1500):
        scores = rng.normal(0, rng.choice([1, 4]), (rng.integers(1, 6), 3)) - rng.uniform(0, 6, 3) * rng.integers(0, 2)
        single = lg.one_language(scores, 8.0)
        assert single < 0 or set(brute(scores, 8.0)[1]) == {single}
        taken += single >= 0
    assert taken > 100
