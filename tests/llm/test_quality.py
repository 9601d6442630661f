import re
from collections import Counter

import numpy as np

from crossquote.llm import quality as ql
from tests.llm.conftest import ODD, SF


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_counts_and_verdicts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = ql.op3_token_fertility(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert counts(r) == plain(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
    fine = [r for r in got if not r.base_failed]
    assert sum(r.kept for r in fine) >= 0.9 * len(fine)


def test_measures_of_one_text(spark):
    import base64

    import public_tokenizers as public
    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(ql.BYTE_VOCABULARY), "rb"))}
    byte = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    piece = sentencepiece.SentencePieceProcessor(model_file=public.path(ql.PIECE_VOCABULARY))
    text = "plain words ☃ and \U0001f9ff signs"
    r = ql.measure(spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string")).first()
    ids = [i for w in text.split() for i in byte.encode_ordinary(" " + w)]
    share = np.array(list(Counter(ids).values())) / len(ids)
    assert np.isclose(r.token_entropy, -(share * np.log2(share)).sum() / np.log2(len(ids)))
    assert np.isclose(r.chars_per_token, r.word_chars / len(ids)) and np.isclose(r.tokens_per_word, len(ids) / 6)
    pieces = [i for w in text.split() for i in piece.encode(w)]
    assert np.isclose(r.byte_share, sum(map(piece.IsByte, pieces)) / len(pieces)) and r.byte_share > 0
    assert r.band == "script Latin"


def test_bands_reject_junk(spark):
    rng = np.random.default_rng(3)
    words = [w for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").limit(20).collect()
             for w in r.text.split() if w.isalpha()]
    rows = [(i, " ".join(rng.choice(words, 150)), "en") for i in range(80)]
    rows += [(100, " ".join("".join(rng.choice(list("ꙮ☃\U0001f9ff"), 6)) for _ in range(90)), "en")]
    rows += [(101, " ".join("".join(rng.choice(list("xq#7zj"), 12)) for _ in range(90)), "en")]
    got = {r.doc_id: r for r in ql.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(80))
    assert "byte_share" in got[100].out_of_band and "chars_per_token" in got[101].out_of_band
    assert not got[100].kept and not got[101].kept


def test_odd_rows(spark, odd, empty):
    got = ql.rules(odd).collect()
    assert sorted(counts(r) for r in got) == sorted(plain(x[1]) for x in ODD)
    assert not any(r.kept for r in got)
    assert ql.rules(empty).collect() == []


def test_repeated_words_beyond_packed_numbers():
    numbers = np.r_[np.arange(10) + (1 << 22), np.arange(10) + (1 << 22)]
    assert ql.repeated_words(numbers) == 20
    assert ql.repeated_words(np.arange(10)) == 0
