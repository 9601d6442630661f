import hashlib
import random

import pytest
import sentencepiece
import public_tokenizers

from crossquote.llm import pieces
from tests.llm.conftest import ODD, SF


@pytest.fixture(scope="module")
def own():
    return pieces.Vocabulary()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_random_texts_against_the_library(own, library):
    letters = "ab ▁\n\t\r,.é中文字 的了ａ😀\x00\x01　\xa0<0x>/s0123456789the in on"
    rng = random.Random(7)
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        ids = own.encode(text)
        assert ids == library.encode(text, add_eos=True)
        assert own.decode(ids) == library.decode(ids)


def test_random_ids_against_the_library(own, library):
    """Also ids that no text has: special ones inside, bytes that are no UTF-8."""
    rng = random.Random(8)
    for _ in range(5000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(0, 262), 259, 28705, 0, 1, 2]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids)


def test_merges_go_by_score_then_from_the_left(own):
    """A slow search for the best pair, done again after each merge."""
    rng = random.Random(9)
    for _ in range(300):
        word = "▁" + "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 25)))
        left = list(word)
        while True:
            pairs = [(-own.library.get_score(own._ids[a + b]), i) for i, (a, b) in enumerate(zip(left, left[1:])) if a + b in own._ids]
            if not pairs:
                break
            at = min(pairs)[1]
            left[at:at + 2] = [left[at] + left[at + 1]]
        assert [own.pieces[i] for i in own.word_ids(word)] == left
        assert own.words_ids([word, "▁" + word, "é中"]) == [own.word_ids(w) for w in (word, "▁" + word, "é中")]


def test_long_words(own, library):
    for text in ("a" * 50_000, "中" * 20_000, " " * 30_000, "ab" * 50_000, "▁" * 1000, "x\n" * 20_000):
        ids = own.encode(text)
        assert ids == library.encode(text, add_eos=True)
        assert own.decode(ids) == library.decode(ids)


def test_the_check_finds_what_is_wrong():
    """A pair that is ranked wrongly changes some texts; exactly those are not checked."""
    fresh = pieces.Vocabulary()
    pair = fresh._ids["▁t"] * fresh._size + fresh._ids["he"]
    at = list(fresh._ranks).index(pair)
    fresh._rank_of[at] = pieces.NONE  # as if it made no piece
    del fresh._ranks[pair]
    texts = ["", "a b", "the", "cat\nthe", "ab\tx the y", "tea " * 30]
    right = [fresh.library.encode(t, add_eos=True) for t in texts]
    ids, agrees = fresh.encode_all(texts, True)
    assert agrees == [a == b for a, b in zip(ids, right)] and agrees[1] and not agrees[2]
    assert fresh.encode_all(texts, True) == (ids, agrees)


def test_whole_table(spark, library):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    again = pieces.encoded(spark.read.parquet(f"{SF}/documents.parquet"), check="texts").collect()
    assert len(again) == len(rows) and all(r.checked for r in again)
    got = pieces.op11_piece_agenda(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(rows[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids) and r.checked
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, odd, empty, library):
    got = sorted(((r.doc_id, r.ids, r.decoded, r.n_tokens, r.checked) for r in pieces.encoded(odd).collect()), key=repr)
    ids = [(i, library.encode(text or "", add_eos=True)) for i, text, *_ in ODD]
    assert got == sorted(((i, x, library.decode(x), len(x), True) for i, x in ids), key=repr)
    assert {r.checked for r in pieces.encoded(odd, check=None).collect()} == {None}
    assert pieces.encoded(empty).collect() == []


def test_other_kinds_of_vocabulary_are_refused(own, monkeypatch):
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "IsUnused", lambda self, i: i == 300)
    with pytest.raises(ValueError):
        pieces.Vocabulary()
