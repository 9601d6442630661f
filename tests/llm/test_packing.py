import zlib
from collections import defaultdict

import numpy as np
import pytest

from crossquote.llm import packing as pk
from tests.llm.conftest import SF


def check(rows, texts, room):
    """Every id of every document lies in one piece; sequences are gapless and full or a power of two."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(pk.TOKENIZER))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces[doc], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == room or (at < room and at & (at - 1) == 0)


def test_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(pk.op4_cost_packing(spark, SF).collect(), {r.doc_id: r.text for r in docs.collect()}, 2048)


def test_odd_rows(spark, odd, empty):
    once = odd.dropDuplicates(["doc_id"])
    check(pk.pack(once, room=64).collect(), {r.doc_id: r.text for r in once.collect()}, 64)
    assert pk.pack(odd).count() >= odd.count()
    assert pk.pack(empty).collect() == []
    with pytest.raises(ValueError):
        pk.pack(odd, room=100)


def test_words_tokenise_like_whole_texts():
    tokens = pk.word_tokens(None)
    for text in ("It's ÉTÉ ½ don't<|endoftext|>x <|startoftext|>", "ΑΣ İı a\x1cb ẛ̣ é", "你好 x2 ßµ"):
        want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert [i for one in tokens(text.encode().split()) for i in one] == want


def test_workers_remember_few_words():
    """Many different words, a few thousand at a time: what a worker keeps of them stays small, and ids stay right."""
    import tracemalloc

    from crossquote.llm.words import RaggedTable

    tokens = pk.WordTokens(None)
    tracemalloc.start()
    table = RaggedTable(tokens, pk.WORDS)
    for at in range(0, 200_000, 4_000):
        words = [b"%s%s" % (bytes(97 + int(c) for c in str(i)), b"qz") for i in range(at, at + 4_000)]
        numbers, _ = table.words.number([b" ".join(words)])
        ids, counts = table.expand(numbers)
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 40e6
    assert ids[-counts[-1]:].tolist() == tokens.tokenizer.encode(words[-1].decode(), add_special_tokens=False).ids


def test_costs_are_balanced():
    lengths = np.random.default_rng(5).integers(20, 1500, 600)
    pieces, cost = pk.assign(lengths, 2048, 1.0, 1 / 2048)
    full = cost[pk.capacities(int(lengths.sum()), 2048) == 2048]
    in_order = np.zeros(len(full) + 12)
    at = 0
    for n in lengths:  # plain filling in the given order
        while n:
            take = min(n, 2048 - at % 2048)
            in_order[at // 2048] += take + take * take / 2048
            at, n = at + take, n - take
    assert full.std() < 0.7 * in_order[:len(full)].std()
