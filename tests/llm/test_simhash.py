import hashlib
import random

from crossquote.llm import simhash as sh
from tests.llm.conftest import SF


def brute(rows, prints):
    """Expected (doc_id, n_chars, edited_sha256) going down by id; rows of equal id must be equal."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (doc, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        changed = sh.edit(text or "", following or "")
        a, b, c = prints([x.encode() for x in (text or "", changed, following or "")]).view("u8").tolist()
        out.append((doc, len(text or ""), hashlib.sha256(changed.encode()).hexdigest(), f"{a:016x}", f"{b:016x}",
                    1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64))
    return sorted(out, key=repr)


def rows_of(df):
    shown = df.select("doc_id", "n_chars", "edited_sha256", sh.as_hex("fingerprint"), sh.as_hex("edited"),
                      sh.likeness("fingerprint", "edited"), sh.likeness("fingerprint", "following"))
    return sorted(map(tuple, shown.collect()), key=repr)


def test_pairs_across_tasks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], sh.Fingerprints())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(sh.edited_pairs(docs.repartition(7))) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sh.op8_simhash(spark, SF).collect()) == len(want)


def test_odd_rows(spark, odd, empty):
    assert rows_of(sh.edited_pairs(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()], sh.Fingerprints())
    assert sh.edited_pairs(empty).collect() == []
    one = sh.edited_pairs(odd.where("doc_id = 7"))
    assert one.count() == 1
    assert sh.fingerprints(empty).collect() == []


def test_equal_texts_and_near_texts():
    prints = sh.Fingerprints()
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    text = rng.choices(words, k=400)
    near = [*text[:200], "other", *text[201:]]
    far = rng.choices(words, k=400)
    a, b, c, d = prints([" ".join(t).encode() for t in (text, text, near, far)]).view("u8").tolist()
    assert a == b and (a ^ c).bit_count() <= 8 and (a ^ d).bit_count() >= 16
    assert prints([b"", b"  "]).tolist() == [0, 0]


def test_neighbours_find_every_pair(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values):
        for _ in range(4):
            values.append(v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*signed, signed[0], None])], "doc_id long, fingerprint long")
    for radius in (0, 1, 3, 5):
        want = {(x, y, n) for i, x in enumerate(signed) for y in signed[i + 1:]
                if (n := ((x ^ y) & (1 << 64) - 1).bit_count()) <= radius}
        found = [tuple(r) for r in sh.neighbours(df, radius).collect()]
        assert set(found) == want and len(found) == len(want)


def test_votes_against_plain_integers():
    """Every bit from its own signed votes, with Python integers."""
    import math
    from collections import Counter

    import numpy as np
    import xxhash

    full = (1 << 64) - 1

    def mix(v):
        v = ((v ^ (v >> 30)) * 0xBF58476D1CE4E5B9) & full
        v = ((v ^ (v >> 27)) * 0x94D049BB133111EB) & full
        return v ^ (v >> 31)

    def vote(text):
        h = [xxhash.xxh3_64_intdigest(w) for w in text.split()]
        terms = Counter(mix((a * 0x9E3779B97F4A7C15 + b) & full) for a, b in zip(h, h[1:])) if len(h) > 1 else Counter(map(mix, h))
        out = 0
        for bit in range(64):
            total = sum(round(16 * (1 + math.log(c))) * (1 if t >> bit & 1 else -1) for t, c in terms.items())
            out |= (total > 0) << bit
        return out

    texts = [b"", b"one", b"one one", b"a b a b a b a b c", " ".join(f"w{i % 37}" for i in range(500)).encode(), "é ü x\ty".encode()]
    assert sh.Fingerprints()(texts).view(np.uint64).tolist() == [vote(t) for t in texts]
