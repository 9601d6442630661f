import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crossquote.llm import merkle
from tests.llm.conftest import DOCS, ODD, SF

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes, arity):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
        out.append(nodes)
    return out


def up(at, tree, node, arity):
    proof = []
    for level in tree[:-1]:
        first = at - at % arity
        run = level[first:first + arity]
        proof += [c for i, c in enumerate(run) if first + i != at]
        run[at - first] = node
        node, at = h(*run), at // arity
    return node, proof


def brute(rows, arity=2):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for rows_of in trees.values():
        rows_of.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {k: levels([leaf(r) for r in trees[k]], arity) for k in names}
    crown = levels([built[k][-1][0] for k in names], arity)
    out = []
    for at, name in enumerate(names):
        for i, r in enumerate(trees[name]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            changed = (*r[:3], r[3] + 1 if hit and r[3] is not None else r[3], r[4])
            node, proof = up(i, built[name], leaf(changed), arity)
            node, more = up(at, crown, node, arity)
            out.append((r[0], leaf(r), built[name][-1][0], crown[-1][0], h(*proof, *more), node))
    return sorted(out, key=repr)


def audit(docs, **options):
    hit = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    docs = docs.withColumn("_n", F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    replaced = merkle.leaf_digest("doc_id", "source", "lang", "_n", "text")
    return merkle.build(docs, F.col("lang"), "doc_id", merkle.leaf_digest(*FIELDS), replaced, **options)


def plain(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in df.collect()), key=repr)


def test_states_are_those_of_sha256():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 1 << 32, (8, 50), dtype=np.uint32)
    names = [d.hex() for d in merkle.raw(digests)]
    for arity in (1, 2, 3, 5):
        state = np.repeat(merkle.START[:, None], 50 // arity, 1)
        for slot in range(arity):
            state = merkle.compress(state, merkle.spelled(digests[:, slot:arity * (50 // arity):arity]))
        got = [d.hex() for d in merkle.raw(merkle.closed(state, np.array(arity)))]
        assert got == [h(*names[i * arity:(i + 1) * arity]) for i in range(50 // arity)]


@pytest.mark.parametrize("arity,span", [(2, 4096), (2, 4), (3, 9), (5, 7)])
def test_against_hashlib(spark, arity, span):
    """Small blocks make many layers."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*FIELDS).collect()]
    assert plain(audit(docs, arity=arity, span=span).audit()) == brute(rows, arity)


@pytest.mark.parametrize("arity", [2, 3])
def test_proofs_rebuild_the_root(spark, arity):
    """A kept state is that of the siblings to the left, and state, leaf and right siblings give the root."""
    manifest = audit(spark.read.parquet(f"{SF}/documents.parquet"), arity=arity, span=16)
    leaves = {(r.tree, r.position): r.digest for r in manifest.leaves.collect()}
    proofs = manifest.proofs().collect()
    assert len(proofs) == len(leaves)
    for r in proofs:
        node = leaves[r.tree, r.position].hex()
        for left, right in zip(r.lefts, r.rights):
            node = h(left.hex(), node, right.hex())
        assert node == r.root.hex()
        path = list(zip(r.before, r.lefts, r.rights))
        start = merkle.words([leaves[r.tree, r.position]])
        assert merkle.raw(merkle.resume(start, path)) == [bytes(r.root)]
        assert merkle.raw(merkle.resume(start + np.uint32(1), path)) != [bytes(r.root)]


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(merkle.ORACLE).fetchall()
    got = [tuple(r) for r in merkle.op13_merkle_manifest(spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows(spark, odd, empty):
    """Nulls everywhere, repeated rows, long texts, a lone leaf, columns with clashing names."""
    order = [DOCS.replace(",", "").split()[::2].index(f) for f in FIELDS]
    rows = [tuple(r[i] for i in order) for r in ODD]
    assert plain(audit(odd).audit()) == brute(rows)
    assert audit(empty).audit().collect() == []
    one = spark.createDataFrame([(5, "t", "en", "s", 1)], DOCS)
    (only,) = audit(one).audit().collect()
    assert only.leaf == only.subroot == only.root and only.proof_sha256 == h()


def test_one_tree_with_most_rows(spark):
    """Ties on the id, one tree of thousands of leaves over several parts."""
    docs = spark.range(9000).select((F.col("id") % 3000).alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"),
                                    F.when(F.col("id") % 50 > 0, "en").otherwise(F.concat(F.lit("l"), F.col("id"))).alias("lang"),
                                    F.lit("s").alias("source"), F.lit(3).cast("long").alias("n_chars"))
    rows = [tuple(r) for r in docs.select(*FIELDS).collect()]
    assert plain(audit(docs, span=256).audit()) == brute(rows)
