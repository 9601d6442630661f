"""Merkle manifest of a table, with the SHA-256 midstates of every inner node.

A leaf is the hash of a row. The leaves of a tree (here: one per language) stand in order; every ``arity``
consecutive nodes become the hash of their hex digests, level by level, until one is left, the subroot. The
subroots of all trees, in order of their tree, make one more tree, whose top is the root of the manifest.

A hex digest is one 64-byte block of SHA-256, so the state of a parent's hash after each child is eight words.
A parent keeps a copy of that state from before each child slot. A changed child needs no left sibling any
more: folding resumes the state kept for its slot, takes in the replacement and the siblings to the right, and
goes on with the result one level up.

On Spark: leaves are range-sorted once and numbered without a window over a tree, so a tree with most rows
is many tasks. Blocks of ``arity ** k`` consecutive leaves, at most ``SPAN``, are built k levels high in one group;
their tops are the leaves of the next layer, about a four-thousandth of the rows. Folding goes down
the layers again: a block gets the path of its top, one row, and folds all its leaves.

Rows: a null field hashes as ``-``. Null ids come first in a tree, equal ids in order of their leaf; a row that
repeats is a leaf each time. Texts are hashed inside the JVM, however long. A null tree comes before all
others. An empty table has no leaves and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossquote.llm.substrings import stored
from crossquote.llm.words import documents, id_remainder

SPAN = 4096  # leaves of a block at most
MASK = (1 << 32) - 1


def _primes(count: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < count:
        if all(n % p for p in found):
            found.append(n)
        n += 1
    return found


def _cube_root(n: int) -> int:
    root = 1 << -(-n.bit_length() // 3)
    while root ** 3 > n:
        root = (2 * root + n // (root * root)) // 3
    return root


#: SHA-256 starts from the fractions of square roots of primes; its rounds add those of cube roots.
START = np.array([isqrt(p << 64) & MASK for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & MASK for p in _primes(64)], np.uint32)
#: Four hex digits, as the 32-bit word of their ASCII codes, of each 16-bit number.
HEX = np.frombuffer("".join(f"{i:04x}" for i in range(1 << 16)).encode(), ">u4").astype(np.uint32)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8 x n words) after one more block (16 x n words) each."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[(t - 15) & 15], w[(t - 2) & 15]
            w[t & 15] = (w[t & 15] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[(t - 7) & 15]
                         + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        one = (h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t & 15])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def spelled(digests: np.ndarray) -> np.ndarray:
    """The 64 hex characters of digests (8 x n words), as blocks (16 x n words)."""
    out = np.empty((16, digests.shape[1]), np.uint32)
    out[0::2], out[1::2] = HEX[digests >> np.uint32(16)], HEX[digests & np.uint32(0xFFFF)]
    return out


def closed(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests of parents from their states after the last child: the closing block tells the length."""
    block = np.zeros((16, state.shape[1]), np.uint32)
    block[0], block[15] = 1 << 31, 512 * children  # bits; a run has few children
    return compress(state, block)


def words(raw: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), ">u4").astype(np.uint32).reshape(-1, 8).T


def raw(digests: np.ndarray) -> list[bytes]:
    flat = np.ascontiguousarray(digests.T).astype(">u4").tobytes()
    return [flat[i:i + 32] for i in range(0, len(flat), 32)]


@dataclass
class Level:
    """Nodes side by side: their digests, and the state their parent keeps from before each of them."""

    digests: np.ndarray
    before: np.ndarray


def grow(digests: np.ndarray, levels: int, arity: int) -> tuple[list[Level], np.ndarray]:
    """``levels`` levels above consecutive nodes, and the digests on top."""
    grown = []
    for _ in range(levels):
        n = digests.shape[1]
        parents = -(-n // arity)
        state, before = np.repeat(START[:, None], parents, 1), np.empty_like(digests)
        for slot in range(min(arity, n)):
            child = digests[:, slot::arity]
            before[:, slot::arity] = state[:, :child.shape[1]]
            state[:, :child.shape[1]] = compress(state[:, :child.shape[1]], spelled(child))
        grown.append(Level(digests, before))
        digests = closed(state, np.minimum(arity, n - arity * np.arange(parents)))
    return grown, digests


def fold(grown: list[Level], replaced: np.ndarray, arity: int) -> np.ndarray:
    """Digest of the block's top for each leaf (8 x n) if that leaf alone were the one in ``replaced``."""
    at = np.arange(replaced.shape[1])
    for level in grown:
        slot, n = at % arity, level.digests.shape[1]
        children = np.minimum(arity, n - (at - slot))
        state = compress(level.before[:, at], spelled(replaced))
        for step in range(1, arity):
            has = np.flatnonzero(slot + step < children)
            if len(has):
                state[:, has] = compress(state[:, has], spelled(level.digests[:, at[has] + step]))
        replaced, at = closed(state, children), at // arity
    return replaced


def resume(digests: np.ndarray, path: Sequence[tuple[bytes, bytes, bytes]]) -> np.ndarray:
    """Fold digests (8 x n) that stand in the same place up a path of (state before, left, right siblings)."""
    for before, left, right in path:
        state = compress(np.repeat(words([before]), digests.shape[1], 1), spelled(digests))
        for i in range(0, len(right), 32):
            state = compress(state, np.repeat(spelled(words([right[i:i + 32]])), digests.shape[1], 1))
        digests = closed(state, np.array(1 + (len(left) + len(right)) // 32))
    return digests


def steps(grown: list[Level], leaf: int, arity: int) -> list[tuple[bytes, bytes, bytes]]:
    """(state before, left siblings, right siblings) of a leaf at each level of its block."""
    out = []
    for level in grown:
        first = leaf - leaf % arity
        out.append(tuple(b"".join(raw(part)) for part in (
            level.before[:, leaf:leaf + 1], level.digests[:, first:leaf], level.digests[:, leaf + 1:first + arity])))
        leaf //= arity
    return out


def height(nodes: int, arity: int) -> int:
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // arity), levels + 1
    return levels


def leaf_digest(*fields: str) -> Column:
    """SHA-256 of the fields: ``-`` for a null, else UTF-8 byte count, ``:`` and value."""
    parts = []
    for name in fields:
        value = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


NODE = "tree string, position long, nodes long, digest binary"
PATH = "tree string, position long, subroot binary, root binary, before array<binary>, lefts array<binary>, rights array<binary>"
SEEN = ["tree", "position", "nodes", "digest"]


def numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``position`` from 0 in its tree and ``nodes``, the tree's size. Sorted parts are counted, not windowed."""
    ranged = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    kept = stored(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    counts = kept.groupBy("tree", part).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")  # a row per tree and sorted part
    earlier = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier"),
                           F.sum("_n").over(tree).alias("nodes"))
    return kept.withColumn("_part", part).join(places, ["tree", "_part"]).withColumn(
        "position", F.col("_at") - F.col("_first") + F.col("_earlier")).drop("_at", "_part", "_first", "_earlier")


def _sorted(table: pa.Table) -> pa.Table:
    return table.combine_chunks().sort_by("position")


def layers(leaves: DataFrame, arity: int = 2, span: int = SPAN) -> list[DataFrame]:
    """Tables (tree, position, nodes, digest) of leaves, block tops, tops of blocks of those, ..., subroots."""
    per_block = 1
    while arity ** (per_block + 1) <= span:
        per_block += 1
    width = arity ** per_block

    def top(table: pa.Table) -> pa.Table:
        table = _sorted(table)
        nodes = table["nodes"][0].as_py()
        levels = height(nodes, arity) if nodes <= width else per_block
        _, digest = grow(words(table["digest"].to_pylist()), levels, arity)
        return pa.table({"tree": table["tree"][:1], "position": pa.array([table["position"][0].as_py() // width], pa.int64()),
                         "nodes": pa.array([-(-nodes // width)], pa.int64()), "digest": pa.array(raw(digest), pa.binary())})

    out = [leaves]
    largest = leaves.agg(F.max("nodes")).first()[0] or 0
    while largest > 1 or len(out) == 1:
        blocks = out[-1].select(*SEEN).groupBy("tree", F.floor(F.col("position") / width).alias("block"))
        out.append(stored(blocks.applyInArrow(top, NODE)))
        largest = -(-largest // width)
    return out


def _blocks(table: DataFrame, paths: DataFrame, arity: int, span: int, schema: str, work) -> DataFrame:
    """``work(rows, levels of their block, first position, path of its top)`` for every block of a layer."""
    per_block = 1
    while arity ** (per_block + 1) <= span:
        per_block += 1
    width = arity ** per_block

    def run(rows: pa.Table, path: pa.Table) -> pa.Table:
        rows = _sorted(rows)
        nodes = rows["nodes"][0].as_py()
        grown, _ = grow(words(rows["digest"].to_pylist()), height(nodes, arity) if nodes <= width else per_block, arity)
        return work(rows, grown, path.to_pylist()[0])

    return table.groupBy("tree", F.floor(F.col("position") / width).alias("block")).cogroup(
        paths.groupBy("tree", F.col("position").alias("block"))).applyInArrow(run, schema)


def paths_down(tables: list[DataFrame], top: DataFrame, arity: int = 2, span: int = SPAN) -> DataFrame:
    """Paths of the nodes of ``tables[0]``, from those of the nodes on top of ``tables[-1]``."""
    def work(rows: pa.Table, grown: list[Level], path: dict) -> pa.Table:
        own = [steps(grown, leaf, arity) for leaf in range(len(rows))]
        return pa.table({
            "tree": rows["tree"], "position": rows["position"], "subroot": pa.array([path["subroot"]] * len(rows), pa.binary()),
            "root": pa.array([path["root"]] * len(rows), pa.binary()),
            **{name: pa.array([[s[i] for s in one] + path[name] for one in own], pa.list_(pa.binary()))
               for i, name in enumerate(("before", "lefts", "rights"))}})

    for table in reversed(tables):
        top = _blocks(table.select(*SEEN), top, arity, span, PATH, work)
    return top


@dataclass
class Manifest:
    """Leaves with their places, the layers above them, and the paths of the tops of the first blocks."""

    leaves: DataFrame
    tops: DataFrame
    arity: int
    span: int

    def proofs(self) -> DataFrame:
        """Per leaf its subroot and root, and per level up to the root the parent's state before it and its siblings."""
        return paths_down([self.leaves], self.tops, self.arity, self.span)

    def audit(self) -> DataFrame:
        """Per leaf (columns ``id``, ``digest``, ``replacement``) the hash of its proof and the root folded from the replacement."""
        arity = self.arity

        def work(rows: pa.Table, grown: list[Level], path: dict) -> pa.Table:
            n = len(rows)
            upper = list(zip(path["before"], path["lefts"], path["rights"]))
            folded = resume(fold(grown, words(rows["replacement"].to_pylist()), arity), upper)
            hexes = [[d.hex().encode() for d in raw(level.digests)] for level in grown]
            above = (b"".join(left + right for _, left, right in upper)).hex().encode()
            proofs = []
            for leaf in range(n):
                siblings, at = [], leaf
                for own in hexes:
                    first = at - at % arity
                    siblings += own[first:at] + own[at + 1:first + arity]
                    at //= arity
                proofs.append(hashlib.sha256(b"".join(siblings) + above).hexdigest())
            return pa.table({
                "doc_id": rows["id"], "leaf": pa.array([d.hex() for d in rows["digest"].to_pylist()]),
                "subroot": pa.array([path["subroot"].hex()] * n), "root": pa.array([path["root"].hex()] * n),
                "proof_sha256": pa.array(proofs), "folded_root": pa.array([d.hex() for d in raw(folded)])})

        return _blocks(self.leaves, self.tops, arity, self.span, "doc_id long, leaf string, subroot string, root string, "
                       "proof_sha256 string, folded_root string", work)


def build(rows: DataFrame, tree: Column, id_column: str, digest: Column, replacement: Column, arity: int = 2,
          span: int = SPAN) -> Manifest:
    """Manifest of all rows: ``digest`` is a row's leaf, ``replacement`` the one to fold instead of it.

    ``tree`` is a text; a null tree stands before all texts, those in order of their UTF-8 bytes.
    """
    if not 2 <= arity <= span:
        raise ValueError("a node has at least two children, and a block room for a node")
    named = F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit("-"))  # '-' sorts before '='
    leaves = numbered(rows.select(named.alias("tree"), F.col(id_column).cast("long").alias("id"), digest.alias("digest"),
                                  replacement.alias("replacement")), ["id", "digest"])
    tables = layers(leaves, arity, span)
    subroots = numbered(tables[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    crown = layers(subroots, arity, span)
    top = crown[-1].select("tree", "position", F.lit(b"").alias("subroot"), F.col("digest").alias("root"),
                           *[F.array().cast("array<binary>").alias(c) for c in ("before", "lefts", "rights")])
    named_paths = paths_down(crown[:-1], top, arity, span).join(
        subroots.select("position", "name", F.col("digest").alias("_own")), "position")
    tops = named_paths.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("position"), F.col("_own").alias("subroot"),
                              "root", "before", "lefts", "rights")
    return Manifest(leaves, stored(paths_down(tables[1:-1], tops, arity, span)), arity, span)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    hit = F.col("doc_id").isNotNull() & (id_remainder(TAMPERED) == 0)
    changed = docs.withColumn("_n", F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    tampered = F.when(hit, leaf_digest("doc_id", "source", "lang", "_n", "text")).otherwise(leaf_digest(*FIELDS))
    found = build(changed, F.col("lang"), "doc_id", leaf_digest(*FIELDS), tampered).audit()
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _spelled_sql(*fields: str) -> str:
    return "sha256(" + " || ".join(
        f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR) END" for f in fields) + ")"


ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT i, list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
crcs AS (SELECT list(v ORDER BY i) AS t FROM crc),
docs AS (
  SELECT *, doc_id IS NOT NULL AND xor(list_reduce(
      list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {TAMPERED} = 0 AS hit
  FROM documents, crcs),
hashed AS (
  SELECT doc_id, lang, {_spelled_sql(*FIELDS)} AS leaf,
    CASE WHEN hit THEN {_spelled_sql("doc_id", "source", "lang", "(n_chars + 1)", "text")} ELSE {_spelled_sql(*FIELDS)} END AS changed
  FROM docs),
leaves AS (
  SELECT *, row_number() OVER () AS k, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
nodes AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(h || coalesce(nxt, '')) FROM (
    SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY pos) AS nxt FROM nodes WHERE n > 1) WHERE pos % 2 = 0),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
crown AS (
  SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(h || coalesce(nxt, '')) FROM (
    SELECT *, lead(h) OVER (ORDER BY pos) AS nxt FROM crown WHERE n > 1) WHERE pos % 2 = 0),
inner_folds AS (
  SELECT k, lang, 0 AS level, pos, n, changed AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT f.k, f.lang, f.level + 1, f.pos // 2, (f.n + 1) // 2,
    sha256(CASE WHEN f.pos % 2 = 0 THEN f.h || coalesce(s.h, '') ELSE s.h || f.h END), f.proof || coalesce(s.h, '')
  FROM inner_folds f LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.pos = xor(f.pos, 1)
  WHERE f.n > 1),
outer_folds AS (
  SELECT f.k, f.lang, 0 AS level, s.pos, s.n, f.h, f.proof
  FROM inner_folds f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
  UNION ALL
  SELECT f.k, f.lang, f.level + 1, f.pos // 2, (f.n + 1) // 2,
    sha256(CASE WHEN f.pos % 2 = 0 THEN f.h || coalesce(s.h, '') ELSE s.h || f.h END), f.proof || coalesce(s.h, '')
  FROM outer_folds f LEFT JOIN crown s ON s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, c.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = c.h AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN outer_folds f ON f.k = l.k AND f.n = 1 JOIN crown c ON c.n = 1
"""
