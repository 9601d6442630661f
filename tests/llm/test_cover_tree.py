import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crossquote.llm import cover_tree as ct
from tests.llm.conftest import SF

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, width=256):
    """Every row against every row, as the contract says it."""
    seen = set()
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        seen.add((i, label, tuple(math.floor(width * float(np.float32(x))) for x in v)))
    rows = sorted(seen, key=repr)
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in rows:
        if a[0] is None or a[0] % every:
            continue
        others = sorted(((-dot(a[2], b[2]), last(b[0]), b) for b in rows if b != a), key=lambda t: t[:2])
        for down, _, p in [o for o in others if o[2][1] == a[1]][:5]:
            fits = [o for o in others if o[2][1] != a[1] and 80 * -down <= 100 * -o[0] <= 100 * -down][:5]
            out += [(a[0], p[0], n, o[2][0], -down, -o[0]) for n, o in enumerate(fits, 1)]
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in ct.hard_negatives(df, **options).collect()), key=repr)


def made(rng, n, clusters=8, dim=6):
    """Clustered vectors of unequal length, some repeated."""
    centres = rng.normal(0, 1, (clusters, dim))
    v = (centres[rng.integers(0, clusters, n)] + rng.normal(0, 0.1, (n, dim))) * rng.uniform(0.5, 2, (n, 1))
    v[rng.integers(0, n, n // 5)] = v[0]
    return v.astype(np.float32)


def test_tree_covers_every_point_once():
    rng = np.random.default_rng(1)
    v = np.floor(256 * made(rng, 3000)).astype(np.int64)
    space = ct.Space(6, int((v ** 2).sum(1).max()))
    points = space.augmented(v)
    order, nodes, radii = ct.grow(points)
    assert sorted(order) == list(range(3000))
    inside = {}
    for at in range(len(nodes) - 1, -1, -1):
        centre, child, children, first, count = nodes[at]
        inside[at] = [*order[first:first + count], *[p for c in range(child, child + children) for p in inside[c]]]
        assert order[centre] in inside[at]
        away = np.sqrt(((points[inside[at]] - points[order[centre]]) ** 2).sum(1))
        assert away.max() <= radii[at]
        assert all(radii[c] <= radii[at] / ct.BASE + 1e-3 for c in range(child, child + children))
    assert len(inside[0]) == 3000 and len(nodes) > 5


@pytest.mark.parametrize("same", [True, False])
def test_descent_against_all_points(same):
    rng = np.random.default_rng(2)
    v = np.floor(256 * made(rng, 900)).astype(np.int64)
    labels, ids = rng.integers(0, 3, 900), rng.permutation(900)
    space = ct.Space(6, int((v ** 2).sum(1).max()))
    block = ct.Block.of(space, ids, labels, v)
    block = ct.Block.read(space, *block.row())
    queries, own = v[:40], labels[:40]
    windows = [[(int(t), int(t * 0.8) + 1) for t in sorted(rng.integers(1, 200_000, 4))] for _ in range(40)]
    got = {(i, top): [(int(x), int(block.ids[a])) for x, a in zip(p, at)] for i, top, p, at in
           block.search(queries, own, windows, same, 5)}
    for i in range(40):
        scores = v @ queries[i]
        for top, need in windows[i]:
            right = (labels == own[i]) == same
            want = sorted((-int(s), int(d)) for s, d, r in zip(scores, ids, right) if r and need <= s <= top)[:5]
            assert got.get((i, top), []) == [(-s, d) for s, d in want]


def test_descent_skips_nodes():
    """In clustered data most points are never compared."""
    rng = np.random.default_rng(3)
    v = np.floor(256 * made(rng, 4000, clusters=10)).astype(np.int64)
    space = ct.Space(6, int((v ** 2).sum(1).max()))
    block = ct.Block.of(space, np.arange(4000), np.zeros(4000, np.int64), v)
    compared = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            compared.append(at.stop - at.start)
            return np.asarray(super().__getitem__(at))

    block._points = block._points.view(Counted)
    list(block.search(v[1:51], np.zeros(50, np.int64), [[(ct.FAR, -ct.FAR)]] * 50, True, 5))
    assert 0 < sum(compared) < 0.5 * 50 * 4000


@pytest.mark.parametrize("block_rows", [None, 40])
def test_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(4)
    v = made(rng, 600)
    rows = [(i, [float(x) for x in v[i]], int(rng.integers(0, 4))) for i in range(600)]
    got = found(spark.createDataFrame(rows, ROWS), anchors_every=10, block_rows=block_rows)
    assert got == brute(rows, 10) and len(got) > 500


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(tuple(r) for r in ct.op12_cover_negatives(spark, SF).collect()) == sorted(con.execute(ct.ORACLE).fetchall())


def test_odd_rows(spark):
    """Nulls, infinities, short and empty vectors, repeated rows, one id twice, ties, null ids, clashing columns."""
    nan, inf = float("nan"), float("inf")
    one, two = [1.0, 0.5], [0.9, 0.55]
    rows = [(0, one, 1), (0, one, 1), (0, two, 1), (100, one, 1), (100, one, 2), (None, one, 1), (None, two, 2), (3, None, 1),
            (4, one, None), (5, [1.0, None], 1), (6, [nan, 1.0], 2), (7, [inf, 1.0], 2), (8, [1.0], 2), (9, [], 2), (10, [1.0, 0.5, 3.0], 2),
            (11, two, 2), (12, two, 2), (13, [-1.0, -1.0], 1), (200, [-1.0, -0.5], 7), (300, [0.0, 0.0], 2)]
    rows += [(1000 + i, one, 2) for i in range(20)] + [(2000 + i, one, 1) for i in range(20)]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("clash") for c in ("q", "v", "cell", "rank", "score", "tile")})
    want = brute([(i, (v + [0.0] * 3)[:3] if v is not None else None, label) for i, v, label in rows])
    got = found(df)
    assert got == want and got
    assert found(spark.createDataFrame([], ROWS)) == []
    assert found(spark.createDataFrame([(0, one, 1)], ROWS)) == []


def test_many_anchors_with_one_vector(spark, monkeypatch):
    """They ask once and the answer is spread; each leaves itself out."""
    monkeypatch.setattr(ct, "TILE", 16)
    rows = [(i, [1.0, 0.5] if i % 3 else [0.5, 1.0 + i / 1000], i % 2) for i in range(300)]
    assert found(spark.createDataFrame(rows, ROWS), anchors_every=2) == brute(rows, 2)


def test_products_beyond_doubles(spark):
    rows = [(i, [1e5 + i, 1e5 - 2 * i, 3.0], i % 2) for i in range(60)]
    assert found(spark.createDataFrame(rows, ROWS), anchors_every=10) == brute(rows, 10)
    huge = [(i, [1e12], i % 2) for i in range(4)]
    with pytest.raises(ArithmeticError):
        found(spark.createDataFrame(huge, ROWS))
