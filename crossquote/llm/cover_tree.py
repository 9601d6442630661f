"""Hard negatives by cover trees over norm-augmented candidates.

An anchor's positives are the rows of its label with the highest inner product; its hard negatives for a positive are
the highest rows of other labels inside a window below the positive's score. Every candidate x gets one more
component, sqrt(M^2 - |x|^2) with M the largest norm, and an anchor a zero. All candidates then have norm M, so
|q - x|^2 = |q|^2 + M^2 - 2 q.x: high products are short distances. A node of a cover tree has a centre
among its points and a radius that covers them, at most ``1 / BASE`` of its parent's; at distance d from its centre
its products lie between those at d + r and d - r. A best-first descent takes the node with the highest bound next,
skips nodes outside all windows or below the k-th score so far, and verifies the points of leaves with exact integers.

On Spark: rows become whole numbers in the JVM. Of rows that share vector and label only the ``k`` with the
smallest ids can ever be answers, so no more are indexed; anchors that share both ask once. Pivots, far apart in a bounded sample,
are the top level of one tree; each row goes to its nearest pivot, and a pivot's rows are dealt to
blocks of bounded size, each with its own subtree, written as one row. Anchors first probe one block of
their best pivot for a k-th score, then go to the blocks that pivot radius and score leave. Anchors
of a block come in tiles of bounded size, so neither side of a group grows. Answers, bounded per anchor, return to all anchors
that asked them by a join that is spread for those asked often. Nothing is approximate: no cap on visits, only bounds.

Rows: those with a null label or vector, or a null or infinite component or NaN, take no part. Vectors of other lengths
are filled with zeros. A row that repeats exactly is one row; rows of one id that differ are different rows, and all but itself
are others to an anchor. A null id is never an anchor and comes last in ties. Scores must fit 63 bits (an ArithmeticError
otherwise). An anchor without other rows of its label, a positive with a negative score, or a window without rows gives no
result. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossquote.llm.substrings import stored

BASE = 1.5  # a level covers with this much less than the one above
LEAF = 128  # points of a node that is not split; a child has more, or its points stay with the node
BLOCK_BYTES = 1 << 20  # vectors of a block
SAMPLE, PIVOTS = 2048, 256  # rows the pivots are chosen from, and pivots, at most
TILE = 8192  # anchors that meet a block in one group
NO_ID = (1 << 63) - 1  # stands for a null id, so that it comes last
FAR = 1 << 62
FOUND = "q binary, high long, score long, vec_id long, same boolean"
INDEX = "block long, ids binary, labels binary, vectors binary, nodes binary, radii binary"


def whole_rows(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v, q): usable rows, each once; components floor(scale * x); ``q`` identifies label and vector."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    whole = used.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    key = F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: x.cast("string")))
    return whole.withColumn("q", F.unhex(F.sha2(key, 256))).groupBy("vec_id", "q").agg(
        F.first("label").alias("label"), F.first("v").alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists as rows of equal width, short ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dim), np.int64)
    counts = np.diff(column.offsets.to_numpy())
    out[np.arange(dim) < counts[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Space:
    """Exact products, and bounds of products from distances in the augmented space."""

    def __init__(self, dim: int, square: int):
        if square >= FAR:
            raise ArithmeticError("inner products of these vectors do not fit 63 bits")
        self.dim, self.square, self._floats = dim, square, square < 1 << 53

    def product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a @ b.T, exact."""
        return (self.exact(a) @ self.exact(b).T).astype(np.int64)

    def exact(self, x: np.ndarray) -> np.ndarray:
        """In doubles, where no product nor any sum of its parts reaches 2 ** 53."""
        return x.astype(np.float64 if self._floats else np.int64, copy=False)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        norms = (x.astype(np.float64) ** 2).sum(1)
        return np.c_[x.astype(np.float64), np.sqrt(np.maximum(self.square - norms, 0))]

    def bounds(self, queries: np.ndarray, products: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) product of each query with any point of each node, from those with the centres."""
        both = (queries.astype(np.float64) ** 2).sum(1)[:, None] + float(self.square)
        slack = 1e-7 * both + 1e-6  # far above the rounding of roots and radii
        far = np.sqrt(np.maximum(both - 2.0 * products, 0))
        low = (both - (far + radii) ** 2) / 2 - slack
        high = (both - np.maximum(far - radii, 0) ** 2) / 2 + slack
        return low, high


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, radii) of a cover tree over the rows of ``points``.

    All points have one norm. A node is (centre, first child, children, first point, points): children are consecutive nodes, its own
    points are consecutive in ``order``. A node with few points, or with all in one place, is not split. Centres of children are
    taken farthest first until all points are covered; once half of the points are centres, the others stay with the node,
    as do the points of small children: comparing them at once costs less than their bounds.
    """
    square = float((points[0] ** 2).sum())
    least = 1e-6 * square ** 0.5  # distances below are rounding

    def away(here: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 * (square - here @ points[centre]), 0))  # all norms are equal

    order: list[np.ndarray] = []
    placed = 0
    nodes, radii, queue, at = [[0, 0, 0, 0, 0]], [float(away(points, 0).max())], [np.arange(len(points))], 0
    while at < len(nodes):
        rows, centre, radius = queue[at], nodes[at][0], radii[at]
        queue[at] = None
        own = rows
        if len(rows) > LEAF and radius > least:
            here, children = points[rows], []
            near, owner = away(here, centre), np.full(len(rows), centre)
            while near.max() > radius / BASE and len(children) < len(rows) // 2:
                new = int(rows[near.argmax()])
                children.append(new)
                gap = away(here, new)
                closer = gap < near
                near[closer], owner[closer] = gap[closer], new
            covered = near <= radius / BASE
            groups = [(c, np.flatnonzero(covered & (owner == c))) for c in [centre, *children]]
            groups = [(c, g) for c, g in groups if len(g) > LEAF]
            alone = np.ones(len(rows), bool)
            for _, g in groups:
                alone[g] = False
            own = rows[alone]
            nodes[at][1:3] = len(nodes), len(groups)
            for c, g in groups:
                nodes.append([c, 0, 0, 0, 0])
                radii.append(float(near[g].max()))
                queue.append(rows[g])
        nodes[at][3:5] = placed, len(own)
        order.append(own)
        placed += len(own)
        at += 1
    order = np.concatenate(order)
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    table = np.array(nodes, np.int64)
    table[:, 0] = place[table[:, 0]]
    return order, table, np.array(radii) + least


class Block:
    """A subtree with its points, in the order of its nodes."""

    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, radii: np.ndarray):
        self.space, self.ids, self.labels, self.vectors, self.nodes, self.radii = space, ids, labels, vectors, nodes, radii
        self._points = space.exact(vectors)

    @classmethod
    def of(cls, space: Space, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Block:
        order, nodes, radii = grow(space.augmented(vectors))
        return cls(space, ids[order], labels[order], vectors[order], nodes, radii)

    def row(self) -> list[bytes]:
        return [self.ids.tobytes(), self.labels.tobytes(), self.vectors.astype(np.int32).tobytes(), self.nodes.tobytes(), self.radii.tobytes()]

    @classmethod
    def read(cls, space: Space, ids: bytes, labels: bytes, vectors: bytes, nodes: bytes, radii: bytes) -> Block:
        return cls(space, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64),
                   np.frombuffer(vectors, np.int32).reshape(-1, space.dim).astype(np.int64),
                   np.frombuffer(nodes, np.int64).reshape(-1, 5), np.frombuffer(radii, np.float64))

    def search(self, queries: np.ndarray, labels: np.ndarray, windows: list[list[tuple[int, int]]], same: bool, k: int):
        """Per query and window (high, need): the first ``k`` points of the same (of other) labels with need <= product <= high.

        Yields (query, high, products, points); products go down, ties up by id. ``need`` rises to the k-th product.
        """
        space = self.space
        lows, highs = space.bounds(queries, space.product(queries, self.vectors[self.nodes[:, 0]]), self.radii)
        asked = space.exact(queries)
        for i, wanted in enumerate(windows):
            low, high = lows[i], highs[i]
            need = [n for _, n in wanted]
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in wanted]
            agenda = [(-high[0], 0)]
            while agenda:
                bound, node = heappop(agenda)
                if -bound < min(need):
                    break
                open_to = [w for w, (top, _) in enumerate(wanted) if -bound >= need[w] and low[node] <= top]
                if not open_to:
                    continue
                _, child, children, first, count = self.nodes[node]
                if count:
                    products = (self._points[first:first + count] @ asked[i]).astype(np.int64)
                    own = self.labels[first:first + count] == labels[i]
                    picked = np.flatnonzero((own == same) & (products >= min(need)))
                    products, picked = products[picked], first + picked
                    for w in open_to:
                        inside = (products >= need[w]) & (products <= wanted[w][0])
                        if not inside.any():
                            continue
                        p, at = np.r_[best[w][0], products[inside]], np.r_[best[w][1], picked[inside]]
                        if len(p) > 4 * k:  # ties with the k-th stay for the sort by id
                            stay = p >= np.partition(p, len(p) - k)[len(p) - k]
                            p, at = p[stay], at[stay]
                        chosen = np.lexsort((at, self.ids[at], -p))[:k]
                        best[w] = (p[chosen], at[chosen])
                        if len(chosen) == k:
                            need[w] = max(need[w], int(p[chosen[-1]]))
                floor, ceiling = min(need), max(top for top, _ in wanted)
                for c in range(child, child + children):
                    if high[c] >= floor and low[c] <= ceiling:
                        heappush(agenda, (-high[c], c))
            for (top, _), (p, at) in zip(wanted, best):
                if len(p):
                    yield i, top, p, at


def visiting(part: pa.RecordBatch, took: list[int], blocks: list[int]) -> pa.RecordBatch:
    names = ["tile", "q", "v", "label", "highs", "needs"]
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *[part.column(c).take(pa.array(took)) for c in names]],
                                      ["block", *names])


class Index:
    """Blocks of candidates below pivots; each block is a written row."""

    def __init__(self, candidates: DataFrame, space: Space, block_rows: int | None = None):
        self.space = space
        size = block_rows or max(64, min(4096, BLOCK_BYTES // (4 * max(space.dim, 1))))
        total = candidates.count()
        sample = candidates.select("v", F.xxhash64("q", "vec_id").alias("h")).orderBy("h", "v").limit(SAMPLE).select("v").toArrow()
        self.pivots = self._far_apart(matrix(sample["v"], space.dim), min(PIVOTS, -(-total // size))) if total else None
        if not total:
            self.blocks, self.cells = candidates.sparkSession.createDataFrame([], INDEX), {}
            return
        pivots, dim = self.pivots, space.dim
        placed_at = space.augmented(pivots)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), 2048):
                    part = batch.slice(start, 2048)
                    v = matrix(part.column("v"), dim)
                    augmented = space.augmented(v)
                    gaps = np.maximum(2.0 * space.square - 2 * augmented @ placed_at.T, 0)
                    cell = gaps.argmin(1)
                    away = np.sqrt(((augmented - placed_at[cell]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(away)],
                                                     [*part.schema.names, "cell", "away"])

        rows = stored(candidates.select("vec_id", "label", "v").mapInArrow(
            place, "vec_id long, label long, v array<long>, cell int, away double"))
        cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # <= PIVOTS rows
        self.cells = {r.cell: (-(-r.n // size), r.radius) for r in cells}
        parts = F.create_map(*[x for c, (n, _) in self.cells.items() for x in (F.lit(c), F.lit(n))])[F.col("cell")]
        block = F.shiftleft(F.col("cell").cast("long"), 32) + F.pmod(F.xxhash64("vec_id", "v"), parts)

        def build(table: pa.Table) -> pa.Table:
            own = Block.of(space, table["vec_id"].to_numpy(), table["label"].to_numpy(), matrix(table["v"], dim))
            names = [f.split()[0] for f in INDEX.split(", ")]
            return pa.table([table["block"][:1], *[pa.array([x], pa.binary()) for x in own.row()]], names)

        self.blocks = stored(rows.withColumn("block", block).groupBy("block").applyInArrow(build, INDEX))

    def _far_apart(self, sample: np.ndarray, wanted: int) -> np.ndarray:
        """Rows of the sample, each the farthest from those before it."""
        points = self.space.augmented(sample)
        chosen, gap = [0], ((points - points[0]) ** 2).sum(1)
        while len(chosen) < wanted and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
        return sample[chosen]

    def _visits(self, queries: DataFrame, probe: bool) -> DataFrame:
        """Queries with the blocks they go to: one to start with, or all others that their bounds leave."""
        space, pivots, dim = self.space, self.pivots, self.space.dim
        cells = sorted(self.cells)
        parts = np.array([self.cells[c][0] for c in cells])
        radii = np.array([self.cells[c][1] for c in cells])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), 512):
                    part = batch.slice(start, 512)
                    v = matrix(part.column("v"), dim)
                    low, high = space.bounds(v, space.product(v, pivots[cells]), radii)
                    took, blocks = [], []
                    for i, (tops, needs, tie) in enumerate(zip(*(part.column(c).to_pylist() for c in ("highs", "needs", "tie")))):
                        near = int(high[i].argmax())
                        first = (cells[near] << 32) + tie % int(parts[near])
                        if probe:
                            took.append(i)
                            blocks.append(first)
                            continue
                        open_to = (high[i][:, None] >= np.array(needs)) & (low[i][:, None] <= np.array(tops))
                        for c in np.flatnonzero(open_to.any(1)):
                            for p in range(parts[c]):
                                if (to := (cells[c] << 32) + p) != first:
                                    took.append(i)
                                    blocks.append(to)
                            if len(took) > 4096:
                                yield visiting(part, took, blocks)
                                took, blocks = [], []
                    if took:
                        yield visiting(part, took, blocks)

        return queries.mapInArrow(run, "block long, tile int, q binary, v array<long>, label long, highs array<long>, needs array<long>")

    def _meet(self, visits: DataFrame, tiles: int, same: bool, k: int) -> DataFrame:
        space = self.space

        def run(index: pa.Table, visitors: pa.Table) -> pa.Table:
            out = [[], [], [], [], []]
            if len(visitors) and len(index):
                block = Block.read(space, **index.select(["ids", "labels", "vectors", "nodes", "radii"]).to_pylist()[0])
                keys, own = visitors["q"].to_pylist(), matrix(visitors["v"], space.dim)
                windows = [list(zip(h, n)) for h, n in zip(visitors["highs"].to_pylist(), visitors["needs"].to_pylist())]
                for i, top, products, at in block.search(own, visitors["label"].to_numpy(), windows, same, k):
                    out[0] += [keys[i]] * len(at)
                    out[1] += [top] * len(at)
                    out[2] += products.tolist()
                    out[3] += block.ids[at].tolist()
                    out[4] += (block.vectors[at] == own[i]).all(1).tolist()
            return pa.table([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                            [f.split()[0] for f in FOUND.split(", ")])

        blocks = self.blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "ids", "labels",
                                    "vectors", "nodes", "radii")
        return blocks.groupBy("block", "tile").cogroup(visits.groupBy("block", "tile")).applyInArrow(run, FOUND)

    def best(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(q, high, score, vec_id, same): the first ``k`` of each query's windows; ``same`` tells rows with the query's own vector.

        ``queries`` has q, v, label and parallel arrays ``highs`` and ``needs``, the windows.
        """
        tiles = max(1, -(-queries.count() // TILE))
        asked = queries.withColumn("tie", F.pmod(F.xxhash64("q"), F.lit(1 << 30))).withColumn(
            "tile", F.pmod(F.col("tie"), F.lit(tiles)).cast("int"))
        if not self.cells:
            return queries.sparkSession.createDataFrame([], FOUND)
        probed = stored(self._meet(self._visits(asked, True), tiles, same, k))
        full = probed.groupBy("q", "high").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        raised = full.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("high", "least"))).alias("least"))  # <= windows
        risen = asked.join(raised, "q", "left").withColumn("needs", F.transform(
            F.arrays_zip("highs", "needs"), lambda w: F.greatest(w["needs"], F.col("least")[w["highs"]]))).drop("least")
        found = probed.unionByName(self._meet(self._visits(risen, False), tiles, same, k))
        first = Window.partitionBy("q", "high").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")


def hard_negatives(rows: DataFrame, anchors_every: int = 100, positives: int = 5, negatives: int = 5, least_percent: int = 80,
                   scale: int = 256, block_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose id is divisible.

    ``rows`` has vec_id, label, embedding. A negative scores from ``least_percent`` of its positive up to the positive.
    """
    points = stored(whole_rows(rows, scale))
    size = points.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("square")).first()
    space = Space(max(size.dim or 0, 1), int(size.square or 0))
    kept = max(positives + 1, negatives)
    copies = Window.partitionBy("q").orderBy("vec_id")
    index = Index(stored(points.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= kept).drop("_n")), space, block_rows)

    anchors = points.where((F.col("vec_id") % anchors_every == 0) & (F.col("vec_id") != NO_ID))
    queries = stored(anchors.groupBy("q").agg(F.first("v").alias("v"), F.first("label").alias("label"), F.count("*").alias("n"))
                     .withColumn("spread", F.ceil(F.col("n") / TILE)))  # a query of many anchors answers in as many places
    asked = queries.select("q", "v", "label", F.array(F.lit(FAR)).alias("highs"), F.array(F.lit(-FAR)).alias("needs"))
    found = index.best(asked, True, positives + 1).groupBy("q").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id", "same"))).alias("found"))
    answers = stored(queries.drop("n").join(found, "q"))
    # an anchor never is its own positive, so its own score needs a window only if another row has the same vector
    needed = F.filter("found", lambda x: ~x["same"] | (F.size(F.filter("found", lambda y: y["same"])) > 1))
    tops = F.array_sort(F.array_distinct(F.transform(needed, lambda x: -x["down"])))
    wanted = answers.select("q", "v", "label", F.filter(tops, lambda x: x >= 0).alias("highs")).where(F.size("highs") > 0).withColumn(
        "needs", F.expr(f"transform(highs, x -> {least_percent} * (x div 100) + ({least_percent} * (x % 100) + 99) div 100)"))
    rejected = index.best(wanted, False, negatives).groupBy("q", "high").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))).alias("list"))
    lists = rejected.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("high", "list"))).alias("lists"))
    full = answers.select("q", "spread", "found").join(lists, "q").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("spread") - 1)))
    told = anchors.select("vec_id", "q").join(queries.select("q", "spread").where("spread > 1"), "q", "left").withColumn(
        "_salt", F.when(F.col("spread") > 1, F.pmod(F.xxhash64("vec_id"), F.col("spread"))).otherwise(F.lit(0).cast("long"))).drop("spread")
    own = told.join(full, ["q", "_salt"]).select("vec_id", "lists", F.slice(F.filter(
        "found", lambda x: ~(x["same"] & (x["vec_id"] == F.col("vec_id")))), 1, positives).alias("picked"))
    pairs = own.select(F.col("vec_id").alias("anchor_id"), "lists", F.explode("picked").alias("p")).select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), (-F.col("p.down")).alias("positive_score"),
        F.posexplode(F.col("lists")[-F.col("p.down")]).alias("at", "x"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return pairs.select("anchor_id", named("positive_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
                        named("x.vec_id").alias("negative_id"), "positive_score", (-F.col("x.down")).alias("negative_score"))


def shifted_labels(rows: DataFrame) -> DataFrame:
    """Labels one up, modulo ten, where the id is divisible by seven."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op12_cover_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(shifted_labels(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


ORACLE = """
WITH fine AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS (SELECT *, row_number() OVER () AS r FROM fine),
scores AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM points a JOIN points b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
