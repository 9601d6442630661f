"""Exact cross-platform similarity join.

All pairs ``platform_a < platform_b`` whose dot product reaches a threshold, with no cap
per row. The vector space is cut into cells around pivot vectors. Every vector *lives* in
its nearest cell; a vector *visits* every other cell that its angle cannot rule out:

    dot(x, y) <= |x| * maxnorm(cell) * cos(max(0, angle(x, pivot) - radius(cell)))

so a pair is found exactly once, in the home cell of its right-hand side, and pruning never
loses a pair. Cells that half of all vectors visit anyhow are compared together, as apart they
would only cost copies. Cells are cut further into tiles of bounded rows, so a cell holding a third
of all vectors becomes many equal tasks. A tile is a matrix product, block by block;
only pairs above the threshold leave it. Tiles grow with the table up to a bound, so that a vector
is copied to about ``COPIES`` of them on either side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CARRIED = ("platform", "id", "vector", "day", "fresh")
MAX_PIVOTS = 512          # bounds the driver-side pivot table: 512 vectors
ROWS_PER_PIVOT = 8192
TILE_ROWS = 2048          # rows on a side of a tile in tables of up to COPIES * TILE_ROWS rows
MAX_TILE_ROWS = 32768     # rows on a side of a tile at most: bounds the memory of a task
COPIES = 16               # tiles that hold one vector on a side, until tiles are as large as they may be
BLOCK_SCORES = 1 << 22    # scores of a tile that are held at once


def _matrix(column) -> np.ndarray:
    """2-D float32 view of an Arrow list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angle to every pivot, norm) per row; a zero vector is at angle 0 with norm 0."""
    wide = vectors.astype(np.float64)
    norms = np.sqrt((wide * wide).sum(axis=1))
    unit = wide / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0)), norms


def _choose_pivots(staged: DataFrame, wanted: int) -> np.ndarray:
    """Up to MAX_PIVOTS unit vectors picked by id hash: deterministic and bounded."""
    rows = (staged.orderBy(F.xxhash64("platform", "id"), "platform", "id")
            .limit(wanted).select("vector").collect())
    pivots = np.array([r[0] for r in rows], dtype=np.float64)
    norms = np.sqrt((pivots * pivots).sum(axis=1))
    pivots = pivots[norms > 0] / norms[norms > 0, None]
    if not len(pivots):
        return np.eye(1, np.array(rows[0][0]).size)
    return np.unique(pivots, axis=0)


def tile_side(rows: int) -> int:
    """Rows on a side of a tile for a table of ``rows`` vectors."""
    return max(TILE_ROWS, min(MAX_TILE_ROWS, math.ceil(rows / COPIES)))


def _together(homes: dict[int, int], visits: dict[int, int], moving: int, cells: int, most: int) -> np.ndarray:
    """Group number per cell: cells that half of the moving rows visit share groups of up to ``most`` rows."""
    group, filled, current = np.arange(cells), 0, -1
    for c in range(cells):
        if 2 * visits.get(c, 0) < moving or not homes.get(c, 0):
            continue
        if current < 0 or filled + homes[c] > most:
            current, filled = c, 0
        group[c], filled = current, filled + homes[c]
    return group


def _cell_stats(staged: DataFrame, pivots: np.ndarray) -> dict[int, tuple[float, float, int]]:
    """Per cell: angular radius, largest norm, rows. At most one row per pivot."""
    def homes(batches):
        for batch in batches:
            angles, norms = _angles(_matrix(batch.column("vector")), pivots)
            home = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(home, pa.int32()), pa.array(angles[np.arange(len(home)), home]),
                 pa.array(norms)], ["cell", "angle", "norm"])

    rows = (staged.select("vector").mapInArrow(homes, "cell int, angle double, norm double")
            .groupBy("cell").agg(F.max("angle"), F.max("norm"), F.count("*")).collect())
    return {r[0]: (r[1], r[2], r[3]) for r in rows}


def _visit_mask(angles, norms, home, fresh, radius, reach, threshold):
    """Cells a row must visit: the home cell plus every cell the bound cannot exclude.

    Rows that are not fresh stay at home.
    """
    if threshold <= 0:
        mask = np.ones_like(angles, dtype=bool)
    else:
        nearest = np.maximum(0.0, angles - radius[None, :] - 1e-6)
        best = np.cos(np.minimum(nearest, np.pi)) * norms[:, None] * reach[None, :]
        mask = best >= threshold - 1e-6
    mask[np.arange(len(home)), home] = True
    return mask & (radius >= 0)[None, :] & fresh[:, None]


def _flags(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _visit_counts(staged, pivots, radius, reach, threshold) -> dict[int, int]:
    def visits(batches):
        for batch in batches:
            angles, norms = _angles(_matrix(batch.column("vector")), pivots)
            mask = _visit_mask(angles, norms, angles.argmin(axis=1), _flags(batch.column("fresh")),
                               radius, reach, threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(mask.shape[1]), pa.int32()),
                 pa.array(mask.sum(axis=0), pa.int64())], ["cell", "n"])

    rows = (staged.select("vector", "fresh").mapInArrow(visits, "cell int, n long")
            .groupBy("cell").agg(F.sum("n")).collect())
    return {r[0]: r[1] for r in rows}


def _route(staged, pivots, radius, reach, threshold, group, home_slices, visit_slices, lives, moves) -> DataFrame:
    """Replicate every vector to the tiles it takes part in.

    ``lives`` and ``moves`` say (of platform, fresh) which rows can be met in a home cell and which can meet others.
    """
    home_slices, visit_slices = np.array(home_slices), np.array(visit_slices)
    groups, member = np.unique(group, return_inverse=True)
    members = np.eye(len(groups), dtype=np.float32)[member]

    def expand(rows, cells, copies):
        """One entry per copy: (row, cell, copy number)."""
        times = copies[cells]
        ends = np.cumsum(times)
        number = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
        return np.repeat(rows, times), np.repeat(cells, times), number

    def tiles(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):  # a row may have many copies
                batch = whole.slice(first, 1024)
                angles, norms = _angles(_matrix(batch.column("vector")), pivots)
                salt = batch.column("salt").to_numpy()
                home = angles.argmin(axis=1)
                fresh = _flags(batch.column("fresh"))
                mask = _visit_mask(angles, norms, home, fresh, radius, reach, threshold)
                met = mask.astype(np.float32) @ members > 0
                met &= moves(batch.column("platform"), fresh)[:, None]
                stay = np.flatnonzero(lives(batch.column("platform"), fresh))
                h_row, h_cell, h_copy = expand(stay, group[home[stay]], visit_slices)
                rows, at = np.nonzero(met)
                v_row, v_cell, v_copy = expand(rows, groups[at], home_slices)
                take = np.concatenate([h_row, v_row])
                tile = np.concatenate([
                    _tile_id(h_cell, salt[h_row] % home_slices[h_cell], h_copy),
                    _tile_id(v_cell, v_copy, salt[v_row] % visit_slices[v_cell])])
                visitor = np.arange(len(take)) >= len(h_row)
                for start in range(0, len(take), 4096):  # keep single batches small
                    part = pa.array(take[start:start + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tile[start:start + 4096]), pa.array(visitor[start:start + 4096]),
                         *[batch.column(n).take(part) for n in _CARRIED]],
                        ["tile", "visitor", *_CARRIED])

    return staged.mapInArrow(tiles, "tile long, visitor boolean, platform string, id string, "
                                    "vector array<float>, day int, fresh boolean")


def _is(column, name: str | None) -> np.ndarray:
    return pc.fill_null(pc.equal(column, pa.scalar(name, pa.string())), False).to_numpy(zero_copy_only=False)


def _tile_id(cell, home_slice, visit_slice):
    return (cell.astype(np.int64) << 44) | (home_slice.astype(np.int64) << 22) | visit_slice


_PAIR = "platform_a string, id_a string, platform_b string, id_b string, score double"


def _match_tile(threshold: float, max_gap: int | None):
    """Kernel of one tile: float32 product to shortlist, float64 dot to decide."""
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        visitor = table.column("visitor").to_numpy()
        platform = np.asarray(table.column("platform").to_pylist(), dtype=object)
        vectors = _matrix(table.column("vector"))
        day = table.column("day").to_numpy(zero_copy_only=False).astype(np.float64)
        fresh = table.column("fresh").to_numpy()
        names = table.select(["platform", "id"]).combine_chunks()
        left, right = np.flatnonzero(visitor), np.flatnonzero(~visitor)
        for name in sorted(set(platform[left])):
            rows = left[platform[left] == name]
            # two fresh rows meet twice; the meeting with the smaller platform visiting counts
            others = right[(platform[right] > name) | ((platform[right] < name) & ~fresh[right])]
            if not len(others):
                continue
            other_vectors = vectors[others]
            wide_others = np.abs(other_vectors).sum(axis=1).max(initial=0.0)
            step = max(1, min(512, BLOCK_SCORES // len(others)))
            for start in range(0, len(rows), step):
                block = rows[start:start + step]
                near = vectors[block] @ other_vectors.T
                slack = 1e-5 * max(1.0, float(np.abs(vectors[block]).max(initial=0.0)) * wide_others)
                i, j = np.nonzero(near >= threshold - slack)
                if max_gap is not None and len(i):
                    gap = np.abs(day[block[i]] - day[others[j]])
                    keep = ~(gap > max_gap)      # unknown day gives nan: kept
                    i, j = i[keep], j[keep]
                for at in range(0, len(i), 1 << 16):
                    first, second = block[i[at:at + (1 << 16)]], others[j[at:at + (1 << 16)]]
                    exact = np.einsum("nd,nd->n", vectors[first].astype(np.float64),
                                      vectors[second].astype(np.float64))
                    sure = exact >= threshold
                    first, second = first[sure], second[sure]
                    swap = platform[first] > platform[second]
                    a, b = np.where(swap, second, first), np.where(swap, first, second)
                    yield pa.RecordBatch.from_arrays(
                        [*[_texts(names.column(c), side) for side in (a, b) for c in ("platform", "id")],
                         pa.array(exact[sure], pa.float64())], ["platform_a", "id_a", "platform_b", "id_b", "score"])
    return match


def _texts(column, at: np.ndarray) -> pa.Array:
    taken = column.take(pa.array(at, pa.int64()))
    return taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken


def similarity_pairs(vectors: DataFrame, threshold: float, *, platform: str = "platform",
                     id_col: str = "market_id", vector: str = "vector",
                     close_day: Column | None = None, max_gap_days: int | None = 90,
                     fresh: Column | None = None) -> DataFrame:
    """Every cross-platform pair with dot product >= threshold.

    ``close_day`` (a date Column) adds the close-date rule: a pair is dropped only when both
    dates are known and further apart than ``max_gap_days``. ``fresh`` (a boolean Column) asks
    only for pairs with at least one fresh row: known rows then wait in their home cells and the
    work follows the number of fresh rows. Rows without a vector take no part.
    """
    day = F.lit(None).cast("int") if close_day is None else F.unix_date(close_day)
    staged = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(
        F.col(platform).alias("platform"), F.col(id_col).cast("string").alias("id"),
        F.col(vector).cast("array<float>").alias("vector"), day.alias("day"),
        (F.lit(True) if fresh is None else fresh).alias("fresh"),
        F.pmod(F.xxhash64(platform, id_col), F.lit(1 << 31)).alias("salt"))
    gap = None if close_day is None else max_gap_days

    rows, moving, dims_low, dims_high, lowest, highest = staged.agg(
        F.count("*"), F.count_if("fresh"), F.min(F.size("vector")), F.max(F.size("vector")), F.min("platform"), F.max("platform")).first()
    if not rows:
        return staged.sparkSession.createDataFrame([], _PAIR)
    if dims_low != dims_high:
        raise ValueError(f"vectors differ in length: {dims_low} to {dims_high}")

    slots = staged.sparkSession.sparkContext.defaultParallelism
    tile_rows = min(tile_side(rows), max(256, math.ceil(rows / max(1.0, math.sqrt(slots)))))
    wanted = min(MAX_PIVOTS, rows // ROWS_PER_PIVOT)
    if wanted <= 1:
        pivots, radius, reach = np.eye(1, dims_low), np.array([math.pi]), np.array([np.inf])
        homes, visits, limit = {0: rows}, {0: moving}, 0.0
    else:
        pivots, limit = _choose_pivots(staged, wanted), threshold
        stats = _cell_stats(staged, pivots)
        radius = np.array([stats[c][0] if c in stats else -1.0 for c in range(len(pivots))])
        reach = np.array([stats[c][1] if c in stats else 0.0 for c in range(len(pivots))])
        homes = {c: s[2] for c, s in stats.items()}
        visits = _visit_counts(staged, pivots, radius, reach, limit)
    cells = range(len(pivots))
    group = _together(homes, visits, moving, len(pivots), tile_rows)
    live, meet = [0] * len(pivots), [0] * len(pivots)
    for c in cells:
        live[group[c]] += homes.get(c, 0)
        meet[group[c]] = min(moving, meet[group[c]] + visits.get(c, 0))
    home_slices = [max(1, math.ceil(n / tile_rows)) for n in live]
    visit_slices = [max(1, math.ceil(n / tile_rows)) for n in meet]
    # a fresh row of the first platform is not met by a larger one; one of the last meets known rows only
    lives = lambda platform, fresh: ~(_is(platform, lowest) & fresh)
    moves = lambda platform, fresh: ~_is(platform, highest) | (rows > moving)

    routed = _route(staged, pivots, radius, reach, limit, group, home_slices, visit_slices, lives, moves)
    return routed.groupBy("tile").applyInArrow(_match_tile(threshold, gap), _PAIR)


def two_list_pairs(left: DataFrame, right: DataFrame, threshold: float, *,
                   platform: str = "platform", id_col: str = "market_id", **options) -> DataFrame:
    """The same join for exactly two given lists; the left list is side a of every pair."""
    sep = "\x01"

    def side(df, name):
        key = F.concat_ws(sep, F.col(platform), F.col(id_col).cast("string"))
        return df.withColumn("_list", F.lit(name)).withColumn("_key", key)

    both = side(left, "0").unionByName(side(right, "1"))
    pairs = similarity_pairs(both, threshold, platform="_list", id_col="_key", **options)
    part = lambda c, n: F.split_part(c, F.lit(sep), F.lit(n))
    return pairs.select(
        part(F.col("id_a"), 1).alias("platform_a"), part(F.col("id_a"), 2).alias("id_a"),
        part(F.col("id_b"), 1).alias("platform_b"), part(F.col("id_b"), 2).alias("id_b"), "score")
