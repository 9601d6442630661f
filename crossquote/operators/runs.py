"""Ordered scans that survive hot keys.

A plain ``Window.partitionBy(key)`` puts one key's whole history into one task. Here the
rows are range-sorted by (key, order) first, so a hot key spans several bounded *runs*
(sorted partitions). Each scan then works per (key, run) and adds a carry computed from
one summary row per (key, run). The sorted rows are checkpointed because the run number
must stay the same in the summary branch and in the row branch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossquote.session import materialize

RUN = "_run"


def sorted_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-sort by keys then order, tag every row with its run number, cut lineage.

    ``order`` must be a total order within a key; then even one key (or one timestamp)
    holding most of the rows is spread over as many runs as its share of the data.
    """
    ordered = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    return materialize(ordered.withColumn(RUN, F.spark_partition_id()))


def _run_window(keys, order):
    return Window.partitionBy(*keys, RUN).orderBy(*order)


def _earlier_runs(keys):
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return window.orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)


def _with_carry(runs, keys, summary, carries, broadcast):
    """Attach per-run carries. One summary row exists per (key, run)."""
    carry = summary.select(*keys, RUN, *[c.alias(n) for n, c in carries.items()])
    if broadcast:  # without keys there is one row per run: bounded by the partition count
        carry = F.broadcast(carry)
    same = runs[RUN] == carry[RUN]
    for key in keys:
        same = same & runs[key].eqNullSafe(carry[key])
    return runs.join(carry, same, "left").drop(*[carry[k] for k in keys], carry[RUN])


def scan_last(runs: DataFrame, keys: Sequence[str], order: Sequence[str],
              cols: Mapping[str, Column], before: Mapping[str, Column] | None = None) -> DataFrame:
    """Latest non-null value up to the row for ``cols``, strictly before it for ``before``."""
    staged, strict = runs, before or {}
    cols = {**cols, **strict}
    for name, expr in cols.items():
        staged = staged.withColumn(f"_v_{name}", expr)
    position = F.struct(*order)
    summary = staged.groupBy(*keys, RUN).agg(*[
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_s_{n}")
        for n in cols])
    carried = _with_carry(
        staged, keys, summary,
        {f"_c_{n}": F.last(f"_s_{n}", ignorenulls=True).over(_earlier_runs(keys)) for n in cols},
        broadcast=not keys)
    for name in cols:
        frame = _run_window(keys, order).rowsBetween(
            Window.unboundedPreceding, -1 if name in strict else 0)
        inside = F.last(f"_v_{name}", ignorenulls=True).over(frame)
        carried = carried.withColumn(name, F.coalesce(inside, F.col(f"_c_{name}")))
    return carried.drop(*[f"_{p}_{n}" for n in cols for p in "vc"])


def scan_next(runs: DataFrame, keys: Sequence[str], order: Sequence[str],
              cols: Mapping[str, Column]) -> DataFrame:
    """Earliest non-null value of each expression strictly after the row."""
    staged = runs
    for name, expr in cols.items():
        staged = staged.withColumn(f"_v_{name}", expr)
    position = F.struct(*order)
    summary = staged.groupBy(*keys, RUN).agg(*[
        F.min_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_s_{n}")
        for n in cols])
    later = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))) \
        .orderBy(RUN).rowsBetween(1, Window.unboundedFollowing)
    carried = _with_carry(
        staged, keys, summary,
        {f"_c_{n}": F.first(f"_s_{n}", ignorenulls=True).over(later) for n in cols},
        broadcast=not keys)
    frame = _run_window(keys, order).rowsBetween(1, Window.unboundedFollowing)
    for name in cols:
        inside = F.first(f"_v_{name}", ignorenulls=True).over(frame)
        carried = carried.withColumn(name, F.coalesce(inside, F.col(f"_c_{name}")))
    return carried.drop(*[f"_{p}_{n}" for n in cols for p in "vc"])


def scan_sum(runs: DataFrame, keys: Sequence[str], order: Sequence[str],
             cols: Mapping[str, Column]) -> DataFrame:
    """Running sum of each expression up to and including the row."""
    staged = runs
    for name, expr in cols.items():
        staged = staged.withColumn(f"_v_{name}", expr)
    summary = staged.groupBy(*keys, RUN).agg(*[
        F.sum(f"_v_{n}").alias(f"_s_{n}") for n in cols])
    carried = _with_carry(
        staged, keys, summary,
        {f"_c_{n}": F.sum(f"_s_{n}").over(_earlier_runs(keys)) for n in cols},
        broadcast=not keys)
    frame = _run_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    for name in cols:
        carried = carried.withColumn(
            name, F.coalesce(F.col(f"_c_{name}"), F.lit(0)) + F.sum(f"_v_{name}").over(frame))
    return carried.drop(*[f"_{p}_{n}" for n in cols for p in "vc"])


def scan_max(runs: DataFrame, keys: Sequence[str], order: Sequence[str],
             cols: Mapping[str, Column]) -> DataFrame:
    """Running maximum of each expression up to and including the row."""
    staged = runs
    for name, expr in cols.items():
        staged = staged.withColumn(f"_v_{name}", expr)
    summary = staged.groupBy(*keys, RUN).agg(*[
        F.max(f"_v_{n}").alias(f"_s_{n}") for n in cols])
    carried = _with_carry(
        staged, keys, summary,
        {f"_c_{n}": F.max(f"_s_{n}").over(_earlier_runs(keys)) for n in cols},
        broadcast=not keys)
    frame = _run_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    for name in cols:  # greatest() skips nulls
        carried = carried.withColumn(
            name, F.greatest(F.col(f"_c_{name}"), F.max(f"_v_{name}").over(frame)))
    return carried.drop(*[f"_{p}_{n}" for n in cols for p in "vc"])


def scan_index(runs: DataFrame, keys: Sequence[str], order: Sequence[str],
               name: str = "idx") -> DataFrame:
    """1-based position of the row within its key."""
    return scan_sum(runs, keys, order, {name: F.lit(1).cast("long")})


def count_until(times: DataFrame, probes: DataFrame, column: str, out: str = "n_until") -> DataFrame:
    """(column, out): how many distinct ``times`` are at or before each distinct probe."""
    marked = (times.select(column).withColumn("_hit", F.lit(1).cast("long"))
              .unionByName(probes.select(column).withColumn("_hit", F.lit(0).cast("long")))
              .where(F.col(column).isNotNull()).groupBy(column).agg(F.max("_hit").alias("_hit")))
    runs = sorted_runs(marked, [], [column])
    return scan_sum(runs, [], [column], {out: F.col("_hit")}).select(column, out)


def exact_quantiles(df: DataFrame, keys: Sequence[str],
                    wanted: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Exact linear-interpolated quantiles per key, without gathering a key in one task.

    ``wanted`` maps a column to {result name: quantile}. All columns are stacked and sorted in
    one pass; a quantile is then read off the two rows next to its position.
    """
    stacked = df.withColumn("_tie", F.monotonically_increasing_id()).select(
        *keys, "_tie", F.explode(F.array(*[
            F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_val")) for c in wanted])).alias("s"))
    rows = stacked.select(*keys, "s._col", "s._val", "_tie").where(F.col("_val").isNotNull())
    group, order = [*keys, "_col"], ["_val", "_tie"]
    ranked = scan_index(sorted_runs(rows, group, order), group, order, "_i")
    totals = ranked.groupBy(*group).agg(F.max("_i").alias("_n"))
    joined = ranked.join(totals, group)
    out = []
    for column, named in wanted.items():
        for name, q in named.items():
            at = (F.col("_n") - 1) * F.lit(float(q))
            low, share = F.floor(at) + 1, at - F.floor(at)
            part = (F.when(F.col("_i") == low, F.col("_val") * (1 - share))
                    .when(F.col("_i") == low + 1, F.col("_val") * share))
            out.append(F.sum(F.when(F.col("_col") == column, part)).alias(name))
    return joined.groupBy(*keys).agg(*out)
