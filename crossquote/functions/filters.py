"""Row predicates: metadata matching, close dates, platform names."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType


def metadata_matches(wanted: Mapping[str, object], types: Mapping[str, DataType]) -> Column:
    """AND of per-column conditions with scalar/list semantics on either side.

    list vs list: any shared value; scalar vs list (both ways): membership; scalar vs scalar:
    equality. A column that does not exist, or is null, only matches a wanted ``None``.
    """
    tests = []
    for name, value in wanted.items():
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        known = [v for v in values if v is not None]
        if name not in types:
            tests.append(F.lit(len(known) < len(values)))
            continue
        column = F.col(name)
        if isinstance(types[name], ArrayType):
            hit = F.arrays_overlap(column, F.array(*map(F.lit, known))) if known else F.lit(False)
        else:
            hit = column.isin(known) if known else F.lit(False)
        if len(known) < len(values):
            hit = hit | column.isNull()
        tests.append(F.coalesce(hit, F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def close_date(*candidates: Column) -> Column:
    """Date of the first non-empty candidate text or time; unreadable text gives null."""
    first = F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates])
    return F.try_to_timestamp(first).cast("date")


def closes_together(a: Column, b: Column, tolerance_days: int = 90) -> Column:
    """False only when both dates are known and further apart than the tolerance."""
    return F.coalesce(F.abs(F.datediff(a, b)) <= tolerance_days, F.lit(True))


# Known platforms in lookup order, the first one is the default.
PLATFORMS = ["polymarket", "kalshi", "manifold"]


def platform_name(raw: Column) -> Column:
    """Exact name, else the first platform contained in (or containing) it, else the default."""
    name = F.lower(F.trim(raw))
    return F.coalesce(
        F.when(name.isin(PLATFORMS), name),
        *[F.when(name.contains(p) | F.lit(p).contains(name), F.lit(p)) for p in PLATFORMS],
        F.lit(PLATFORMS[0]))
