"""Named queries with their oracle statements."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def half_up(sql: str) -> str:
    """Rounding as Spark does it: half up on the shortest decimal text of the double.

    DuckDB rounds doubles by scaling, which moves values that lie next to a tie.
    """
    out, at = [], 0
    for match in re.finditer(r"\bround\(", sql):
        if match.start() < at:
            continue
        depth, end, comma = 1, match.end(), -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            end += 1
        value, digits = half_up(sql[match.end():comma]), sql[comma + 1:end - 1].strip()
        out.append(sql[at:match.start()])
        out.append(f"CAST(round(CAST(CAST(CAST({value} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)")
        at = end
    return "".join(out) + sql[at:]


def query(name: str, oracle: str | None = None):
    """Register a query; without an oracle only its rows are checked."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = half_up(oracle)
        return fn
    return add


def quoted(values) -> str:
    """Texts as SQL literals, comma-separated."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def micros(ts) -> Column:
    """Times leave as epoch microseconds, which compare the same in every engine."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def listed(values) -> Column:
    """Arrays leave as text."""
    return F.concat_ws("|", values)
