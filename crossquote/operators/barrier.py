"""Keeping long expression chains from being repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame) -> DataFrame:
    """Same rows; filters added later are applied after the columns computed so far.

    The optimizer pushes a filter below projections by substituting their expressions. Over a
    long chain that repeats the chain many times and outgrows generated code. A generator that
    yields each row once stops the substitution and stays inside generated code.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
