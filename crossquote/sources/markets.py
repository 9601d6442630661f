"""Question and market tables: scans, document mapping, validation, balanced loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def with_vector(questions: DataFrame) -> DataFrame:
    return questions.where(F.col("vector").isNotNull())


def without_vector(questions: DataFrame) -> DataFrame:
    return questions.where(F.col("vector").isNull())


def split_valid(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) questions: non-empty id, text and market, price within [0, 1]."""
    filled = lambda n: F.coalesce(F.length(F.trim(F.col(n).cast("string"))), F.lit(0)) > 0
    ok = (filled("market_id") & filled("question") & filled("platform")
          & F.coalesce(F.col("price").between(0.0, 1.0), F.lit(False)))
    return questions.where(ok), questions.where(~ok)


def question_rows(documents: DataFrame, known: tuple[str, ...] = ("id", "text", "market", "price", "vector",
                                                                  "embedded_at", "created_at")) -> DataFrame:
    """Stored question documents as (id, text, market, price, metadata, vector)."""
    have = set(documents.columns)
    rest = [c for c in documents.columns if c not in known]
    meta = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    return documents.select(
        "id", "text", "market", F.coalesce(F.col("price").cast("double") if "price" in have else F.lit(None),
                                           F.lit(0.5)).alias("price"), meta.alias("metadata"),
        (F.col("vector") if "vector" in have else F.lit(None)).cast("array<float>").alias("vector"))


def market_rows(documents: DataFrame) -> DataFrame:
    """Market documents (platform, market_id, question, yes_price, no_price, end_date) as questions.

    A missing or zero Yes price means 0.5, a missing or zero No price its complement.
    """
    have = set(documents.columns)
    given = lambda n: F.nullif(F.col(n).cast("double"), F.lit(0.0)) if n in have else F.lit(None)
    yes = F.coalesce(given("yes_price"), F.lit(0.5))
    staged = documents.withColumn("_yes", yes).withColumn(
        "_no", F.coalesce(given("no_price"), F.round(1.0 - F.col("_yes"), 6)))
    end = F.nullif(F.col("end_date").cast("string"), F.lit("")) if "end_date" in have else F.lit(None)
    return staged.select(
        F.col("platform"), F.col("market_id").cast("string").alias("market_id"), "question",
        F.col("_yes").alias("price"), F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"),
        F.create_map(F.lit("Yes"), F.col("_yes"), F.lit("No"), F.col("_no")).alias("prices"),
        F.try_to_timestamp(end.cast("string")).alias("close_time"),
        *([F.col("vector")] if "vector" in have else []))


def platforms(markets: DataFrame) -> DataFrame:
    return markets.select("platform").distinct()


def first_per_group(df: DataFrame, group: str, order: list[Column], limit: int, salts: int = 64) -> DataFrame:
    """First ``limit`` rows per group; each salt keeps its own first rows before groups meet."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    near = Window.partitionBy(group, "_salt").orderBy(*order)
    far = Window.partitionBy(group).orderBy(*order)
    kept = salted.withColumn("_rn", F.row_number().over(near)).where(F.col("_rn") <= limit)
    return (kept.withColumn("_rn", F.row_number().over(far)).where(F.col("_rn") <= limit)
            .drop("_salt", "_rn"))


def balanced_load(markets: DataFrame, limit: int, keyword: str | None = None,
                  only: list[str] | None = None) -> DataFrame:
    """Up to ``limit`` rows per platform, embedded rows first, then by market id."""
    rows = markets
    if keyword:
        rows = rows.where(F.col("question").rlike("(?i)" + keyword))
    if only:
        rows = rows.where(F.col("platform").isin(only))
    embedded = F.col("vector").isNull() if "vector" in rows.columns else F.lit(True)
    return first_per_group(rows.withColumn("_late", embedded), "platform",
                           [F.col("_late"), F.col("market_id")], limit).drop("_late")


def questions_per_market(questions: DataFrame, column: str = "platform") -> DataFrame:
    return questions.groupBy(column).agg(F.count("*").alias("n"))


def rebuild_pairs(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, malformed) from the flat stored form, with structs a and b and defaults filled in."""
    have = set(stored.columns)
    col = lambda n, t, d=None: F.coalesce(
        F.col(n).cast(t) if n in have else F.lit(None).cast(t), F.lit(d).cast(t))

    def side(s: str) -> Column:
        price = col(f"price_{s}", "double", 0.5)
        return F.struct(
            F.col(f"market_{s}").alias("platform"), F.col(f"question_id_{s}").cast("string").alias("market_id"),
            col(f"text_{s}", "string", "").alias("question"), price.alias("price"),
            F.create_map(F.lit("Yes"), price, F.lit("No"), F.round(1.0 - price, 6)).alias("prices"),
            F.array(F.lit("Yes"), F.lit("No")).alias("outcomes"),
            F.try_to_timestamp(col(f"end_date_{s}", "string")).alias("close_time"))

    need = ["id", "market_a", "market_b", "question_id_a", "question_id_b"]
    ok = F.lit(True)
    for n in need:
        ok = ok & (F.col(n).isNotNull() if n in have else F.lit(False))
    pairs = stored.where(ok).select(
        F.col("id").alias("candidate_id"), side("a").alias("a"), side("b").alias("b"),
        col("similarity_score", "double", 0.7).alias("similarity"),
        col("has_potential_negation", "boolean", False).alias("has_negation"))
    return pairs, stored.where(~ok)
