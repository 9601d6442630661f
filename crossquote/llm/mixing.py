"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / weight, where u comes from a hash of its id and
the seed. Within a source documents stand in key order, which is a weighted draw without
replacement. A target of k and a bit times the source takes k complete epochs, then the documents
whose prefix sum stays inside the rest.

Only one place of that order has to be found for each source, so nothing is sorted as a whole:
the key range is cut into ``buckets``, their sums locate the bucket in which the budget
runs out, and only that bucket is sorted. A source with a third of all documents costs
a few thousand combined sums and one window over a few thousandths of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossquote.llm.substrings import stored
from crossquote.llm.words import WORD, documents, few
from crossquote.session import materialize

SEED = 17
BUCKETS = 4096
MOST_EPOCHS = 3
FEW_WEIGHTS = 2_000_000  # weights that are sent to all tasks, at most: 32 MB
CYCLE = 3  # source weights 1, 2, 3, 1, 2, 3, ...
#: Sampling weight of a document by its quality label.
GOOD, PLAIN, POOR = 4.0, 2.0, 1.0


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from quality labels; contradicting labels of a document count as the better one."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("best"))
    return best.select("doc_id", F.when(F.col("best") == 1, GOOD).when(F.col("best") == 0, POOR)
                       .otherwise(PLAIN).alias("weight"))


def _keyed(docs: DataFrame, weights: DataFrame, seed: int, buckets: int) -> DataFrame:
    """The documents with size, source key, sampling key and bucket under names of their own."""
    own = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"),
                      F.concat(F.when(F.col("source").isNull(), "~").otherwise("="),
                               F.coalesce(F.col("source"), F.lit(""))).alias("_source"),
                      word_count().alias("_size"))
    narrow = stored(weights.select(F.col("doc_id").alias("_wid"), F.col("weight").alias("_weight")))
    # with more weights than are sent to all tasks, the documents are shuffled with their texts
    weighted = own.join(few(narrow, FEW_WEIGHTS), F.col("_id") == F.col("_wid"), "left")
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")),
                                        F.lit(f":{seed}")).cast("binary")), 1, 12)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    key = -F.log(uniform) / F.coalesce(F.col("_weight"), F.lit(PLAIN))
    return (weighted.withColumn("_key", key)
            .withColumn("_bucket", F.floor(buckets * F.col("_key") / (1 + F.col("_key"))).cast("int"))
            .drop("_wid", "_weight"))


def source_targets(sizes: DataFrame, cycle: int = CYCLE, most: int = MOST_EPOCHS) -> DataFrame:
    """(_source, source_size, target) of a table with one row per source (_source, source_size).

    Sources in code point order, null last, weigh 1 to ``cycle`` in turn and share the total by
    weight. Filling is level: the level is the largest mean rest per weight over all prefixes
    of the sources in order of their cap per weight. The windows see one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    # "=" sorts before "~", so the null source comes last
    ranked = sizes.withColumn("_w", (F.row_number().over(every.orderBy("_source")) - 1) % cycle + 1)
    capped = ranked.withColumn("_cap", most * F.col("source_size"))
    order = every.orderBy(F.col("_cap") / F.col("_w"), "_source").rowsBetween(Window.unboundedPreceding, -1)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(order), F.lit(0))).cast("double")
    weight = (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(order), F.lit(0))).cast("double")
    levels = capped.withColumn("_level", rest / weight)
    return levels.withColumn("_level", F.max("_level").over(whole)).select(
        "_source", "source_size",
        F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_level")).alias("target"))


def source_plans(narrow: DataFrame) -> DataFrame:
    """Per source: size, target, complete epochs, and the place in key order where the rest ends.

    ``narrow`` has _source, _id, _size, _key, _bucket. The place is the struct (key, id, size) of
    the last document taken; ``_last`` words of it are taken. Equal rows share them.
    """
    sums = narrow.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words"))
    totals = source_targets(sums.groupBy("_source").agg(F.sum("_words").alias("source_size")))
    epochs = F.floor(F.try_divide("target", "source_size"))
    plans = totals.withColumn("_epochs", F.when(F.col("source_size") > 0, epochs).otherwise(0).cast("long")) \
        .withColumn("_rest", F.floor(F.col("target") - F.col("_epochs") * F.col("source_size") + 0.5).cast("long"))
    running = F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket"))
    ends = (sums.withColumn("_upto", running).join(plans.select("_source", "_rest"), "_source")
            .where((F.col("_upto") - F.col("_words") < F.col("_rest")) & (F.col("_rest") <= F.col("_upto")))
            .select("_source", "_bucket", "_rest", (F.col("_upto") - F.col("_words")).alias("_before")))
    near = (narrow.join(ends, ["_source", "_bucket"])
            .groupBy("_source", "_rest", "_before", F.struct("_key", "_id", "_size").alias("_place"))
            .agg(F.sum("_size").alias("_words"), F.count("*").alias("_equal")))
    inside = F.col("_before") + F.sum("_words").over(Window.partitionBy("_source").orderBy("_place"))
    last = (near.withColumn("_upto", inside)
            .where((F.col("_upto") - F.col("_words") < F.col("_rest")) & (F.col("_rest") <= F.col("_upto")))
            .select("_source", "_place", F.floor((F.col("_rest") - F.col("_upto") + F.col("_words"))
                                                 / F.col("_equal")).cast("long").alias("_last")))
    return plans.drop("_rest").join(last, "_source", "left")


def mix(docs: DataFrame, weights: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) of all documents.

    ``taken`` counts words: complete epochs, then the whole size of documents inside the rest of
    the budget, and part of the one where it ends, so that a source misses its target by
    less than a word (more only where equal rows share the end). Null sources are one source, a
    null or blank text has size 0, repeated rows are documents of their own.
    """
    narrow = materialize(_keyed(docs.select("doc_id", "source", "text"), weights, seed, buckets)
                         .select("_id", "_source", "_size", "_key", "_bucket"))
    place = F.struct("_key", "_id", "_size")
    more = (F.when(F.col("_place").isNull() | (place > F.col("_place")), 0)
            .when(place == F.col("_place"), F.col("_last")).otherwise(F.col("_size")))
    return narrow.join(few(stored(source_plans(narrow))), "_source").select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_epochs") * F.col("_size") + more).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The mix itself: whole documents, each as often as it is taken, with the columns of ``docs``.

    The document at which a budget ends is in if at least half of its words are. Texts are not
    shuffled: each row compares its own key with its source's plan. Blank documents
    have no words; they stay as often as the complete epochs say, once at least.
    """
    keyed = _keyed(docs, weights, seed, buckets)
    narrow = materialize(keyed.select("_id", "_source", "_size", "_key", "_bucket"))
    place = F.struct("_key", "_id", "_size")
    more = (F.when(F.col("_size") == 0, 0).when(F.col("_place").isNull() | (place > F.col("_place")), 0)
            .when(place == F.col("_place"), (2 * F.col("_last") >= F.col("_size")).cast("int")).otherwise(1))
    times = F.col("_epochs") + more
    times = F.when(F.col("_size") == 0, F.greatest(times, F.lit(1))).otherwise(times)
    taken = keyed.join(few(stored(source_plans(narrow))), "_source").withColumn("_times", times.cast("int"))
    return taken.where("_times > 0").select("_doc", F.explode(F.sequence(F.lit(1), "_times")).alias("_n")).select("_doc.*")


def op6_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE = f"""
WITH best AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source,
    CAST(coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST(concat('0x', substr(md5(concat(coalesce(CAST(d.doc_id AS VARCHAR), ''), ':{SEED}')), 1, 12)) AS BIGINT)
      + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
      / CASE b.q WHEN 1 THEN {GOOD}::DOUBLE WHEN 0 THEN {POOR}::DOUBLE ELSE {PLAIN}::DOUBLE END AS k
  FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id),
s AS (
  SELECT source, sum(size) AS source_size, {MOST_EPOCHS} * sum(size) AS cap,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {CYCLE} + 1 AS w FROM d GROUP BY source),
l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER o, 0) AS DOUBLE)
      / CAST((SELECT sum(w) FROM s) - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS lv
  FROM s WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
    least(CAST(cap AS DOUBLE), w * (SELECT max(lv) FROM l)) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size,
    CAST(floor(target - epochs * source_size + 0.5) AS BIGINT) - before)) AS BIGINT) AS taken
FROM p
"""
