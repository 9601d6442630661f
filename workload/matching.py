"""Vector, similarity and pairing queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crossquote.functions import filters, text as tx, vectors as vf
from crossquote.operators import neighbours, pairscores, simjoin
from crossquote.plans import serving
from crossquote.session import shared_dir
from crossquote.sources import markets, upserts
from workload.registry import query
from workload.views import table, view, with_views

THRESHOLD = 0.30  # the given vectors are nearly independent; 0.70 would return nothing
SWEEP = (0.20, 0.25, 0.30, 0.35, 0.40)

_DOT = "list_dot_product(CAST({a}.vector AS DOUBLE[]), CAST({b}.vector AS DOUBLE[]))"
_DOT_AB = _DOT.format(a="a", b="b")
_PAIRS = f"""pairs AS (
  SELECT a.platform AS platform_a, CAST(a.market_id AS VARCHAR) AS id_a,
         b.platform AS platform_b, CAST(b.market_id AS VARCHAR) AS id_b,
         {_DOT_AB} AS score, a.label = b.label AS is_match
  FROM v_vec a JOIN v_vec b ON a.platform < b.platform)"""


def pair_table(spark, sf_dir, threshold=THRESHOLD):
    return simjoin.similarity_pairs(view(spark, sf_dir, "v_vec"), threshold)


@query("candidate_pairs", with_views("v_vec", also=_PAIRS) + f"""
SELECT substr(sha256(concat(id_a, '|', id_b)), 1, 16) AS candidate_id, platform_a, id_a, platform_b, id_b,
       round(score, 6) AS similarity FROM pairs WHERE score >= {THRESHOLD}""")
def candidate_pairs(spark, sf_dir):
    return pair_table(spark, sf_dir).select(
        tx.pair_hash("id_a", "id_b").alias("candidate_id"), "platform_a", "id_a", "platform_b", "id_b",
        F.round("score", 6).alias("similarity"))


@query("candidate_pairs_dated", with_views("v_vec", "v_question", also=f"""dated AS (
  SELECT v.market_id, v.platform, v.vector, q.question, CAST(q.close_time AS DATE) AS close_date
  FROM v_vec v JOIN v_question q ON v.market_id = q.market_id),
toks AS (SELECT *, list_distinct(regexp_extract_all(lower(question), '\\w+')) AS w FROM dated)""") + f"""
SELECT a.platform AS platform_a, CAST(a.market_id AS VARCHAR) AS id_a, b.platform AS platform_b,
       CAST(b.market_id AS VARCHAR) AS id_b, round({_DOT_AB}, 6) AS similarity,
       list_contains(a.w, 'not') <> list_contains(b.w, 'not') AS has_negation
FROM toks a JOIN toks b ON a.platform < b.platform
WHERE {_DOT_AB} >= {THRESHOLD} AND abs(date_diff('day', a.close_date, b.close_date)) <= 400""")
def candidate_pairs_dated(spark, sf_dir):
    questions = view(spark, sf_dir, "v_question").select("market_id", "question", "close_time")
    # the negation words of a market's questions travel in its id, so that pairs need no join
    words = F.concat_ws(" ", tx.negation_words("question"))
    told = F.concat(F.col("market_id").cast("string"), F.lit("\x01"), F.array_join(F.col("told"), "\x02"))
    by_id = questions.join(view(spark, sf_dir, "v_vec").select("market_id"), "market_id", "left_semi").groupBy("market_id").agg(F.collect_list(
        F.when(F.col("question").isNull(), F.lit("\x03")).otherwise(words)).alias("told")).select("market_id", told.alias("key"))
    dated = view(spark, sf_dir, "v_vec").join(questions, "market_id").join(by_id, "market_id")
    close = filters.close_date(F.col("close_time"))
    pairs = simjoin.similarity_pairs(dated, THRESHOLD, id_col="key", close_day=close, max_gap_days=400)
    for s in "ab":
        part = lambda n: F.split_part(F.col(f"id_{s}"), F.lit("\x01"), F.lit(n))  # noqa: B023, E731
        pairs = pairs.withColumn(f"q{s}", F.explode(F.split(part(2), "\x02"))).withColumns(
            {f"id_{s}": part(1), f"q{s}": F.nullif(F.col(f"q{s}"), F.lit("\x03"))})
    return pairs.select("platform_a", "id_a", "platform_b", "id_b", F.round("score", 6).alias("similarity"),
                        (F.size(tx.asymmetric_negation("qa", "qb")) > 0).alias("has_negation"))


@query("two_list_pairs", with_views("v_vec", also=_PAIRS) + f"""
SELECT id_a, id_b, round(score, 6) AS similarity FROM pairs
WHERE platform_a = 'alpha' AND platform_b = 'beta' AND score >= {THRESHOLD}""")
def two_list_pairs(spark, sf_dir):
    v = view(spark, sf_dir, "v_vec")
    pairs = simjoin.two_list_pairs(v.where("platform = 'alpha'"), v.where("platform = 'beta'"), THRESHOLD)
    return pairs.select("id_a", "id_b", F.round("score", 6).alias("similarity"))


_COS = """greatest(0.0, least(1.0, list_dot_product(CAST(v.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[]))
 / (sqrt(list_dot_product(CAST(v.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[])))
  * sqrt(list_dot_product(CAST(q.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[]))))))"""


def _probe(spark, sf_dir):
    return [float(x) for x in view(spark, sf_dir, "v_vec").where("market_id = 0").first()["vector"]]


@query("knn_topk", with_views("v_vec") + f"""
SELECT v.market_id, round({_COS}, 6) AS score, row_number() OVER (ORDER BY {_COS} DESC, v.market_id) AS rank
FROM v_vec v, (SELECT vector FROM v_vec WHERE market_id = 0) q QUALIFY rank <= 10""")
def knn_topk(spark, sf_dir):
    best = neighbours.top_matches(view(spark, sf_dir, "v_vec"), _probe(spark, sf_dir), 10, id_col="market_id")
    return best.select("market_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("knn_filtered", with_views("v_vec") + f"""
SELECT v.market_id, v.platform, round({_COS}, 6) AS score,
       row_number() OVER (ORDER BY {_COS} DESC, v.market_id) AS rank
FROM v_vec v, (SELECT vector FROM v_vec WHERE market_id = 0) q
WHERE v.platform IN ('alpha', 'gamma') AND v.label = 3 QUALIFY rank <= 7""")
def knn_filtered(spark, sf_dir):
    corpus = view(spark, sf_dir, "v_vec")
    types = {f.name: f.dataType for f in corpus.schema}
    keep = filters.metadata_matches({"platform": ["alpha", "gamma"], "label": 3}, types)
    best = neighbours.top_matches(corpus, _probe(spark, sf_dir), 7, where=keep, id_col="market_id")
    return best.select("market_id", "platform", F.round("score", 6).alias("score"),
                       F.col("rank").cast("long").alias("rank"))


@query("knn_batch", with_views("v_vec") + f"""
SELECT CAST(q.market_id AS VARCHAR) AS query_id, CAST(v.market_id AS VARCHAR) AS id, round({_COS}, 6) AS score,
       row_number() OVER (PARTITION BY q.market_id ORDER BY round({_COS}, 12) DESC, CAST(v.market_id AS VARCHAR)) AS rank
FROM v_vec q JOIN v_vec v ON true QUALIFY rank <= 5""")
def knn_batch(spark, sf_dir):
    v = view(spark, sf_dir, "v_vec")
    found = neighbours.batch_matches(v, v, 5, id_col="market_id")
    return found.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vec_metrics", with_views("v_vec") + f"""
SELECT v.market_id, round({_COS}, 6) AS cosine, round({_DOT.format(a='v', b='q')}, 6) AS dot,
       round(sqrt(list_sum(list_transform(list_zip(CAST(v.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])),
             lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS euclidean
FROM v_vec v JOIN v_vec q ON q.market_id = v.market_id + 1""")
def vec_metrics(spark, sf_dir):
    v = view(spark, sf_dir, "v_vec")
    other = v.select((F.col("market_id") - 1).alias("market_id"), F.col("vector").alias("w"))
    return v.join(other, "market_id").select(
        "market_id", F.round(vf.cosine("vector", "w"), 6).alias("cosine"),
        F.round(vf.dot("vector", "w"), 6).alias("dot"), F.round(vf.euclidean("vector", "w"), 6).alias("euclidean"))


@query("vec_normalise", with_views("v_vec") + """
SELECT market_id, pos, round(x / sqrt(s), 6) AS x FROM (
  SELECT market_id, generate_subscripts(vector, 1) - 1 AS pos, unnest(CAST(vector AS DOUBLE[])) AS x,
         list_dot_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[])) AS s FROM v_vec) t""")
def vec_normalise(spark, sf_dir):
    unit = view(spark, sf_dir, "v_vec").select("market_id", F.posexplode(vf.l2_normalise("vector")).alias("pos", "x"))
    return unit.select("market_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


_TOKENS = """tok AS (SELECT market_id, unnest(regexp_extract_all(lower(question), '[a-zA-Z0-9_#+.\\-]+')) AS t
  FROM v_question),
hsh AS (SELECT market_id, CAST(concat('0x', substr(sha256(t), 1, 8)) AS BIGINT) % 128 AS slot,
  CASE WHEN CAST(concat('0x', substr(sha256(t), 9, 2)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END
    * (1.0 + length(t) / 20.0) AS w FROM tok),
slots AS (SELECT market_id, slot, CAST(sum(w) AS DOUBLE) AS raw FROM hsh GROUP BY 1, 2),
unit AS (SELECT market_id, slot, raw / sqrt(sum(raw * raw) OVER (PARTITION BY market_id)) AS weight FROM slots)"""


@query("hash_embedding", with_views("v_question", also=_TOKENS) + """
SELECT market_id, slot, round(coalesce(weight, 0), 6) AS weight FROM unit WHERE weight IS NULL OR weight = weight""")
def hash_embedding(spark, sf_dir):
    rows = vf.hash_embed_sparse(view(spark, sf_dir, "v_question", spread=True), "market_id", "question", 128)
    return rows.select("market_id", "slot", F.round("weight", 6).alias("weight"))


@query("text_query", with_views("v_question", also=_TOKENS + """,
asked AS (SELECT slot, weight FROM unit WHERE market_id = (SELECT min(market_id) FROM v_question WHERE question LIKE '%NBA%')),
found AS (SELECT q.market_id, greatest(0.0, least(1.0, coalesce((SELECT sum(u.weight * a.weight) FROM unit u JOIN asked a USING (slot) WHERE u.market_id = q.market_id), 0.0))) AS score
  FROM v_question q WHERE platform <> 'gamma')""") + """
SELECT CAST(market_id AS VARCHAR) AS id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, CAST(market_id AS VARCHAR)) AS rank
FROM found QUALIFY rank <= 25""")
def text_query(spark, sf_dir):
    """Texts are added to a collection, which embeds them, one namespace is cleared, and a text is asked for."""
    rows = view(spark, sf_dir, "v_question", spread=True)
    path = f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}"
    collection = upserts.VectorCollection(spark, path, buckets=8)
    texts = rows.select(F.col("platform").alias("namespace"), F.col("market_id").cast("string").alias("id"), F.col("question").alias("text"))
    collection.add_texts(texts, 128)
    collection.clear("gamma")
    text = rows.where("question LIKE '%NBA%'").agg(F.min_by("question", "market_id")).first()[0]
    best = neighbours.text_matches(collection.read(), text, 25, 128)
    return best.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("text_similarity", with_views("v_question", also=_TOKENS) + """
SELECT a.market_id, round(least(1.0, greatest(0.0, coalesce(
  (SELECT sum(x.weight * y.weight) FROM unit x JOIN unit y ON x.slot = y.slot
   WHERE x.market_id = a.market_id AND y.market_id = a.market_id + 8), 0.0))), 6) AS similarity
FROM v_question a WHERE EXISTS (SELECT 1 FROM v_question b WHERE b.market_id = a.market_id + 8)""")
def text_similarity(spark, sf_dir):
    rows = vf.hash_embed_dense(view(spark, sf_dir, "v_question", spread=True).select("market_id", "question"),
                               "market_id", "question", 128)
    other = rows.select((F.col("market_id") - 8).alias("market_id"), F.col("vector").alias("w"))
    return rows.join(other.hint("merge"), "market_id").select(  # vectors are larger than Spark takes them for
        "market_id", F.round(vf.cosine("vector", "w"), 6).alias("similarity"))


@query("score_distribution", with_views("v_vec", also=_PAIRS) + """
SELECT platform_a, platform_b, count(*) AS pairs, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score,
       CAST(count_if(score >= 0.25) AS BIGINT) AS at_least_25, CAST(count_if(score >= 0.30) AS BIGINT) AS at_least_30,
       CAST(count_if(score >= 0.35) AS BIGINT) AS at_least_35
FROM pairs WHERE score >= 0.2 GROUP BY 1, 2""")
def score_distribution(spark, sf_dir):
    pairs = pair_table(spark, sf_dir, 0.2).withColumnRenamed("score", "similarity")
    out = serving.score_distribution(pairs, (0.25, 0.30, 0.35), ["platform_a", "platform_b"])
    return out.withColumns({c: F.round(c, 6) for c in ("min_score", "max_score")})


# Labelled pairs: every order line names two vectors, by its part and by its supplier; its line number is the sector.
_MARKED = f"""sz AS (SELECT max(market_id) + 1 AS n FROM v_vec),
asked AS (SELECT l_linenumber AS sector, l_partkey % n AS va, l_suppkey * 7 % n AS vb FROM lineitem, sz),
marked AS (SELECT sector, {_DOT_AB} AS score, a.label = b.label AS is_match
  FROM asked JOIN v_vec a ON a.market_id = va JOIN v_vec b ON b.market_id = vb)"""
_SWEEP = _MARKED + f""",
sweep AS (SELECT threshold, count_if(score >= threshold AND is_match) AS tp,
  count_if(score >= threshold AND NOT is_match) AS fp, count_if(score < threshold AND is_match) AS fn
  FROM marked p, (SELECT unnest([{', '.join(map(str, SWEEP))}]) AS threshold) t GROUP BY 1),
rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM sweep),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM rates)"""


def _labelled(spark, sf_dir):
    """The labelled pair table, scored row by row: a match when the labels of the two vectors agree."""
    rows = view(spark, sf_dir, "v_vec").select("market_id", "label", "vector")
    count = rows.agg(F.max("market_id") + 1).first()[0] or 1
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("sector"), (F.col("l_partkey") % count).alias("a"),
                                                    (F.col("l_suppkey") * 7 % count).alias("b"))
    return pairscores.scored_pairs(asked, rows, "sector")


_BY_SECTOR = _SWEEP.replace("sweep AS (SELECT threshold,", "sweep AS (SELECT sector, threshold,").replace("GROUP BY 1)", "GROUP BY 1, 2)")


@query("sector_sweep", with_views("v_vec", also=_BY_SECTOR) + """
SELECT sector, CAST(threshold AS DOUBLE) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f""")
def sector_sweep(spark, sf_dir):
    out = serving.threshold_sweep(_labelled(spark, sf_dir), SWEEP, ["sector"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("best_sector_threshold", with_views("v_vec", also=_BY_SECTOR) + """
SELECT sector, CAST(threshold AS DOUBLE) AS best_threshold, round(f1, 6) AS best_f1 FROM f
QUALIFY row_number() OVER (PARTITION BY sector ORDER BY f1 DESC, threshold) = 1""")
def best_sector_threshold(spark, sf_dir):
    sweep = serving.threshold_sweep(_labelled(spark, sf_dir), SWEEP, ["sector"])
    return serving.best_threshold(sweep, ["sector"]).withColumn("best_f1", F.round("best_f1", 6))


@query("threshold_sweep", with_views("v_vec", also=_SWEEP) + """
SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f""")
def threshold_sweep(spark, sf_dir):
    out = serving.threshold_sweep(_labelled(spark, sf_dir), SWEEP)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("best_threshold", with_views("v_vec", also=_SWEEP) + """
SELECT CAST(threshold AS DOUBLE) AS best_threshold, round(f1, 6) AS best_f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1""")
def best_threshold(spark, sf_dir):
    sweep = serving.threshold_sweep(_labelled(spark, sf_dir), SWEEP)
    return serving.best_threshold(sweep).withColumn("best_f1", F.round("best_f1", 6))


@query("score_separation", with_views("v_vec", also=_MARKED) + """
SELECT round(coalesce(avg(score) FILTER (is_match), 0), 6) AS mean_match,
       round(coalesce(avg(score) FILTER (NOT is_match), 0), 6) AS mean_other,
       round(coalesce(avg(score) FILTER (is_match) - avg(score) FILTER (NOT is_match), 0), 6) AS separation
FROM marked""")
def score_separation(spark, sf_dir):
    out = serving.separation(_labelled(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("pair_membership", with_views("v_vec", also=_PAIRS + f""",
ids AS (SELECT platform_a AS platform, id_a AS id FROM pairs WHERE score >= {THRESHOLD}
  UNION ALL SELECT platform_b, id_b FROM pairs WHERE score >= {THRESHOLD})""") + """
SELECT v.platform, CAST(v.market_id AS VARCHAR) AS market_id, count(i.id) AS candidates
FROM v_vec v LEFT JOIN ids i ON v.platform = i.platform AND CAST(v.market_id AS VARCHAR) = i.id GROUP BY 1, 2""")
def pair_membership(spark, sf_dir):
    rows = view(spark, sf_dir, "v_vec").select("platform", F.col("market_id").cast("string").alias("market_id"))
    return serving.pair_membership(rows, pair_table(spark, sf_dir))


@query("questions_per_platform", with_views("v_question") + "SELECT platform, count(*) AS n FROM v_question GROUP BY 1")
def questions_per_platform(spark, sf_dir):
    return markets.questions_per_market(view(spark, sf_dir, "v_question"))


@query("platforms", with_views("v_question") + "SELECT DISTINCT platform FROM v_question")
def platforms(spark, sf_dir):
    return markets.platforms(view(spark, sf_dir, "v_question"))


_EMBEDDED = """loaded AS (SELECT q.platform, q.market_id, q.question, v.vector IS NULL AS late
  FROM v_question q LEFT JOIN v_vec v ON v.market_id = q.market_id)"""


@query("balanced_load", with_views("v_question", "v_vec", also=_EMBEDDED) + """
SELECT platform, market_id, late FROM loaded WHERE regexp_matches(question, '(?i)bitcoin|biden')
QUALIFY row_number() OVER (PARTITION BY platform ORDER BY late, market_id) <= 120""")
def balanced_load(spark, sf_dir):
    vectors = view(spark, sf_dir, "v_vec").select("market_id", "vector")
    rows = view(spark, sf_dir, "v_question").join(vectors, "market_id", "left")
    loaded = markets.balanced_load(rows, 120, "bitcoin|biden")
    return loaded.select("platform", "market_id", F.col("vector").isNull().alias("late"))


@query("embedded_split", with_views("v_question", "v_vec", also=_EMBEDDED) + """
SELECT CASE WHEN late THEN 'new' ELSE 'embedded' END AS kind, count(*) AS n FROM loaded GROUP BY 1""")
def embedded_split(spark, sf_dir):
    vectors = view(spark, sf_dir, "v_vec").select("market_id", "vector")
    rows = view(spark, sf_dir, "v_question").join(vectors, "market_id", "left")
    kinds = markets.with_vector(rows).select(F.lit("embedded").alias("kind")).unionByName(
        markets.without_vector(rows).select(F.lit("new").alias("kind")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"))


@query("question_checks", with_views("v_question", also="""raw AS (
  SELECT CASE WHEN market_id % 50 = 0 THEN '' ELSE CAST(market_id AS VARCHAR) END AS market_id, platform,
         CASE WHEN market_id % 70 = 0 THEN '  ' ELSE question END AS question,
         CASE WHEN market_id % 90 = 0 THEN 1.5 ELSE price END AS price FROM v_question)""") + """
SELECT market_id <> '' AND trim(question) <> '' AND price BETWEEN 0 AND 1 AS valid, count(*) AS n FROM raw GROUP BY 1""")
def question_checks(spark, sf_dir):
    q = view(spark, sf_dir, "v_question")
    bad = lambda k, v, c: F.when(F.col("market_id") % k == 0, v).otherwise(c)
    raw = q.select(bad(50, F.lit(""), F.col("market_id").cast("string")).alias("market_id"), "platform",
                   bad(70, F.lit("  "), F.col("question")).alias("question"),
                   bad(90, F.lit(1.5), F.col("price")).alias("price"))
    good, rejected = markets.split_valid(raw)
    both = good.select(F.lit(True).alias("valid")).unionByName(rejected.select(F.lit(False).alias("valid")))
    return both.groupBy("valid").agg(F.count("*").alias("n"))


@query("market_documents", with_views("v_question") + """
SELECT platform, CAST(market_id AS VARCHAR) AS market_id, CASE WHEN price = 0 THEN 0.5 ELSE price END AS yes,
       round(1.0 - CASE WHEN price = 0 THEN 0.5 ELSE price END, 6) AS no, epoch_us(close_time) AS close_us
FROM v_question""")
def market_documents(spark, sf_dir):
    docs = view(spark, sf_dir, "v_question").select(
        "platform", "market_id", "question", F.col("price").alias("yes_price"),
        F.col("close_time").cast("string").alias("end_date"))
    rows = markets.market_rows(docs)
    return rows.select("platform", "market_id", F.col("prices")["Yes"].alias("yes"),
                       F.col("prices")["No"].alias("no"), F.unix_micros("close_time").alias("close_us"))


@query("stored_pairs", with_views("v_vec", also=_PAIRS) + f"""
SELECT substr(sha256(concat(id_a, '|', id_b)), 1, 16) AS candidate_id, platform_a, id_a, platform_b, id_b,
       CAST(0.5 AS DOUBLE) AS yes_a, round(score, 4) AS similarity FROM pairs WHERE score >= {THRESHOLD}""")
def stored_pairs(spark, sf_dir):
    flat = pair_table(spark, sf_dir).select(
        tx.pair_hash("id_a", "id_b").alias("id"), F.col("platform_a").alias("market_a"),
        F.col("id_a").alias("question_id_a"), F.col("platform_b").alias("market_b"),
        F.col("id_b").alias("question_id_b"), F.round("score", 4).alias("similarity_score"))
    pairs, _ = markets.rebuild_pairs(flat)
    return pairs.select(
        "candidate_id", F.col("a.platform").alias("platform_a"), F.col("a.market_id").alias("id_a"),
        F.col("b.platform").alias("platform_b"), F.col("b.market_id").alias("id_b"),
        F.col("a.prices")["Yes"].alias("yes_a"), "similarity")


@query("upsert_latest", with_views("v_replay") + """
SELECT market_id, max(seq) AS seq, arg_max(ask_yes, seq) AS ask_yes FROM v_replay GROUP BY 1""")
def upsert_latest(spark, sf_dir):
    rows = view(spark, sf_dir, "v_replay").select("market_id", "seq", "ask_yes")
    half = F.col("seq") % 2 == 0
    old = upserts.merge_latest(None, rows.where(half), ["market_id"], "seq")
    # replaying the whole table over it is idempotent and leaves the newest row per key
    return upserts.merge_latest(old, rows, ["market_id"], "seq")


@query("delete_keys", with_views("v_vec") + """
SELECT platform, count(*) AS n FROM v_vec WHERE label <> 5 GROUP BY 1""")
def delete_keys(spark, sf_dir):
    v = view(spark, sf_dir, "v_vec")
    return upserts.namespace_counts(upserts.remove_keys(
        v, v.where("label = 5"), ["market_id"]).withColumnRenamed("platform", "namespace")) \
        .withColumnRenamed("namespace", "platform")


@query("deleted_count", with_views("v_vec") + "SELECT count(*) AS deleted FROM v_vec WHERE label = 5")
def deleted_count(spark, sf_dir):
    v = view(spark, sf_dir, "v_vec")
    return upserts.deleted_count(v, v.where("label = 5"), ["market_id"])


@query("vector_writeback", with_views("v_question", "v_vec") + """
SELECT q.platform, count(*) AS questions, count(v.vector) AS with_vector
FROM v_question q LEFT JOIN v_vec v ON q.market_id = v.market_id AND v.label < 5 GROUP BY 1""")
def vector_writeback(spark, sf_dir):
    rows = view(spark, sf_dir, "v_question").withColumn("vector", F.lit(None).cast("array<float>"))
    fresh = view(spark, sf_dir, "v_vec").where("label < 5").select("market_id", "vector")
    updated = upserts.update_vectors(rows, fresh)
    return updated.groupBy("platform").agg(F.count("*").alias("questions"), F.count("vector").alias("with_vector"))


@query("top_candidates", with_views("v_vec", also=_PAIRS) + f"""
SELECT substr(sha256(concat(id_a, '|', id_b)), 1, 16) AS candidate_id, round(score, 6) AS similarity
FROM pairs WHERE score >= {THRESHOLD} ORDER BY score DESC, candidate_id LIMIT 50""")
def top_candidates(spark, sf_dir):
    pairs = pair_table(spark, sf_dir).select(
        tx.pair_hash("id_a", "id_b").alias("candidate_id"), F.col("score").alias("similarity"))
    return serving.top_candidates(pairs, THRESHOLD, limit=50).select("candidate_id", F.round("similarity", 6).alias("similarity"))


