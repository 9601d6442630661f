"""Text rule, validation and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossquote.functions import outcomes as oc, text as tx
from crossquote.functions.templates import MANY_OUTCOMES, RULES, add_template
from crossquote.operators import clusters
from crossquote.plans import validation as va
from workload.registry import listed, query, quoted
from workload.views import view, with_views

# Order-keeping distinct of a list expression in the oracle.
def _distinct(x):
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


_PUNCT = "regexp_replace(lower({x}), '[[:punct:]]', '', 'g')"
_CLEAN = "trim(regexp_replace(" + _PUNCT + ", '\\s+', ' ', 'g'))"
_ALIASES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in tx.ENTITY_ALIASES.items()) + "}"


def _norm(x):
    return f"coalesce({_ALIASES}[{_CLEAN.format(x=x)}], {_CLEAN.format(x=x)})"


_ANY = lambda col, pats: "(" + " OR ".join(
    "regexp_matches({}, '(?i){}')".format(col, p.replace("'", "''")) for p in pats) + ")"

_JURIS = "CASE " + " ".join(
    f"WHEN regexp_matches(full_text, '(?i){p}') THEN {_norm(f'regexp_extract(full_text, $${chr(40)}?i){p}$$)')}"
    for p in tx.JURISDICTION_PATTERNS) + " END"
_HINTS = _distinct("list_filter([" + ", ".join(
    f"lower(trim(nullif(regexp_extract(full_text, '(?i){p}', 1), '')))" for p in tx.RESOLUTION_PATTERNS) \
    + "], lambda h: h IS NOT NULL)")
_COMPARATORS = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(full_text, '(?i){p}') THEN '{s}' END" for s, p in tx.COMPARATOR_PATTERNS) \
    + "], lambda c: c IS NOT NULL)"

_MONTH = lambda names, dot: (
    "list_transform(regexp_extract_all({t}, '(?i)\\b(?:" + "|".join(names) + ")" + dot
    + "\\s+\\d{{1,2}},?\\s+\\d{{4}}\\b'), lambda m: concat(right(m, 4), '-', lpad(CAST(MAP {{"
    + ", ".join(f"'{n.lower()}': {i}" for i, n in enumerate(names, 1))
    + "}}[lower(regexp_extract(m, '^[A-Za-z]+'))] AS VARCHAR), 2, '0'), '-',"
    " lpad(regexp_extract(m, '(\\d{{1,2}}),?\\s+\\d{{4}}$', 1), 2, '0')))")


def _specific(t):
    checked = lambda pat, fmt: (
        f"list_filter(list_transform(regexp_extract_all({t}, '{pat}'), lambda m: strftime(try_strptime(m, '{fmt}'), '%Y-%m-%d')),"
        " lambda d: d IS NOT NULL)")
    return "list_concat(" + ", ".join([
        checked(r"\b\d{4}-\d{2}-\d{2}\b", "%Y-%m-%d"), checked(r"\b\d{1,2}/\d{1,2}/\d{4}\b", "%m/%d/%Y"),
        checked(r"\b\d{1,2}-\d{1,2}-\d{4}\b", "%m-%d-%Y"),
        _MONTH(tx.MONTHS, "").format(t=t), _MONTH(tx.MONTHS_SHORT, r"\.?").format(t=t),
        f"list_transform(regexp_extract_all({t}, '(?i)\\bQ[1-4]\\s+\\d{{4}}\\b'), lambda m: concat(right(m, 4), '-',"
        " lpad(CAST((CAST(substr(m, 2, 1) AS INT) - 1) * 3 + 1 AS VARCHAR), 2, '0'), '-01'))",
        f"list_transform(regexp_extract_all({t}, '(?i)\\bend of\\s+20\\d{{2}}\\b|\\bby\\s+end\\s+of\\s+20\\d{{2}}\\b'),"
        " lambda m: concat(right(m, 4), '-12-31'))",
        f"list_transform({_before(t)}, lambda y: concat(CAST(CAST(y AS INT) - 1 AS VARCHAR), '-12-31'))"]) + ")"


def _before(t):
    return (f"list_transform(regexp_extract_all({t}, '(?i)\\bbefore\\s+20\\d{{2}}\\b|\\bprior to\\s+20\\d{{2}}\\b'),"
            " lambda m: right(m, 4))")


_AMOUNT = (r"(?i)(?:above|below|over|under|at least|more than|less than|exceed|reach)\s*\$?\s*[\d,]+(?:\.\d+)?"
           r"\s*(?:(?:billion|million|thousand|percent)\b|%|(?:k|m|b)\b)?"
           r"|\$\s*[\d,]+(?:\.\d+)?\s*(?:(?:billion|million|thousand|percent)\b|%|(?:k|m|b)\b)?")

_TEMPLATE_COUNTS = ",\n".join(
    f"  (0 {''.join(chr(10) + '   + CAST(regexp_matches(folded, $$(?i)' + p + '$$) AS INT)' for p in pats)}) AS n{i}"
    for i, (_, _, pats) in enumerate(RULES))
_TEMPLATE_RANKED = "list_sort(list_filter([" + ", ".join(
    f"CASE WHEN n{i} > 0 THEN {{'s': -(CAST({b} AS DOUBLE) * (0.5 + 0.5 * (least(n{i}, 3) / CAST(3.0 AS DOUBLE)))), 'r': {i}, 't': '{t}'}} END"
    for i, (t, b, _) in enumerate(RULES)) + "], lambda s: s IS NOT NULL))"

# Feature rows per market of the view with descriptions.
FEATURES = f"""texts AS (SELECT *, concat_ws(' ', question, nullif(description, '')) AS full_text,
  lower(concat_ws(' ', question, nullif(description, ''))) AS folded,
  concat(question, ' ', description) AS short_text FROM v_rich),
dated AS (SELECT *, {_specific('full_text')} AS spec, {_before('full_text')} AS bef,
  regexp_extract_all(full_text, '\\b20\\d{{2}}\\b') AS years FROM texts),
covered AS (SELECT *, list_concat(list_transform(spec, lambda d: split_part(d, '-', 1)), bef) AS cov FROM dated),
alld AS (SELECT *, list_concat(spec, list_transform(list_filter(years, lambda y: NOT list_contains(cov, y)),
  lambda y: concat(y, '-01-01'))) AS d0 FROM covered),
ents AS (SELECT *, {_distinct('d0')} AS dates,
  list_filter(list_transform(list_filter(list_transform(list_concat(
    regexp_extract_all(full_text, '{tx.ENTITY_PATTERNS[0]}', 1), regexp_extract_all(full_text, '{tx.ENTITY_PATTERNS[1]}', 1),
    regexp_extract_all(full_text, '{tx.ENTITY_PATTERNS[2]}', 1), regexp_extract_all(full_text, '{tx.ENTITY_PATTERNS[3]}', 1)),
    lambda e: trim(e)), lambda e: length(e) > 1), lambda e: {_norm('e')}),
    lambda e: length(e) > 1 AND NOT list_contains([{quoted(tx.NON_ENTITY_FIRST_WORDS)}], split_part(e, ' ', 1))) AS e0,
  list_transform(regexp_extract_all(full_text, '{_AMOUNT}'), lambda m: {{'v': TRY_CAST(replace(regexp_extract(m, '[\\d,]+(?:\\.\\d+)?'), ',', '') AS DOUBLE),
    's': CAST(CASE WHEN regexp_matches(lower(m), '[0-9,]\\s*(billion|b)$') THEN 1e9 WHEN regexp_matches(lower(m), '[0-9,]\\s*(million|m)$') THEN 1e6
         WHEN regexp_matches(lower(m), '[0-9,]\\s*(thousand|k)$') THEN 1e3 ELSE 1 END AS DOUBLE)}}) AS t0
  FROM alld),
feats AS (SELECT *, {_distinct('e0')} AS entities,
  list_transform(list_filter(t0, lambda t: t.v IS NOT NULL AND NOT (t.v BETWEEN 1900 AND 2200 AND t.v = floor(t.v))), lambda t: t.v * t.s) AS thresholds,
  {_JURIS} AS jurisdiction, {_HINTS} AS hints, {_COMPARATORS} AS comparators,
  CASE WHEN {_ANY('question', tx.NEGATIVE_PATTERNS)} THEN 'negative' WHEN {_ANY('question', tx.POSITIVE_PATTERNS)} THEN 'positive' END AS polarity,
  list_distinct(regexp_extract_all(lower(question), '\\w+')) AS words, strftime(close_time, '%Y-%m-%d') AS last_date,
{_TEMPLATE_COUNTS} FROM ents),
ranked AS (SELECT *, {_TEMPLATE_RANKED} AS rk, entities[1] AS primary_entity, thresholds[1] AS t1,
  dates[len(dates)] AS window_end,
  {_ANY('lower(question)', va.NOMINATION_PATTERNS)} AS is_nom, {_ANY('lower(question)', va.GENERAL_PATTERNS)} AS is_gen FROM feats)"""


def rich_markets(spark, sf_dir):
    return va.canonical_markets(view(spark, sf_dir, "v_rich", spread=True))


def featured(spark, sf_dir):
    return va.market_features(rich_markets(spark, sf_dir))


@query("fold_text", """SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS folded_hash
FROM documents""")
def fold_text(spark, sf_dir):
    from workload.views import table
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.fold("text"), 256).alias("folded_hash"))


@query("chunks", """
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda x: x <> '') AS words FROM documents),
c AS (SELECT doc_id, text, words, unnest(range(0, CASE WHEN len(words) <= 256 THEN 1 ELSE CAST(ceil((len(words) - 256) / 206.0) AS BIGINT) + 1 END)) AS i FROM w WHERE text <> '')
SELECT doc_id, i AS chunk, CASE WHEN len(words) <= 256 THEN length(text) ELSE length(array_to_string(list_slice(words, i * 206 + 1, i * 206 + 256), ' ')) END AS n_chars FROM c""")
def chunks(spark, sf_dir):
    from workload.views import table
    docs = table(spark, sf_dir, "documents")
    pieces = docs.select("doc_id", F.posexplode(tx.chunk_words("text")).alias("chunk", "piece"))
    return pieces.select("doc_id", F.col("chunk").cast("long").alias("chunk"),
                         F.length("piece").cast("long").alias("n_chars"))


@query("date_features", with_views("v_rich", also=FEATURES) + """
SELECT market_id, array_to_string(dates, '|') AS dates, CASE WHEN len(dates) >= 2 THEN dates[1] END AS window_start,
       window_end FROM ranked""")
def date_features(spark, sf_dir):
    return view(spark, sf_dir, "v_rich", spread=True).select("market_id", tx.date_mentions(
        F.concat_ws(" ", "question", F.nullif(F.col("description"), F.lit("")))).alias("d")).select(
        "market_id", listed("d").alias("dates"), F.when(F.size("d") >= 2, F.get("d", F.lit(0))).alias("window_start"),
        F.get("d", F.size("d") - 1).alias("window_end"))


@query("threshold_features", with_views("v_rich", also=FEATURES) + """
SELECT market_id, CAST(len(thresholds) AS BIGINT) AS n, round(coalesce(list_sum(thresholds), 0), 2) AS total, round(t1, 2) AS first FROM ranked""")
def threshold_features(spark, sf_dir):
    rows = view(spark, sf_dir, "v_rich", spread=True).select("market_id", tx.thresholds(
        F.concat_ws(" ", "question", F.nullif(F.col("description"), F.lit("")))).alias("t"))
    return rows.select(
        "market_id", F.size("t").cast("long").alias("n"),
        F.round(F.aggregate("t", F.lit(0.0), lambda a, x: a + x), 2).alias("total"),
        F.round(F.get("t", F.lit(0)), 2).alias("first"))


@query("market_features", with_views("v_rich", also=FEATURES) + """
SELECT market_id, array_to_string(entities, '|') AS entities, array_to_string(comparators, '|') AS comparators,
       polarity, jurisdiction, array_to_string(hints, '|') AS hints, primary_entity, window_end, last_date FROM ranked""")
def market_features(spark, sf_dir):
    return featured(spark, sf_dir).select(
        F.col("market_id").cast("long").alias("market_id"), listed("entities").alias("entities"),
        listed("comparators").alias("comparators"), "polarity", "jurisdiction",
        listed("resolution_hints").alias("hints"), "primary_entity", "window_end", "last_date")


@query("templates", with_views("v_rich", also=FEATURES) + """
SELECT market_id, coalesce(rk[1].t, 'unknown') AS template, round(coalesce(-rk[1].s, 0.5), 6) AS confidence,
       CASE WHEN -rk[2].s >= 0.5 THEN rk[2].t END AS secondary FROM ranked""")
def templates(spark, sf_dir):
    rows = add_template(rich_markets(spark, sf_dir))
    return rows.select(F.col("market_id").cast("long").alias("market_id"), F.col("template.primary").alias("template"),
                       F.round("template.confidence", 6).alias("confidence"), F.col("template.secondary").alias("secondary"))


@query("outcome_count_template", """
SELECT o_orderpriority AS priority, CASE WHEN count(DISTINCT o_orderstatus) > 3 THEN 'multi_outcome_exhaustive' ELSE 'unknown' END AS template
FROM orders GROUP BY 1""")
def outcome_count_template(spark, sf_dir):
    from workload.views import table
    groups = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.collect_set("o_orderstatus").alias("outcomes"))
    rows = add_template(groups.withColumns({"question": F.lit("Outcome listing"), "description": F.lit("")}))
    return rows.select("priority", F.col("template.primary").alias("template"))


# ---------------------------------------------------------------- pairs of questions

_QPAIRS = FEATURES + """,
qp AS (SELECT a.market_id AS ma, b.market_id AS mb, a.platform AS pa, b.platform AS pb,
  0.7 + CAST(a.market_id % 30 AS DOUBLE) / 100.0 AS similarity
  FROM v_rich a JOIN v_rich b ON b.market_id = a.market_id + 8 AND a.platform <> b.platform
  UNION ALL SELECT a.market_id, b.market_id, a.platform, b.platform, 0.7 + CAST(a.market_id % 30 AS DOUBLE) / 100.0
  FROM v_rich a JOIN v_rich b ON b.market_id = a.market_id + 1 AND a.platform <> b.platform),
sides AS (SELECT qp.*, substr(sha256(concat(ma, '|', mb)), 1, 16) AS candidate_id, a AS a, b AS b
  FROM qp JOIN ranked a ON a.market_id = ma JOIN ranked b ON b.market_id = mb),
gaps AS (SELECT *, coalesce(a.primary_entity <> b.primary_entity AND length(a.primary_entity) > 2 AND length(b.primary_entity) > 2
    AND NOT contains(a.primary_entity, b.primary_entity) AND NOT contains(b.primary_entity, a.primary_entity), false) AS f_entity,
  abs(date_diff('day', TRY_CAST(a.window_end AS DATE), TRY_CAST(b.window_end AS DATE))) AS gap,
  coalesce(a.t1 > 0 AND b.t1 > 0 AND abs(a.t1 - b.t1) / greatest(a.t1, b.t1) > 0.05, false) AS f_threshold,
  (a.is_nom AND b.is_gen) OR (a.is_gen AND b.is_nom) AS f_stage FROM sides),
flagged AS (SELECT *, coalesce(gap > 45, false) AS f_date, f_entity OR coalesce(gap > 45, false) OR f_stage AS hard_reject,
  len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) AS text_score,
  greatest(0.0, 1.0 - abs(date_diff('day', CAST(a.last_date AS DATE), CAST(b.last_date AS DATE))) / 90.0) AS date_score FROM gaps),
scored AS (SELECT *, 0.5 * text_score + 0.3 * date_score + 0.2 AS rerank FROM flagged)"""
_QP = with_views("v_rich", also=_QPAIRS)


def question_pairs(spark, sf_dir):
    q = view(spark, sf_dir, "v_rich").select("market_id", "platform")
    pairs = None
    for step in (8, 1):
        other = q.select((F.col("market_id") - step).alias("market_id"), F.col("market_id").alias("mb"),
                         F.col("platform").alias("platform_b"))
        rows = q.join(other, "market_id").where(F.col("platform") != F.col("platform_b")).select(
            F.col("platform").alias("platform_a"), F.col("market_id").cast("string").alias("id_a"), "platform_b",
            F.col("mb").cast("string").alias("id_b"),
            (0.7 + (F.col("market_id") % 30).cast("double") / 100.0).alias("similarity"))
        pairs = rows if pairs is None else pairs.unionByName(rows)
    return pairs.withColumn("candidate_id", tx.pair_hash("id_a", "id_b"))


def checked_pairs(spark, sf_dir, *fields):
    sides = va.attach_sides(question_pairs(spark, sf_dir), featured(spark, sf_dir), va.CONTRADICTION_FIELDS, *fields)
    return va.contradictions(sides)


@query("negation_flags", _QP + """
SELECT candidate_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(a.words, b.words)), lambda w:
  list_contains(['not', 'no', 'never', 'fail', 'lose', 'without', 'against'], w) AND list_contains(a.words, w) <> list_contains(b.words, w))), '|') AS negation FROM sides""")
def negation_flags(spark, sf_dir):
    q = view(spark, sf_dir, "v_rich").select(F.col("market_id").cast("string").alias("id"), "question")
    rows = (question_pairs(spark, sf_dir).join(q.select(F.col("id").alias("id_a"), F.col("question").alias("qa")), "id_a")
            .join(q.select(F.col("id").alias("id_b"), F.col("question").alias("qb")), "id_b"))
    return rows.select("candidate_id", listed(tx.asymmetric_negation("qa", "qb")).alias("negation"))


@query("topic_words", with_views("v_rich") + f"""
SELECT market_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(concat(question, ' ', description)), '[a-z0-9]+')),
  lambda w: length(w) > 2 AND NOT list_contains([{quoted(tx.TOPIC_STOPWORDS)}], w))), '|') AS words FROM v_rich""")
def topic_words(spark, sf_dir):
    rows = view(spark, sf_dir, "v_rich", spread=True)
    return rows.select("market_id", listed(F.array_sort(tx.topic_words("question", "description"))).alias("words"))


@query("contradictions", _QP + """
SELECT candidate_id, f_entity, f_date, f_threshold, f_stage, hard_reject,
  CAST(greatest(CASE WHEN f_entity OR f_date THEN 0.85 ELSE 0 END, CASE WHEN f_stage THEN 0.92 ELSE 0 END) AS DOUBLE) AS confidence FROM flagged""")
def contradictions(spark, sf_dir):
    flag = lambda name: F.exists("flags", lambda f: f.startswith(name))
    return checked_pairs(spark, sf_dir).select(
        "candidate_id", flag("entity_mismatch").alias("f_entity"), flag("date_gap_exceeded").alias("f_date"),
        flag("threshold_mismatch").alias("f_threshold"), flag("nomination").alias("f_stage"), "hard_reject",
        F.col("contradiction_confidence").alias("confidence"))


@query("rerank", _QP + """
SELECT candidate_id, round(text_score, 6) AS text_overlap, round(date_score, 6) AS date_proximity, round(rerank, 6) AS score FROM scored""")
def rerank(spark, sf_dir):
    return va.rerank(checked_pairs(spark, sf_dir, va.RERANK_FIELDS)).select(
        "candidate_id", F.round("rerank.text_overlap", 6).alias("text_overlap"),
        F.round("rerank.date_proximity", 6).alias("date_proximity"), F.round("rerank.score", 6).alias("score"))


@query("verdict_no_judge", _QP + """
SELECT candidate_id, CASE WHEN f_entity OR f_date THEN 'REJECT' WHEN similarity >= 0.8 THEN 'ACCEPT' ELSE 'REJECT' END AS verdict,
       CAST(CASE WHEN NOT (f_entity OR f_date) AND similarity >= 0.8 THEN round(similarity, 4) ELSE 0 END AS DOUBLE) AS confidence FROM flagged""")
def verdict_no_judge(spark, sf_dir):
    return va.verdict_without_judge(checked_pairs(spark, sf_dir)).select("candidate_id", "verdict", "confidence")


@query("verdict_counts", _QP + """
SELECT CASE WHEN f_entity OR f_date THEN 'REJECT' WHEN similarity >= 0.8 THEN 'ACCEPT' ELSE 'REJECT' END AS verdict, count(*) AS n
FROM flagged GROUP BY 1""")
def verdict_counts(spark, sf_dir):
    return va.verdict_without_judge(checked_pairs(spark, sf_dir)).groupBy("verdict").agg(F.count("*").alias("n"))


# Numbers as the prompts write them: always with a fraction part.
_NUMBER = "CASE WHEN x = floor(x) THEN format('{:.1f}', x) ELSE CAST(x AS VARCHAR) END"


def _quoted_list(values):
    return f"concat('[', array_to_string(list_transform({values}, lambda v: concat('''', v, '''')), ', '), ']')"


def _side_text(s):
    thresholds = f"list_transform({s}.thresholds, lambda x: {_NUMBER})"
    return f"""concat('Platform: ', p{s}, chr(10), 'Question: ', {s}.question,
  CASE WHEN {s}.description <> '' THEN concat(chr(10), 'Description: ', {s}.description) ELSE '' END, chr(10), 'Outcomes: [''Yes'', ''No'']',
  chr(10), 'Template: ', coalesce({s}.rk[1].t, 'unknown'), format(' (conf {{:.2f}})', coalesce(-{s}.rk[1].s, 0.5)),
  chr(10), 'Primary entity: ', coalesce({s}.primary_entity, 'None'), chr(10), 'Dates: ', {_quoted_list(s + '.dates')},
  chr(10), 'Thresholds: [', array_to_string({thresholds}, ', '), ']')"""


_FLAG_TEXTS = f"""list_filter([
  CASE WHEN f_entity THEN concat('entity_mismatch: ''', a.primary_entity, ''' vs ''', b.primary_entity, ''' (confidence 0.85)') END,
  CASE WHEN f_date THEN concat('date_gap_exceeded: ', gap, ' days apart (threshold 45)') END,
  CASE WHEN f_threshold THEN concat('threshold_mismatch: ', list_transform([a.t1], lambda x: {_NUMBER})[1], ' vs ',
    list_transform([b.t1], lambda x: {_NUMBER})[1], ' (', format('{{:.1f}}', abs(a.t1 - b.t1) / greatest(a.t1, b.t1) * 100), '% difference)') END,
  CASE WHEN f_stage THEN 'nomination_vs_general_election_mismatch' END], lambda f: f IS NOT NULL)"""


@query("judge_prompts", _QP + f"""
SELECT candidate_id, sha256(concat('=== MARKET A ===', chr(10), {_side_text('a')}, chr(10), chr(10), '=== MARKET B ===', chr(10), {_side_text('b')},
  chr(10), chr(10), '=== SIGNALS ===', chr(10), 'Contradiction flags: ', {_quoted_list(_FLAG_TEXTS)},
  chr(10), 'Hard reject signal: False', chr(10), 'Reranker score: ', format('{{:.3f}}', rerank))) AS prompt_sha256
FROM scored WHERE NOT hard_reject""")
def judge_prompts(spark, sf_dir):
    """Whole prompts, compared by their hash."""
    prompts = va.judge_prompts(va.rerank(checked_pairs(spark, sf_dir, va.RERANK_FIELDS, va.PROMPT_FIELDS)))
    return prompts.select("candidate_id", F.sha2("prompt", 256).alias("prompt_sha256"))


# A table of judge replies derived from the pairs: readable, fenced, odd and broken ones.
_RELATION = "CASE ma % 7 WHEN 0 THEN 'Equivalent' WHEN 1 THEN 'complement' WHEN 2 THEN 'subset' WHEN 3 THEN 'unrelated' WHEN 4 THEN 'equivalent' WHEN 5 THEN 'sibling' ELSE 'complement' END"
_VERDICT = "CASE ma % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'REVIEW' WHEN 2 THEN 'perhaps' ELSE 'ACCEPT' END"
_CONF = "CAST(ma % 14 AS DOUBLE) / 10.0"
_REPLIES = f""",
replies AS (SELECT *, upper({_VERDICT}) AS v0, lower({_RELATION}) AS r0, {_CONF} AS c0, ma % 11 = 10 AS broken FROM scored),
judged AS (SELECT *, CASE WHEN broken THEN 'REVIEW' WHEN v0 IN ('ACCEPT', 'REJECT', 'REVIEW') THEN v0 ELSE 'REVIEW' END AS jv,
  CASE WHEN broken THEN 'unrelated' WHEN r0 IN ('equivalent', 'complement', 'subset', 'unrelated') THEN r0 ELSE 'unrelated' END AS jr,
  CASE WHEN broken THEN 0.0 ELSE least(1.0, c0) END AS jc FROM replies),
mapped AS (SELECT *, CASE jr WHEN 'equivalent' THEN 'direct' WHEN 'complement' THEN 'inverted' WHEN 'subset' THEN 'subset_mapping' ELSE 'unmappable' END AS mapping_type,
  CASE jr WHEN 'equivalent' THEN 'binary_pair' WHEN 'complement' THEN 'complement_basket' WHEN 'subset' THEN 'multi_leg_basket' ELSE 'not_arb' END AS structure,
  CASE WHEN jr IN ('equivalent', 'complement') THEN jc WHEN jr = 'subset' THEN jc * 0.7 ELSE 0.0 END AS mapping_confidence FROM judged)"""
_QJ = with_views("v_rich", also=_QPAIRS + _REPLIES)


def replies(spark, sf_dir):
    ma = F.col("id_a").cast("long")
    rows = question_pairs(spark, sf_dir).withColumn("ma", ma)
    body = F.concat(F.lit('{"verdict": "'), F.expr(_VERDICT), F.lit('", "relationship_type": "'), F.expr(_RELATION),
                    F.lit('", "confidence": '), F.expr(f"CAST({_CONF} AS STRING)"),
                    F.lit(', "reasoning": "read", "outcome_hints": {}}'))
    text = F.when(ma % 11 == 10, "not json").when(ma % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return rows.select("candidate_id", text.alias("response"))


def decisions(spark, sf_dir):
    pairs = va.rerank(checked_pairs(spark, sf_dir, va.RERANK_FIELDS, va.DECISION_FIELDS))
    return va.decide(pairs, va.judge_verdicts(replies(spark, sf_dir)))


@query("judge_verdicts", _QJ + "SELECT candidate_id, jv AS verdict, jr AS relationship, round(jc, 6) AS confidence FROM mapped")
def judge_verdicts(spark, sf_dir):
    return va.judge_verdicts(replies(spark, sf_dir)).select(
        "candidate_id", F.col("judge_verdict").alias("verdict"), F.col("judge_relationship").alias("relationship"),
        F.round("judge_confidence", 6).alias("confidence"))


@query("outcome_mapping", _QJ + """
SELECT candidate_id, mapping_type, structure, round(mapping_confidence, 6) AS mapping_confidence FROM mapped WHERE NOT hard_reject""")
def outcome_mapping(spark, sf_dir):
    return decisions(spark, sf_dir).where(F.col("outcome_mapping").isNotNull()).select(
        "candidate_id", F.col("outcome_mapping.mapping_type").alias("mapping_type"),
        F.col("basket.arb_structure").alias("structure"),
        F.round("outcome_mapping.confidence", 6).alias("mapping_confidence"))


@query("final_decisions", _QJ + """
SELECT candidate_id, CASE WHEN hard_reject THEN 'REJECT' WHEN jv = 'ACCEPT' AND structure = 'not_arb' THEN 'REJECT' ELSE jv END AS verdict,
       CAST(round(CASE WHEN hard_reject OR (jv = 'ACCEPT' AND structure = 'not_arb') OR jv = 'REJECT' THEN 0.0
         ELSE least(1.0, 0.3 * rerank + 0.6 * jc + 0.1) END, 6) AS DOUBLE) AS confidence FROM mapped""")
def final_decisions(spark, sf_dir):
    return decisions(spark, sf_dir).select("candidate_id", "verdict", F.round("confidence", 6).alias("confidence"))


@query("basket_legs", _QJ + """
SELECT candidate_id, oa AS outcome_a, CASE WHEN jr = 'equivalent' THEN oa WHEN oa = 'Yes' THEN 'No' ELSE 'Yes' END AS outcome_b,
  round(CASE WHEN oa = 'Yes' THEN a.price ELSE 1.0 - a.price END
   + CASE WHEN (jr = 'equivalent') = (oa = 'Yes') THEN b.price ELSE 1.0 - b.price END, 6) AS combined_price,
  CASE WHEN jr = 'complement' THEN 'complement' ELSE 'binary' END AS leg_type
FROM mapped, (SELECT unnest(['Yes', 'No']) AS oa) o WHERE NOT hard_reject AND jr IN ('equivalent', 'complement')""")
def basket_legs(spark, sf_dir):
    legs = va.leg_rows(decisions(spark, sf_dir))
    return legs.select("candidate_id", "outcome_a", "outcome_b",
                       F.round("combined_price", 6).alias("combined_price"), "leg_type")


@query("accepted_pairs", _QJ + """
SELECT candidate_id, jr AS relationship FROM mapped WHERE NOT hard_reject AND jv = 'ACCEPT' AND structure <> 'not_arb'""")
def accepted_pairs(spark, sf_dir):
    found = decisions(spark, sf_dir)
    return va.accepted(question_pairs(spark, sf_dir), found).select("candidate_id", "relationship")


@query("event_edges", _QJ + """
SELECT CAST(ma AS VARCHAR) AS id_a, CAST(mb AS VARCHAR) AS id_b, structure FROM mapped
WHERE NOT hard_reject AND jv = 'ACCEPT' AND structure IN ('binary_pair', 'complement_basket')""")
def event_edges(spark, sf_dir):
    edges = clusters.arb_baskets(clusters.edge_table(decisions(spark, sf_dir)))
    return edges.select("id_a", "id_b", F.col("arb_structure").alias("structure"))


_WALK = """nodes AS (SELECT id_a AS n FROM v_edge UNION SELECT id_b FROM v_edge),
links AS MATERIALIZED (SELECT id_a AS u, id_b AS v FROM v_edge UNION SELECT id_b, id_a FROM v_edge),
reach(n, r) USING KEY (n) AS (SELECT n, n FROM nodes
  UNION (SELECT links.v, min(reach.r) FROM reach JOIN links ON links.u = reach.n JOIN recurring.reach AS known ON known.n = links.v
         WHERE reach.r < known.r GROUP BY links.v))"""


@query("clusters", with_views("v_edge", also=_WALK) + "SELECT n AS node, r AS component FROM reach")
def cluster_nodes(spark, sf_dir):
    return clusters.connected_components(view(spark, sf_dir, "v_edge"))


@query("cluster_sizes", with_views("v_edge", also=_WALK)
       + "SELECT r AS component, count(*) AS members FROM reach GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return clusters.event_clusters(view(spark, sf_dir, "v_edge"))


@query("graph_counts", with_views("v_edge", also=_WALK) + """
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM v_edge) AS edges""")
def graph_counts(spark, sf_dir):
    return clusters.graph_counts(view(spark, sf_dir, "v_edge"))


@query("label_classes", """
SELECT DISTINCT p_type AS label, CASE WHEN regexp_matches(lower(p_type), 'yes|true|win|will|above|over|higher') THEN 'positive'
  WHEN regexp_matches(lower(p_type), 'no|false|lose|won''t|below|under|lower') THEN 'negative' ELSE 'unknown' END AS kind FROM part""")
def label_classes(spark, sf_dir):
    from workload.views import table
    labels = table(spark, sf_dir, "part").select(F.col("p_type").alias("label")).distinct()
    return labels.select("label", oc.label_class(F.col("label")).alias("kind"))
