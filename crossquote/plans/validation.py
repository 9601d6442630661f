"""Pair validation: features per market, contradictions, rerank score, verdicts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossquote.functions import outcomes as oc
from crossquote.functions import text as tx
from crossquote.functions.templates import add_template
from crossquote.operators.barrier import compute_once
from crossquote.session import materialize

# ---------------------------------------------------------------- fixed values
DATE_TOLERANCE_DAYS = 45
THRESHOLD_TOLERANCE = 0.05
ENTITY_CONFIDENCE = 0.85
TEMPLATE_CONFIDENCE = 0.9
DATE_CONFIDENCE = 0.85
NOMINATION_CONFIDENCE = 0.92
TEMPLATE_MIN_CONFIDENCE = 0.8
INCOMPATIBLE_TEMPLATES = [("binary_winner", "multi_outcome_exhaustive"),
                          ("range_bucket_market", "binary_winner")]
NOMINATION_PATTERNS = [r"\bnomination\b", r"\bnominee\b", r"\bprimary\b", r"\bcaucus\b"]
GENERAL_PATTERNS = [r"\bgeneral election\b", r"\bpresidential election\b", r"\bnational election\b"]
RERANK_WEIGHTS = {"text": 0.5, "date": 0.3, "outcome": 0.2}
RERANK_DATE_SPAN = 90.0
CONFIDENCE_WEIGHTS = {"rerank": 0.3, "judge": 0.6, "no_contradiction": 0.1}
STRUCTURAL_FLAGS = ["entity_mismatch", "incompatible_templates", "date_gap_exceeded"]
# ----------------------------------------------------------- end of fixed values

MARKET_COLUMNS = {
    "platform": "string", "market_id": "string", "question": "string", "description": "string",
    "outcomes": "array<string>", "prices": "map<string,double>", "close_time": "timestamp",
    "resolution_rules": "string",
}


def canonical_markets(questions: DataFrame) -> DataFrame:
    """Questions (platform, market_id, question, price, ...) as full market rows.

    Missing outcomes mean Yes/No; missing prices are filled for binary markets only.
    """
    have = set(questions.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None)
    given = col("outcomes").cast("array<string>")
    labels = F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(
        F.array(F.lit("Yes"), F.lit("No")))
    price = col("price").cast("double")
    binary = F.map_from_entries(F.array(
        F.struct(F.get(F.col("outcomes"), F.lit(0)), price),
        F.struct(F.get(F.col("outcomes"), F.lit(1)), F.lit(1.0) - price)))
    typed = questions.withColumn("outcomes", labels)
    prices = F.coalesce(col("prices").cast("map<string,double>"),
                        F.when(F.size("outcomes") == 2, binary),
                        F.create_map().cast("map<string,double>"))
    staged = typed.withColumn("prices", prices)
    return staged.select(*[
        (F.col(n) if n in ("outcomes", "prices") or n in have else F.lit(None)).cast(t).alias(n)
        for n, t in MARKET_COLUMNS.items()])


def market_features(markets: DataFrame) -> DataFrame:
    """Adds extracted text features, template and date list, once per market."""
    full = F.concat_ws(" ", "question", F.nullif(F.col("description"), F.lit("")),
                       F.nullif(F.col("resolution_rules"), F.lit("")))
    short = F.concat_ws(" ", F.col("question"), F.coalesce("description", F.lit("")))
    staged = markets.select("*", full.alias("_full"), short.alias("_short")).withColumn("_plain_full", tx.plain_lower("_full"))
    plain = F.col("_plain_full")
    staged = staged.withColumn("_parts", tx.date_parts("_full", plain))
    dated = add_template(staged).select(
        "*", tx.entities("_full", plain=plain).alias("entities"), tx.dates_of("_full", F.col("_parts")).alias("dates"),
        tx.thresholds("_full", plain).alias("thresholds"), tx.comparators("_full", plain).alias("comparators"),
        tx.polarity("question").alias("polarity"), tx.jurisdiction("_full", plain).alias("jurisdiction"),
        tx.resolution_hints("_full", plain).alias("resolution_hints"),
        tx.fold("question").alias("normalised_question"), tx.word_set("question").alias("words"),
        F.coalesce(F.date_format("close_time", "yyyy-MM-dd"),
                   F.get(F.reverse(tx.date_mentions("_short")), F.lit(0))).alias("last_date"))
    n = F.size("dates")
    folded = tx.plain_lower("normalised_question")
    return dated.drop("_full", "_short", "_plain_full", "_parts").withColumns({
        "primary_entity": F.get("entities", F.lit(0)),
        "window_start": F.when(n >= 2, F.get("dates", F.lit(0))),
        "window_end": F.when(n >= 1, F.get("dates", n - 1)),
        "is_nomination": tx.has_any("normalised_question", NOMINATION_PATTERNS, folded),
        "is_general": tx.has_any("normalised_question", GENERAL_PATTERNS, folded),
    })


# What each step reads of a side; pass the union of those that follow to ``attach_sides``.
CONTRADICTION_FIELDS = ("primary_entity", "template", "window_end", "thresholds", "is_nomination", "is_general")
RERANK_FIELDS = ("words", "last_date", "outcomes")
DECISION_FIELDS = ("platform", "market_id", "outcomes", "prices")
PROMPT_FIELDS = ("platform", "question", "description", "outcomes", "resolution_rules", "template", "primary_entity", "dates", "thresholds")


def attach_sides(pairs: DataFrame, markets: DataFrame, *fields: tuple[str, ...]) -> DataFrame:
    """Pairs (candidate_id, platform_a, id_a, platform_b, id_b, similarity, ...) with structs a, b of the given fields (all without any).

    Only these fields are computed, once per market, and written; the narrow table is then joined once per side. A market that
    very many pairs share is split by the adaptive skew join.
    """
    names = list(dict.fromkeys(f for group in fields for f in group))
    # of a template, named steps read these two
    narrow = {"template": F.struct("template.primary", "template.confidence").alias("template")}
    side = F.struct(*[narrow.get(f, F.col(f)) for f in names]) if names else F.struct(*markets.columns)
    packed = materialize(markets.select(F.col("platform").alias("_p"), F.col("market_id").alias("_m"), side.alias("_s")))
    out = pairs
    for side in "ab":
        named = packed.select(F.col("_p").alias(f"platform_{side}"), F.col("_m").alias(f"id_{side}"),
                              F.col("_s").alias(side))
        out = out.join(named, [f"platform_{side}", f"id_{side}"])
    return out


def contradictions(pairs: DataFrame) -> DataFrame:
    """Adds ``flags``, ``hard_reject`` and ``contradiction_confidence``."""
    a, b = F.col("a"), F.col("b")
    ea, eb = a["primary_entity"], b["primary_entity"]
    entity = ((ea != eb) & (F.length(ea) > 2) & (F.length(eb) > 2)
              & ~eb.contains(ea) & ~ea.contains(eb))
    ta, tb = a["template"], b["template"]
    clash = reduce(lambda x, y: x | y, [
        ((ta["primary"] == p) & (tb["primary"] == q)) | ((ta["primary"] == q) & (tb["primary"] == p))
        for p, q in INCOMPATIBLE_TEMPLATES])
    template = (clash & (ta["confidence"] >= TEMPLATE_MIN_CONFIDENCE)
                & (tb["confidence"] >= TEMPLATE_MIN_CONFIDENCE))
    gap = tx.day_gap(a["window_end"], b["window_end"])
    date = gap > DATE_TOLERANCE_DAYS
    xa, xb = F.get(a["thresholds"], F.lit(0)), F.get(b["thresholds"], F.lit(0))
    ratio = F.try_divide(F.abs(xa - xb), F.greatest(xa, xb))
    threshold = (xa > 0) & (xb > 0) & (ratio > THRESHOLD_TOLERANCE)
    stage = (a["is_nomination"] & b["is_general"]) | (a["is_general"] & b["is_nomination"])

    flags = F.array(
        F.when(entity, F.concat(F.lit("entity_mismatch: '"), ea, F.lit("' vs '"), eb,
                                F.lit(f"' (confidence {ENTITY_CONFIDENCE:.2f})"))),
        F.when(template, F.concat(F.lit("incompatible_templates: "), ta["primary"], F.lit(" vs "),
                                  tb["primary"])),
        F.when(date, F.concat(F.lit("date_gap_exceeded: "), gap.cast("string"),
                              F.lit(f" days apart (threshold {DATE_TOLERANCE_DAYS})"))),
        F.when(threshold, F.concat(F.lit("threshold_mismatch: "), tx.plain_number(xa), F.lit(" vs "),
                                   tx.plain_number(xb), F.lit(" ("),
                                   F.format_string("%.1f", ratio * 100), F.lit("% difference)"))),
        F.when(stage, F.lit("nomination_vs_general_election_mismatch")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    hard = yes(entity) | yes(template) | yes(date) | yes(stage)
    confidence = F.greatest(
        F.when(yes(entity), ENTITY_CONFIDENCE).otherwise(0.0),
        F.when(yes(template), TEMPLATE_CONFIDENCE).otherwise(0.0),
        F.when(yes(date), DATE_CONFIDENCE).otherwise(0.0),
        F.when(yes(stage), NOMINATION_CONFIDENCE).otherwise(0.0))
    return compute_once(pairs.withColumns({
        "flags": F.filter(flags, lambda f: f.isNotNull()),
        "hard_reject": hard, "contradiction_confidence": confidence}))


def overlap_score(a: Column, b: Column) -> Column:
    """struct(score, text_overlap, date_proximity, outcome_overlap) of two market structs."""
    text = tx.jaccard(a["words"], b["words"])
    gap = tx.day_gap(a["last_date"], b["last_date"])
    date = F.when(gap.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - gap / RERANK_DATE_SPAN)).otherwise(0.5)
    outcome = oc.label_overlap(a["outcomes"], b["outcomes"])
    w = RERANK_WEIGHTS
    total = w["text"] * text + w["date"] * date + w["outcome"] * outcome
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("score"),
                    text.alias("text_overlap"), date.alias("date_proximity"),
                    outcome.alias("outcome_overlap"))


# A reranker is a function of two market structs; register more under other names.
RERANKERS: dict[str, Callable[[Column, Column], Column]] = {"overlap": overlap_score}


def rerank(pairs: DataFrame, kind: str = "overlap") -> DataFrame:
    scorer = RERANKERS.get(kind, overlap_score)
    return pairs.withColumn("rerank", scorer(F.col("a"), F.col("b")))


def verdict_without_judge(pairs: DataFrame, min_similarity: float = 0.80) -> DataFrame:
    """Structural contradiction rejects; otherwise similarity decides."""
    structural = F.filter("flags", lambda f: reduce(
        lambda x, y: x | y, [f.contains(k) for k in STRUCTURAL_FLAGS]))
    accept = F.col("similarity") >= min_similarity
    shown = F.format_string("%.3f", F.col("similarity"))
    return pairs.withColumn("_bad", structural).withColumns({
        "verdict": F.when(F.size("_bad") > 0, "REJECT").when(accept, "ACCEPT")
        .when(F.col("similarity").isNull(), "REVIEW").otherwise("REJECT"),
        "reason": F.when(F.size("_bad") > 0, F.concat(F.lit("structural: "), F.concat_ws("; ", "_bad")))
        .otherwise(F.concat(F.lit("similarity "), shown, F.when(accept, F.lit(" >= ")).otherwise(F.lit(" < ")),
                            F.lit(str(min_similarity)))),
        "confidence": F.when((F.size("_bad") == 0) & accept, F.round("similarity", 4)).otherwise(0.0),
        "relationship": F.when((F.size("_bad") == 0) & accept, "equivalent").otherwise("unrelated"),
    }).drop("_bad")


# ---------------------------------------------------------------- judge tables

def _listing(values: Column) -> Column:
    """['x', 'y'] text of a string array."""
    quoted = F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    return F.concat(F.lit("["), F.concat_ws(", ", quoted), F.lit("]"))


def judge_prompts(pairs: DataFrame, description_chars: int | None = None, rules_chars: int | None = None) -> DataFrame:
    """Prompt text per surviving pair: the input table of any batch-inference job.

    Descriptions and resolution rules are whole unless a length is given.
    """
    head = lambda c, n: c if n is None else F.left(c, F.lit(n))

    def part(side: str):
        m = F.col(side)
        line = lambda label, value: F.concat(F.lit(label + ": "), value)
        filled = lambda c: F.nullif(c, F.lit(""))
        return [
            F.lit(f"=== MARKET {side.upper()} ==="), line("Platform", m["platform"]),
            line("Question", m["question"]),
            line("Description", head(filled(m["description"]), description_chars)),
            line("Outcomes", _listing(m["outcomes"])),
            line("Resolution", head(filled(m["resolution_rules"]), rules_chars)),
            F.concat(F.lit("Template: "), m["template"]["primary"],
                     F.format_string(" (conf %.2f)", m["template"]["confidence"])),
            line("Primary entity", F.coalesce(m["primary_entity"], F.lit("None"))),
            line("Dates", _listing(m["dates"])),
            F.concat(F.lit("Thresholds: ["), F.concat_ws(
                ", ", F.transform(m["thresholds"], tx.plain_number)), F.lit("]")),
        ]

    signals = [
        F.lit("\n=== SIGNALS ==="),
        F.concat(F.lit("Contradiction flags: "), _listing(F.col("flags"))),
        F.concat(F.lit("Hard reject signal: "), F.when(F.col("hard_reject"), "True").otherwise("False")),
        F.concat(F.lit("Reranker score: "), F.format_string("%.3f", F.col("rerank.score")))]
    b = part("b")
    b[0] = F.lit("\n=== MARKET B ===")
    return (pairs.where(~F.col("hard_reject"))
            .select("candidate_id", F.concat_ws("\n", *part("a"), *b, *signals).alias("prompt")))


_REPLY = ("verdict string, relationship_type string, confidence string, reasoning string, "
          "outcome_hints map<string,string>")


def judge_verdicts(responses: DataFrame) -> DataFrame:
    """(candidate_id, response) replies as typed verdict rows; unreadable replies ask for REVIEW."""
    body = F.trim(F.col("response"))
    fenced = F.trim(F.rtrim(F.regexp_replace(body, r"^[^\n]*\n?", ""), F.lit("`")))
    text = F.when(body.startswith("```"), fenced).otherwise(body)
    parsed = F.from_json(text, _REPLY, {"mode": "PERMISSIVE"})
    ok = F.coalesce(F.get_json_object(text, "$").isNotNull() & text.startswith("{"), F.lit(False))
    conf = F.when(parsed["confidence"].isNull(), F.lit(0.5)).otherwise(
        parsed["confidence"].try_cast("double"))
    staged = responses.select("candidate_id", F.col("response").alias("raw_response"),
                              parsed.alias("p"), (ok & conf.isNotNull()).alias("ok"), conf.alias("c"))
    asked, relation = F.upper(F.col("p.verdict")), F.lower(F.col("p.relationship_type"))
    keep = lambda value, allowed, default: F.when(
        F.col("ok") & value.isin(allowed), value).otherwise(F.lit(default))
    return staged.select(
        "candidate_id", keep(asked, oc.VERDICTS, "REVIEW").alias("judge_verdict"),
        keep(relation, oc.RELATIONSHIPS, "unrelated").alias("judge_relationship"),
        F.when(F.col("ok"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c"))))
        .otherwise(0.0).alias("judge_confidence"),
        F.when(F.col("ok"), F.coalesce("p.reasoning", F.lit("")))
        .otherwise("unreadable judge response").alias("judge_reasoning"),
        F.when(F.col("ok"), F.coalesce("p.outcome_hints", F.create_map().cast("map<string,string>")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("judge_hints"),
        "raw_response")


def missing_verdicts(prompts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Prompts that no stored verdict answers yet."""
    return prompts.join(verdicts.select("candidate_id"), "candidate_id", "left_anti")


def decide(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Final decision rows: contradictions short-circuit, then judge, mapping and basket rules."""
    judged = pairs.join(verdicts, "candidate_id", "left")
    empty = F.create_map().cast("map<string,string>")
    relation = F.coalesce("judge_relationship", F.lit("unrelated"))
    hints = F.coalesce("judge_hints", empty)
    a, b = F.col("a"), F.col("b")

    def with_basket(mapping):
        return tx.bind(oc.basket_check(a["outcomes"], b["outcomes"], relation, hints, mapping),
                       lambda basket: F.struct(mapping.alias("mapping"), basket.alias("basket"),
                                               oc.basket_legs(a, b, mapping, basket).alias("legs")))

    # Bound step by step: a filter pushed below this projection repeats the whole expression.
    mapping = oc.outcome_mapping(a["outcomes"], b["outcomes"], relation,
                                 F.coalesce("judge_confidence", F.lit(0.0)), hints)
    legged = judged.withColumn("_o", tx.bind(mapping, with_basket)).select(
        "*", F.col("_o.mapping").alias("outcome_mapping"), F.col("_o.basket").alias("basket"),
        F.col("_o.legs").alias("legs"))
    hard = F.col("hard_reject")
    asked = F.coalesce("judge_verdict", F.lit("REVIEW"))
    verdict = (F.when(hard, "REJECT")
               .when((asked == "ACCEPT") & ~F.col("basket.is_compatible"), "REJECT").otherwise(asked))
    w = CONFIDENCE_WEIGHTS
    blended = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (
        w["rerank"] * F.col("rerank.score") + w["judge"] * F.coalesce("judge_confidence", F.lit(0.0))
        + F.when(hard, 0.0).otherwise(w["no_contradiction"]))))
    soft = lambda c: F.when(~hard, c)
    decided = legged.withColumn("verdict", verdict).select(
        "candidate_id", "platform_a", "id_a", "platform_b", "id_b", "similarity", "verdict",
        F.when(hard, F.concat(F.lit("hard contradiction: "), F.concat_ws("; ", "flags")))
        .otherwise(F.coalesce("judge_reasoning", F.lit("no judge verdict"))).alias("reason"),
        "flags", soft(F.col("rerank.score")).alias("rerank_score"),
        F.when(hard, "unrelated").otherwise(relation).alias("relationship"),
        soft(F.col("outcome_mapping")).alias("outcome_mapping"), soft(F.col("basket")).alias("basket"),
        F.when(hard, F.slice("legs", 1, 0)).otherwise(F.col("legs")).alias("legs"),
        F.when(F.col("verdict") == "REJECT", 0.0).otherwise(blended).alias("confidence"))
    return compute_once(decided)


def leg_rows(decisions: DataFrame) -> DataFrame:
    """One row per basket leg. (The outer form keeps the planner from filtering on the legs first.)"""
    rows = decisions.select("candidate_id", F.posexplode_outer("legs").alias("leg_no", "leg"))
    return rows.where(F.col("leg_no").isNotNull()).select("candidate_id", "leg_no", "leg.*")


def accepted(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates whose decision is ACCEPT."""
    kept = decisions.where(F.col("verdict") == "ACCEPT").select(
        "candidate_id", F.col("confidence").alias("decision_confidence"), "relationship")
    return candidates.join(kept, "candidate_id")


def check_aligned(candidates: DataFrame, decisions: DataFrame) -> None:
    """Raise when the two tables differ in length (one decision per candidate is expected)."""
    n, m = candidates.count(), decisions.count()
    if n != m:
        raise ValueError(f"{n} candidates but {m} decisions")
