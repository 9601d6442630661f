"""Question template classification by scored keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossquote.functions.text import bind, fold, has_plain, plain_lower

# ---------------------------------------------------------------- fixed values
# (template, base confidence, patterns); order breaks ties.
RULES = [
    ("election_event", 0.9, [
        r"\belection\b", r"\bvote\b.*\bpresident", r"\bprimary\b", r"\bballot\b",
        r"\belect(ed)?\b", r"\bpresidential\b", r"\bsenate race\b", r"\bhouse race\b",
        r"\bgovernor\b.*\belection\b"]),
    ("approval_event", 0.85, [
        r"\bapprove[d]?\b", r"\bapproval\b", r"\bpass(ed)?\b.*\bbill\b", r"\bsigned into law\b",
        r"\blegislation\b", r"\bconfirm(ed|ation)?\b", r"\bratif(y|ied|ication)\b"]),
    ("sports_result", 0.9, [
        r"\bwin\b.*\bgame\b", r"\bchampionship\b", r"\bsuperbowl\b", r"\bsuper bowl\b", r"\bnba\b",
        r"\bnfl\b", r"\bmlb\b", r"\bnhl\b", r"\bworld series\b", r"\bworld cup\b", r"\bplayoffs?\b",
        r"\bfinals?\b.*\b(win|champion)\b", r"\bmatch\b.*\b(win|lose)\b"]),
    ("threshold_event", 0.8, [
        r"\breach\b.*\b\$?[\d,]+", r"\bexceed[s]?\b", r"\babove\b.*\b\$?[\d,]+",
        r"\bbelow\b.*\b\$?[\d,]+", r"\bat least\b.*\b[\d,]+", r"\bmore than\b.*\b[\d,]+",
        r"\b(price|rate|level)\b.*\b[\d,]+", r"\b[\d,]+\b.*\b(billion|million|trillion)\b"]),
    ("by_date_event", 0.8, [
        r"\bby\b.*\b(january|february|march|april|may|june|july|august|september|october|november|december)\b",
        r"\bby\b.*\b20\d{2}\b", r"\bby end of\b", r"\bbefore\b.*\b20\d{2}\b", r"\bprior to\b",
        r"\bdeadline\b"]),
    ("range_bucket_market", 0.75, [
        r"\bbetween\b.*\band\b.*\b[\d,]+", r"\brange\b", r"\bbucket\b", r"[\d,]+\s*[-–]\s*[\d,]+",
        r"\binterval\b"]),
    ("margin_market", 0.8, [
        r"\bmargin\b", r"\bspread\b", r"\bpoints?\b.*\b(win|lead|ahead)\b",
        r"\bby more than\b.*\bpoints?\b"]),
    ("multi_outcome_exhaustive", 0.7, [
        r"\bwhich\b.*\bwill\b.*\b(first|win|be)\b", r"\bwho will\b",
        r"\bwhich (team|country|candidate|party|company)\b"]),
    ("binary_winner", 0.7, [
        r"\bwill\b.*\b(win|lose|happen|occur|be elected|be appointed|be confirmed)\b",
        r"\b(yes|no)\b.*\bmarket\b", r"\bwill .* (succeed|fail|resign|pass away|be impeached)\b"]),
]
UNKNOWN = ("unknown", 0.5)
MANY_OUTCOMES = ("multi_outcome_exhaustive", 0.6, "outcome_count > 3")
SECONDARY_MIN = 0.5
# ----------------------------------------------------------- end of fixed values


def _bits(text: Column, plain: Column, patterns: list[str]) -> Column:
    """Bit i is set when pattern i matches; plain integers keep this part in generated code."""
    total = F.lit(0)
    for i, pattern in enumerate(patterns):
        total = total + F.when(has_plain(text, plain, pattern), F.lit(1 << i)).otherwise(F.lit(0))
    return total


def _candidate(conf: Column, rank: int, template: str, hits: Column) -> Column:
    """Struct whose descending order is best confidence first, then rule order."""
    return F.struct(conf.alias("sort"), F.lit(-rank).alias("rank"),
                    F.lit(template).alias("template"), hits.alias("hits"))


def _matched(best: Column) -> Column:
    """Patterns of the best rule named by its bits."""
    names = F.array(*[F.array(*map(F.lit, p)) for _, _, p in RULES], F.array(F.lit(MANY_OUTCOMES[2])))
    listed = F.transform(F.get(names, -best["rank"]), lambda p, i: F.when(
        F.call_function("shiftright", best["hits"], i).bitwiseAND(F.lit(1)) == 1, p))
    return F.filter(listed, lambda p: p.isNotNull())


def add_template(df: DataFrame, question: str = "question", description: str = "description",
                 outcomes: str = "outcomes", out: str = "template") -> DataFrame:
    """Adds struct(primary, secondary, confidence, patterns).

    A rule scores base * (0.5 + n/6) for n matching patterns, at most three counted. A pattern is searched for only
    where a text that it needs is there. The tests, the ranking and the final pick are separate
    projections so that every pattern runs once per row.
    """
    folded = F.when(F.coalesce(F.length(description), F.lit(0)) > 0,
                    F.concat_ws(" ", fold(question), fold(description))).otherwise(fold(question))
    tested = df.withColumn("_text", folded).withColumn("_plain", plain_lower("_text"))
    tested = tested.withColumns({f"_h{i}": _bits(F.col("_text"), F.col("_plain"), p) for i, (_, _, p) in enumerate(RULES)})

    scored = []
    for rank, (template, base, _) in enumerate(RULES):
        hits = F.col(f"_h{rank}")
        share = F.least(F.bit_count(hits), F.lit(3)) / F.lit(3.0)
        conf = F.lit(base) * (F.lit(0.5) + F.lit(0.5) * share)
        scored.append(F.when(hits > 0, _candidate(conf, rank, template, hits)))
    name, conf, _ = MANY_OUTCOMES
    scored.append(F.when(F.size(outcomes) > 3, _candidate(F.lit(conf), len(RULES), name, F.lit(1))))
    # descending, so that rules that do not apply (null) come last
    ranked = tested.withColumn("_ranked", F.sort_array(F.array(*scored), asc=False))

    best, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    picked = F.struct(
        F.coalesce(best["template"], F.lit(UNKNOWN[0])).alias("primary"),
        F.when(second["sort"] >= SECONDARY_MIN, second["template"]).alias("secondary"),
        F.coalesce(best["sort"], F.lit(UNKNOWN[1])).alias("confidence"),
        F.when(best.isNotNull(), bind(best, _matched)).otherwise(
            F.array().cast("array<string>")).alias("patterns"))
    return ranked.withColumn(out, picked).drop(
        "_text", "_plain", "_ranked", *[f"_h{i}" for i in range(len(RULES))])
