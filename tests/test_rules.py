"""Text, template, mapping, pricing and correlation rules on small fixtures."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from crossquote.functions import filters, outcomes as oc, pricing as px, text as tx
from crossquote.functions.templates import add_template
from crossquote.operators import series
from crossquote.plans import learning, live, scoring, validation as va


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("out")).first()["out"]


DATES = {
    "Will this resolve by 2025-12-31?": ["2025-12-31"],
    "due 12/31/2025 or 1-5-2026": ["2025-12-31", "2026-01-05"],
    "By March 3, 2025 or Jan. 5 2026": ["2025-03-03", "2026-01-05"],
    "May 5, 2025": ["2025-05-05"],
    "in Q3 2024 and 2024": ["2024-07-01"],
    "by end of 2025": ["2025-12-31"],
    "before 2030 or prior to 2027": ["2029-12-31", "2026-12-31"],
    "in 2024 or 2025-02-29": ["2024-01-01", "2025-01-01"],
    "Feb 31, 2025": ["2025-02-31"],
    "nothing": [],
}
AMOUNTS = {
    "Will Bitcoin reach $100,000?": [100000.0], "over 5k and under 2.5 million": [5000.0, 2500000.0],
    "$3b by 2025": [3e9], "above 2,000 billion": [], "exceed 2100.5": [2100.5], "by 2025": [],
    "$10 below 7 percent": [10.0, 7.0], "reach ,": [],
}


def test_dates_and_amounts(spark):
    for cases, rule in ((DATES, tx.date_mentions), (AMOUNTS, tx.thresholds)):
        df = spark.createDataFrame([(t,) for t in cases], "t string")
        assert {r.t: r.out for r in df.select("t", rule("t").alias("out")).collect()} == cases


def test_entities_and_hints(spark):
    text = 'Will $BTC beat "Daily Planet"? senator Jane Smith met Joe Biden, according to Associated Press.'
    got = one(spark, tx.entities("t"), t=text)
    assert got[0] == "bitcoin" and "joe biden" in got and "daily planet" in got and "jane smith" in got
    assert one(spark, tx.normalise_entity(F.lit("  U.S. "))) == "united states"
    assert one(spark, tx.jurisdiction("t"), t="the FED in Texas") == "texas"
    assert one(spark, tx.resolution_hints("t"), t=text) == ["associated press"]
    assert one(spark, tx.polarity("t"), t="Will it not happen? I won't") == "negative"
    assert one(spark, tx.polarity("t"), t="maybe") is None


def test_negation_ignores_contractions(spark):
    assert one(spark, tx.asymmetric_negation("a", "b"), a="It won't fail", b="It will not fail") == ["not"]
    assert one(spark, tx.asymmetric_negation("a", "b"), a="not never", b="x") == ["never", "not"]


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(600))
    got = one(spark, tx.chunk_words("t"), t=words)
    want, start = [], 0
    while True:
        want.append(" ".join(words.split()[start:start + 256]))
        if start + 256 >= 600:
            break
        start += 206
    assert got == want
    assert one(spark, tx.chunk_words("t"), t=" a  b ") == [" a  b "] and one(spark, tx.chunk_words("t"), t="") == []


def test_pair_id(spark):
    import hashlib
    assert one(spark, tx.pair_hash(F.lit("a1"), F.lit("b2"))) == hashlib.sha256(b"a1|b2").hexdigest()[:16]


def test_templates(spark):
    rows = spark.createDataFrame([
        ("Will X win the presidential election?", "", ["Yes", "No"]), ("zzz", "", ["a", "b", "c", "d"]),
        ("zzz", None, ["Yes", "No"]), ("Which team will win the NBA finals win?", "", ["a", "b"])],
        "question string, description string, outcomes array<string>")
    got = [r.template for r in add_template(rows).collect()]
    assert got[0].primary == "election_event" and math.isclose(got[0].confidence, 0.9 * (0.5 + 0.5 * 2 / 3))
    assert (got[1].primary, got[1].confidence, got[1].patterns) == ("multi_outcome_exhaustive", 0.6, ["outcome_count > 3"])
    assert (got[2].primary, got[2].confidence, got[2].secondary) == ("unknown", 0.5, None)
    assert got[3].primary == "sports_result" and len(got[3].patterns) <= 5


def pairs_of(spark, questions, similarity=0.9):
    df = spark.createDataFrame([("alpha", "a", questions[0]), ("beta", "b", questions[1])], "platform string, market_id string, question string") \
        .withColumn("price", F.lit(0.5))
    sides = va.market_features(va.canonical_markets(df))
    pair = spark.createDataFrame([("c1", "alpha", "a", "beta", "b", similarity)],
                                 "candidate_id string, platform_a string, id_a string, platform_b string, id_b string, similarity double")
    return va.contradictions(va.attach_sides(pair, sides))


CONTRADICTIONS = [
    ("Will it happen by 2025-01-01?", "Will it happen by 2025-06-01?", "date_gap", True),
    ("reach $100,000?", "reach $200,000?", "threshold_mismatch", False),
    ("win the primary nomination", "win the general election", "nomination", True),
    ("about Joe Biden", "about Donald Trump", "entity_mismatch", True),
    ("about Biden", "about Joe Biden", None, False)]


def test_contradictions(spark):
    markets = [(p, f"{p}{i}", c[k], 0.5) for i, c in enumerate(CONTRADICTIONS) for k, p in enumerate("ab")]
    sides = va.market_features(va.canonical_markets(spark.createDataFrame(
        markets, "platform string, market_id string, question string, price double")))
    pairs = spark.createDataFrame([(i, "a", f"a{i}", "b", f"b{i}", 0.9) for i in range(len(CONTRADICTIONS))],
                                  "candidate_id long, platform_a string, id_a string, platform_b string, id_b string, similarity double")
    got = {r.candidate_id: r for r in va.contradictions(va.attach_sides(pairs, sides)).collect()}
    for i, (_, _, flag, hard) in enumerate(CONTRADICTIONS):
        assert got[i].hard_reject is hard
        assert (flag is None and got[i].flags == []) or any(f.startswith(flag) for f in got[i].flags)


def test_rerank_without_dates_is_neutral(spark):
    r = va.rerank(pairs_of(spark, ("a b c", "a b d"))).first().rerank
    assert r.date_proximity == 0.5 and r.text_overlap == 0.5 and r.outcome_overlap == 1.0


REPLIES = [
    ('{"verdict":"accept","relationship_type":"COMPLEMENT","confidence":0.8}', "ACCEPT", "complement", 0.8),
    ('```json\n{"verdict":"ACCEPT","relationship_type":"equivalent","confidence":7}\n```', "ACCEPT", "equivalent", 1.0),
    ('{"verdict":"huh"}', "REVIEW", "unrelated", 0.5), ("broken", "REVIEW", "unrelated", 0.0),
    ('{"confidence":"x"}', "REVIEW", "unrelated", 0.0)]


def test_judge_replies(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "candidate_id long, response string")
    got = {r.candidate_id: (r.judge_verdict, r.judge_relationship, r.judge_confidence) for r in va.judge_verdicts(df).collect()}
    assert got == {i: r[1:] for i, r in enumerate(REPLIES)}


def test_decision_and_prompt(spark):
    pairs = va.rerank(pairs_of(spark, ("Will X pass?", "X will pass?")))
    replies = spark.createDataFrame([("c1", '{"verdict":"ACCEPT","relationship_type":"related_but_not_arb_compatible","confidence":0.9}')],
                                    "candidate_id string, response string")
    r = va.decide(pairs, va.judge_verdicts(replies)).first()
    assert (r.verdict, r.confidence, r.legs) == ("REJECT", 0.0, [])
    missing = va.decide(pairs, va.judge_verdicts(replies.where("false"))).first()
    assert missing.verdict == "REVIEW"
    prompts = va.judge_prompts(pairs)
    assert "=== MARKET B ===" in prompts.first().prompt and "Outcomes: ['Yes', 'No']" in prompts.first().prompt
    assert va.missing_verdicts(prompts, va.judge_verdicts(replies)).count() == 0
    with pytest.raises(ValueError):
        va.check_aligned(pairs, replies.where("false"))


def test_outcome_mapping(spark):
    df = spark.createDataFrame([
        (["No", "Yes"], ["Yes", "No"], "equivalent", 0.9, {}), (["Yes", "No"], ["True", "False"], "complement", 0.8, {}),
        (["a", "b", "c"], ["x", "y"], "equivalent", 0.5, {}), (["Yes", "No"], ["Yes", "No"], "subset", 1.0, {}),
        (["Yes", "No"], ["Yes", "No"], "unrelated", 1.0, {}), (["Yes", "No"], ["Yes", "No"], "equivalent", 0.7, {"Yes": "No"})],
        "oa array<string>, ob array<string>, rel string, conf double, hints map<string,string>")
    m = oc.outcome_mapping(F.col("oa"), F.col("ob"), F.col("rel"), F.col("conf"), F.col("hints"))
    rows = df.withColumn("m", m).withColumn("c", oc.basket_check(F.col("oa"), F.col("ob"), F.col("rel"), F.col("hints"), F.col("m"))).collect()
    assert rows[0].m.mappings == {"Yes": "Yes", "No": "No"} and rows[0].c.arb_structure == "binary_pair"
    assert rows[1].m.mappings == {"Yes": "False", "No": "True"} and rows[1].c.arb_structure == "complement_basket"
    assert rows[2].m.mappings == {"a": "x", "b": "y"} and math.isclose(rows[2].m.confidence, 0.4)
    assert rows[3].m.mapping_type == "subset_mapping" and rows[3].c.arb_structure == "multi_leg_basket"
    assert rows[4].m.mapping_type == "unmappable" and not rows[4].c.is_compatible
    assert rows[5].m.mappings == {"Yes": "No"}
    assert one(spark, oc.label_class(F.lit("November"))) == "negative"


def test_metadata_filter(spark):
    df = spark.createDataFrame([("a", ["x", "y"], 1), (None, ["z"], 2)], "s string, l array<string>, n int")
    types = {f.name: f.dataType for f in df.schema}
    count = lambda **w: df.where(filters.metadata_matches(w, types)).count()
    assert count(s="a") == 1 and count(s=["a", None]) == 2 and count(l="x") == 1 and count(l=["z", "x"]) == 2
    assert count(absent="q") == 0 and count(absent=None) == 2 and count(s="a", n=2) == 0


@pytest.mark.parametrize("raw,name", [("Kalshi ", "kalshi"), ("the-polymarket-feed", "polymarket"), ("mani", "manifold"), ("?", "polymarket")])
def test_platform_names(spark, raw, name):
    assert one(spark, filters.platform_name(F.lit(raw))) == name


@pytest.mark.parametrize("a,b,spread,side", [(0.70, 0.63, 0.07, "buy_b_sell_a"), (0.55, 0.65, 0.10, "buy_a_sell_b"), (0.60, 0.60, 0.0, "buy_b_sell_a")])
def test_spread(spark, a, b, spread, side):
    assert one(spark, px.raw_spread(F.lit(a), F.lit(b))) == spread
    assert one(spark, px.direction(F.lit(a), F.lit(b))) == side


def test_kelly_zero_guards(spark):
    k = lambda p, s, r, c: one(spark, px.kelly_fraction(*map(F.lit, (p, s, r, c, 1.0))))
    assert k(0.0, 0.1, 0.1, 0.05) == 0.0 and k(0.9, 0.0, 0.1, 0.05) == 0.0 and k(0.9, 0.1, 0.02, 0.05) == 0.0
    assert k(0.99, 0.5, 0.5, 0.01) == 0.10


def history(spark, a, b):
    t0 = datetime(2024, 1, 1)
    rows = [("p", "a", t0 + timedelta(hours=i), i, x) for i, x in enumerate(a)]
    rows += [("q", "b", t0 + timedelta(hours=i, minutes=5), 1000 + i, x) for i, x in enumerate(b)]
    pairs = spark.createDataFrame([("pair", "p", "a", "q", "b", 0.9, 0.5)],
                                  "pair_id string, platform_a string, id_a string, platform_b string, id_b string, price_a double, price_b double")
    return pairs, spark.createDataFrame(rows, "platform string, market_id string, ts timestamp, seq long, yes_price double")


def AS_OF():
    return F.lit("2024-01-05").cast("timestamp")


def test_alignment(spark):
    pairs, hist = history(spark, [0.60, 0.62, 0.65], [0.55, 0.57, 0.60])
    got = [round(r.spread, 6) for r in series.hourly_spread(pairs, hist, AS_OF()).orderBy("hour").collect()]
    assert got == [0.05, 0.05, 0.05]
    empty = series.hourly_spread(pairs, hist.where("market_id = 'a'"), AS_OF()).collect()
    assert [round(r.spread, 6) for r in empty] == [0.4]
    f = series.spread_features(pairs, series.hourly_spread(pairs, hist, AS_OF()), AS_OF()).first()
    assert f.volatility > 0 and f.days_to_close == 365.0 and f.volume_ratio == 10.0 and abs(f.velocity) < 1e-12


def test_correlation(spark):
    up = [0.3 + 0.02 * i for i in range(15)]
    pairs, hist = history(spark, up, up)
    assert series.price_correlation(pairs, hist, AS_OF()).first().correlation_ok
    pairs, hist = history(spark, up, up[::-1])
    assert not series.price_correlation(pairs, hist, AS_OF()).first().correlation_ok
    pairs, hist = history(spark, up[:2], up[:2])
    r = series.price_correlation(pairs, hist, AS_OF()).first()
    assert (r.correlation, r.correlation_ok) == (0.0, True)


def test_labels_and_model(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("p", t0 + timedelta(hours=i), x) for i, x in enumerate([.10, .09, .08, .07, .03, .01])]
    df = spark.createDataFrame(rows, "pair_id string, hour timestamp, spread double")
    got = [r.label for r in series.convergence_labels(df, 3).orderBy("hour").collect()]
    assert got == [0, 1, 1]  # .08 -> .01 and .09 -> .03 at least halve
    assert learning.fit(learning.training_rows(df)) is None
    assert learning.predictor(None)(series.running_features(df)).count() == 6


def test_live_validation(spark):
    df = spark.createDataFrame([
        ("ok", 0.7, 0.6, "buy_b_sell_a", 100.0, 0.7, 0.6, 10000.0, 10000.0),
        ("gone", 0.7, 0.6, "buy_b_sell_a", 100.0, 0.61, 0.6, 10000.0, 10000.0),
        ("turned", 0.7, 0.6, "buy_b_sell_a", 100.0, 0.5, 0.6, 10000.0, 10000.0),
        ("thin", 0.7, 0.6, "buy_b_sell_a", 1000.0, 0.7, 0.6, 1000.0, 1000.0),
        ("unknown", 0.7, 0.6, "buy_b_sell_a", 1000.0, None, None, 10000.0, 10000.0)],
        "pair_id string, price_a double, price_b double, direction string, size_usd double, live_a double, live_b double, liquidity_a double, liquidity_b double")
    got = {r.pair_id: r for r in live.validate(df).collect()}
    assert [k for k, r in got.items() if r.executable] == ["ok", "unknown"]
    assert len(got["unknown"].reasons) == 2 and got["thin"].adjusted_size == 100.0
    assert [(a.leg, a.side, a.amount_usd, a.limit_price) for a in got["ok"].actions] == [("b", "yes", 50.0, 0.61), ("a", "no", 50.0, 0.31)]


def test_pair_flow_to_signal(spark):
    pairs = va.verdict_without_judge(pairs_of(spark, ("Will X pass?", "X will pass?"), 0.95))
    priced = pairs.withColumns({"a": F.col("a").withField("prices", F.create_map(F.lit("Yes"), F.lit(0.8), F.lit("No"), F.lit(0.2))),
                                "b": F.col("b").withField("prices", F.create_map(F.lit("Yes"), F.lit(0.5), F.lit("No"), F.lit(0.5)))})
    matched = scoring.matched_pairs(priced.where("verdict = 'ACCEPT'"))
    (s,) = scoring.score_pairs(matched).collect()
    assert s.direction == "buy_b_sell_a" and s.raw_spread == 0.3 and s.kelly_fraction == 0.1 and s.size_usd == 1000.0


def test_patterns_are_found_with_and_without_the_prefilter(spark):
    """Texts around every pattern's literals, in other cases and with letters whose lower case is not the one a search folds them to."""
    from crossquote.functions import templates as tp

    patterns = [p for _, _, ps in tp.RULES for p in ps] + tx.RESOLUTION_PATTERNS + tx.JURISDICTION_PATTERNS + tx.NEGATIVE_PATTERNS \
        + tx.POSITIVE_PATTERNS + [p for _, p in tx.COMPARATOR_PATTERNS] + va.NOMINATION_PATTERNS + va.GENERAL_PATTERNS
    texts = {"", "no", "1-2", "will the ﬁnals", "Will NOT win the game by March 5, 2027 above $1,000", "MARÇO ıs by END of 2026"}
    for p in patterns:
        for literal in tx.required(p):
            texts |= {f"x {literal} 20 win 2026 bill", literal.upper() + " president game election", literal.replace("s", "ſ"),
                      literal.replace("k", "K"), literal[:-1], f"by the {literal.title()}ed 1,000 million points ahead be first"}
    rows = spark.createDataFrame([(t,) for t in sorted(texts)], "t string").withColumn("plain", tx.plain_lower("t"))
    different = rows.select(*[F.count_if(tx.has("t", p) != (tx.may_have(F.col("plain"), p) & tx.has("t", p))).alias(f"c{i}")
                              for i, p in enumerate(patterns)]).first()
    assert set(different) == {0}
    ruled_out = rows.select(*[F.count_if(~tx.may_have(F.col("plain"), p)).alias(f"c{i}") for i, p in enumerate(patterns)]).first()
    assert sum(n > 0 for n in ruled_out) > 0.9 * len(patterns)
    assert tx.required(r"\b(price|rate)\b.*x?") == ("price", "rate") and tx.required(r"[a-z]+(ab)?") == ()


def test_plain_searches_find_the_same(spark):
    """ASCII texts are searched in lower case; a search starts only where all groups of literals are. Blanks fold as before."""
    assert tx.needed(r"\bvote\b.*\b(president|senate)") == (("president", "senate"), ("vote",))
    texts = ["Vote for PRESIDENT", "a president", "vote 5", "VOTE, \u212aing and president", "", None, "won't  pass\tthe\n bill ", " a \u00a0 b",
             "2025-02-30 or 2025-03-01 by Jan. 5, 2027", "\u0662\u0660\u0662\u0665-01-01 before 2031", "$5k above 2,000"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("plain", tx.plain_lower("t"))
    patterns = [r"\bvote\b.*\bpresident", r"\bK", r"\bwon'?t\b", r"\d+\S\d"]
    same = [tx.has("t", p).eqNullSafe(tx.has_plain("t", F.col("plain"), p)) for p in patterns]
    same.append(tx.fold("t") == F.coalesce(F.trim(F.regexp_replace(F.lower("t"), r"(?U)\s+", " ")), F.lit("")))
    same.append(tx.matches("t", tx.THRESHOLD_PATTERN).eqNullSafe(tx.matches_plain("t", F.col("plain"), tx.THRESHOLD_PATTERN)))
    assert rows.where(~F.array_min(F.array(*same))).collect() == []
    assert rows.where("t like 'a pres%' or t = 'vote 5'").where(tx.may_have(F.col("plain"), patterns[0])).count() == 0
