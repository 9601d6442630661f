"""Outcome labels of a pair: classes, mapping between sides, basket legs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label fragments; a positive fragment wins over a negative one.
POSITIVE_LABELS = ["yes", "true", "win", "will", "above", "over", "higher"]
NEGATIVE_LABELS = ["no", "false", "lose", "won't", "below", "under", "lower"]
OPPOSITES = {"yes": "no", "no": "yes", "true": "false", "false": "true"}
INDEX_MATCH_FACTOR = 0.8
PARTIAL_COVER_FACTOR = 0.7

RELATIONSHIPS = ["equivalent", "complement", "subset", "superset",
                 "related_but_not_arb_compatible", "unrelated"]
VERDICTS = ["ACCEPT", "REJECT", "REVIEW"]

_EMPTY_MAP = "map<string,string>"


def label_class(label: Column) -> Column:
    text = F.lower(F.trim(label))
    contains = lambda words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    return (F.when(contains(POSITIVE_LABELS), "positive")
            .when(contains(NEGATIVE_LABELS), "negative").otherwise("unknown"))


def label_overlap(a: Column, b: Column) -> Column:
    """Shared label share, directly or after flipping yes/no and true/false."""
    clean = lambda xs: F.array_distinct(F.transform(xs, lambda o: F.lower(F.trim(o))))
    left, right = clean(a), clean(b)
    flips = F.create_map(*[F.lit(x) for kv in OPPOSITES.items() for x in kv])
    flipped = F.transform(left, lambda o: F.coalesce(F.try_element_at(flips, o), o))
    union = F.size(F.array_union(left, right))
    share = lambda xs: F.size(F.array_intersect(xs, right)) / F.greatest(union, F.lit(1))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.5)).otherwise(
        F.greatest(share(left), share(flipped)))


def _positive_first(labels: Column) -> Column:
    first, second = F.get(labels, F.lit(0)), F.get(labels, F.lit(1))
    swap = (label_class(first) != "positive") & (label_class(second) == "positive")
    return F.when(swap, F.array(second, first)).otherwise(labels)


def _unique_map(keys: Column, values: Column) -> Column:
    """Map from two arrays; a repeated key keeps its last value."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    later = F.filter(pairs, lambda p, i: ~F.exists(
        F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(later, lambda p: F.struct(p["k"], p["v"])))


def outcome_mapping(outcomes_a: Column, outcomes_b: Column, relationship: Column,
                    confidence: Column, hints: Column) -> Column:
    """struct(mapping_type, mappings, confidence, notes) of one judged pair."""
    binary = (F.size(outcomes_a) == 2) & (F.size(outcomes_b) == 2)
    left, right = _positive_first(outcomes_a), _positive_first(outcomes_b)
    shared = F.least(F.size(outcomes_a), F.size(outcomes_b))
    by_index = _unique_map(F.slice(outcomes_a, F.lit(1), F.greatest(shared, F.lit(0))),
                           F.slice(outcomes_b, F.lit(1), F.greatest(shared, F.lit(0))))
    none = F.create_map().cast(_EMPTY_MAP)

    def result(kind, mappings, conf, notes):
        return F.struct(F.lit(kind).alias("mapping_type"), mappings.alias("mappings"),
                        conf.alias("confidence"),
                        (F.lit(notes) if isinstance(notes, str) else notes).alias("notes"))

    equal, flip = relationship == "equivalent", relationship == "complement"
    partial = relationship.isin("subset", "superset")
    return (
        F.when(F.coalesce(F.size(F.map_keys(hints)), F.lit(0)) > 0,
               result("direct", hints, confidence, "outcome hints from the judge"))
        .when(equal & binary, result("direct", _unique_map(left, right), confidence,
                                     "equivalent binary markets"))
        .when(equal & (F.size(outcomes_a) > 0) & (F.size(outcomes_b) > 0),
              result("direct", by_index, confidence * INDEX_MATCH_FACTOR,
                     "equivalent markets matched by position"))
        .when(flip & binary, result("inverted", _unique_map(left, F.reverse(right)), confidence,
                                    "complement markets"))
        .when(partial, result("subset_mapping", none, confidence * PARTIAL_COVER_FACTOR,
                              F.concat(relationship, F.lit(" needs manual mapping"))))
        .otherwise(result("unmappable", none, F.lit(0.0),
                          F.concat(F.lit("no mapping for "), relationship))))


def basket_check(outcomes_a: Column, outcomes_b: Column, relationship: Column,
                 hints: Column, mapping: Column) -> Column:
    """struct(arb_structure, is_compatible, rejection_reason, leg_type)."""
    def verdict(structure, ok, reason=None, leg_type=None):
        reason = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
        return F.struct(F.lit(structure).alias("arb_structure"), F.lit(ok).alias("is_compatible"),
                        reason.alias("rejection_reason"),
                        F.lit(leg_type).cast("string").alias("leg_type"))

    no_hints = F.coalesce(F.size(F.map_keys(hints)), F.lit(0)) == 0
    mapped = F.size(F.map_keys(mapping["mappings"]))
    n_a, n_b = F.size(outcomes_a), F.size(outcomes_b)
    equal = relationship == "equivalent"
    return (
        F.when(relationship.isin("unrelated", "related_but_not_arb_compatible"),
               verdict("not_arb", False, F.concat(F.lit("relationship is "), relationship)))
        .when((mapping["mapping_type"] == "unmappable") & no_hints,
              verdict("not_arb", False, "outcomes cannot be mapped"))
        .when(relationship.isin("subset", "superset"), verdict("multi_leg_basket", True))
        .when((relationship == "complement") & (mapped > 0),
              verdict("complement_basket", True, leg_type="complement"))
        .when((n_a == 2) & (n_b == 2), verdict("binary_pair", True, leg_type="binary"))
        .when(equal & (n_a > 2) & (n_b > 2) & (mapped < n_a),
              verdict("not_arb", False, F.concat(
                  F.lit("only "), mapped.cast("string"), F.lit("/"), n_a.cast("string"),
                  F.lit(" outcomes mapped"))))
        .when(equal, verdict("binary_pair", True, leg_type="binary"))
        .otherwise(verdict("not_arb", False, F.concat(F.lit("unhandled relationship "), relationship))))


def basket_legs(side_a: Column, side_b: Column, mapping: Column, check: Column) -> Column:
    """One leg struct per mapped outcome; empty unless the structure has legs."""
    def leg(entry):
        price_a = F.coalesce(F.try_element_at(side_a["prices"], entry["key"]), F.lit(0.0))
        price_b = F.coalesce(F.try_element_at(side_b["prices"], entry["value"]), F.lit(0.0))
        return F.struct(
            side_a["platform"].alias("platform_a"), side_a["market_id"].alias("market_id_a"),
            entry["key"].alias("outcome_a"), price_a.alias("price_a"),
            side_b["platform"].alias("platform_b"), side_b["market_id"].alias("market_id_b"),
            entry["value"].alias("outcome_b"), price_b.alias("price_b"),
            (price_a + price_b).alias("combined_price"), check["leg_type"].alias("leg_type"))

    entries = F.map_entries(mapping["mappings"])
    return F.transform(F.filter(entries, lambda e: check["is_compatible"] & check["leg_type"].isNotNull()), leg)
