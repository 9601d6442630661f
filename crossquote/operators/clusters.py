"""Connected components of accepted pairs by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from crossquote.session import materialize


def edge_table(decisions: DataFrame) -> DataFrame:
    """Edges of accepted decisions that have an outcome mapping and a basket verdict."""
    return decisions.where((F.col("verdict") == "ACCEPT") & F.col("outcome_mapping").isNotNull()
                           & F.col("basket").isNotNull()).select(
        "id_a", "id_b", "relationship", "confidence", F.col("basket.arb_structure").alias("arb_structure"),
        "legs")


def arb_baskets(edges: DataFrame) -> DataFrame:
    return edges.where(F.size("legs") > 0)


def graph_counts(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("id_a").alias("n")).union(edges.select("id_b")).distinct()
    links = edges.select("id_a", "id_b").distinct()
    kinds = nodes.select(F.lit("node").alias("kind")).unionByName(links.select(F.lit("edge").alias("kind")))
    return kinds.agg(F.count_if(F.col("kind") == "node").alias("nodes"),
                     F.count_if(F.col("kind") == "edge").alias("edges"))


FEW_EDGES = 100_000  # so many pairs of ids are less work for one task than for many with their shuffles; more are dealt out


def _together(table: DataFrame, few: bool) -> DataFrame:
    return table.coalesce(1) if few else table


def _large_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood.

    Only the minimum per node is aggregated (map-side combine), never a neighbour list, so a
    node holding a third of all edges costs one combined row plus a skew-splittable join.
    """
    both = _together(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), few)
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(low, "u")  # one row per edge; the small star makes them distinct
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")))


def _small_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Link every smaller neighbour (and the node itself) to the smallest smaller neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return _together(linked.union(own), few).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node id as component name.

    Each round contracts stars twice and is checkpointed; the number of rounds grows with the
    logarithm of the longest chain. Stops when a round changes nothing. Up to FEW_EDGES edges stay in one
    partition, so that a round of a small table is one task.
    """
    pairs = edges.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    size = Observation()
    current = materialize(pairs.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().observe(size, F.count("*").alias("n")))
    few = size.get["n"] <= FEW_EDGES
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    current, mark = _together(current, few), None
    for _ in range(max_rounds):
        seen = Observation()
        current = materialize(_small_star(_large_star(current, few), few).observe(
            seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        # equal row count and equal order-free sum of row hashes, taken while the rows are written: nothing changed
        now = seen.get
        if mark == now:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    named = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(named, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def event_clusters(edges: DataFrame) -> DataFrame:
    return connected_components(edges).groupBy("component").agg(F.count("*").alias("members"))
