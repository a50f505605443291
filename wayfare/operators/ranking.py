"""Orders of nodes and checks of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.arcs import numbered
from wayfare.functions.measures import normalized, normalized_estimate
from wayfare.sources.shared import settled


def top_with_ties(scores: DataFrame, k: int, score: str = "closeness") -> DataFrame:
    """node, score and rank of the k best and all that tie with the last of them. Scores are settled once; ranks are those of distinct scores, k at most."""
    held = settled(scores.select("node", score), "scores")
    counts = held.groupBy(score).agg(F.count("*").alias("__rows")).orderBy(F.desc(score)).limit(max(k, 0))
    ranks = counts.select(F.col(score).alias("__score"), F.coalesce(F.sum("__rows").over(Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__above"))
    joined = held.join(F.broadcast(ranks.filter(F.col("__above") < k)), F.col(score) == F.col("__score"))
    return joined.select("node", score, (F.col("__above") + 1).cast("int").alias("rank"))


def ranked(scores: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """scores with their place from 1 in the given order."""
    out = numbered(scores, order, name)
    return out.withColumn(name, (F.col(name) + 1).cast("bigint"))


def by_degree(degrees: DataFrame) -> DataFrame:
    return ranked(degrees, [F.desc("degree"), F.col("node")])


def by_closeness(scores: DataFrame) -> DataFrame:
    return ranked(scores, [F.desc("closeness"), F.col("node")])


def by_farness(scores: DataFrame, farness: str = "farness") -> DataFrame:
    return ranked(scores, [F.col(farness), F.col("node")])


def shuffled(nodes: DataFrame, draw: Column) -> DataFrame:
    """Nodes in the order of a seeded draw."""
    return ranked(nodes.withColumn("__u", draw), [F.col("__u"), F.col("node")]).drop("__u")


def progressive_order(state: DataFrame) -> DataFrame:
    """state (node, processed, farness, estimate): processed nodes by farness, then the others by estimate."""
    value = F.when(F.col("processed"), F.col("farness")).otherwise(F.col("estimate"))
    return ranked(state.withColumn("__first", F.when(F.col("processed"), 0).otherwise(1)).withColumn("__value", value.cast("double")), [F.col("__first"), F.col("__value"), F.col("node")]).drop("__first", "__value")


def merged_order(state: DataFrame, sources: int, nodes: int) -> DataFrame:
    """Exact and estimated normalized closeness in one order, greatest first and among equals the greater node."""
    exact = normalized(F.col("farness"), nodes)
    guess = normalized_estimate(F.col("estimate"), sources, nodes)
    score = F.coalesce(exact, guess, F.lit(0.0))
    return ranked(state.select("node", score.alias("score")), [F.desc("score"), F.desc("node")])


def precision_at_k(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: the part of k that found and exact (both with node) share, of at most k."""
    common = found.select("node").join(exact.select("node"), "node", "left_semi")
    return common.agg(F.least(F.count("*"), F.lit(k)).alias("hits")).select("hits", (F.col("hits") / F.lit(float(k))).alias("precision"))


def inversions(rows: DataFrame, order: list[str], value: str, descending: bool = True) -> DataFrame:
    """One row: how many neighbours in the given order (unique) stand the wrong way round. Neighbours across ranges meet through the ranges' ends."""
    placed = numbered(rows, order, "__n").select("__n", F.col(value).alias("v"))
    after = placed.select((F.col("__n") - 1).alias("__n"), F.col("v").alias("w"))
    wrong = F.col("w") > F.col("v") if descending else F.col("w") < F.col("v")
    return placed.join(after, "__n").agg(F.coalesce(F.sum(F.when(wrong, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("inversions"))
