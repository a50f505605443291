"""Farness of every node estimated from weighted samples of sources, for symmetric graphs.

A few first sources give each node a weight: its greatest share of a first source's distances, at least 1/n. Each node is sampled with
probability min(1, k weight), k = ceil(ln n / eps^2), and the sampled nodes' distances, divided by their probabilities, sum to an unbiased
estimate of farness. Up to 648 nodes and eps = 0.1 every probability is 1 and the estimate exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.measures import inverse
from wayfare.operators.traversal import Graph, histogram, pairs, sums_and_farness
from wayfare.sources.shared import discard, settled

EPS = 0.1


def coefficient(nodes: int, eps: float = EPS) -> int:
    return math.ceil(math.log(nodes) / eps**2) if nodes > 1 else 0


def first_count(nodes: int) -> int:
    """How many first sources: the whole part of log2 n, 2 at least, n at most."""
    return min(nodes, max(int(math.log2(nodes)) if nodes > 0 else 0, 2))


def draw(node: Column, seed: int) -> Column:
    """A number from 0 to 1 (excluded) for each node."""
    return F.pmod(F.xxhash64(F.lit(seed), node), F.lit(1 << 52)) / F.lit(float(1 << 52))


@dataclass
class Estimate:
    """weights (node, weight, p); first (id); sample (node, p); farness (node, estimate, exact); known (node, farness) of the nodes searched
    for the estimate; firsts and sampled, the numbers of searches."""

    weights: DataFrame
    first: DataFrame
    sample: DataFrame
    farness: DataFrame
    known: DataFrame
    firsts: int
    sampled: int

    @property
    def searches(self) -> int:
        return self.firsts + self.sampled


def first_sources(graph: Graph, u: Column) -> DataFrame:
    """The nodes (id) of lowest draw; u is an expression over the column node."""
    graph.hold()
    nodes = graph.vertices.select(F.col("id").alias("node"))
    return nodes.orderBy(u, "node").limit(first_count(graph.node_count())).select(F.col("node").alias("id"))


def weights(graph: Graph, reached: DataFrame, eps: float = EPS) -> DataFrame:
    """node, weight and p, given the pairs (source, node, dist) of the first sources."""
    n = graph.node_count()
    k = coefficient(n, eps)
    total = reached.groupBy("source").agg(F.sum("dist").alias("__total")).filter("__total > 0")
    # a row for each first source, some log2 n
    share = reached.join(F.broadcast(total), "source").groupBy("node").agg(F.max(F.col("dist") / F.col("__total")).alias("__share"))
    nodes = graph.vertices.select(F.col("id").alias("node")).join(share, "node", "left")
    weight = F.greatest(F.lit(1.0 / max(1, n)), F.coalesce("__share", F.lit(0.0)))
    return nodes.select("node", weight.alias("weight")).withColumn("p", F.least(F.lit(1.0), F.lit(float(k)) * F.col("weight")))


def estimate(graph: Graph, seed: int = 1, eps: float = EPS, first_u: Column | None = None, sample_u: Column | None = None) -> Estimate:
    """Estimates for one seed; the draws may be given as expressions over the column node. The searches made also tell the searched nodes' own farness."""
    node = F.col("node")
    first = settled(first_sources(graph, draw(node, seed) if first_u is None else first_u), "first")
    reached = settled(pairs(graph, first), "reached")
    weighted = settled(weights(graph, reached, eps), "weights")
    u = draw(node, seed + 1) if sample_u is None else sample_u
    sample = settled(weighted.filter(u < F.col("p")).select("node", "p"), "sample")
    found = settled(sums_and_farness(graph, sample.select(F.col("node").alias("id"), (F.lit(1.0) / F.col("p")).alias("weight"))), "sums")
    sums = found.filter("not far").select("node", F.col("value").alias("total"))
    own = reached.groupBy(F.col("source").alias("node")).agg(F.sum("dist").cast("bigint").alias("farness"))
    known = settled(own.union(found.filter("far").select("node", F.col("value").cast("bigint"))).groupBy("node").agg(F.max("farness").alias("farness")), "known")
    discard(reached)
    nodes = graph.vertices.select(F.col("id").alias("node"))
    far = nodes.join(sums, "node", "left").join(known.select("node", F.lit(True).alias("__known")), "node", "left")
    far = settled(far.select("node", F.coalesce("total", F.lit(0.0)).alias("estimate"), F.coalesce("__known", F.lit(False)).alias("exact")), "estimate")
    discard(found)
    return Estimate(weighted, first, sample, far, known, first.count(), sample.count())


def estimate_errors(graph: Graph, made: Estimate) -> DataFrame:
    """node, farness, estimate and error (relative; 0 where farness is 0)."""
    exact = histogram(graph, arcs=False).groupBy(F.col("source").alias("node")).agg(F.sum(F.col("dist") * F.col("cnt")).cast("bigint").alias("farness"))
    error = F.when(F.col("farness") > 0, F.abs(F.col("estimate") - F.col("farness")) / F.col("farness")).otherwise(F.lit(0.0))
    return exact.join(made.farness, "node").select("node", "farness", "estimate", error.alias("error"))


def estimated_closeness(made: Estimate) -> DataFrame:
    return made.farness.select("node", inverse(F.col("estimate")).alias("closeness"), "exact")
