"""Measures as aggregates of level histograms (source, dist, cnt) in which a source stands at distance 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 0.5


def inverse(farness: Column) -> Column:
    """1 / farness, 0 where nothing is reached."""
    return F.when(farness > 0, F.lit(1.0) / farness).otherwise(F.lit(0.0))


def measures(histogram: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """node, farness, closeness, lin, harmonic, exponential and reachable of each source."""
    far = F.when(F.col("dist") > 0, F.col("cnt")).otherwise(F.lit(0))
    out = histogram.groupBy(F.col("source").alias("node")).agg(
        F.sum(F.col("dist") * F.col("cnt")).cast("bigint").alias("farness"),
        F.sum(F.when(F.col("dist") > 0, F.col("cnt") / F.col("dist")).otherwise(F.lit(0.0))).alias("harmonic"),
        F.sum(far * F.pow(F.lit(float(alpha)), F.col("dist").cast("double"))).alias("exponential"),
        F.sum("cnt").cast("bigint").alias("reachable"),
    )
    close = inverse(F.col("farness"))
    lin = F.when(F.col("farness") > 0, F.col("reachable").cast("double") * F.col("reachable") * close).otherwise(F.lit(1.0))
    return out.select("node", "farness", close.alias("closeness"), lin.alias("lin"), "harmonic", "exponential", "reachable")


def visited(histogram: DataFrame) -> DataFrame:
    """One row: nodes reached from other nodes and arcs scanned on the way. histogram has arcs, the out-arcs of each level's nodes."""
    nodes = F.sum(F.when(F.col("dist") > 0, F.col("cnt")).otherwise(F.lit(0)))
    return histogram.agg(F.coalesce(nodes, F.lit(0)).cast("bigint").alias("visited_nodes"), F.coalesce(F.sum("arcs"), F.lit(0)).cast("bigint").alias("visited_arcs"))


def normalized(farness: Column, nodes: int) -> Column:
    """(n - 1) / farness, null where nothing is reached."""
    return F.when(farness > 0, F.lit(float(nodes - 1)) / farness)


def normalized_estimate(sum_: Column, sources: int, nodes: int) -> Column:
    """k (n - 1) / (n f) for a sum f of distances from k sources, null for 0."""
    return F.when(sum_ > 0, F.lit(float(sources * (nodes - 1))) / (F.lit(float(nodes)) * sum_))
