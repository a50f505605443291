"""Degrees and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators.traversal import Graph, pairs
from wayfare.sources.shared import discard, settled

#: Up to so many nodes strong components are told from pairs of nodes.
PAIR_NODES = 3000
#: Neighbours of a node that are joined in one task; those of a greater one are dealt to several.
HUB_ROWS = 1_000_000


def degrees(graph: Graph) -> DataFrame:
    """node and degree, its number of out-arcs, 0 included."""
    if (counted := graph.degree_table()) is not None:
        return counted
    counted = graph.arcs.groupBy("src").agg(F.count("*").alias("degree"))
    joined = graph.vertices.join(counted, F.col("id") == F.col("src"), "left")
    return joined.select(F.col("id").alias("node"), F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def spanned(edges: DataFrame) -> DataFrame:
    """node and part (the least node joined to it) for the nodes of edges (a, b), by large and small stars in turn."""
    at = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    size = at.count()
    while True:
        # every larger neighbour of a node is tied to the least of the node and its neighbours
        sides = at.select("a", "b").union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = _with_least(sides.filter("b > a"), low, size).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # a node and its smaller neighbours are tied to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        tied = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, F.col("a") == F.col("n")).select(F.explode(tied).alias("e")).select("e.*")
        after = settled(small.filter("a <> b").distinct(), "edges")
        count = after.count()
        same = count == size and after.join(at, ["a", "b"], "left_anti").isEmpty()
        discard(at)
        at, size = after, count
        if same:
            break
    roots = at.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("part"))
    return at.select(F.col("a").alias("node"), F.col("b").alias("part")).union(roots)


def _with_least(sides: DataFrame, low: DataFrame, size: int) -> DataFrame:
    """sides (a, b) with m of low (n, m) where n is a; a hub's rows are dealt over salts. size: an upper bound of any node's rows."""
    if size <= HUB_ROWS:
        return sides.join(low, F.col("a") == F.col("n"))
    hubs = sides.groupBy("a").count().filter(F.col("count") > HUB_ROWS)
    # at most one hub for HUB_ROWS rows
    hubs = settled(hubs.select(F.col("a").alias("hub"), F.ceil(F.col("count") / HUB_ROWS).cast("int").alias("salts")), "hubs")
    dealt = sides.join(F.broadcast(hubs), F.col("a") == F.col("hub"), "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")).select("a", "b", "salt")
    spread = low.join(F.broadcast(hubs), F.col("n") == F.col("hub"), "left").select("n", "m", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("of"))
    return dealt.join(spread, (F.col("a") == F.col("n")) & (F.col("salt") == F.col("of")))


def labelled(arrays: tuple) -> np.ndarray:
    """For each place in the arrays' ids the least place that arcs join it to in either direction. Each step takes roots under the least label next to them and halves the ways to roots."""
    ids, first, src, first_out, out, _ = arrays
    sides = [(np.flatnonzero(np.diff(f)), f, to) for f, to in ((first, src), (first_out, out)) if to is not None and len(to)]
    label = np.arange(len(ids))
    while True:
        above = label[label]
        low = above.copy()
        for some, f, to in sides:
            low[some] = np.minimum(low[some], np.minimum.reduceat(above.take(to), f[some]))
        after = np.minimum(above, low)
        np.minimum.at(after, label, low)
        if np.array_equal(after, label):
            return label
        label = after


def components(graph: Graph) -> DataFrame:
    """node and component, the least node that arcs join it to in either direction: in one task where it can hold the graph, or its nodes, else by stars."""
    reader = graph.reader()
    if reader is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                arrays = reader.value
                yield pa.RecordBatch.from_arrays([pa.array(arrays[0]), pa.array(arrays[0][labelled(arrays)])], names=["node", "component"])

        return settled(graph.spark.range(0, 1, 1, 1).mapInArrow(run, "node long, component long"), "components")
    if (places := graph.places()) is not None:
        return places.select(F.col("id").alias("node"), "component")
    parts = spanned(graph.arcs.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    joined = graph.vertices.join(parts, F.col("id") == F.col("node"), "left")
    return joined.select(F.col("id").alias("node"), F.coalesce("part", "id").alias("component"))


def strong_components(graph: Graph) -> DataFrame:
    """node and component, the least node that it reaches and that reaches it."""
    if graph.node_count() <= PAIR_NODES and graph.arrays() is not None:
        reach = pairs(graph).select("source", "node")
        back = reach.select(F.col("node").alias("source"), F.col("source").alias("node"))
        both = reach.join(back, ["source", "node"])
        return both.groupBy(F.col("source").alias("node")).agg(F.min("node").alias("component"))
    found = _colored(graph)
    least = found.groupBy("component").agg(F.min("node").alias("__least"))
    return found.join(least, "component").select("node", F.col("__least").alias("component"))


def _colored(graph: Graph) -> DataFrame:
    """Forward colours (the greatest node that reaches a node), then backward from each colour's own node; what is found leaves, and again."""
    graph.hold()
    left, arcs = settled(graph.vertices.select(F.col("id").alias("node")), "left"), settled(graph.arcs, "arcs")
    found = None
    while not left.isEmpty():
        color = settled(left.select("node", F.col("node").alias("color"), F.lit(True).alias("__up")), "color")
        while not color.filter("__up").isEmpty():
            sent = color.join(arcs, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("__sent"))
            after = color.select("node", "color").join(sent, "node", "left")
            after = settled(after.select("node", F.greatest("color", F.coalesce("__sent", "color")).alias("color"), F.coalesce(F.col("__sent") > F.col("color"), F.lit(False)).alias("__up")), "color")
            discard(color)
            color = after
        own = color.select("node", "color")
        to = arcs.select(F.col("dst").alias("node"), F.col("src").alias("__to"))
        back = settled(own.filter("node = color").withColumn("__new", F.lit(True)), "back")
        while not back.filter("__new").isEmpty():
            step = back.filter("__new").join(to, "node").select(F.col("__to").alias("node"), "color").join(own, ["node", "color"], "left_semi").distinct()
            fresh = step.join(back, ["node", "color"], "left_anti").withColumn("__new", F.lit(True))
            after = settled(back.withColumn("__new", F.lit(False)).union(fresh), "back")
            discard(back)
            back = after
        strong = back.select("node", F.col("color").alias("component"))
        more = settled(strong if found is None else found.union(strong), "strong")
        rest = settled(left.join(more, "node", "left_anti"), "left")
        kept = arcs.join(rest.withColumnRenamed("node", "src"), "src", "left_semi").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
        fewer = settled(kept, "arcs")
        for old in (color, back, left, arcs, *([] if found is None else [found])):
            discard(old)
        found, left, arcs = more, rest, fewer
    return found if found is not None else graph.vertices.select(F.col("id").alias("node"), F.col("id").alias("component"))
