"""Graphs derived from whole tables. Each is one SQL text for DuckDB; Spark runs the same text, but for the pages, whose targets it numbers in ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.arcs import numbered, symmetrized
from wayfare.operators.traversal import Graph

_LEAD = "SELECT DISTINCT a, b FROM (SELECT {0} AS a, lead({0}) OVER (PARTITION BY {1} ORDER BY {2}) AS b FROM {3}) t WHERE b IS NOT NULL AND a <> b"
_LINES = "l_linenumber, l_partkey, l_suppkey"
_HREF = '<a href="(/[^"]*)"'
#: Tables and SQL of the arcs (a, b) of each graph.
ARCS = {
    # parts, and suppliers, that follow each other in an order
    "part_next": (["lineitem"], _LEAD.format("l_partkey", "l_orderkey", _LINES, "{lineitem}")),
    "supp_next": (["lineitem"], _LEAD.format("l_suppkey", "l_orderkey", _LINES, "{lineitem}")),
    # suppliers and the parts that they deliver
    "supp_part": (["lineitem"], "SELECT DISTINCT l_suppkey AS a, 1000000000 + l_partkey AS b FROM {lineitem}"),
    "geo": (
        ["region", "nation", "supplier", "customer"],
        "SELECT r_regionkey AS a, 100 + n_nationkey AS b FROM {region} JOIN {nation} ON n_regionkey = r_regionkey UNION ALL SELECT 100 + n_nationkey, 1000000000 + s_suppkey FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey UNION ALL SELECT 100 + n_nationkey, 2000000000 + c_custkey FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey",
    ),
    # users whose events follow each other in the same minute
    "user_next": (["events"], _LEAD.format("user_id", "date_trunc('minute', ts)", "ts, event_id", "{events}")),
    # pages and what they link to
    "pages": (["pages"], f"SELECT DISTINCT page_id AS a, 1000000000 + dense_rank() OVER (ORDER BY u) AS b FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS u FROM {{pages}}) t"),
}


def duckdb_arcs(name: str) -> str:
    tables, text = ARCS[name]
    return text.format(**{t: t for t in tables})


def arcs_of(spark: SparkSession, sf_dir: str, name: str, once: bool = True) -> DataFrame:
    """The graph's arcs src, dst as derived, in one direction; each once, unless that comes later. No view of the session is touched."""
    tables, text = ARCS[name]
    if not once:
        text = text.replace("SELECT DISTINCT a, b ", "SELECT a, b ")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if name == "pages":
        links = frames["pages"].select(F.col("page_id").alias("a"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("u")).distinct()
        targets = numbered(links.select("u").distinct(), ["u"], "n")
        found = links.join(targets, "u").select("a", (F.col("n") + 1000000001).alias("b"))
    else:
        found = spark.sql(text, **frames)
    return found.select(F.col("a").cast("bigint").alias("src"), F.col("b").cast("bigint").alias("dst"))


def graph_of(spark: SparkSession, sf_dir: str, name: str, directed: bool = False) -> Graph:
    arcs = arcs_of(spark, sf_dir, name, directed)
    return Graph(arcs.distinct() if directed else symmetrized(arcs.filter("src <> dst")), symmetric=not directed)
