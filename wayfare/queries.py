"""Queries over graphs derived from the tables, one for each operator, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import arcs as etl
from wayfare.functions.measures import measures, normalized, visited
from wayfare.graphs import arcs_of, duckdb_arcs, graph_of
from wayfare.operators import ranking, structure
from wayfare.operators.traversal import Graph, frontier_pairs, histogram, pairs
from wayfare.plans.estimation import Estimate, coefficient, estimate, estimate_errors, estimated_closeness, first_count
from wayfare.plans.threshold import BLOCK, exact_closeness, sweep, threshold_top
from wayfare.sources import files
from wayfare.sources.shared import new_dir
from wayfare.streaming.progressive import snapshot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL parts -------------------------------------------------------------------------------------------------------


def graph_sql(name: str, directed: bool = False) -> str:
    """Tables e0 (arcs as derived), e (arcs a, b) and v (nodes n)."""
    arcs = "e AS (SELECT DISTINCT a, b FROM e0)" if directed else "e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b)"
    return f"e0 AS (SELECT a::BIGINT AS a, b::BIGINT AS b FROM ({duckdb_arcs(name)}) x), {arcs}, v AS (SELECT a AS n FROM e UNION SELECT b FROM e)"


def bfs_sql(name: str, directed: bool = False) -> str:
    """Also bfs (s, n, d): all distances."""
    return f"""WITH RECURSIVE {graph_sql(name, directed)}, bfs(s, n, d) USING KEY (s, n) AS (
      SELECT n, n, 0 FROM v UNION SELECT f.s, e.b, f.d + 1 FROM bfs f JOIN e ON e.a = f.n
      WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.s = f.s AND r.n = e.b))"""


def measures_sql(name: str, directed: bool = False) -> str:
    """Also m: every measure of every node."""
    return f"""{bfs_sql(name, directed)}, m0 AS (SELECT s AS node, sum(d)::BIGINT AS farness, coalesce(sum(1e0 / d) FILTER (WHERE d > 0), 0e0) AS harmonic,
      coalesce(sum(pow(0.5e0, d)) FILTER (WHERE d > 0), 0e0) AS exponential, count(*)::BIGINT AS reachable FROM bfs GROUP BY s),
      m1 AS (SELECT *, CASE WHEN farness > 0 THEN 1e0 / farness ELSE 0e0 END AS closeness FROM m0),
      m AS (SELECT node, farness, closeness, CASE WHEN farness > 0 THEN reachable::DOUBLE * reachable * closeness ELSE 1e0 END AS lin, round(harmonic, 9) AS harmonic, exponential, reachable FROM m1)"""


def portable_draw(node: Column, seed: int) -> Column:
    """A draw that both engines can make."""
    return ((node * F.lit(2654435761) + F.lit(seed)) % F.lit(4294967296)) / F.lit(4294967296.0)


def draw_sql(node: str, seed: int) -> str:
    return f"((({node} * 2654435761 + {seed}) % 4294967296) / 4294967296e0)"


FIRST_SEED, SAMPLE_SEED = 12345, 987654321


def estimate_sql(name: str, first: int = FIRST_SEED, sample: int = SAMPLE_SEED) -> str:
    """Also i (first nodes n), w (n, weight, p), q (sampled n, p) and f (n, estimate)."""
    return f"""{bfs_sql(name)}, c AS (SELECT count(*) AS n FROM v), i AS (SELECT v.n FROM v, c
      QUALIFY row_number() OVER (ORDER BY {draw_sql('v.n', first)}, v.n) <= least(c.n, greatest(floor(log2(c.n)), 2))),
      t AS (SELECT s, sum(d) AS total FROM bfs WHERE s IN (SELECT n FROM i) GROUP BY s HAVING sum(d) > 0),
      r AS (SELECT bfs.n, max(d / total::DOUBLE) AS share FROM bfs JOIN t USING (s) GROUP BY bfs.n),
      w AS (SELECT v.n, greatest(1e0 / c.n, coalesce(share, 0e0)) AS weight, least(1e0, ceil(ln(c.n) / (0.1e0 * 0.1e0)) * greatest(1e0 / c.n, coalesce(share, 0e0))) AS p FROM c, v LEFT JOIN r ON r.n = v.n),
      q AS (SELECT n, p FROM w WHERE {draw_sql('n', sample)} < p),
      f AS (SELECT v.n, coalesce(x.total, 0e0) AS estimate FROM v LEFT JOIN (SELECT bfs.n, sum(d / p) AS total FROM bfs JOIN q ON q.n = bfs.s GROUP BY bfs.n) x ON x.n = v.n)"""


def searches_sql(name: str, first: int = FIRST_SEED, sample: int = SAMPLE_SEED) -> str:
    """Also z (nodes n with bound and place, whether known), and h (g places searched, enough: nodes certain then, fresh: searches made for them)."""
    return f"""{estimate_sql(name, first, sample)},
      u AS (SELECT s AS n, sum(d)::BIGINT AS far, count(*) AS size, bool_or(n IN (SELECT n FROM i)) AS has_first FROM bfs GROUP BY s),
      k AS (SELECT n FROM i UNION SELECT n FROM q), g AS (SELECT a AS n, count(*) AS degree FROM e GROUP BY a),
      y AS (SELECT u.n, far, u.n IN (SELECT n FROM k) AS known, round(greatest((2 * (size - 1) - degree)::DOUBLE, CASE WHEN has_first THEN estimate / 1.1e0 ELSE 0e0 END), 6) AS bound
        FROM u JOIN g ON g.n = u.n JOIN f ON f.n = u.n WHERE size > 1),
      z AS (SELECT *, row_number() OVER (ORDER BY bound, n) AS place FROM y),
      grid AS (SELECT DISTINCT least({BLOCK} * (1::BIGINT << j), (SELECT count(*) FROM z)) AS g FROM range(0, 40) t(j)),
      x AS (SELECT g, (SELECT min(bound) FROM z WHERE place > g AND NOT known) AS least FROM grid),
      h AS (SELECT g, least, (SELECT count(*) FROM z WHERE (known OR place <= g) AND (least IS NULL OR far < least)) AS enough,
        (SELECT count(*) FROM z WHERE NOT known AND place <= g) AS fresh FROM x)"""


def made(graph: Graph) -> Estimate:
    node = F.col("node")
    return estimate(graph, first_u=portable_draw(node, FIRST_SEED), sample_u=portable_draw(node, SAMPLE_SEED))


# --- transforms ------------------------------------------------------------------------------------------------------


@query(f"WITH {graph_sql('user_next')} SELECT a AS src, b AS dst FROM e")
def symmetrized_arcs(spark, sf_dir):
    return etl.symmetrized(arcs_of(spark, sf_dir, "user_next"))


@query(f"WITH {graph_sql('user_next', True)} SELECT b AS src, a AS dst FROM e")
def transpose_arcs(spark, sf_dir):
    return etl.transposed(arcs_of(spark, sf_dir, "user_next"))


@query(f"WITH {graph_sql('supp_part')} SELECT a AS node, count(*)::BIGINT AS degree FROM e GROUP BY a")
def outdegree(spark, sf_dir):
    return structure.degrees(graph_of(spark, sf_dir, "supp_part"))


@query(f"WITH {graph_sql('user_next')} SELECT row_number() OVER (ORDER BY count(*) DESC, a) AS rank, a AS node, count(*)::BIGINT AS degree FROM e GROUP BY a")
def degree_schedule(spark, sf_dir):
    return ranking.by_degree(structure.degrees(graph_of(spark, sf_dir, "user_next"))).select("rank", "node", "degree")


#: Raw lines as arc lists may hold them: some with a dot, with one number only, with further ones, with a sign.
_LINES = "SELECT l_orderkey * 100000 + l_linenumber * 1000 + l_partkey % 1000 AS line_no, CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN concat(l_suppkey, '.5 ', l_partkey) WHEN 1 THEN concat(l_suppkey, '  -', l_partkey) WHEN 2 THEN concat(' ', l_suppkey, ' ', l_partkey, ' 7') WHEN 3 THEN concat(l_suppkey, '') ELSE concat(l_suppkey + 1, ' ', l_partkey + 1) END AS value FROM {lineitem}"
_PARSED = f"x AS (SELECT line_no, string_split_regex(trim(value), '\\s+') AS p FROM ({_LINES.format(lineitem='lineitem')}) l WHERE NOT contains(value, '.')), y AS (SELECT line_no, p[1]::BIGINT AS src, abs(p[2]::BIGINT) AS dst FROM x WHERE len(p) > 1)"


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines, written as text and read back; line_no comes along where the order matters."""
    return spark.sql(_LINES, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@query(f"WITH {_PARSED}, z AS (SELECT DISTINCT src, dst FROM y) SELECT src - k AS src, dst - k AS dst FROM z, (SELECT CASE WHEN min(least(src, dst)) = 1 THEN 1 ELSE 0 END AS k FROM z)")
def clean_arcs(spark, sf_dir):
    path = new_dir(spark, "lines")
    raw_lines(spark, sf_dir).select("value").write.text(path)
    return etl.cleaned(spark.read.text(path))


@query(f"WITH {_PARSED} SELECT src, dst, count(*)::BIGINT AS n FROM y GROUP BY ALL HAVING count(*) > 1")
def duplicate_arcs(spark, sf_dir):
    return etl.duplicates(raw_lines(spark, sf_dir))


@query(f"WITH {_PARSED}, z AS (SELECT src AS raw_id, 2 * line_no AS pos FROM y UNION ALL SELECT dst, 2 * line_no + 1 FROM y) SELECT raw_id, row_number() OVER (ORDER BY min(pos), raw_id) - 1 AS id FROM z GROUP BY raw_id")
def dense_ids(spark, sf_dir):
    return etl.dense_ids(raw_lines(spark, sf_dir))


@query(f"WITH {_PARSED}, z AS (SELECT src AS raw_id, 2 * line_no AS pos FROM y UNION ALL SELECT dst, 2 * line_no + 1 FROM y), i AS (SELECT raw_id, row_number() OVER (ORDER BY min(pos), raw_id) - 1 AS id FROM z GROUP BY raw_id) SELECT DISTINCT a.id AS src, b.id AS dst FROM y JOIN i a ON a.raw_id = src JOIN i b ON b.raw_id = dst")
def dense_arcs(spark, sf_dir):
    lines = raw_lines(spark, sf_dir)
    return etl.with_dense_ids(etl.parsed(lines.select("value")), etl.dense_ids(lines))


# --- structure -------------------------------------------------------------------------------------------------------


@query(f"WITH {graph_sql('geo')} SELECT count(*)::BIGINT AS nodes FROM v")
def num_nodes(spark, sf_dir):
    return graph_of(spark, sf_dir, "geo").vertices.agg(F.count("*").alias("nodes"))


@query(f"{bfs_sql('pages')} SELECT s AS node, min(n) AS component FROM bfs GROUP BY s")
def component_labels(spark, sf_dir):
    return structure.components(graph_of(spark, sf_dir, "pages"))


@query(f"{bfs_sql('pages')} SELECT count(DISTINCT c)::BIGINT AS components FROM (SELECT min(n) AS c FROM bfs GROUP BY s)")
def component_count(spark, sf_dir):
    return structure.components(graph_of(spark, sf_dir, "pages")).agg(F.countDistinct("component").alias("components"))


@query(f"{bfs_sql('user_next', True)} SELECT count(DISTINCT c)::BIGINT AS components FROM (SELECT x.s, min(x.n) AS c FROM bfs x JOIN bfs y ON x.s = y.n AND x.n = y.s GROUP BY x.s)")
def scc_count_directed(spark, sf_dir):
    return structure.strong_components(graph_of(spark, sf_dir, "user_next", True)).agg(F.countDistinct("component").alias("components"))


# --- traversal -------------------------------------------------------------------------------------------------------


@query(f"{bfs_sql('user_next')} SELECT s AS source, n AS node, d::INTEGER AS dist FROM bfs")
def bfs_pairs(spark, sf_dir):
    return pairs(graph_of(spark, sf_dir, "user_next"))


@query(f"{bfs_sql('user_next')} SELECT s AS source, n AS node, d::INTEGER AS dist FROM bfs")
def bfs_frontier(spark, sf_dir):
    graph = Graph(graph_of(spark, sf_dir, "user_next").arcs, kernel_arcs=-1)
    return frontier_pairs(graph)


@query(f"{bfs_sql('user_next', True)} SELECT s AS source, d::INTEGER AS dist, count(*)::BIGINT AS cnt FROM bfs GROUP BY ALL")
def level_histogram_distributed(spark, sf_dir):
    return histogram(Graph(graph_of(spark, sf_dir, "user_next", True).arcs, kernel_arcs=-1), arcs=False).select("source", "dist", "cnt")


@query(f"{bfs_sql('user_next', True)}, x AS (SELECT x.s, min(x.n) AS c FROM bfs x JOIN bfs y ON x.s = y.n AND x.n = y.s GROUP BY x.s) SELECT s AS node, c AS component FROM x")
def scc_labels_distributed(spark, sf_dir):
    return structure.strong_components(Graph(graph_of(spark, sf_dir, "user_next", True).arcs, kernel_arcs=-1))


@query(f"{bfs_sql('pages')} SELECT s AS source, d::INTEGER AS dist, count(*)::BIGINT AS cnt FROM bfs GROUP BY ALL")
def level_histogram(spark, sf_dir):
    return histogram(graph_of(spark, sf_dir, "pages"), arcs=False).select("source", "dist", "cnt")


@query(f"{bfs_sql('geo')} SELECT max(d)::INTEGER AS diameter FROM bfs")
def diameter(spark, sf_dir):
    return histogram(graph_of(spark, sf_dir, "geo"), arcs=False).agg(F.max("dist").alias("diameter"))


# --- measures --------------------------------------------------------------------------------------------------------


def _measured(spark, sf_dir, name: str, directed: bool = False, transpose: bool = False) -> DataFrame:
    graph = graph_of(spark, sf_dir, name, directed)
    if transpose:
        graph = Graph(etl.transposed(graph.arcs))
    return measures(histogram(graph, arcs=False)).withColumn("harmonic", F.round("harmonic", 9))


@query(f"{measures_sql('part_next')} SELECT node, farness FROM m")
def farness(spark, sf_dir):
    return _measured(spark, sf_dir, "part_next").select("node", "farness")


@query(f"{measures_sql('geo')} SELECT node, closeness FROM m")
def closeness(spark, sf_dir):
    return _measured(spark, sf_dir, "geo").select("node", "closeness")


@query(f"{measures_sql('pages')} SELECT node, lin FROM m")
def lin(spark, sf_dir):
    return _measured(spark, sf_dir, "pages").select("node", "lin")


@query(f"{measures_sql('pages')} SELECT node, harmonic FROM m")
def harmonic(spark, sf_dir):
    return _measured(spark, sf_dir, "pages").select("node", "harmonic")


@query(f"{measures_sql('geo')} SELECT node, exponential FROM m")
def exponential(spark, sf_dir):
    return _measured(spark, sf_dir, "geo").select("node", "exponential")


@query(f"{measures_sql('pages')} SELECT node, reachable FROM m")
def reachable(spark, sf_dir):
    return _measured(spark, sf_dir, "pages").select("node", "reachable")


@query(f"{measures_sql('user_next')} SELECT * FROM m")
def all_measures(spark, sf_dir):
    return _measured(spark, sf_dir, "user_next")


@query(f"{bfs_sql('user_next')}, g AS (SELECT a, count(*) AS k FROM e GROUP BY a) SELECT (SELECT count(*) FROM bfs WHERE d > 0)::BIGINT AS visited_nodes, (SELECT sum(k) FROM bfs JOIN g ON g.a = bfs.n)::BIGINT AS visited_arcs")
def visited_counts(spark, sf_dir):
    return visited(histogram(graph_of(spark, sf_dir, "user_next")))


@query(f"{measures_sql('user_next', True)} SELECT * FROM m")
def measures_directed(spark, sf_dir):
    return _measured(spark, sf_dir, "user_next", True)


@query(measures_sql("user_next", True).replace("e AS (SELECT DISTINCT a, b FROM e0)", "e AS (SELECT DISTINCT b AS a, a AS b FROM e0)") + " SELECT node, closeness FROM m")
def closeness_transpose(spark, sf_dir):
    return _measured(spark, sf_dir, "user_next", True, True).select("node", "closeness")


@query(f"{measures_sql('user_next')} SELECT node, CASE WHEN farness > 0 THEN ((SELECT count(*) FROM v) - 1)::DOUBLE / farness END AS normalized FROM m")
def normalized_closeness(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "user_next")
    scores = measures(histogram(graph, arcs=False))
    return scores.select("node", normalized(F.col("farness"), graph.node_count()).alias("normalized"))


# --- ranking ---------------------------------------------------------------------------------------------------------


@query(f"{measures_sql('geo')} SELECT * FROM (SELECT node, closeness, rank() OVER (ORDER BY closeness DESC)::INTEGER AS rank FROM m) WHERE rank <= 20")
def exact_topk_ties(spark, sf_dir):
    return ranking.top_with_ties(exact_closeness(graph_of(spark, sf_dir, "geo")), 20)


@query(f"{measures_sql('pages')} SELECT node, closeness, row_number() OVER (ORDER BY closeness DESC, node) AS rank FROM m")
def ground_truth_rank(spark, sf_dir):
    return ranking.by_closeness(exact_closeness(graph_of(spark, sf_dir, "pages")))


@query(f"WITH {graph_sql('user_next')} SELECT n AS node, row_number() OVER (ORDER BY {draw_sql('n', 7)}, n) AS rank FROM v")
def random_schedule(spark, sf_dir):
    nodes = graph_of(spark, sf_dir, "user_next").vertices.select(F.col("id").alias("node"))
    return ranking.shuffled(nodes, portable_draw(F.col("node"), 7))


@query(f"WITH {graph_sql('pages')}, g AS (SELECT a AS n, count(*) AS k FROM e GROUP BY a), x AS (SELECT k, lag(k) OVER (ORDER BY n) AS before FROM g) SELECT (count(*) FILTER (WHERE k > before))::BIGINT AS inversions FROM x")
def sortedness_check(spark, sf_dir):
    return ranking.inversions(structure.degrees(graph_of(spark, sf_dir, "pages")), ["node"], "degree")


@query(f"{measures_sql('pages')}, r AS (SELECT node, closeness, row_number() OVER (ORDER BY closeness DESC, node) AS rank FROM m), x AS (SELECT closeness, lag(closeness) OVER (ORDER BY rank) AS before FROM r) SELECT (count(*) FILTER (WHERE closeness > before))::BIGINT AS inversions FROM x")
def ranking_is_sorted(spark, sf_dir):
    return ranking.inversions(ranking.by_closeness(exact_closeness(graph_of(spark, sf_dir, "pages"))), ["rank"], "closeness")


@query(f"{measures_sql('pages')} SELECT node, farness, row_number() OVER (ORDER BY farness, node) AS rank FROM m")
def farness_rank(spark, sf_dir):
    return ranking.by_farness(_measured(spark, sf_dir, "pages").select("node", "farness"))


# --- estimation ------------------------------------------------------------------------------------------------------


@query(f"{estimate_sql('part_next')} SELECT n AS node, round(weight, 12) AS weight, round(p, 9) AS p FROM w")
def weights_and_probabilities(spark, sf_dir):
    return made(graph_of(spark, sf_dir, "part_next")).weights.select("node", F.round("weight", 12).alias("weight"), F.round("p", 9).alias("p"))


@query(f"{estimate_sql('part_next')} SELECT n AS node, round(p, 9) AS p FROM q")
def sample_nodes(spark, sf_dir):
    return made(graph_of(spark, sf_dir, "part_next")).sample.select("node", F.round("p", 9).alias("p"))


@query(f"{estimate_sql('part_next')} SELECT n AS node, round(estimate, 6) AS estimate, n IN (SELECT n FROM i) OR n IN (SELECT n FROM q) AS exact FROM f")
def ht_farness(spark, sf_dir):
    return made(graph_of(spark, sf_dir, "part_next")).farness.select("node", F.round("estimate", 6).alias("estimate"), "exact")


@query(f"{estimate_sql('user_next')} SELECT n AS node, round(estimate, 6) AS estimate FROM f")
def ht_farness_exact(spark, sf_dir):
    return made(graph_of(spark, sf_dir, "user_next")).farness.select("node", F.round("estimate", 6).alias("estimate"))


@query(f"{estimate_sql('part_next')} SELECT (count(*) FILTER (WHERE abs(estimate - far) > 0.1e0 * far))::BIGINT AS over_eps, round(max(abs(estimate - far) / far), 6) AS worst FROM f JOIN (SELECT s, sum(d)::DOUBLE AS far FROM bfs GROUP BY s HAVING sum(d) > 0) x ON x.s = f.n")
def estimate_error(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "part_next")
    errors = estimate_errors(graph, made(graph))
    return errors.agg(F.coalesce(F.sum(F.when(F.col("error") > 0.1, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("over_eps"), F.round(F.max("error"), 6).alias("worst"))


@query(f"WITH {graph_sql('part_next')}, c AS (SELECT count(*) AS n FROM v) SELECT n::BIGINT AS nodes, ceil(ln(n) / (0.1e0 * 0.1e0))::INTEGER AS coefficient, least(n, greatest(floor(log2(n)), 2))::INTEGER AS first_sources FROM c")
def sampling_parameters(spark, sf_dir):
    n = graph_of(spark, sf_dir, "part_next").node_count()
    return spark.range(1).select(F.lit(n).cast("bigint").alias("nodes"), F.lit(coefficient(n)).alias("coefficient"), F.lit(first_count(n)).alias("first_sources"))


# --- top k by threshold, progressive ---------------------------------------------------------------------------------


def _top_sql(name: str, k: int) -> str:
    return f"{measures_sql(name)} SELECT * FROM (SELECT node, closeness, rank() OVER (ORDER BY closeness DESC)::INTEGER AS rank FROM m) WHERE rank <= {k}"


@query(_top_sql("part_next", 20))
def threshold_topk(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "part_next")
    return threshold_top(graph, 20, made(graph)).top


@query(_top_sql("supp_next", 40))
def threshold_topk_dense(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "supp_next")
    return threshold_top(graph, 40, made(graph)).top


@query(_top_sql("pages", 20))
def threshold_topk_disconnected(spark, sf_dir):
    return threshold_top(graph_of(spark, sf_dir, "pages"), 20).top


@query(f"{searches_sql('part_next')}, j AS (SELECT min(g) AS g FROM h WHERE enough >= 20 OR least IS NULL), o AS (SELECT (SELECT count(*) FROM i) + (SELECT count(*) FROM q) AS apx) SELECT 20::INTEGER AS k, (apx + j.g)::BIGINT AS total_bfs, ((SELECT count(*) FROM k) + h.fresh)::BIGINT AS distinct_bfs, apx::BIGINT AS apx_bfs FROM o, j JOIN h ON h.g = j.g")
def bfs_accounting(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "part_next")
    found = threshold_top(graph, 20, made(graph))
    numbers = {"total_bfs": found.total_searches, "distinct_bfs": found.distinct_searches, "apx_bfs": found.estimate_searches}
    return spark.range(1).select(F.lit(20).alias("k"), *[F.lit(n).cast("bigint").alias(c) for c, n in numbers.items()])


#: The sizes of answers that a sweep asks for, and its rounds' seeds.
SWEEP_KS = [1, *range(20, 2001, 20)]
ROUNDS = [(FIRST_SEED, SAMPLE_SEED), (4321, 192837465)]


def _round_sql(first: int, sample: int) -> str:
    ks = "SELECT unnest([1] || range(20, 2001, 20)) AS want"
    return f"""SELECT * FROM ({searches_sql('pages', first, sample)}, o AS (SELECT (SELECT count(*) FROM i) + (SELECT count(*) FROM q) AS apx),
      j AS (SELECT want, (SELECT min(g) FROM h WHERE enough >= want OR least IS NULL) AS g FROM ({ks}))
      SELECT want::INTEGER AS k, apx + j.g AS total, apx, (SELECT count(*) FROM k) + h.fresh AS made FROM o, j JOIN h ON h.g = j.g)"""


_RUNS = " UNION ALL ".join(_round_sql(*r) for r in ROUNDS)


@query(f"SELECT k, avg(total) AS avg_bfs, avg(apx) AS avg_bfs_apx, avg(made) AS avg_bfs_made FROM ({_RUNS}) GROUP BY k")
def topk_sweep(spark, sf_dir):
    node = F.col("node")
    return sweep(graph_of(spark, sf_dir, "pages"), SWEEP_KS, [(portable_draw(node, a), portable_draw(node, b)) for a, b in ROUNDS])


@query(f"{estimate_sql('part_next')}, m AS (SELECT s AS n, sum(d)::BIGINT AS far FROM bfs GROUP BY s), a AS (SELECT n FROM m QUALIFY rank() OVER (ORDER BY far) <= 20), b AS (SELECT n FROM f QUALIFY row_number() OVER (ORDER BY round(estimate, 6), n) <= 20) SELECT least(count(*), 20)::BIGINT AS hits, least(count(*), 20) / 20e0 AS precision FROM a JOIN b USING (n)")
def precision_at_k(spark, sf_dir):
    graph = graph_of(spark, sf_dir, "part_next")
    guessed = estimated_closeness(made(graph)).select("node", F.round(1 / F.col("closeness"), 6).alias("estimate"))
    first = ranking.by_farness(guessed, "estimate").filter("rank <= 20")
    return ranking.precision_at_k(first, ranking.top_with_ties(exact_closeness(graph), 20), 20)


@query(f"{estimate_sql('part_next')} SELECT n AS node, round(1e0 / estimate, 12) AS closeness FROM f")
def approximate_closeness(spark, sf_dir):
    found = estimated_closeness(made(graph_of(spark, sf_dir, "part_next")))
    return found.select("node", F.round("closeness", 12).alias("closeness"))


def _batches_sql(batches: int) -> str:
    """Snapshots by unrolled steps: o is the order before each batch, p the nodes searched so far."""
    far = "(SELECT sum(d) FROM bfs WHERE s = v.n)"
    out = f"{bfs_sql('user_next')}, o0 AS (SELECT a AS n, row_number() OVER (ORDER BY count(*) DESC, a) AS rank FROM e GROUP BY a)"
    for k in range(batches):
        out += f""", p{k} AS (SELECT n FROM o{k} WHERE rank <= {10 * (k + 1)}),
          o{k + 1} AS (SELECT v.n, row_number() OVER (ORDER BY CASE WHEN v.n IN (SELECT n FROM p{k}) THEN 0 ELSE 1 END,
            CASE WHEN v.n IN (SELECT n FROM p{k}) THEN {far} ELSE coalesce((SELECT sum(d) FROM bfs WHERE bfs.n = v.n AND s IN (SELECT n FROM p{k})), 0) END, v.n) AS rank FROM v)"""
    return out + f" SELECT least({10 * batches}, (SELECT count(*) FROM v))::INTEGER AS processed_count, rank, n AS node FROM o{batches}"


@query(_batches_sql(1))
def progressive_batch1(spark, sf_dir):
    return snapshot(graph_of(spark, sf_dir, "user_next"), 1)


@query(_batches_sql(2))
def progressive_batch2(spark, sf_dir):
    return snapshot(graph_of(spark, sf_dir, "user_next"), 2)


@query(f"{measures_sql('user_next')} SELECT (SELECT count(*) FROM v)::INTEGER AS processed_count, row_number() OVER (ORDER BY farness, node) AS rank, node FROM m")
def progressive_full(spark, sf_dir):
    return snapshot(graph_of(spark, sf_dir, "user_next"))


@query(f"{bfs_sql('user_next')}, o AS (SELECT a AS n, row_number() OVER (ORDER BY count(*) DESC, a) AS rank FROM e GROUP BY a), x AS (SELECT v.n, c.k, (SELECT sum(d) FROM bfs WHERE s = v.n) AS far, (SELECT sum(d) FROM bfs WHERE bfs.n = v.n AND s IN (SELECT n FROM o WHERE rank <= 10)) AS est, v.n IN (SELECT n FROM o WHERE rank <= 10) AS done FROM v, (SELECT count(*) AS k FROM v) c), y AS (SELECT n, CASE WHEN done THEN (k - 1)::DOUBLE / far ELSE coalesce((10 * (k - 1))::DOUBLE / (k::DOUBLE * est), 0e0) END AS score FROM x) SELECT n AS node, score, row_number() OVER (ORDER BY score DESC, n DESC) AS rank FROM y")
def merged_schedule(spark, sf_dir):
    from wayfare.streaming.progressive import snapshots

    graph = graph_of(spark, sf_dir, "user_next")
    _, state = next(snapshots(graph))
    state = state.select("node", F.when(F.col("processed"), F.col("farness")).alias("farness"), F.col("estimate").cast("double").alias("estimate"))
    return ranking.merged_order(state, 10, graph.node_count())


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query(f"{measures_sql('user_next')} SELECT node, closeness, farness, row_number() OVER (ORDER BY closeness DESC, node) AS rank FROM m")
def ground_truth_json_roundtrip(spark, sf_dir):
    path = new_dir(spark, "truth")
    files.write_ground_truth(_measured(spark, sf_dir, "user_next"), path)
    return files.read_ground_truth(spark, path)


@query(f"WITH {graph_sql('pages')} SELECT a AS src, b AS dst FROM e")
def arcs_text_roundtrip(spark, sf_dir):
    path = new_dir(spark, "text")
    files.write_arcs_text(graph_of(spark, sf_dir, "pages").arcs, path)
    return files.load_graph(spark, path, text=True)


@query(f"WITH {graph_sql('geo')} SELECT a AS src, b AS dst FROM e")
def arcs_parquet_roundtrip(spark, sf_dir):
    path = new_dir(spark, "arcs")
    files.write_arcs(graph_of(spark, sf_dir, "geo").arcs, path)
    return files.load_graph(spark, path, cache=True)


@query(f"WITH {graph_sql('pages')}, g AS (SELECT a, count(*) AS k FROM e GROUP BY a), x AS (SELECT unnest([10, 2, 33]) AS n) SELECT concat('run', n, '.json') AS name, concat('{{\"degree\":', n, ',\"nodes\":', (SELECT count(*) FROM g WHERE k >= n), '}}') AS content, row_number() OVER (ORDER BY n) AS place FROM x")
def merged_results(spark, sf_dir):
    path, degree = new_dir(spark, "reports"), structure.degrees(graph_of(spark, sf_dir, "pages"))
    for n in (10, 2, 33):
        files.write_report(degree.filter(F.col("degree") >= n).agg(F.lit(n).alias("degree"), F.count("*").alias("nodes")), path, f"run{n}")
    found = files.merged_reports(spark, path)
    return ranking.ranked(found, ["number", "name"], "place").select("name", "content", "place")


@query(f"WITH {graph_sql('pages')}, g AS (SELECT a, count(*) AS k FROM e GROUP BY a) SELECT concat('[', string_agg(concat('{{\"degree\":', n, ',\"nodes\":', (SELECT count(*) FROM g WHERE k >= n), '}}'), ', ' ORDER BY n), ']') AS merged FROM (SELECT unnest([10, 2, 33]) AS n)")
def merged_array(spark, sf_dir):
    path, target, degree = new_dir(spark, "reports"), new_dir(spark, "merged"), structure.degrees(graph_of(spark, sf_dir, "pages"))
    for n in (10, 2, 33):
        files.write_report(degree.filter(F.col("degree") >= n).agg(F.lit(n).alias("degree"), F.count("*").alias("nodes")), path, f"run{n}")
    files.write_merged(spark, path, target)
    return spark.read.text(target).select(F.col("value").alias("merged"))


@query(f"WITH {_PARSED}, z AS (SELECT DISTINCT src, dst FROM y), c AS (SELECT src - k AS src, dst - k AS dst FROM z, (SELECT CASE WHEN min(least(src, dst)) = 1 THEN 1 ELSE 0 END AS k FROM z)) SELECT concat(src, ' ', dst) AS line, row_number() OVER (ORDER BY src, dst) AS place FROM c")
def cleaned_text(spark, sf_dir):
    """Lines as written, with their places: files in order of their names, lines in order in each."""
    path = new_dir(spark, "cleaned")
    files.write_cleaned(raw_lines(spark, sf_dir), path)
    found = spark.read.text(path).select(F.col("value").alias("line"), "_metadata.file_name", F.monotonically_increasing_id().alias("at"))
    return ranking.ranked(found, ["file_name", "at"], "place").select("line", "place")


@query(f"WITH {graph_sql('user_next')}, r AS (SELECT max(n) AS top FROM v) SELECT (top + 1)::BIGINT AS nodes, (top + 1 - (SELECT count(*) FROM v))::BIGINT AS isolated FROM r")
def isolated_text_nodes(spark, sf_dir):
    path = new_dir(spark, "text")
    arcs = graph_of(spark, sf_dir, "user_next").arcs
    files.write_arcs_text(arcs, path)
    degree = structure.degrees(files.open_graph(spark, path, text=True))
    return degree.agg(F.count("*").alias("nodes"), F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).cast("bigint").alias("isolated"))


@query(f"SELECT k, avg(total) AS avg_bfs, avg(apx) AS avg_bfs_apx FROM ({_RUNS}) GROUP BY k")
def experiment_roundtrip(spark, sf_dir):
    path = new_dir(spark, "experiment")
    files.write_experiment(topk_sweep(spark, sf_dir), path)
    return files.read_experiment(spark, path)


@query(_batches_sql(2))
def snapshot_roundtrip(spark, sf_dir):
    path = new_dir(spark, "snapshots")
    files.write_snapshots(snapshot(graph_of(spark, sf_dir, "user_next"), 2), path)
    return files.read_snapshots(spark, path)


@query(f"{measures_sql('user_next')}, r AS (SELECT row_number() OVER (ORDER BY node) - 1 AS node, closeness, farness FROM m) SELECT *, row_number() OVER (ORDER BY closeness DESC, node) AS rank FROM r")
def ground_truth_array_roundtrip(spark, sf_dir):
    path = new_dir(spark, "truth")
    scores = _measured(spark, sf_dir, "user_next").select("node", "closeness", "farness")
    files.write_ground_truth_arrays(ranking.ranked(scores, ["node"], "n").select((F.col("n") - 1).alias("node"), "closeness", "farness"), path)
    return files.read_ground_truth_arrays(spark, path)


@query(f"{measures_sql('user_next')} SELECT * FROM m")
def scores_parquet_roundtrip(spark, sf_dir):
    path = new_dir(spark, "scores")
    files.write_scores(_measured(spark, sf_dir, "user_next"), path)
    return spark.read.parquet(path)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nodes of greatest closeness, ties included, in the part graph."""
    return ranking.top_with_ties(exact_closeness(graph_of(spark, sf_dir, "part_next")), 10)
