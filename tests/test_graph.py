"""Hand-computed graphs, differential tests and properties."""

import json
import os
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from wayfare.functions import arcs as etl
from wayfare.functions.measures import measures, visited
from wayfare.operators import ranking, structure
from wayfare.operators.traversal import Graph, distance_sums, histogram, pairs
from wayfare.plans.estimation import coefficient, estimate, estimate_errors, first_count
from wayfare.plans.threshold import threshold_top
from wayfare.sources import files
from wayfare.streaming.progressive import all_snapshots, snapshot

PATH5 = [(0, 1), (1, 2), (2, 3), (3, 4)]
CYCLE6 = [(k, (k + 1) % 6) for k in range(6)]
STAR5 = [(0, k) for k in range(1, 5)]


def arcs(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def undirected(spark, rows):
    return Graph(etl.symmetrized(arcs(spark, rows)))


def scores(graph):
    return {r["node"]: tuple(r)[1:] for r in measures(histogram(graph)).collect()}


def close(got, farness, closeness, lin, harmonic, exponential, reachable):
    want = [float(Fraction(x)) for x in (farness, closeness, lin, harmonic, exponential, reachable)]
    assert [float(x) for x in got] == pytest.approx(want)


def test_path(spark):
    g = undirected(spark, PATH5)
    got = scores(g)
    for n in (0, 4):
        close(got[n], 10, "1/10", "5/2", "25/12", "15/16", 5)
    for n in (1, 3):
        close(got[n], 7, "1/7", "25/7", "17/6", "11/8", 5)
    close(got[2], 6, "1/6", "25/6", 3, "3/2", 5)
    assert tuple(visited(histogram(g)).first()) == (20, 40)
    top = ranking.top_with_ties(measures(histogram(g)), 2).collect()
    assert {r["node"] for r in top} == {1, 2, 3}


def test_star_and_cycle(spark):
    got = scores(undirected(spark, STAR5))
    close(got[0], 4, "1/4", "25/4", 4, 2, 5)
    close(got[3], 7, "1/7", "25/7", "5/2", "5/4", 5)
    g = undirected(spark, CYCLE6)
    close(scores(g)[5], 9, "1/9", 4, "10/3", "13/8", 6)
    assert threshold_top(g, 2).top.count() == 6


def test_isolated_node(spark):
    g = Graph(etl.symmetrized(arcs(spark, [(0, 1)])), spark.createDataFrame([(2,)], "id long"))
    close(scores(g)[0], 1, 1, 4, 1, "1/2", 2)
    close(scores(g)[2], 0, 0, 1, 0, 0, 1)


def test_directed_with_loop(spark, kernel_off):
    rows = arcs(spark, [(0, 0), (0, 1), (1, 2)])
    for g in (Graph(rows), kernel_off(rows)):
        got = scores(g)
        close(got[0], 3, "1/3", 3, "3/2", "3/4", 3)
        close(got[1], 1, 1, 4, 1, "1/2", 2)
        close(got[2], 0, 0, 1, 0, 0, 1)
        assert {r["source"]: r["a"] for r in histogram(g).groupBy("source").agg(F.sum("arcs").alias("a")).collect()} == {0: 3, 1: 1, 2: 0}


def test_empty_graph(spark):
    g = Graph(arcs(spark, []))
    assert histogram(g).count() == 0 and structure.components(g).count() == 0 and ranking.top_with_ties(measures(histogram(g)), 3).count() == 0
    assert threshold_top(g, 3).top.count() == 0 and snapshot(g).count() == 0


def test_dirty_lines(spark):
    lines = spark.createDataFrame([(x,) for x in ("1 2 99", "2 -3", "3.5 4", "1 2", "7", "4 1", "")], "value string")
    assert sorted(map(tuple, etl.cleaned(lines).collect())) == [(0, 1), (1, 2), (3, 0)]
    assert [tuple(r) for r in etl.duplicates(lines).collect()] == [(1, 2, 2)]


def test_dense_ids(spark):
    lines = spark.createDataFrame([(0, "10 7"), (1, "7 42"), (2, "10 42")], "line_no long, value string")
    ids = etl.dense_ids(lines)
    assert {r["raw_id"]: r["id"] for r in ids.collect()} == {10: 0, 7: 1, 42: 2}
    assert sorted(map(tuple, etl.with_dense_ids(etl.parsed(lines.select("value")), ids).collect())) == [(0, 1), (0, 2), (1, 2)]


def random_graph(spark, nodes, count, seed):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count)]


def test_kernel_equals_joins(spark, kernel_off):
    rows = etl.symmetrized(arcs(spark, random_graph(spark, 60, 100, 1)).filter("src <> dst"))
    fast, slow = Graph(rows), kernel_off(rows)
    assert sorted(map(tuple, pairs(fast).collect())) == sorted(map(tuple, pairs(slow).select("source", "node", "dist").collect()))
    columns = ["source", "dist", "cnt", "arcs"]
    assert sorted(map(tuple, histogram(fast).select(columns).collect())) == sorted(map(tuple, histogram(slow).select(columns).collect()))
    weights = fast.vertices.filter("id % 3 = 0").withColumn("weight", F.lit(2.0))
    a, b = ({r["node"]: r["total"] for r in distance_sums(g, weights).collect()} for g in (fast, slow))
    assert a == pytest.approx(b)


def test_distributed_search_in_many_sweeps(spark, kernel_off, monkeypatch):
    """Several sweeps, hubs over salts, and no pairs unless they are asked for."""
    from wayfare.operators import traversal

    rows = arcs(spark, random_graph(spark, 90, 300, 11) + [(0, k) for k in range(1, 40)])  # directed, with loops and repeats
    rows = rows.distinct()
    fast = Graph(rows)
    want = {c: sorted(map(tuple, df.collect())) for c, df in (("h", histogram(fast).select("source", "dist", "cnt", "arcs")), ("p", pairs(fast)))}
    weights = fast.vertices.select("id", (F.col("id") % 5 + 0.5).alias("weight"))
    sums = {(r["far"], r["node"]): r["value"] for r in traversal.sums_and_farness(fast, weights).collect()}
    for name, value in (("SWEEP_WORDS", 1), ("SWEEP", 64), ("HUB_ARCS", 3)):
        monkeypatch.setattr(traversal, name, value)
    slow = kernel_off(rows)
    assert slow.spread()[1].count() > 5
    assert sorted(map(tuple, pairs(slow).select("source", "node", "dist").collect())) == want["p"]
    monkeypatch.setattr(traversal, "frontier_pairs", None)
    assert sorted(map(tuple, histogram(slow).select("source", "dist", "cnt", "arcs").collect())) == want["h"]
    got = {(r["far"], r["node"]): r["value"] for r in traversal.sums_and_farness(slow, weights).collect()}
    assert got == pytest.approx(sums) and sum(far for far, _ in got) == fast.node_count()


def test_numbering_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(etl, "RANGE_ROWS", 7)
    rng = random.Random(13)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3, 9]), k, rng.random()) for k in range(200)]
    df = spark.createDataFrame(rows, "g long, k long, x double")
    want, counts = {}, {}
    for g, k, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[k] = counts[g] = counts.get(g, -1) + 1
    assert {r["k"]: r["n"] for r in etl.numbered_within(df, "g", [F.col("k")], "n").collect()} == want
    assert [r["k"] for r in sorted(etl.numbered(df, ["x", "k"], "n").collect(), key=lambda r: r["n"])] == [k for _, k, _ in sorted(rows, key=lambda r: r[2])]
    assert etl.numbered_within(df.limit(0), "g", [F.col("k")], "n").count() == 0


def test_top_with_ties(spark):
    scores = spark.createDataFrame([(k, float(v)) for k, v in enumerate([5, 3, 3, 9, 3, 1, 9])], "node long, closeness double")
    for k, want in ((0, []), (1, [(3, 9.0, 1), (6, 9.0, 1)]), (4, [(0, 5.0, 3), (1, 3.0, 4), (2, 3.0, 4), (3, 9.0, 1), (4, 3.0, 4), (6, 9.0, 1)])):
        assert sorted(map(tuple, ranking.top_with_ties(scores, k).collect())) == want
    assert ranking.top_with_ties(scores, 99).count() == 7


def test_distances_are_metric(spark):
    g = undirected(spark, [x for x in random_graph(spark, 30, 45, 2) if x[0] != x[1]])
    d = {(r["source"], r["node"]): r["dist"] for r in pairs(g).collect()}
    assert all(d[b, a] == k for (a, b), k in d.items())
    assert all(d[a, c] <= k + m for (a, b), k in d.items() for (x, c), m in d.items() if x == b)


def test_components(spark, monkeypatch):
    rows = random_graph(spark, 200, 150, 3) + [(500 + k, 501 + k) for k in range(40)] + [(700, 701 + k) for k in range(30)]
    part = {n: n for e in rows for n in e}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in rows:
        x, y = find(a), find(b)
        part[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in structure.components(Graph(arcs(spark, rows))).collect()}
    assert got == {n: find(n) for n in part}
    monkeypatch.setattr(structure, "HUB_ROWS", 2)  # every node of some neighbours is a hub
    assert {r["node"]: r["component"] for r in structure.components(Graph(arcs(spark, rows))).collect()} == got


def test_strong_components(spark, kernel_off):
    rows = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5), (4, 6)]
    want = [{0, 1, 2}, {3, 4}, {5}, {6}]
    for g in (Graph(arcs(spark, rows)), kernel_off(arcs(spark, rows))):
        groups = {}
        for r in structure.strong_components(g).collect():
            groups.setdefault(r["component"], set()).add(r["node"])
        assert sorted(groups.values(), key=min) == want


def test_strong_components_are_named_alike(spark, kernel_off):
    rows = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5), (4, 6)]
    for g in (Graph(arcs(spark, rows)), kernel_off(arcs(spark, rows))):
        got = {r["node"]: r["component"] for r in structure.strong_components(g).collect()}
        assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}
    assert structure.strong_components(kernel_off(arcs(spark, []))).count() == 0
    many = random_graph(spark, 30, 45, 16)
    both = [sorted(map(tuple, structure.strong_components(g).collect())) for g in (Graph(arcs(spark, many)), kernel_off(arcs(spark, many)))]
    assert both[0] == both[1]


def test_estimator(spark):
    assert (coefficient(10617), first_count(10617), coefficient(1), first_count(1)) == (928, 13, 0, 1)
    g = undirected(spark, [x for x in random_graph(spark, 60, 120, 4) if x[0] != x[1]])
    errors = estimate_errors(g, estimate(g, seed=3)).collect()
    assert max(r["error"] for r in errors) < 1e-9  # every probability is 1 for so few nodes
    loose = [estimate(g, seed=s, eps=1.0) for s in range(12)]
    means = {}
    for made in loose:
        for r in made.farness.collect():
            means[r["node"]] = means.get(r["node"], 0) + r["estimate"] / len(loose)
    far = {r["node"]: r["farness"] for r in errors}
    assert sum(means.values()) == pytest.approx(sum(far.values()), rel=0.25)


def test_threshold_needs_fewer_searches(spark):
    rows = [(k, k + 1) for k in range(700)] + [(350, 1000 + k) for k in range(60)]
    g = undirected(spark, rows)
    found = threshold_top(g, 3)
    exact = ranking.top_with_ties(measures(histogram(g)), 3)
    assert sorted(map(tuple, found.top.collect())) == sorted(map(tuple, exact.collect()))
    assert found.estimate_searches > 0 and found.distinct_searches <= found.total_searches and set(found.seconds) == {"estimate", "schedule", "search"}


def test_threshold_on_many_components(spark):
    """A large component, many small ones and isolated nodes: the answer is exact and most nodes are never searched."""
    from wayfare.plans import threshold

    rng = random.Random(14)
    rows = [(k, (k + d) % 900) for k in range(900) for d in (1, 30)] + [(k, rng.randrange(900)) for k in range(900)]
    rows += [(2000 + 5 * c + a, 2000 + 5 * c + b) for c in range(40) for a in range(5) for b in range(a)]
    g = Graph(etl.symmetrized(arcs(spark, [x for x in rows if x[0] != x[1]])), spark.range(5000, 5020))
    found = threshold_top(g, 3, eps=0.5)
    exact = ranking.top_with_ties(measures(histogram(g)), 3)
    assert sorted(map(tuple, found.top.collect())) == sorted(map(tuple, exact.collect())) and found.top.count() == 200
    assert found.distinct_searches < g.node_count() - 300
    whole = threshold_top(g, 5000, eps=0.5)
    assert whole.top.count() == g.node_count()
    runs = {r["k"]: r for r in threshold.sweep(g, [1, 20, 4000], [1, 2], eps=0.5).collect()}
    assert runs[1]["avg_bfs"] <= runs[20]["avg_bfs"] <= runs[4000]["avg_bfs"] and runs[4000]["avg_bfs_made"] == g.node_count() - 20


def test_known_nodes_are_not_searched_again(spark, monkeypatch):
    from wayfare.plans import threshold

    g = undirected(spark, [x for x in random_graph(spark, 60, 150, 15) if x[0] != x[1]])
    made = estimate(g)  # every node is sampled
    far = {r["node"]: r["farness"] for r in made.known.collect()}
    assert far == {k: v[0] for k, v in scores(g).items()}
    searched = []
    plain = threshold.exact_farness
    monkeypatch.setattr(threshold, "exact_farness", lambda graph, sources: searched.append(sources.count()) or plain(graph, sources))
    found = threshold_top(g, 4, made)
    assert sum(searched) == 0 and found.distinct_searches == g.node_count() < found.total_searches


def test_progressive(spark):
    g = undirected(spark, [x for x in random_graph(spark, 25, 40, 5) if x[0] != x[1]])
    shots = all_snapshots(g)
    n = g.node_count()
    assert shots.groupBy("processed_count").count().filter(F.col("count") != n).isEmpty()
    last = [r["node"] for r in shots.filter(F.col("processed_count") == n).orderBy("rank").collect()]
    far = {k: v[0] for k, v in scores(g).items()}
    assert last == sorted(far, key=lambda k: (far[k], k))


def test_files(spark, tmp_path):
    g = undirected(spark, PATH5)
    files.write_arcs_text(g.arcs, f"{tmp_path}/t")
    assert sorted(map(tuple, files.load_graph(spark, f"{tmp_path}/t", text=True).collect())) == sorted(map(tuple, g.arcs.collect()))
    assert files.text_vertices(spark, arcs(spark, [(0, 5)])).count() == 6
    found = measures(histogram(g))
    files.write_ground_truth_arrays(found, f"{tmp_path}/truth")
    back = {r["node"]: (r["closeness"], r["farness"], r["rank"]) for r in files.read_ground_truth_arrays(spark, f"{tmp_path}/truth").collect()}
    assert back[2] == (1 / 6, 6, 1) and back[0][2] == 4
    for name in ("r10", "r9"):
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        with open(f"{tmp_path}/in/{name}.json", "w") as f:
            f.write('{"1": [2.0, 1.0]}')
    assert [r["name"] for r in files.merged_reports(spark, f"{tmp_path}/in").collect()] == ["r9.json", "r10.json"]
    files.write_merged(spark, f"{tmp_path}/in", f"{tmp_path}/merged.txt")
    with open(f"{tmp_path}/merged.txt") as f:
        assert json.load(f) == [{"1": [2.0, 1.0]}] * 2
    runs = spark.createDataFrame([(1, 2.0, 1.0)], "k int, avg_bfs double, avg_bfs_apx double")
    files.write_experiment(runs, f"{tmp_path}/e")
    assert files.read_experiment(spark, f"{tmp_path}/e").collect() == runs.collect()
    files.write_snapshots(snapshot(g, 1), f"{tmp_path}/s")
    assert sorted(map(tuple, files.read_snapshots(spark, f"{tmp_path}/s").collect())) == sorted(map(tuple, snapshot(g, 1).collect()))
    (opened,) = [files.open_graph(spark, f"{tmp_path}/t", text=True).node_count()]
    assert opened == 5


def test_large_reports_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ARRAY_NODES", 2)
    monkeypatch.setattr(files, "MERGED_BYTES", 3)
    with pytest.raises(ValueError):
        files.write_ground_truth_arrays(measures(histogram(undirected(spark, PATH5))), f"{tmp_path}/a")
    files.write_report(spark.range(5), f"{tmp_path}/r", "one")
    assert os.listdir(f"{tmp_path}/r")[-1].endswith(("json", "crc"))
    with pytest.raises(ValueError):
        files.write_merged(spark, f"{tmp_path}/r", f"{tmp_path}/m")


def test_command_lines(spark, tmp_path, capsys):
    from wayfare.__main__ import main, sizes

    t = str(tmp_path)
    with open(f"{t}/g.txt", "w") as f:
        f.write("".join(f"{a} {b}\n" for a, b in PATH5 + [(6, 6)]))
    main(["top", "-t", "-e", "--k", "2", "--out", f"{t}/top", f"{t}/g"], spark)
    assert {(r["node"], r["rank"]) for r in spark.read.json(f"{t}/top").collect()} == {(2, 1), (1, 2), (3, 2)}
    main(["top", "-t", "--ks", "1,2:5:2", "--rounds", "1", "--out", f"{t}/sweep", f"{t}/g"], spark)
    assert sorted(r["k"] for r in files.read_experiment(spark, f"{t}/sweep").collect()) == [1, 2, 4] == sizes("1,2:5:2")
    assert "components 3" in capsys.readouterr().out  # the path, the loop and the isolated node 5
    main(["clean", f"{t}/g.txt", f"{t}/clean"], spark)
    main(["dense", f"{t}/g.txt", f"{t}/dense"], spark)
    main(["measures", "-m", f"{t}/dense", *(f"{t}/{m}" for m in ("c", "l", "h", "x", "r"))], spark)
    assert {r["node"]: r["reachable"] for r in spark.read.parquet(f"{t}/r").collect()} == {0: 5, 1: 4, 2: 3, 3: 2, 4: 1, 5: 1}
    main(["exact", "--arrays", f"{t}/dense", f"{t}/truth"], spark)
    assert files.read_ground_truth_arrays(spark, f"{t}/truth").count() == 6
    main(["symmetrize", f"{t}/dense", f"{t}/both"], spark)
    assert spark.read.text(f"{t}/both").count() == 9
    files.write_report(spark.range(1), f"{t}/reports", "a")
    main(["merge", f"{t}/reports", f"{t}/merged"], spark)
    with open(f"{t}/merged") as f:
        assert json.load(f) == [{"id": 0}]


def test_inversions(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 4.0), (3, 4.5), (4, 1.0)], "rank long, v double")
    assert ranking.inversions(rows, ["rank"], "v").first()[0] == 1
    assert ranking.precision_at_k(arcs(spark, [(1, 0), (2, 0)]).toDF("node", "x"), arcs(spark, [(2, 0), (3, 0)]).toDF("node", "x"), 2).first()["precision"] == 0.5


def test_searches_from_files_equal_the_broadcast_and_the_joins(spark, kernel_off, monkeypatch):
    """Beyond the broadcast tasks read the graph from the shared folder; beyond what a task can hold, joins."""
    from wayfare.operators import traversal

    rows = arcs(spark, random_graph(spark, 90, 200, 17) + [(0, k) for k in range(1, 40)]).distinct()  # directed, with loops
    found = []
    for files_too, g in ((True, Graph(rows)), (True, kernel_off(rows)), (False, kernel_off(rows))):
        with monkeypatch.context() as m:
            m.setattr(traversal, *(("swept", None) if files_too else ("FILE_ARCS", -1)))
            weights = g.vertices.select("id", (F.col("id") % 5 + 0.5).alias("weight"))
            tables = (pairs(g).select("source", "node", "dist"), histogram(g).select("source", "dist", "cnt", "arcs"), histogram(g, arcs=False).select("source", "dist", "cnt"), traversal.sums_and_farness(g, weights).select("far", "node", "value"))
            found.append([sorted(map(tuple, t.collect())) for t in tables])
    assert found[0][:3] == found[1][:3] == found[2][:3]
    for other in found[1:]:
        assert [x[:2] for x in other[3]] == [x[:2] for x in found[0][3]] and [x[2] for x in other[3]] == pytest.approx([x[2] for x in found[0][3]])


@pytest.mark.parametrize("symmetric", [True, False])
def test_levels_with_hubs(monkeypatch, symmetric):
    """Against plain searches, with hubs, many groups of nodes and sources of several words."""
    import numpy as np

    from wayfare.operators import traversal

    monkeypatch.setattr(traversal, "HUB", 5)
    monkeypatch.setattr(traversal, "ROWS", 7)
    some = {x for x in random_graph(None, 150, 220, 23)} | {(3, k) for k in range(60, 110)} | {(k, 7) for k in range(20, 60)}
    some |= {(b, a) for a, b in some} if symmetric else set()
    ids = np.array(sorted({10 * x for arc in some for x in arc}))
    src, dst = (np.searchsorted(ids, 10 * np.array([arc[k] for arc in some])) for k in range(2))
    arrays = traversal.sorted_arrays(ids, src, dst)
    assert (arrays[3] is None) == symmetric
    after = {}
    for a, b in some:
        after.setdefault(10 * a, []).append(10 * b)
    want = set()
    for s in ids.tolist():
        seen, now, dist = {s}, [s], 0
        while now:
            want |= {(s, x, dist) for x in now}
            now = list({y for x in now for y in after.get(x, [])} - seen)
            seen |= set(now)
            dist += 1
    got = [(int(ids[s]), int(ids[front[k]]), dist) for dist, front, bits in traversal.levels(arrays, ids) for k, s in zip(*np.nonzero(traversal.unpacked(bits, len(ids))))]
    assert len(got) == len(want) and set(got) == want


def test_progressive_stretches(spark, monkeypatch):
    """The last snapshot needs a few steps, not some for every batch; batch by batch, stretch by stretch and by joins the states are the same."""
    from wayfare.operators import traversal
    from wayfare.streaming import progressive

    g = undirected(spark, [x for x in random_graph(spark, 25, 30, 31) if x[0] != x[1]])
    rows = lambda df: sorted(map(tuple, df.select("processed_count", "rank", "node").collect()))
    every, written, plain = rows(all_snapshots(g, 4)), [], progressive.settled
    n = g.node_count()
    with monkeypatch.context() as m:
        m.setattr(progressive, "settled", lambda df, label: written.append(label) or plain(df, label))
        assert rows(snapshot(g, None, 4)) == [x for x in every if x[0] == n]
        assert len(written) == 2  # the first order and the last
        m.setattr(progressive, "STRETCH", 2)
        assert rows(snapshot(g, 3, 4)) == [x for x in every if x[0] == 12]
    monkeypatch.setattr(traversal.Graph, "reader", lambda self: None)
    assert rows(snapshot(g, 2, 4)) == [x for x in every if x[0] == 8]


@pytest.mark.parametrize("symmetric", [True, False])
def test_first_steps_gather_no_arcs(monkeypatch, symmetric):
    """Two steps from each source are followed source by source where that is less work; the levels and their sizes stay those of plain searches."""
    import numpy as np

    from wayfare.operators import traversal

    some = {x for x in random_graph(None, 300, 420, 29)} | {(5, k) for k in range(40, 90)}
    some |= {(b, a) for a, b in some} if symmetric else set()
    ids = np.array(sorted({x for arc in some for x in arc}))
    src, dst = (np.searchsorted(ids, np.array([arc[k] for arc in some])) for k in range(2))
    arrays, found, plain = traversal.sorted_arrays(ids, src, dst), [], traversal._gathered
    for cost in (0, 10**9):
        gathers, shots = [], []
        with monkeypatch.context() as m:
            m.setattr(traversal, "ROWS", 1 << 20)
            m.setattr(traversal, "PAIR_COST", cost, raising=False)
            m.setattr(traversal, "_gathered", lambda *a: gathers.append(1) or plain(*a))
            for dist, front, bits in traversal.levels(arrays, ids[::2]):
                own = traversal.unpacked(bits, len(ids[::2]))
                degree = arrays[5][front]
                count, out = traversal.tallies(bits, own.shape[1], degree)
                assert np.array_equal(count, own.sum(0, dtype=np.int64)) and np.array_equal(out, degree @ own.astype(np.int64))
                shots.append((dist, front.tolist(), own.tolist()))
                assert len(gathers) == (max(0, dist - 2) if cost == 0 else dist)
        found.append(shots)
    assert found[0] == found[1] and len(found[0]) > 4


def test_first_steps_of_sparse_graphs_are_gathered():
    """Where few arcs meet many nodes, nodes aren't marked for each source apart."""
    import numpy as np

    from wayfare.operators import traversal

    ids, ring = np.arange(5000), np.arange(5000)
    sparse, dense = (traversal.sorted_arrays(ids, np.concatenate([ring] * k + [(ring + j) % 5000 for j in range(1, k + 1)]), np.concatenate([(ring + j) % 5000 for j in range(1, k + 1)] + [ring] * k)) for k in (1, 40))
    assert not list(traversal._near(sparse[1], sparse[2], ids[:2048], 32))
    assert len(list(traversal._near(dense[1], dense[2], ids[:64], 1))) > 0
    front = {dist: sorted(places.tolist()) for dist, places, _ in traversal.levels(sparse, ids[:10])}
    assert front[3] == sorted({(k + d) % 5000 for k in range(10) for d in (-3, 3)}) and max(front) == 2500


def test_symmetrized_arcs_are_exchanged_one_way(spark):
    rows = [(1, 2), (2, 1), (3, 3), (3, 3), (4, 1), (None, 5), (5, None), (None, None)]
    both = etl.symmetrized(spark.createDataFrame(rows, "src long, dst long"))
    assert sorted(map(tuple, both.collect()), key=str) == sorted({*rows, (1, 4)}, key=str)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")


def test_small_tables_are_numbered_without_ranges(spark, monkeypatch):
    written, plain = [], etl.settled
    monkeypatch.setattr(etl, "settled", lambda df, label: written.append(label) or plain(df, label))
    assert [tuple(r) for r in etl.numbered(spark.range(40), [F.desc("id")], "n").orderBy("id").collect()] == [(k, 39 - k) for k in range(40)]
    assert written == ["unranged"]
    monkeypatch.setattr(etl, "RANGE_ROWS", 7)
    assert [tuple(r) for r in etl.numbered(spark.range(40), [F.desc("id")], "n").orderBy("id").collect()] == [(k, 39 - k) for k in range(40)]
    assert written[1:] == ["unranged", "ranged"]


def test_arcs_beyond_the_broadcast_are_written_once(spark, kernel_off, monkeypatch):
    """Tasks sort the arcs that they read; no table of places and no second, sorted one is written. Symmetric arcs are derived in one reading."""
    from wayfare.operators import traversal

    written, plain = [], traversal.settled
    monkeypatch.setattr(traversal, "settled", lambda df, label: written.append(label) or plain(df, label))
    rows = arcs(spark, [x for x in random_graph(spark, 60, 90, 37) if x[0] != x[1]])
    g = kernel_off(etl.symmetrized(rows))
    assert {r["node"]: r["farness"] for r in measures(histogram(g)).collect()} == {k: v[0] for k, v in scores(g).items()}
    assert written == ["arcs", "vertices"]


def test_components_in_one_task(spark, kernel_off, monkeypatch):
    """Graphs that a task can hold need no stars, and are labelled as by stars: arcs one way, long paths against the order of ids, hubs, isolated nodes."""
    from wayfare.operators import traversal

    rows = random_graph(spark, 200, 150, 29) + [(900 - k, 899 - k) for k in range(120)] + [(1000 + (k * 37) % 101, 1000 + ((k + 1) * 37) % 101) for k in range(100)]
    rows += [(2000 + k, 2999) for k in range(40)] + [(3000, 3000)]
    more = spark.range(4000, 4003)
    with monkeypatch.context() as m:
        m.setattr(traversal, "FILE_ARCS", -1)
        want = sorted(map(tuple, structure.components(kernel_off(arcs(spark, rows).distinct(), more)).collect()))
    monkeypatch.setattr(structure, "spanned", None)
    for g in (Graph(arcs(spark, rows).distinct(), more), kernel_off(arcs(spark, rows).distinct(), more)):
        assert sorted(map(tuple, structure.components(g).collect())) == want
    assert {(4001, 4001), (3000, 3000), (2999, 2000), (900, 780), (1100, 1000)} <= set(want)


def test_schedules_followed_on_the_driver(spark, monkeypatch):
    """Small schedules need no table for each stretch, and give the same stretches as the tables."""
    from wayfare.plans import threshold

    g = undirected(spark, [x for x in random_graph(spark, 60, 110, 31) if x[0] != x[1]])
    made = estimate(g, eps=2.0)
    schedule = threshold.bounded_schedule(g, made, 2.0)

    def stretches(searched):
        return [(x.done, x.fresh, x.enough, x.all_known, sorted(map(tuple, x.known().collect()))) for x in searched(g, made, schedule, 16)]

    want = stretches(threshold._searched_apart)
    assert len(want) > 1 and want[-1][1] > 0
    monkeypatch.setattr(threshold, "settled", None)
    assert stretches(threshold._searched) == want


def test_the_estimate_derives_the_graph_once(spark):
    """The first sources are drawn from the written nodes, not from what the graph is derived from."""
    from wayfare.plans.estimation import first_sources

    g = undirected(spark, [(k, k + 1) for k in range(20)])
    first = first_sources(g, F.col("node"))
    assert first.inputFiles() and all("/vertices-" in f for f in first.inputFiles())
    assert [r["id"] for r in first.collect()] == [0, 1, 2, 3]


def test_frontier_pairs_derive_the_graph_once(spark, kernel_off):
    from wayfare.operators.traversal import frontier_pairs

    g = kernel_off(etl.symmetrized(arcs(spark, [(k, k + 1) for k in range(20)])))
    found = frontier_pairs(g)
    assert found.inputFiles() and all("/vertices-" in f for f in found.inputFiles())
    assert sorted(map(tuple, found.collect())) == [(a, b, abs(a - b)) for a in range(21) for b in range(21)]


def test_searches_come_in_whole_rounds_of_tasks(spark, monkeypatch):
    from wayfare.operators import traversal

    monkeypatch.setattr(traversal, "WORDS", 1)
    slots = spark.sparkContext.defaultParallelism
    g = undirected(spark, [(k, k + 1) for k in range(64 * 2 * slots)])  # one node more than fills two rounds
    found = histogram(g, arcs=False)
    assert found.rdd.getNumPartitions() == 3 * slots
    assert found.agg(F.sum("cnt")).first()[0] == (128 * slots + 1) ** 2


def test_arrays_are_sorted_as_one_number_an_arc(monkeypatch):
    import numpy as np

    from wayfare.operators import traversal

    monkeypatch.setattr(np, "lexsort", None)
    ids, src, dst = np.array([5, 7, 9]), np.array([2, 0, 1, 0]), np.array([0, 2, 0, 1])
    got = traversal.sorted_arrays(ids, src, dst)
    assert [x.tolist() for x in got[1:3]] == [[0, 2, 3, 4], [1, 2, 0, 0]] and got[3] is None and got[5].tolist() == [2, 1, 1]


def test_graphs_beyond_a_task_are_searched_by_parts(spark, monkeypatch):
    """No sweep where the components fit: parts of several components, isolated nodes, ids far apart, hubs; both kinds of arcs; stars aren't needed."""
    from wayfare.operators import traversal

    rows = [(a + c, b + c) for c in (0, 1000, -70000, 1 << 40) for a, b in random_graph(spark, 60, 90, 41)] + [(5000, 5000 + k) for k in range(30)]
    more = spark.range(6000, 6004)
    monkeypatch.setattr(traversal, "PART_NODES", 70)
    monkeypatch.setattr(traversal, "PIECE_ARCS", 90)
    for one, kinds in ((arcs(spark, rows).distinct(), [False]), (etl.symmetrized(arcs(spark, rows)), [False, True])):
        g = Graph(one, more)
        weights = g.vertices.select("id", (F.col("id") % 5 + 0.5).alias("weight"))

        def tables(g):
            out = (pairs(g), pairs(g, g.vertices.filter("id % 7 = 0")), histogram(g), histogram(g, arcs=False), traversal.sums_and_farness(g, weights), structure.components(g), traversal.frontier_pairs(g))
            return [sorted(map(tuple, t.select(sorted(t.columns)).collect())) for t in out]

        want = tables(g)
        for symmetric in kinds:
            with monkeypatch.context() as m:
                m.setattr(traversal, "swept", None)
                m.setattr(structure, "spanned", None)
                m.setattr(traversal.Graph, "reader", lambda self: None)
                m.setattr(traversal.Graph, "files", lambda self: None)
                h = Graph(one, more, -1, symmetric)
                got = tables(h)
                assert len(h.parts().names) > 1 and len(h.parts().starts()) > 3
            assert [x for x in got if x is not got[4]] == [x for x in want if x is not want[4]]
            assert [x[:2] for x in got[4]] == [x[:2] for x in want[4]] and [x[2] for x in got[4]] == pytest.approx([x[2] for x in want[4]])


def test_arcs_of_symmetric_graphs_are_made_distinct_once(spark):
    from wayfare.graphs import arcs_of

    plans = [arcs_of(spark, "/root/testdata/sf0.001", "part_next", once)._jdf.queryExecution().optimizedPlan().toString() for once in (True, False)]
    assert [p.count("Aggregate") for p in plans] == [1, 0]


def test_degrees_counted_before_are_taken(spark):
    rows = etl.symmetrized(arcs(spark, [(0, k) for k in range(1, 9)] + [(3, 4)]))
    g = Graph(rows, spark.range(20, 22), symmetric=True)
    want = sorted(map(tuple, structure.degrees(g).collect()))
    assert g.places() is not None and "/places-" in structure.degrees(g).inputFiles()[0]
    assert sorted(map(tuple, structure.degrees(g).collect())) == want and dict(want)[0] == 8 and dict(want)[20] == 0


@pytest.mark.parametrize("joins", [False, True])
def test_the_last_snapshot_needs_no_batches(spark, kernel_off, monkeypatch, joins):
    """It equals the one that all batches in turn lead to, on several components with isolated nodes, also for a last batch that isn't full."""
    from wayfare.operators import traversal
    from wayfare.streaming import progressive

    rows = etl.symmetrized(arcs(spark, [x for x in random_graph(spark, 25, 30, 43) if x[0] != x[1]] + [(50, 51), (51, 52)]))
    g = Graph(rows, spark.range(60, 63))
    n, written, plain = g.node_count(), [], progressive.settled
    for _, state in progressive.snapshots(g, 4):
        pass
    want = sorted((n, r["rank"], r["node"]) for r in state.collect())
    if joins:
        monkeypatch.setattr(traversal, "FILE_ARCS", -1)
        g = kernel_off(rows, spark.range(60, 63))
    monkeypatch.setattr(progressive, "snapshots", None)
    monkeypatch.setattr(progressive, "settled", lambda df, label: written.append(label) or plain(df, label))
    for batches in (None, -(-n // 4)):
        assert sorted(map(tuple, snapshot(g, batches, 4).select("processed_count", "rank", "node").collect())) == want
    assert written == 2 * ["farness", "progress"]


def test_many_rounds_of_parts_are_fewer_tasks(spark, monkeypatch):
    from wayfare.operators import traversal

    monkeypatch.setattr(traversal, "WORDS", 1)
    monkeypatch.setattr(traversal, "MANY_ROUNDS", 3)
    monkeypatch.setattr(traversal.Graph, "reader", lambda self: None)
    slots = spark.sparkContext.defaultParallelism
    g = undirected(spark, [(k, k + 1) for k in range(64 * 7 * slots)])  # one node more than fills seven rounds
    found = histogram(g, arcs=False)
    assert found.rdd.getNumPartitions() == 2 * slots
    assert found.agg(F.sum("cnt")).first()[0] == (64 * 7 * slots + 1) ** 2
