"""Sharding, fingerprints, toxicity, the Jaccard join, quality rules, quotation linking and the pipeline against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfare.llm import fingerprints, jaccard_join, quality, quotation, sharding, toxicity

SF = "/root/testdata/sf0.001"


def test_sharding(spark, odd_docs, odd_rows, no_docs):
    got = sharding.sharded_documents(odd_docs, 8).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    shards = {}
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards.get(k, [])) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.sharded_documents(no_docs, 8).count() == 0


def test_hypergeometric_law():
    rng, n = random.Random(1), 20_000
    found = Counter(sharding.hypergeometric(rng, 7, 5, 6) for _ in range(n))
    from math import comb

    for k in range(1, 7):
        assert found[k] / n == pytest.approx(comb(7, k) * comb(5, 6 - k) / comb(12, 6), abs=0.015)
    matrix = sharding.communication_matrix(rng, [5, 0, 9, 4], [6, 6, 6])
    assert [sum(r) for r in matrix] == [5, 0, 9, 4] and [sum(c) for c in zip(*matrix)] == [6, 6, 6]


def test_shuffle_is_uniform(spark):
    rows = spark.range(60).withColumnRenamed("id", "n").cache()
    seen = Counter()
    for seed in range(12):
        seen.update(r["shard"] for r in sharding.shuffle_to_shards(rows, "n", 3, seed).filter("n < 20").collect())
    assert all(50 <= seen[s] <= 110 for s in range(3))  # 80 expected


PIECE = re.compile(r"[^.!?\n]{1,200}[.!?\n]*|[.!?\n]+", re.S)


def likeness(a, b):
    a, b = set(PIECE.findall(a)), set(PIECE.findall(b))
    return len(a & b) / len(a | b) if a | b else 1.0


MASK = (1 << 64) - 1


def tag(digest):
    """2^32 plus Spark's 32-bit hash of a 64-bit number (Murmur3, seed 42)."""
    h, m = 42, 0xFFFFFFFF
    for part in (digest & m, digest >> 32 & m):
        part = part * 0xCC9E2D51 & m
        part = (part << 15 | part >> 17) & m
        h ^= part * 0x1B873593 & m
        h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    h ^= 8
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return (1 << 32) + (h ^ h >> 16)


def turn(digest, n):
    return (digest << n | digest >> 64 - n) & MASK if n else digest


def read_fingerprint(text):
    *_, count, cells = text.split(":")
    return int(count), [[tuple(int(v, 16) for v in c.split(".")) if c else (0, 0) for c in row.split(",")] for row in cells.split(";")]


def fold(rows, size):
    out = []
    for row in rows:
        step = len(row) // size
        xors = [0] * size
        for k, (x, _) in enumerate(row):
            xors[k // step] ^= x
        out.append(list(zip(xors, [sum(s for _, s in row[k * step : (k + 1) * step]) for k in range(size)])))
    return out


def peel(rows):
    """The digests that a difference of sketches holds, or None."""
    rows, found, size = [list(r) for r in rows], set(), len(rows[0])
    while True:
        hits = {turn(x, 64 - 16 * r if r else 0): (1 if s > 0 else -1) for r, row in enumerate(rows) for x, s in row if 1 << 32 <= abs(s) < 1 << 33 and abs(s) == tag(x)}
        if not hits:
            return None if any(x or s for row in rows for x, s in row) else found
        found |= set(hits)
        for digest, sign in hits.items():
            for r, row in enumerate(rows):
                t = turn(digest, 16 * r)
                c = (t ^ 1 << 63) >> 64 - size.bit_length() + 1  # cells stand in signed order
                row[c] = (row[c][0] ^ t, row[c][1] - sign * tag(t))


def likeness_of(a, b):
    """From two fingerprints alone: the likeness, and whether it had to be estimated."""
    (m, x), (n, y) = read_fingerprint(a), read_fingerprint(b)
    size = min(len(x[0]), len(y[0]))
    minus = [[(p ^ q, s - t) for (p, s), (q, t) in zip(u, v)] for u, v in zip(fold(x, size), fold(y, size))]
    found, opened, estimated = peel(minus), (peel(x), peel(y)), False
    if found is not None:  # smaller sizes fail where the largest does
        d = len(found)
    elif None not in opened:
        d = len(opened[0] ^ opened[1])
    else:
        squares = sum((s / 6442450943 - (m - n) / size) ** 2 for row in minus for _, s in row)
        d, estimated = min(m + n, max(abs(m - n), round(squares / 3 / (28 / 27 - 1 / size)))), True
    return (1.0 if m + n == 0 else (m + n - d) / (m + n + d)), estimated


def test_fingerprints(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    import xxhash

    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 7)
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    ordered = sorted(((i, t or "") for i, t, *_ in odd_rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    got = {}
    for r in fingerprints.fingerprinted(odd_docs).collect():
        got.setdefault((r["doc_id"], r["n_chars"], r["edited_sha256"]), []).append(r)
    print_of, near, exact = {}, [], 0
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i, len(t), hashlib.sha256(edited.encode()).hexdigest()].pop()
        for text, column in ((t, "fingerprint"), (edited, "edited_fingerprint")):
            assert print_of.setdefault(text, r[column]) == r[column]
        near.append((t, edited, r["fingerprint"], r["edited_fingerprint"], r["near_edited"]))
        near.append((t, after, r["fingerprint"], None, r["near_next"]))
    assert not any(got.values())
    for a, b, print_a, print_b, found in near:
        want, estimated = likeness_of(print_a, print_b or print_of[b])
        assert found == pytest.approx(want)
        if not estimated:
            exact += 1
            assert found == pytest.approx(likeness(a, b))
        else:
            assert found == pytest.approx(likeness(a, b), abs=0.25)
    assert exact > 0.95 * len(near)
    assert fingerprints.fingerprinted(no_docs).count() == 0
    alone = fingerprints.fingerprinted(odd_docs.filter("doc_id = 5")).first()
    assert alone["near_next"] == 1.0


def test_a_doc_id_of_many_rows_spans_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 10)
    rows = [(k % 3 if k < 200 else 5, f"text {k}") for k in range(500)] + [(None, f"none {k}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = [r["count"] for r in fingerprints.ranged(docs).groupBy("__range").count().collect()]
    assert sum(sizes) == 650 and max(sizes) < 60 and len(sizes) > 30
    assert fingerprints.fingerprinted(docs).count() == 650


def sketched(sets):
    return F.expr(fingerprints.let("w", fingerprints.marks("bits"), fingerprints.sketch(sets, "w")))


def test_sketches_are_peeled_and_retried(spark):
    rng = random.Random(2)
    draw = lambda: (rng.getrandbits(63) | fingerprints.ODD) & ~fingerprints.SECOND
    sets = []
    for n in (0, 1, 5, 12, 40, 300, 5000):
        a = [draw() for _ in range(n)]
        sets.append((a, a[: n // 2] + [draw() for _ in range(n // 3)]))
    df = spark.createDataFrame(sets, "a array<long>, b array<long>")
    least = {}
    for bits in (3, 6, 9, 12):
        cells = df.withColumn("bits", F.lit(bits)).withColumn("x", sketched("a")).withColumn("y", sketched("b"))
        cells = cells.withColumn("m", F.expr(fingerprints.minus("x", "y")))
        found = cells.select("a", "b", F.expr(fingerprints.differing("m", str(bits), str(bits))).alias("d"), F.expr(fingerprints.differing("m", "3", str(bits))).alias("e")).collect()
        for k, r in enumerate(found):
            want = len(set(r["a"]) ^ set(r["b"]))
            assert r["d"] in (None, want) and r["e"] in (None, want) and (r["e"] is not None or r["d"] is None)
            if r["d"] is not None:
                least.setdefault(k, bits)
    assert least[0] == 3 and least[5] in (6, 9) and least[6] == 12 and sorted(least) == list(range(7))
    # a sketch folded is the sketch of that size
    both = df.withColumn("bits", F.lit(6)).withColumn("x", sketched("a")).withColumn("bits", F.lit(4)).withColumn("y", sketched("a"))
    assert both.filter(F.expr(f"{fingerprints.folded('x', '6', '4')} = y")).count() == len(sets)


def test_unlike_fingerprints_are_opened_and_not_sketched_anew(spark, monkeypatch):
    rng = random.Random(3)
    draw = lambda n: [(rng.getrandbits(63) | fingerprints.ODD) & ~fingerprints.SECOND for _ in range(n)]
    sets = [(a, a[:common] + draw(n)) for m, n, common in ((0, 40, 0), (300, 20, 0), (300, 300, 5), (40, 700, 40)) for a in [draw(m)]]
    df = spark.createDataFrame([(*s, *map(len, s)) for s in sets], "a array<long>, b array<long>, m int, n int")
    for c in "ab":
        bits = f"cast(greatest({fingerprints.FIRST_BITS}, ceil(log2(greatest(1, size({c}))))) as int)"
        df = df.withColumn("bits", F.expr(bits)).withColumn(f"cells_{c}", sketched(c))
    monkeypatch.setattr(fingerprints, "sketch", None)
    for r in fingerprints.with_likeness(df, "near", "m", "cells_a", "n", "cells_b").collect():
        assert r["near"] == pytest.approx(len({*r["a"]} & {*r["b"]}) / len({*r["a"]} | {*r["b"]}))


def maximal_segments(values, first=0):
    """By their definition: the highest-scoring stretch, and the same to its left and right."""
    stretches = [(sum(values[a:b]), a, b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)]
    score, a, b = max(stretches, default=(0, 0, 0))
    if score <= 1e-9:
        return []
    return maximal_segments(values[:a], first) + [(score, first + a, first + b)] + maximal_segments(values[b:], first + b)


def test_segments_equal_brute_force():
    rng = random.Random(3)
    scanner = toxicity.Scanner({"bad$": 2.03, "awf": 1.007, "awful$": 3.11, "vil": 0.613}, -0.517)
    assert scanner.token("awful") == 3.11 and scanner.token("awfully") == 1.007 and scanner.token("good") is None
    for _ in range(600):
        words = [rng.choice(["ok"] * rng.randrange(1, 9) + ["bad", "awful", "awfully", "vile"]) for _ in range(rng.randrange(26))]
        values = [-0.517 if scanner.token(w) is None else scanner.token(w) for w in words]
        found, want = scanner.segments(words), maximal_segments(values)
        assert [x[1:] for x in found] == [x[1:] for x in want] and [x[0] for x in found] == pytest.approx([x[0] for x in want])


def test_a_passage_scores_alike_wherever_it_stands():
    scanner = toxicity.Scanner({"vile$": 3.0}, -0.2)
    assert scanner.segments(["vile", "vile"] + ["ok"] * 200 + ["vile"] * 10) == [(6.0, 0, 2), (pytest.approx(30.0), 202, 212)]


def test_decay_solves_its_equation():
    scores = [(2.0, 50, 30), (3.5, 9, 4), (None, 2000, 5000)]
    other = toxicity.other_score(scores)
    decay = toxicity.decay_factor(scores, other)
    assert other < 0 < decay
    assert sum(n * 2.718281828459045 ** (decay * (other if s is None else s)) for s, _, n in scores) / 5034 == pytest.approx(1.0)
    assert toxicity.decay_factor([], -0.01) == 1.0 and toxicity.other_score([]) == -0.01


def test_spans_are_places_of_the_text():
    assert toxicity.lowered("İSTANBUL Vile") == "istanbul vile" and toxicity.lowered("ÀB") == "àb"


def toxic_corpus(spark, n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(9)) * 0 for _ in range(80)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(6):
                words[rng.randrange(80)] = rng.choice(["vilest", "vilehaus", "vileword", "scorn"])
        docs.append((i, " ".join(words), "x", 1))
        labels.append((i, int(toxic)))
    docs += [(None, None, "x", 1), (n, "", "x", 1), (n + 1, "alpha beta", "x", 1), (n + 1, "alpha beta", "x", 1)]
    labels += [(None, 1), (n, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, scores string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, monkeypatch):
    docs, labels = toxic_corpus(spark)
    got = toxicity.scored(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held) and len(held) > 100
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.97
    few = toxicity.training_labels(labels).count()
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 100)
    assert 0 < toxicity.training_labels(labels).count() < few / 2
    monkeypatch.undo()
    hit = next(r for r in rows if r["doc_id"] == 0)
    assert hit["passages"] and hit["passages"][0]["span"]["end"] > hit["passages"][0]["span"]["first"]
    kept = {r["doc_id"] for r in toxicity.kept_documents(docs, labels).collect()}
    assert None in kept and 600 in kept and len(kept & set(range(600))) >= 470
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    blank = toxicity.scored(docs, labels.limit(0)).collect()
    assert len({r["score"] for r in blank}) == 1 and not any(r["predicted"] for r in blank)


def test_toxic_rows_go_one_by_one(spark):
    docs, labels = toxic_corpus(spark)
    toxic, clean = "vilest scorn vileword vilehaus " * 6, "alpha beta gamma " * 20
    more = spark.createDataFrame([(None, toxic, "y", 2), (None, clean, "y", 3), (9999, toxic, "y", 4), (9999, clean, "y", 5)], docs.schema)
    docs = docs.union(more).withColumn("odd name", F.lit(1))
    kept = toxicity.kept_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"], r["toxic"]) for r in kept.filter("scores = 'y'").collect()} == {(None, clean, 3), (9999, clean, 5)}
    scores = toxicity.scored(docs, labels).groupBy("predicted").count()
    assert kept.count() == scores.filter("predicted = 0").first()["count"]


def brute_classes(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    link = lambda a, b: a == b or bool(a and b) and 9 * len(a & b) >= 4 * (len(a) + len(b))
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and link(sets[a], sets[b]):
                links[a] += 1
                part[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min(least.get(r, float("inf")), float("inf") if i is None else i)
    return Counter((i, None if least[find(k)] == float("inf") else least[find(k)], links[k]) for k, (i, _) in enumerate(rows))


def near_copies():
    rng = random.Random(6)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 160))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(999)}"
            rows.append((len(rows) * 3, " ".join(copy)))
    passage = " ".join(f"p{k}" for k in range(60))
    return rows + [(500 + k, passage + " " + " ".join(f"q{k}x{j}" for j in range(60))) for k in range(20)]


def test_jaccard_join(spark, odd_rows, no_docs, monkeypatch):
    rows = near_copies() + [(i, t) for i, t, *_ in odd_rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_classes(rows)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs).collect()) == want
    plain = jaccard_join.with_blocks
    monkeypatch.setattr(jaccard_join, "with_blocks", lambda rows, key, *_: plain(rows, key, 3))  # every group in many blocks
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(jaccard_join, "CHUNK", 20)
    monkeypatch.setattr(jaccard_join, "HELD_BYTES", 2000)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(docs).collect()) == want
    assert jaccard_join.near_duplicates(no_docs).count() == 0


def test_only_pairs_that_met_and_stayed_are_verified(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(9)
    n = 40
    sets = [np.arange(100, dtype=np.uint64) for _ in range(n)]  # all alike, so that only the candidates decide
    signed = rng.integers(0, 3, (n, 60)).astype(np.uint8)
    signed[20:] = signed[20]
    keys = rng.integers(0, 300, (n, 20))
    want = set()
    for a in range(n):
        for b in range(a + 1, n):
            matches = np.cumsum(signed[a] == signed[b])
            if (keys[a] == keys[b]).any() and all(matches[k - 1] >= jaccard_join.least_matches(k) for k in range(10, 61, 10)):
                want.add((a, b))
    got = set(zip(*map(np.ndarray.tolist, jaccard_join.candidates(keys, signed, None))))
    assert got == want and want and len(want) < n * (n - 1) // 2
    rows = {"part": [0] * n, "i": [0] * n, "j": [0] * n, "mine": [0] * n, "rep": list(range(n)), "copies": [1] * n}
    whole = pa.table(rows | {"keys": keys.tolist(), "matches": [x.tobytes() for x in signed], "chunk": [0] * n, "set": [x.tobytes() for x in sets]})
    (found,) = jaccard_join.verified(whole)
    assert found.column(1).to_pylist() == [sum(k in p for p in want) for k in range(n)]


def test_blocks_hold_bytes(spark):
    rows = spark.createDataFrame([(k % 2, k, 100 if k % 2 else 1) for k in range(20)], "part long, rep long, size long")
    got = {r["part"]: r["__blocks"] for r in jaccard_join.with_blocks(rows, "part", 50, F.col("size"), 300).collect()}
    assert got == {0: 1, 1: 4}


def test_words_end_at_the_same_white_space_in_sql(spark):
    rows = [(1, "a\xa0b c\u2003d e f\x1cg"), (2, "a b c d e f g"), (3, "a\u200bb c d e f g"), (4, "A\x85b c d e\u3000f g"), (5, "one two")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = sorted(map(tuple, jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(con.sql(jaccard_join.OP5_SQL).fetchall()) and got[0][3] == 2


def test_one_of_each_class_stays(spark, odd_docs, odd_rows):
    kept = jaccard_join.kept_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = Counter(t for i, t, *_ in odd_rows)
    got = Counter(r["text"] for r in kept.collect())
    assert all(n == 1 for n in got.values()) and len([t for t in got if t and len(t.split()) > 4]) <= len(texts)
    named = odd_docs.withColumnsRenamed({"length": "__row", "n_words": "a.b"})
    assert jaccard_join.kept_documents(named).columns == named.columns and quality.kept_documents(named).columns == named.columns
    plain = spark.createDataFrame(near_copies(), "doc_id long, text string")
    assert jaccard_join.kept_documents(plain).count() == len({c for _, c, _ in brute_classes(near_copies())})


def test_pruning_bounds():
    assert jaccard_join.least_matches(60) < 48 and jaccard_join.least_matches(10) == 0
    assert (1 - 0.8**jaccard_join.ROWS) ** jaccard_join.BANDS < 1e-6


def test_quality(spark, odd_docs, odd_rows, no_docs):
    measures = quality.measured(odd_docs.select("doc_id", "source", "text")).cache()
    got = Counter(tuple(r) for r in quality.judged(measures, quality.host_rates(measures)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for i, t, *_ in odd_rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert got == want
    kept = quality.kept_documents(odd_docs)
    assert kept.columns == odd_docs.columns and all(r["n_words"] == 1.5 for r in kept.collect())
    assert {r["doc_id"] for r in kept.collect()} >= {100 + k for k in range(25)} and 12 not in {r["doc_id"] for r in kept.collect()}
    assert quality.kept_documents(no_docs).count() == 0


def test_a_missing_host_is_its_own(spark):
    rows = [(k, None, "## " * 60) for k in range(20)] + [(100 + k, "", " ".join(f"w{k}x{j}" for j in range(60))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    measures = quality.measured(docs).cache()
    rates = {r["doc_id"]: r["host_rate"] for r in quality.judged(measures, quality.host_rates(measures)).collect()}
    assert min(rates[k] for k in range(20)) > 0.9 and max(rates[100 + k] for k in range(20)) < 0.1
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = {r[0]: r[-1] for r in con.sql(quality.OP8_SQL).fetchall()}
    assert {k: round(x, 9) for k, x in rates.items()} == want


def test_hosts_tighten_limits(spark):
    junk = [(k, "bad", "word%d " % k * 1 + "## " * 30 + " ".join(f"a{k}b{j}" for j in range(60))) for k in range(40)]
    mild = " ".join(f"m{j}" for j in range(80)) + " ####"
    docs = spark.createDataFrame(junk + [(100, "bad", mild), (101, "good", mild)] + [(200 + k, "good", " ".join(f"g{k}h{j}" for j in range(60))) for k in range(40)], "doc_id long, source string, text string")
    kept = {r["doc_id"] for r in quality.kept_documents(docs).collect()}
    assert 101 in kept and 100 not in kept and kept >= set(range(200, 240)) and not kept & set(range(40))


def test_quotation(spark):
    rows = [
        (1, 0, "user", "Hello there.\n\nHow are you?"), (1, 1, "assistant", "On Monday X wrote:\n> hello   there.\n\nFine."), (1, 2, "user", "Other topic"), (1, 3, "assistant", "> > Hello there.\n> Fine.\nGood\n\n"),
        (1, 4, "user", ">other topic\nyes"), (1, 5, "user", None), (2, 0, "user", ""), (2, 0, "user", "> nothing known"), (None, 1, "x", "> y"), (3, None, None, "a > b"), (1, 6, "a", "> Good\n> > Fine.\nend"), (1, 6, "a", "> Good\n> > Fine.\nend"),
    ]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, place int, lines string")
    got = sorted(map(tuple, quotation.reply_ordered(df).collect()), key=str)
    con = duckdb.connect()
    con.register("conversations", df.drop("place", "lines").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert got == sorted(con.sql(quotation.OP10_SQL).fetchall(), key=str)
    by = {(r[0], r[1], r[2]): r for r in got}
    assert by[1, 3, "assistant"][3:8] == ("Good", 2, 2, 1, 0) and by[1, 4, "user"][6] == 2
    chat = {r["conv_id"]: r["chat"] for r in quotation.chat_texts(quotation.reply_ordered(df)).collect()}
    assert chat[1].startswith("<|user|>\nHello there.") and ">" not in chat[1].replace("|>", "")
    assert quotation.reply_ordered(df.limit(0)).count() == 0


def test_latest_source_by_brute_force(spark):
    rng = random.Random(12)
    quotes = [(c, d, rng.randrange(40)) for c in range(2) for d in range(3) for _ in range(12)]
    sources = [(c, d, rng.randrange(40)) for c in range(2) for d in range(3) for _ in range(9)]
    frames = [spark.createDataFrame(x, "conv_id long, digest long, turn long") for x in (quotes, sources)]
    got = {(r["conv_id"], r["digest"], r["turn"]): r["__from"] for r in quotation.latest_sources(*frames, turns=7).collect()}
    assert got == {(c, d, t): max((u for a, b, u in sources if (a, b) == (c, d) and u < t), default=None) for c, d, t in quotes}


def test_long_conversations(spark, monkeypatch):
    """One conversation and one thread of many rows, a passage that all quote, a long text; places against DuckDB."""
    from wayfare.functions import arcs

    monkeypatch.setattr(arcs, "RANGE_ROWS", 50)
    monkeypatch.setattr(quotation, "TURNS", 16)
    rows = [(1, 0, "user", "Common words")] + [(1, k, "user", "> Common words\n" + f"answer {k}") for k in range(1, 300)] + [(2, k, "a", "> answer\n" * 3 + "x " * 5000) for k in range(3)]
    rows += [(None, None, "user", "nobody")] * 120 + [(3, None, None, None)] * 70 + [(4, 5, "user", "tie")] * 60
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = sorted(map(tuple, quotation.reply_ordered(df).collect()), key=str)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert got == sorted(con.sql(quotation.OP10_SQL).fetchall(), key=str)
    assert sum(r[6] == 0 for r in got) == 299


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_quoted_replies_equal_sql(spark):
    got = sorted(map(tuple, quotation.quoted_replies(spark, SF).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert got == sorted(con.sql(quotation.QUOTED_SQL).fetchall(), key=str)
    assert sum(r[5] for r in got) > 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        fewer = stage(spark, kept, SF).cache()
        assert fewer.columns == docs.columns and fewer.count() <= kept.count()
        kept = fewer
    packed = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}


def brute_quality(rows):
    """Whether each (source, text) stays, by the rules and the hosts' shrunk rates."""
    measures = []
    for source, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        measures.append((source, base, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines))))

    def over(m, part):
        return m[3] > 0.05 * part * m[2] or (m[5] > 0.3 * part * m[4] and m[5] > 2)

    hosts = {}
    for m in measures:
        n, f = hosts.get(m[0], (0, 0))
        hosts[m[0]] = n + 1, f + (m[1] or over(m, 1.0))
    rates = [f / n for n, f in hosts.values()]
    mean = sum(rates) / len(rates)
    spread = max(sum((r - mean) ** 2 for r in rates) / len(rates) - sum(f / n * (1 - f / n) / n for n, f in hosts.values()) / len(rates), 1e-4)
    mean = min(0.999, max(0.001, mean))
    strength = max(1.0, mean * (1 - mean) / spread - 1)
    shrunk = {h: (f + mean * strength) / (n + strength) for h, (n, f) in hosts.items()}
    return [not m[1] and shrunk[m[0]] < 0.9 and not over(m, 1 - shrunk[m[0]]) for m in measures]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Nulls, empty and repeated rows, near copies, junk hosts, long white space and clashing columns, through all stages."""
    import corpus_pipeline
    from tokenizers import Tokenizer
    from wayfare.llm.common import vocabulary_path

    rng = random.Random(21)
    prose = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    rows, toxic = [], set()
    for i in range(300):
        words = prose(rng.randrange(60, 120))
        if i % 4 == 0:
            toxic.add(i)
            for k in rng.sample(range(len(words)), 8):
                words[k] = rng.choice(["vilest", "vilehaus", "vileword", "scornful"])
        rows.append((i, " ".join(words), rng.choice(["a", "b"])))
    base = prose(100)
    rows += [(400 + k, " ".join(base[:50] + [f"x{k}"] + base[51:]), "a") for k in range(5)]  # near copies
    rows += [(None, " ".join(prose(80)), None), (None, "vilest scornful vileword " * 30, "a"), (None, None, "b"), (500, "", ""), (501, None, None)]
    rows += [(502, " ".join(base), "b")] * 3 + [(600 + k, " ".join(prose(70)) + " ##" * 40, "junk") for k in range(30)] + [(700, " ".join(prose(70)), "junk")]
    rows += [(800, " ".join(prose(60)) + " " * 400_000 + " ".join(prose(60)), "a")]
    schema = "doc_id long, text string, source string, lang string, n_words long, `__row` int, score double, length long"
    docs = spark.createDataFrame([(*r, "en", 1, 2, 3.5, 4) for r in rows], schema)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [r for r in rows if not re.search("vile|scorn", r[1] or "")]
    left = [r for r, stays in zip(left, brute_quality([(r[2], r[1]) for r in left])) if stays]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (r[1].split() for r in left)]
    part = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = {}
    for k, r in enumerate(left):
        want.setdefault(part[k], set()).add((r[0], len(library.encode(r[1], add_special_tokens=False).ids) + 1))
    got = {}
    for r in packed:
        got[r["doc_id"], r["doc_tokens"]] = got.get((r["doc_id"], r["doc_tokens"]), 0) + r["length"]
    assert all(n == total for (_, total), n in got.items())
    assert len(got) == len(want) and all(len(group & set(got)) == 1 for group in want.values())
    assert len(want) > 200 and (None, next(n for i, n in got if i is None)) in got
    windows = {}
    for r in packed:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in w) <= 2048 and [at for at, _ in sorted(w)] == [sum(n for _, n in sorted(w)[:k]) for k in range(len(w))] for w in windows.values())
