"""Near-duplicate join on word shingles: banded MinHash candidates, Bayesian pruning, exact verification.

Texts become sets of hashed runs of five words (words as split at Unicode white space, lower case; a text of one to four words is one
run, one without words the empty set). Equal sets are copies of one representative. Representatives meet in buckets of
BANDS keys of ROWS MinHash values; of the pairs at similarity 0.8 one in two million never meets. Inside a bucket pairs are
compared step by step on a byte of each MinHash; a pair goes as soon as the posterior probability of a similarity of
0.8 or more, from a uniform prior, is below TOLERANCE. What stays joins representatives to parts; only edges that span the parts of a
bucket are written, not pairs. Inside each part the pairs that met and stayed, and no others, are verified exactly on whole sets, in
blocks, and the exact links are counted and spanned again. The answer is one row per document: its class (the least doc_id joined to it by a chain of links,
itself included), its representative's doc_id and its number of links: other documents, copies included, of similarity 0.8 or more.

Buckets of more than BLOCK members and parts of more than PART_BLOCK members or PART_BYTES are cut into blocks that meet two by two, so
that no bucket or part is one task's. Long sets come in rows of CHUNK values. Texts without words are copies of each other. A null
text has no words. Rows that share a doc_id count as documents each; null doc_ids stand after all others for representatives and classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.structure import spanned

from .common import discard, settled, table, text_or_empty, whole

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 3
STEP = 10
TOLERANCE = 1e-9
#: Members of a bucket, and of a part, that one task compares with each other.
BLOCK, PART_BLOCK = 1024, 1024
#: Bytes of the sets of a block, and values of a set in one row.
PART_BYTES = 16 << 20
CHUNK = 1 << 13
SEED = 7919
HOT_KEYS = 100_000
HELD_BYTES = 64 << 20
#: Up to so many representatives (about 60 bytes each) that share a part go to the executors to pick their texts; beyond that both sides are shuffled.
BROADCAST_ROWS = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the outcome depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word runs, sorted. Words are hashed once while they are remembered."""

    def __init__(self, width: int = WIDTH, most: int = 400_000):
        self.width, self.most, self.known = width, most, {}
        self.factors = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(width)], np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        hashes = list(map(known.get, words))
        if None in hashes:
            if len(known) > self.most:
                known.clear()
            for i, h in enumerate(hashes):
                if h is None:
                    hashes[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        h = np.array(hashes, np.uint64)
        width = min(self.width, len(h))
        runs = np.full(len(h) - width + 1, len(words) if width < self.width else 0, np.uint64)
        for k in range(width):
            runs += mixed(h[k : len(h) - width + 1 + k] * self.factors[k])
        return np.unique(mixed(runs))


def least_matches(count: int, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> int:
    """Of count compared MinHash values the fewest matches at which a pair isn't dropped.

    With m matches and a uniform prior the similarity is Beta(m + 1, count - m + 1); its upper tail is a binomial sum.
    """
    for m in range(count + 1):
        # P(Beta(m + 1, n - m + 1) >= s) = P(Binomial(n + 1, s) <= m)
        tail = sum(math.comb(count + 1, i) * similarity**i * (1 - similarity) ** (count + 1 - i) for i in range(m + 1))
        if tail >= tolerance:
            return m
    return count + 1


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, digest (16 bytes of the set), size, keys (a 64-bit key for each band) and matches (a byte of each MinHash value)."""
    hashes = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle = Shingler()
        draw = np.random.default_rng(SEED)
        odd = draw.integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
        add = draw.integers(0, 1 << 63, hashes, np.uint64)
        salt = draw.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(2):
                s = shingle(text.as_py())
                least = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(s), 4096):
                    part = s[at : at + 4096]
                    least = np.minimum(least, (odd[:, None] * part[None, :] + add[:, None]).min(1))
                least = mixed(least)
                keys = mixed((least.reshape(BANDS, ROWS) * salt).sum(1, dtype=np.uint64)).astype(np.int64)
                rows.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), keys, (least >> np.uint64(56)).astype(np.uint8).tobytes()))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.binary())],
                names=["doc_id", "text_hash", "digest", "size", "keys", "matches"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, digest binary, size long, keys array<long>, matches binary")


def with_blocks(rows: DataFrame, key: str, block: int = BLOCK, size: Column | None = None, most: int = 1) -> DataFrame:
    """rows with __blocks: into how many blocks the members of its key are cut, 1 for up to block of them (and sizes of up to most together). The list of large keys is broadcast if it is short, else joined."""
    needed = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.lit(0) if size is None else size) / most))
    large = settled(rows.groupBy(key).agg(needed.cast("int").alias("__blocks")).filter("__blocks > 1"), "large")
    n = large.count()
    if not n:
        discard(large)
        return rows.withColumn("__blocks", F.lit(1))
    rows = rows.join(F.broadcast(large) if n <= HOT_KEYS else large, key, "left")
    return rows.withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))


def in_block_pairs(rows: DataFrame, member: str) -> DataFrame:
    """rows with __blocks, once for every pair (i, j) of blocks that theirs is of; mine tells which of the two it is (0 where they are one)."""
    own = F.pmod(F.xxhash64(F.lit("block"), member), F.col("__blocks")).cast("int")
    rows = rows.withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    mine = F.when((low < high) & (F.col("__own") == high), 1).otherwise(0)
    return rows.withColumns({"i": low, "j": high, "mine": mine}).drop("__blocks", "__own", "__other")


def by_group(run_group: Callable[[pa.Table], Iterator[pa.RecordBatch]], size: int) -> Callable:
    """A function for mapInArrow over rows sorted by their first three columns: it hands on tables of whole groups, each of about size rows, HELD_BYTES or one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < size and sum(b.nbytes for b in held) < HELD_BYTES:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = [whole.column(k).to_numpy() for k in range(3)]
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            if not len(change):
                continue
            cut = int(change[-1])
            yield from run_group(whole.slice(0, cut))
            held, rows = whole.slice(cut).to_batches(), whole.num_rows - cut
        if rows:
            yield from run_group(pa.Table.from_batches(held).combine_chunks())

    return run


def group_starts(whole: pa.Table) -> np.ndarray:
    keys = [whole.column(k).to_numpy() for k in range(3)]
    return np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))


def connected(count: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (the least row of each part) after joining the rows a and b."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        low, high = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


#: Compared values, and the fewest matches among them at which a pair stays.
STEPS = [(at + STEP, least_matches(at + STEP)) for at in range(0, BANDS * ROWS, STEP)]


def pruned(signed: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of signed (a byte of each MinHash value) that stay, comparing a step of values at a time."""
    same, at = np.zeros(len(a), np.int64), 0
    for upto, least in STEPS:
        same += (signed[a, at:upto] == signed[b, at:upto]).sum(1)
        stay = same >= least
        a, b, same, at = a[stay], b[stay], same[stay], upto
    return a, b


def signatures_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def bucket_edges(whole: pa.Table) -> Iterator[pa.RecordBatch]:
    """Edges that span, inside each bucket, the pairs that pruning leaves. Columns: key, i, j, mine, rep, matches."""
    n = whole.num_rows
    starts = group_starts(whole)
    sizes = np.diff(np.append(starts, n))
    end = np.repeat(starts + sizes, sizes)
    mine = whole.column(3).to_numpy()
    two = whole.column(1).to_numpy() != whole.column(2).to_numpy()
    reps, signed = whole.column(4).to_numpy(), signatures_of(whole.column(5))
    label, place = np.arange(n), np.arange(n)
    left = place
    for shift in range(1, int(sizes.max())):
        left = a = left[left + shift < end[left]]
        b = a + shift
        a, b = (x[(label[a] != label[b]) & (~two[a] | (mine[a] != mine[b]))] for x in (a, b))
        label = connected(n, *pruned(signed, a, b), label)
    moved = np.flatnonzero(label != place)
    yield pa.RecordBatch.from_arrays([pa.array(reps[moved]), pa.array(reps[label[moved]])], names=["a", "b"])


def candidates(keys: np.ndarray, signed: np.ndarray, apart: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of members (the first one earlier) that share a band's key and stay when pruned; apart: the sides that must differ."""
    n, met_a, met_b = len(keys), [], []
    step = max(1, (1 << 22) // n)
    for at in range(0, n, step):
        met = np.zeros((min(step, n - at), n), bool)
        for band in range(BANDS):
            met |= keys[at : at + step, band, None] == keys[None, :, band]
        a, b = np.nonzero(met)
        keep = a + at < b
        if apart is not None:
            keep &= apart[a + at] != apart[b]
        a, b = pruned(signed, a[keep] + at, b[keep])
        met_a.append(a), met_b.append(b)
    return np.concatenate(met_a), np.concatenate(met_b)


def verified(whole: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each member its exact links in this block or pair of blocks, and edges that span them. Columns: part, i, j, mine, rep, copies, keys, matches, chunk, set."""
    starts = group_starts(whole)
    ends = np.append(starts[1:], whole.num_rows)
    reps = whole.column(4).to_numpy()
    out_rep, out_links, out_edge = [], [], []
    for first, last in zip(starts, ends):
        begins = first + np.flatnonzero(np.append(True, reps[first + 1 : last] != reps[first : last - 1]))  # a member's first row
        n = len(begins)
        if n < 2:
            continue
        heads = whole.take(pa.array(begins))
        two = heads.column(1)[0].as_py() != heads.column(2)[0].as_py()
        keys = np.array(heads.column(6).to_pylist(), np.int64)
        a, b = candidates(keys, signatures_of(heads.column(7)), heads.column(3).to_numpy() if two else None)
        if not len(a):
            continue
        rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in whole.column(9).slice(first, last - first).combine_chunks()]
        bounds = [*(begins - first), last - first]
        sets = [rows[x] if y - x == 1 else np.concatenate(rows[x:y]) for x, y in zip(bounds, bounds[1:])]
        sizes = np.fromiter(map(len, sets), np.int64, n)
        if len(a) <= 2 * n:
            shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)], np.int64)
        else:
            shared = overlaps(sets)[a, b]
        close = shared * (1 + SIMILARITY) >= SIMILARITY * (sizes[a] + sizes[b]) - 1e-9
        a, b = a[close], b[close]
        copies = heads.column(5).to_numpy()
        links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        out_rep.append(reps[begins])
        out_links.append(links)
        out_edge.append(reps[begins][connected(n, a, b, np.arange(n))])
    if out_rep:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_rep, out_links, out_edge)], names=["rep", "links", "edge"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of pairs: the product of the incidence matrix with itself, some columns at a time."""
    n = len(sets)
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    often = count > 1
    number = np.cumsum(often) - 1
    row, column = row[often[column]], number[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = max(64, min(8192, (4 << 20) // max(1, n)))
    for at in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id (the column key), class_id, rep_id and n_links of each row of docs."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty().alias("text"))
    signed = settled(signatures(docs), "signed")
    last = F.lit((1 << 63) - 1)
    first = F.min(F.struct(F.coalesce("doc_id", last).alias("d"), F.col("text_hash").alias("t")))
    reps = signed.groupBy("digest").agg(first.alias("f"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("matches").alias("matches"))
    # representatives are numbered, as doc_ids may be null or repeat
    reps = settled(reps.select("digest", "f", "copies", "size", "keys", "matches", F.monotonically_increasing_id().alias("rep")), "reps")
    banded = reps.filter("size > 0").select(F.posexplode("keys").alias("band", "key"), "rep", "matches")
    banded = with_blocks(banded.select(F.xxhash64("band", "key").alias("key"), "rep", "matches"), "key")
    buckets = in_block_pairs(banded, "rep").select("key", "i", "j", "mine", "rep", "matches")
    buckets = buckets.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    parts = spanned(buckets.mapInArrow(by_group(bucket_edges, 20_000), "a long, b long"))
    members = parts.join(reps.select("rep", "f", "copies", "size", "keys", "matches"), F.col("node") == F.col("rep"))
    members = members.select("part", "rep", "copies", "keys", "matches", "size", F.col("f.d").alias("rep_id"), F.col("f.t").alias("text_hash"))
    members = settled(with_blocks(members, "part", PART_BLOCK, 8 * F.col("size"), PART_BYTES).drop("size"), "members")
    sets = shingle_sets(docs, signed, members.select("rep", "rep_id", "text_hash"))
    pairs = in_block_pairs(sets.join(members.drop("rep_id", "text_hash"), "rep"), "rep")
    pairs = pairs.select("part", "i", "j", "mine", "rep", "copies", "keys", "matches", "chunk", "set")
    exact = pairs.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "rep", "chunk").mapInArrow(by_group(verified, 2_000), "rep long, links long, edge long")
    exact = settled(exact, "exact")
    links = exact.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = spanned(exact.select(F.col("rep").alias("a"), F.col("edge").alias("b")))
    named = reps.select("rep", "digest", F.col("f.d").alias("rep_id"), "copies").join(links, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left")
    named = named.withColumn("part", F.coalesce("part", "rep")).drop("node")
    least = named.groupBy("part").agg(F.min("rep_id").alias("class_id"))
    named = named.join(least, "part").select("digest", "rep_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = {c: F.when(F.col(c) != last, F.col(c)) for c in ("class_id", "rep_id")}
    return signed.select("doc_id", "digest").join(named, "digest").withColumns(known).select("doc_id", "class_id", "rep_id", "n_links")


def shingle_sets(docs: DataFrame, signed: DataFrame, chosen: DataFrame) -> DataFrame:
    """rep, chunk and set (up to CHUNK sorted 64-bit values): the set of the first document of each of chosen (rep, rep_id, text_hash), from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()

        def out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            reps, chunks, sets = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(chunks, pa.int32()), pa.array(sets, pa.binary())], names=["rep", "chunk", "set"])

        for batch in batches:
            rows, held = [], 0
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = shingle(text.as_py())
                for k in range(0, len(own), CHUNK):
                    rows.append((rep, k // CHUNK, own[k : k + CHUNK].tobytes()))
                held += own.nbytes
                if held > HELD_BYTES // 4:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    texts = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("rep_id"), F.xxhash64("text").alias("text_hash"), "text")
    small = chosen.count() <= BROADCAST_ROWS
    joined = texts.join(F.broadcast(chosen) if small else chosen, ["rep_id", "text_hash"])
    sets = joined.select("rep", "text").mapInArrow(run, "rep long, chunk int, set binary")
    repeated = signed.groupBy("doc_id", "text_hash").count().filter("count > 1")
    return sets if repeated.isEmpty() else sets.dropDuplicates(["rep", "chunk"])


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns: the one whose doc_id names the class.

    Where doc_ids are null or repeat, rows are written with a number each, and the least number of a class stays.
    """
    counts = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if counts[0] == counts[1]:
        kept = near_duplicates(docs).filter("doc_id = class_id").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
    numbered = settled(docs.select(whole(docs).alias("__doc"), "text", F.monotonically_increasing_id().alias("__row")), "numbered")
    kept = near_duplicates(numbered, "__row").filter("doc_id = class_id").select(F.col("doc_id").alias("__row"))
    return numbered.join(kept, "__row", "left_semi").select("__doc.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB SQL for op5_jaccard_join over documents. Its white space is that of str.split.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
      FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT d.r, doc_id, coalesce(n, 0) AS n, coalesce(k, '') AS k
      FROM d LEFT JOIN (SELECT r, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM g GROUP BY r) USING (r)),
c AS (SELECT k, min(r) AS r, min(doc_id) AS rep_id, count(*) AS copies, any_value(n) AS n FROM z GROUP BY k),
e AS (SELECT a.r AS a, b.r AS b FROM (SELECT g.* FROM g JOIN c USING (r)) a JOIN (SELECT g.* FROM g JOIN c USING (r)) b ON a.s = b.s AND a.r <> b.r
      JOIN c x ON x.r = a.r JOIN c y ON y.r = b.r GROUP BY a.r, b.r, x.n, y.n HAVING 9 * count(*) >= 4 * (x.n + y.n)),
l AS (SELECT a, sum(copies) AS n FROM e JOIN c ON c.r = e.b GROUP BY a),
t AS (SELECT r AS a, r AS b FROM c UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b),
m AS (SELECT t.a, min(c.rep_id) AS class_id FROM t JOIN c ON c.r = t.b GROUP BY t.a)
SELECT z.doc_id, m.class_id, c.rep_id, (coalesce(l.n, 0) + c.copies - 1)::BIGINT AS n_links
FROM z JOIN c ON z.k = c.k JOIN m ON m.a = c.r LEFT JOIN l ON l.a = c.r
"""
