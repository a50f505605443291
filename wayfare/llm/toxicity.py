"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Features are whole words (runs of letters, lower case, marked by a closing $) and their first three to eight letters. How many
training texts of either label hold a word, summed over a feature's words, gives its log-odds, smoothed by a Dirichlet prior in
proportion to its frequency in both. Those of at least MIN_ODDS that exceed Z standard deviations are listed, at most MAX_FEATURES of
the surest. A token scores the log-odds of its longest listed feature, and all other tokens those of their common share of all tokens,
which are negative. A linear scan finds all maximal segments of a text; every occurrence of a word scores alike, whatever stands elsewhere.

A segment of score s in a text of m tokens is expected K m exp(-decay s) times by chance. The decay is the positive root of
E[exp(decay score)] = 1 over the tokens of clean training texts, K the maximum-likelihood value for those texts' best
segments; a segment is significant where fewer than SIGNIFICANT are expected. The evidence of a text is the sum of -log of these
expectations, and a logistic curve over it, fitted to the training rows, gives the score.

Only rows whose crc32(doc_id as text) mod 3 isn't 1 teach, about TRAIN_ROWS labelled ids at most (those of low hash). Equal
texts count once. A null or empty text has no evidence and gets the score of such texts. Without labels of both kinds no
feature is listed and every score is the share of toxic training rows, smoothed. A null doc_id is never held out nor labelled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, settled, table, text_or_empty, whole

#: Labelled ids that teach; with more of them those whose hash lies below a bound that lets about so many pass.
TRAIN_ROWS = 500_000
MAX_FEATURES = 200_000
PRIOR = 0.05
Z, MIN_ODDS = 4.0, 1.5
SIGNIFICANT = 0.01
SHORT, LONG = 3, 8
THRESHOLD = 0.7
WORDS = re.compile(r"[^\W\d_]+")


def held_out() -> Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of about TRAIN_ROWS labelled ids at most that may teach."""
    own = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = TRAIN_ROWS / max(1, labels.count())
    return own if share >= 1 else own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, t and c (how many toxic and clean texts hold it), m and n (how often it stands in them). docs has text and toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, often = (Counter(), Counter()), (Counter(), Counter())

        def out():
            words = list(kinds[0].keys() | kinds[1].keys())
            columns = [pa.array([k[w] for w in words], pa.int64()) for k in (*kinds[::-1], *often[::-1])]
            for k in (*kinds, *often):
                k.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *columns], names=["word", "t", "c", "m", "n"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                own = Counter(WORDS.findall(text.as_py().lower()))
                kinds[toxic > 0].update(own.keys())
                often[toxic > 0].update(own)
            if len(kinds[0]) + len(kinds[1]) > 400_000:
                yield out()
        yield out()

    counted = docs.select("text", "toxic").mapInArrow(run, "word string, t long, c long, m long, n long")
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in "tcmn"])


def listed_features(words: DataFrame) -> dict[str, float]:
    """The listed features' log-odds. At most MAX_FEATURES features come to the driver."""
    sums = words.agg(F.sum("t"), F.sum("c")).first()
    n_t, n_c = sums[0] or 0, sums[1] or 0
    if not n_t or not n_c:
        return {}
    heads = [F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in range(SHORT, LONG + 1)]
    features = F.array_compact(F.array(F.concat("word", F.lit("$")), *heads))
    counts = words.select(F.explode(features).alias("feature"), "t", "c").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter("t > 1")
    prior = PRIOR * (F.col("t") + F.col("c"))
    total = PRIOR * (n_t + n_c)
    y_t, y_c = F.col("t") + prior, F.col("c") + prior
    odds = F.log(y_t / (n_t + total - y_t)) - F.log(y_c / (n_c + total - y_c))
    sure = counts.select("feature", odds.alias("odds"), (odds / F.sqrt(1 / y_t + 1 / y_c)).alias("z")).filter((F.col("z") > Z) & (F.col("odds") >= MIN_ODDS))
    return {r["feature"]: r["odds"] for r in sure.orderBy(F.col("z").desc(), "feature").limit(MAX_FEATURES).collect()}


def token_scores(words: DataFrame, listed: dict[str, float]) -> list[tuple[float | None, int, int]]:
    """score (None: not listed) and the sums of m and n of the words that have it; no more rows than listed features and one."""
    model = words.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.value, 0.0)
        for batch in batches:
            scores = pa.array([scanner.token(w) for w in batch.column(0).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([scores, *batch.columns[1:]], names=["score", "m", "n"])

    rows = words.select("word", "m", "n").mapInArrow(run, "score double, m long, n long")
    return [tuple(r) for r in rows.groupBy("score").agg(F.sum("m"), F.sum("n")).collect()]


def other_score(scores: list[tuple]) -> float:
    """The log-odds of all tokens that aren't listed, taken together; below 0, as a scan needs."""
    rest = next((r for r in scores if r[0] is None), (None, 0, 0))
    sums = [sum(r[k] for r in scores) for k in (1, 2)]
    if not all(sums):
        return -0.01
    return min(-0.01, math.log((rest[1] + 1) / (sums[0] + 1)) - math.log((rest[2] + 1) / (sums[1] + 1)))


def decay_factor(scores: list[tuple], other: float) -> float:
    """The positive root of E[exp(x score)] = 1 over clean tokens; 1 where no clean token has a listed feature (log-odds have the root 1)."""
    total = sum(r[2] for r in scores)
    own = [(r[0], r[2] / total) for r in scores if r[0] is not None and r[2]] if total else []
    rest = 1 - sum(q for _, q in own)

    def excess(x: float) -> float:
        return sum(q * math.exp(min(500.0, x * s)) for s, q in own) + rest * math.exp(x * other) - 1

    if not own or sum(q * s for s, q in own) + rest * other >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while excess(high) < 0:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


class Scanner:
    """Finds the maximal scoring segments of texts."""

    def __init__(self, listed: dict[str, float], other: float):
        self.listed, self.other = listed, other
        self.heads = {f[:SHORT].rstrip("$") for f in listed}

    def token(self, word: str) -> float | None:
        if word[:SHORT] not in self.heads:
            return None
        found = self.listed.get(word + "$")
        for k in range(min(LONG, len(word)), SHORT - 1, -1):
            if found is not None:
                return found
            found = self.listed.get(word[:k])
        return found

    def segments(self, words: list[str]) -> list[tuple[float, int, int]]:
        """(score, first token, token after the last) of the maximal segments, in order; each token is handled once."""
        heads, token = self.heads, self.token
        found: list[tuple[float, float, int, int, int]] = []  # sums before and after, tokens, the nearest one before with a smaller sum before it
        total, at = 0.0, 0
        for i, word in enumerate(words):
            if word[:SHORT] not in heads or (score := token(word)) is None:
                continue
            total += self.other * (i - at)
            low, first, at = total, i, i + 1
            total += score
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][0] >= low:
                    j = found[j][4]
                if j < 0 or found[j][1] >= total:
                    found.append((low, total, first, at, j))
                    break
                low, first = found[j][0], found[j][2]
                del found[j:]
        return [(after - before, a, b) for before, after, a, b, _ in found]


def lowered(text: str) -> str:
    """text in lower case, a character for each of its own, so that places in it are places in the text."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c.lower()[0] for c in text)


def scanned(docs: DataFrame, listed: dict[str, float], other: float, columns: list[str]) -> DataFrame:
    """columns of docs with tokens (count), scores (of the maximal segments) and spans (their first and last character)."""
    model = docs.sparkSession.sparkContext.broadcast((listed, other))
    inner = docs.select(*columns, text_or_empty().alias("__text"))
    found = StructType.fromDDL("tokens long, scores array<double>, spans array<struct<first:long,end:long>>")
    pairs = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*model.value)
        for batch in batches:
            tokens, scores, spans = [], [], []
            for value in batch.column(len(columns)):
                text = lowered(value.as_py())
                words = WORDS.findall(text)
                segments = scanner.segments(words)
                tokens.append(len(words))
                scores.append([s for s, _, _ in segments])
                places = [m.span() for m in WORDS.finditer(text)] if segments else []
                spans.append([{"first": places[a][0], "end": places[b - 1][1]} for _, a, b in segments])
            arrays = [batch.column(k) for k in range(len(columns))] + [pa.array(tokens, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(spans, pairs)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "tokens", "scores", "spans"])

    return inner.mapInArrow(run, StructType(inner.schema.fields[:-1] + found.fields))


def log_expected(score: Column, k: float, decay: float) -> Column:
    """The log of how many segments of this score a clean text of so many tokens has by chance."""
    return F.lit(math.log(k)) + F.log(F.col("tokens").cast("double")) - F.lit(decay) * score


def with_evidence(scans: DataFrame, k: float, decay: float) -> DataFrame:
    """Add passages (score, first and end character of the significant segments) and evidence."""
    joined = F.arrays_zip(F.col("scores").alias("score"), F.col("spans").alias("span"))
    kept = F.filter(joined, lambda x: log_expected(x["score"], k, decay) < math.log(SIGNIFICANT))
    out = scans.withColumn("passages", kept)
    return out.withColumn("evidence", F.aggregate("passages", F.lit(0.0), lambda a, x: a - log_expected(x["score"], k, decay)))


def logistic_fit(bins: list[tuple[float, int, int]], ridge: float = 1e-3) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-a - b x)) for (x, clean rows, toxic rows), by Newton steps."""
    clean, toxic = sum(n for _, n, _ in bins), sum(n for _, _, n in bins)
    a, b = math.log((toxic + 1) / (clean + 1)), 0.0
    if not clean or not toxic:
        return a, b
    for _ in range(50):
        ga, gb, haa, hab, hbb = 0.0, -ridge * b, 1e-9, 0.0, ridge
        for x, c, t in bins:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x))))
            r, w = t - (c + t) * p, (c + t) * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + r, gb + r * x, haa + w, hab + w * x, hbb + w * x * x
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5 / max(1e-9, abs(da), abs(db)))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def scored(docs: DataFrame, labels: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, passages and the carried columns of each row of docs, learnt from labels of docs' rows."""
    teach = settled(training_labels(labels), "labels")
    own = docs.select("doc_id", text_or_empty().alias("text"), *carried)
    # about TRAIN_ROWS pairs of numbers at most
    taught = own.join(F.broadcast(teach), "doc_id")
    once = settled(taught.groupBy(F.xxhash64("text")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic"), "taught")
    words = settled(word_counts(own.join(F.broadcast(once.distinct()), "doc_id").select("text", "toxic")), "words")
    listed = listed_features(words)
    by_score = token_scores(words, listed)
    other = other_score(by_score)
    decay = decay_factor(by_score, other)
    scans = scanned(own, listed, other, ["doc_id", *carried]).join(F.broadcast(teach), "doc_id", "left")
    scans = settled(scans, "scans")
    for done in (words, once, teach):
        discard(done)
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    clean = scans.filter("toxic = 0 and tokens > 0").agg(F.count("*"), F.sum(F.col("tokens") * F.exp(-F.lit(decay) * best))).first()
    k = clean[0] / clean[1] if clean[0] else 1e-3
    scans = with_evidence(scans, k, decay)
    binned = F.round(F.least(F.col("evidence"), F.lit(60.0)) * 4) / 4
    bins = scans.filter("toxic is not null").groupBy(binned.alias("x")).agg(F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0))).collect()
    a, b = logistic_fit([tuple(r) for r in sorted(bins)])
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.least(F.col("evidence"), F.lit(60.0)))))
    out = scans.select("doc_id", held_out().alias("held_out"), score.alias("score"), "evidence", "passages", *carried)
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't toxic, with their own columns. Each row is judged by its own text, whether or not its doc_id is null or shared."""
    return scored(docs.select("doc_id", "text", whole(docs).alias("__doc")), labels, ("__doc",)).filter("predicted = 0").select("__doc.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "evidence", F.size("passages").alias("n_passages"))
