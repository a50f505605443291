"""Quality rules with host-level verdicts.

Each document is measured by rules. Failures are counted by host (the column source) and each host's rate is shrunk
by a beta prior fitted to all hosts' rates by moments. The verdict comes back to the host's documents: it tightens
their limits in proportion to the shrunk rate, and a host that fails almost always loses all its documents. A document
without symbols and repeated lines stays on any other host.

Words are runs of characters other than ASCII white space. A null text has none, so it fails for being short; a null
host is a host of its own, apart from an empty one. Repeated rows count each. Windows of three words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table, whole

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Parts of word characters that are symbols, and of lines with words that repeat; they hold on a host that never fails.
SYMBOL_LIMIT, LINE_LIMIT = 0.05, 0.3
HOST_LIMIT = 0.9
#: A line of boilerplate that comes again is no fault yet.
FORGIVEN_LINES = 2
#: Fixed values of the contract.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    cut = F.split(F.trim(text, F.lit(BLANKS)), "[ \\t\\n\\x0B\\f\\r]+")
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "")
    out = docs.withColumns(
        {
            "__words": F.when(F.length(bare) > 0, cut).otherwise(F.array().cast("array<string>")),
            "__lines": lines,
            "word_chars": F.length(bare).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__runs": F.expr("if(size(__words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(__words) - 3), i -> xxhash64(__words[i], __words[i + 1], __words[i + 2])))"),
        }
    ).drop("__words", "__lines")
    # places of runs in order of their digests; those whose neighbour is alike, again in order of place
    out = out.withColumn("__sorted", F.expr("if(size(array_distinct(__runs)) = size(__runs), null, sort_array(transform(__runs, (r, i) -> struct(r as r, i as i))))")).drop("__runs")
    out = out.withColumn("__twice", F.expr("sort_array(transform(filter(__sorted, (x, k) -> x.r = get(__sorted, k - 1).r or x.r = get(__sorted, k + 1).r), x -> x.i))")).drop("__sorted")
    covered = "aggregate(__twice, named_struct('n', 0L, 'end', 0), (a, i) -> named_struct('n', a.n + 3 - greatest(0, a.end - i), 'end', i + 3), a -> a.n)"
    repeats = F.expr(f"if(size(__twice) > 0, {covered}, 0L)")
    # always true, but not deterministic: later filters stay above, where they don't repeat the lists for each of their elements
    return out.withColumn("n_repeat_words", F.when(F.monotonically_increasing_id() >= 0, repeats)).drop("__twice")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def over(limit_part: Column) -> Column:
    """Whether symbols or repeated lines exceed this part of their limits."""
    return (F.col("n_symbols") > SYMBOL_LIMIT * limit_part * F.col("word_chars")) | ((F.col("n_dup_lines") > LINE_LIMIT * limit_part * F.col("n_lines")) & (F.col("n_dup_lines") > FORGIVEN_LINES))


def host() -> Column:
    """The host, marked, so that none reads like a missing one."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def host_rates(measures: DataFrame) -> DataFrame:
    """host and its shrunk failure rate. One row for each host; three sums of them fit the prior."""
    failed = F.when(base_failed() | over(F.lit(1.0)), 1).otherwise(0)
    hosts = measures.groupBy(host().alias("__host")).agg(F.count("*").alias("__n"), F.sum(failed).alias("__failed"))
    hosts = settled(hosts, "hosts")
    rate = F.col("__failed") / F.col("__n")
    # moments of the rates, weighted alike; what sampling adds to their variance is taken off
    fit = hosts.agg(F.count("*").alias("k"), F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(rate * (1 - rate) / F.col("__n")).alias("s")).first()
    mean = min(0.999, max(0.001, fit["m"] or 0.0))
    spread = max((fit["v"] or 0.0) - (fit["s"] or 0.0), 1e-4)
    strength = max(1.0, mean * (1 - mean) / spread - 1)
    shrunk = (F.col("__failed") + F.lit(mean * strength)) / (F.col("__n") + F.lit(strength))
    return hosts.select("__host", shrunk.alias("host_rate"))


def judged(measures: DataFrame, rates: DataFrame) -> DataFrame:
    """measures with base_failed, host_rate and kept."""
    joined = measures.join(rates, host() == F.col("__host")).drop("__host")
    verdict = (F.col("host_rate") < HOST_LIMIT) & ~over(1 - F.col("host_rate"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns. Rows and their measures are written once; host rates read the measures only."""
    measures = settled(measured(docs.select(whole(docs).alias("__doc"), "source", "text")).drop("text"), "measures")
    return judged(measures, host_rates(measures)).filter("kept").select("__doc.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measures = settled(measured(docs).drop("text"), "measures")
    return judged(measures, host_rates(measures)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


#: DuckDB SQL for op8_quality over documents.
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(x) AS word, generate_subscripts(x, 1) AS i
      FROM (SELECT r, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS x FROM d)),
g AS (SELECT r, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) AS n FROM g WHERE c IS NOT NULL),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
wc AS (SELECT r, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY r),
l AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, host, coalesce(wc.n, 0)::BIGINT AS n_words, coalesce(wc.chars, 0)::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_lines,
        coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN wc USING (r) LEFT JOIN l USING (r) LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
s AS (SELECT host, count(*)::DOUBLE AS n,
        sum(CASE WHEN base_failed OR n_symbols > {SYMBOL_LIMIT}::DOUBLE * word_chars OR (n_dup_lines > {LINE_LIMIT}::DOUBLE * n_lines AND n_dup_lines > {FORGIVEN_LINES}) THEN 1 ELSE 0 END)::DOUBLE AS f
      FROM b GROUP BY host),
f AS (SELECT least(0.999, greatest(0.001, avg(f / n))) AS mean, greatest(var_pop(f / n) - avg(f / n * (1 - f / n) / n), 1e-4) AS spread FROM s),
q AS (SELECT host, (s.f + mean * strength) / (n + strength) AS rate
      FROM s, (SELECT mean, greatest(1.0, mean * (1 - mean) / spread - 1) AS strength FROM f))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate < {HOST_LIMIT} AND NOT (n_symbols > {SYMBOL_LIMIT}::DOUBLE * (1 - rate) * word_chars OR n_dup_lines > {LINE_LIMIT}::DOUBLE * (1 - rate) * n_lines AND n_dup_lines > {FORGIVEN_LINES}) AS kept,
  round(rate, 9) AS host_rate
FROM b JOIN q USING (host)
"""
