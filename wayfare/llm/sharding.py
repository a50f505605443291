"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows are dealt to blocks; how many rows each block sends to each shard is drawn exactly as in a uniform shuffle of
all rows, given the blocks' and shards' sizes. Each block permutes its rows and cuts the order by these counts; each
shard permutes what it gets, in buckets of a hash whose sizes give the buckets' first slots. The law is `rows`:
shard sizes are at most one apart.

Only counts of blocks come to the driver, at most MAX_BLOCKS. Rows are numbered when the digests are written, so
equal rows are rows of their own, and no key's rows meet in one task. A null text has size 1 and the checksum of
no bytes; doc_id may be null or repeat. For one layout of the input a seed gives one shuffle.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, table, text_or_empty

SHARDS = 8
SEED = 20_011
BLOCK_ROWS = 1 << 16
MIN_BLOCKS, MAX_BLOCKS = 256, 1 << 16


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of draws rows out of good and bad ones are good; inversion outwards from the mode, exact to rounding."""
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - at_mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while u >= 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u < 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u < 0:
                return down
    return mode


def communication_matrix(rng: random.Random, rows: list[int], columns: list[int]) -> list[list[int]]:
    """Counts with these row and column sums, distributed as those of a uniform permutation. Halves the rows again and again."""
    if len(rows) == 1:
        return [list(columns)]
    half = len(rows) // 2
    draws, left, open_ = sum(rows[:half]), [], sum(columns)
    for c in columns:
        open_ -= c
        n = hypergeometric(rng, c, open_, draws)
        left.append(n)
        draws -= n
    return communication_matrix(rng, rows[:half], left) + communication_matrix(rng, rows[half:], [c - n for c, n in zip(columns, left)])


def shuffle_to_shards(rows: DataFrame, number: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add shard and slot (gapless from 0 in each shard) to rows, told apart by the column number; rows is read several times."""
    total = rows.count()
    blocks = min(MAX_BLOCKS, max(MIN_BLOCKS, -(-total // BLOCK_ROWS)))

    def draw(what: str) -> Column:
        return F.xxhash64(F.lit(f"{what} {seed}"), F.col(number))

    dealt = rows.withColumn("__block", F.pmod(draw("block"), F.lit(blocks)).cast("int"))
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("__block").count().collect())
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(random.Random(seed), [n for _, n in sizes], targets) if sizes else []
    ends = []
    for (block, _), row in zip(sizes, matrix):
        ends.append({"b": block, "ends": [sum(row[: s + 1]) for s in range(shards - 1)]})
    cuts = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(ends)), "array<struct<b:int,ends:array<bigint>>>")).alias("c")).select("c.*")
    rank = F.row_number().over(Window.partitionBy("__block").orderBy(draw("order"), number)) - 1
    # at most MAX_BLOCKS rows of one number for each shard
    sent = dealt.withColumn("__rank", rank).join(F.broadcast(cuts), F.col("__block") == F.col("b"))
    shard = F.size(F.filter("ends", lambda e: F.col("__rank") >= e)).cast("int")
    buckets = max(32, -(-total // (shards * BLOCK_ROWS)))
    sent = settled(sent.select(*rows.columns, shard.alias("shard"), F.pmod(draw("bucket"), F.lit(buckets)).cast("int").alias("__bucket")), "sharded")
    counts = sent.groupBy(F.col("shard").alias("__s"), F.col("__bucket").alias("__b")).count()
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("__s", "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    own = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(draw("slot"), number)) - 1
    placed = sent.withColumn("__own", own).join(firsts, (F.col("shard") == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    return placed.select(*rows.columns, "shard", (F.col("__first") + F.col("__own")).alias("slot"))


def sharded_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document."""
    text = text_or_empty()
    digests = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.monotonically_increasing_id().alias("__number"))
    placed = shuffle_to_shards(settled(digests, "digests"), "__number", shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_documents(table(spark, sf_dir, "documents"))
