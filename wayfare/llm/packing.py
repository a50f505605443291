"""Pack token sequences into windows by minimum bin slack.

Documents are cut at multiples of the window, and a rest of over half a window at its half; only the histogram of piece lengths is needed to plan. For each window the
longest remaining length is laid in, then a dynamic programme over bitsets (bit s: a sum s can be reached) picks the
multiset of remaining lengths that fills the rest closest to capacity, and its counts are traced back. The pattern
found is applied as often as the counts allow, so the plan's size depends on the window, not on the data. Pieces
then take the places of their length in turn, ranked within salted groups of their numbers.

Null texts are empty; an empty text still has its end id (without one it makes no piece); repeated rows are packed each, as pieces
are told apart by a number that is written with them.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, table, text_or_empty, vocabulary_path
from .encoding import map_texts
from .pieces import ByteEncoder, four_bytes

WINDOW = 2048
END_ID = 1
ROWS_PER_SALT = 200_000
#: Places of a plan (48 bytes each) that are broadcast; those of a longer one are joined by shuffle.
BROADCAST_PLACES = 200_000


def closest_fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths, with at most counts[n] of length n, whose sum is largest without exceeding room."""
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left = most = min(counts[length], room // length)
        steps.append((length, reach, most))
        take = 1
        while left:
            take = min(take, left)
            reach |= reach << take * length & mask
            left -= take
            take *= 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for length, before, most in reversed(steps):
        n = next(n for n in range(most + 1) if at >= n * length and before >> at - n * length & 1)
        if n:
            used[length] = n
            at -= n * length
    return used


def plan_windows(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: count in a window}) for each pattern, until every length is used up."""
    left, plan = {n: c for n, c in counts.items() if c}, []
    if any(n < 1 or n > window for n in left):
        raise ValueError("lengths lie between 1 and the window")
    while left:
        first = max(left)
        others = dict(left)
        others[first] -= 1
        pattern = closest_fill(window - first, others)
        pattern[first] = pattern.get(first, 0) + 1
        repeats = min(left[n] // c for n, c in pattern.items())
        plan.append((repeats, pattern))
        for n, c in pattern.items():
            left[n] -= repeats * c
            if not left[n]:
                del left[n]
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first window, pieces in a window, offset of the first): where ranks of a length go."""
    rank: dict[int, int] = {}
    out, base = [], 0
    for repeats, pattern in plan:
        offset = 0
        for n, c in sorted(pattern.items(), reverse=True):
            low = rank.get(n, 0)
            rank[n] = low + repeats * c
            out.append((n, low, rank[n], base, c, offset))
            offset += n * c
        base += repeats
    return out


def pack(pieces: DataFrame, length: str, number: str, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to pieces of 1 to window tokens, told apart by the whole number in the column number.

    pieces is read several times and should be cheap to read. Only the histogram, at most window rows, comes to the driver.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    laid = places(plan_windows(histogram, window))
    spots = spark.createDataFrame(laid, "__l long, low long, high long, base long, each long, at long")
    if len(laid) <= BROADCAST_PLACES:
        spots = F.broadcast(spots)
    salts = max(16, math.ceil(sum(histogram.values()) / ROWS_PER_SALT))
    salted = pieces.select(F.struct(*pieces.columns).alias("__piece"), F.col(length).alias("__length"), F.col(number).alias("__n"))
    salted = salted.withColumn("__salt", F.pmod(F.xxhash64("__n"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("__length", "__salt").count()
    before = Window.partitionBy("__length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("__length", "__salt").orderBy("__n")) - 1
    ranked = salted.withColumn("__own", own).join(groups, ["__length", "__salt"]).withColumn("__rank", F.col("__own") + F.col("__before"))
    placed = ranked.join(spots, (F.col("__length") == F.col("__l")) & (F.col("__rank") >= F.col("low")) & (F.col("__rank") < F.col("high")))
    step = F.col("__rank") - F.col("low")
    return placed.select(
        "__piece.*",
        (F.col("base") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.col("__length") * F.pmod(step, F.col("each"))).cast("long").alias("offset"),
    )


def cut_pieces(ids: bytes, window: int = WINDOW, end_id: int | None = END_ID, keep_ids: bool = False) -> list[tuple]:
    """(start, length, crc32 of the ids, tokens of the document[, ids]) for pieces of at most window ids.

    A last piece of over half a window is cut there: halves pair up, and lengths of up to half a window fill windows closely.
    """
    if end_id is not None:
        ids += four_bytes([end_id])
    total = len(ids) // 4
    if not total:
        return []
    starts = [*range(0, total, window)]
    if total - starts[-1] > window // 2 and total % window:
        starts.append(starts[-1] + window // 2)
    out = []
    for at, end in zip(starts, [*starts[1:], total]):
        part = ids[4 * at : 4 * end]
        out.append((at, end - at, zlib.crc32(part), total) + ((part,) if keep_ids else ()))
    return out


def token_pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int | None = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (little-endian, 32 bits each)."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    schema = "start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if keep_ids else "")
    return map_texts(rows, "text", ["doc_id"], vocabulary, ByteEncoder, lambda ids: cut_pieces(ids, window, end_id, keep_ids), schema)


def packed_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Every document's pieces with the window (sequence_id) and the offset there that each takes."""
    pieces = token_pieces(docs, vocabulary, window, keep_ids=keep_ids).withColumn("__number", F.monotonically_increasing_id())
    return pack(settled(pieces, "pieces"), "length", "__number", window).drop("__number")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
