"""Document fingerprints from invertible Bloom lookup sketches of paragraphs.

A text is cut into short paragraphs (at line feeds and sentence ends, long ones every 200 characters); their 64-bit digests
form a set. A sketch has three rows of a power of two of cells; a digest enters one cell of each row, by its leading bits after it
is turned by 0, 16 or 32 bits. A cell holds the xor of its (turned) digests and the sum of their tags (2^32 plus a 32-bit
hash), so that the sum tells both their number and whether the xor is a single digest. A row is built by sorting the turned digests
among a mark for each cell. The fingerprint is the text's length and hash, the number of digests, and a sketch that
has a cell a row for PER_CELL of them, sixteen at least; there is no largest one.

Two fingerprints are compared by what they hold and nothing else. Cells of neighbours add up to those of a smaller sketch, so both
are brought to the smaller one's size and subtracted cell by cell; cells of single digests are peeled until nothing is left, which recovers the
digests in which the texts differ. Peeling begins at a size that the difference's counts suggest; where it fails it is tried again at twice the
size, up to the common one. Beyond that both fingerprints are opened (each peeled to its own digests), and the digests that only one of them
holds are counted. Only if a fingerprint can't be opened, as two of its digests share their cells in all rows, the
difference is estimated by the counts' squared deviations, between the bounds that the numbers of digests give. Likeness is the
Jaccard similarity of the two sets of digests, from their sizes and the number of differing digests; two empty sets are alike.

A null text is empty. Rows follow by descending doc_id, null ones last, equal ones by a hash of the text; after the last comes the first,
which in a table of one row is itself. Neighbours meet in ranges of about ROWS_PER_RANGE rows; a doc_id of more rows spans several.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty

ROWS_PER_RANGE = 2000
MAX_RANGES = 1 << 16
ROUNDS = 24
FIRST_BITS = 4
TABLE_ROWS = 3
#: Differing digests for each cell of a row that a sketch is made for, and at which peeling begins.
PER_CELL, PEELED_PER_CELL = 1.1, 1.6
#: Bits that every digest has (the lowest one after any turn), by which marks of cells differ; and the bit that none has, set for those of the second text.
ODD, SECOND = 0x0001000100010001, 2
PARAGRAPH = "(?s)[^.!?\\n]{1,200}[.!?\\n]*|[.!?\\n]+"


def let(name: str, value: str, body: str) -> str:
    """body with name bound to value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def tag(digest: str) -> str:
    return f"(4294967296L + (cast(hash({digest}) as bigint) & 4294967295L))"


def turned(digest: str, row: int) -> str:
    n = 16 * (row % 4)
    return f"(shiftleft({digest}, {n}) | shiftrightunsigned({digest}, {64 - n}))" if n else digest


def marks(bits: str) -> str:
    """A value for each cell of a row that sorts before the turned digests of the cell."""
    return f"transform(sequence(0, shiftleft(1, {bits}) - 1), c -> shiftleft(cast(c as bigint) - shiftleft(1L, {bits} - 1), 64 - {bits}))"


def row_cells(digests: str, row: int, marked: str, before: str = "") -> str:
    """The cells of a row, one for each mark.

    before: cells that the digests are taken out of; those with the bit SECOND, which counts for nothing else, are put in instead.
    """
    second = SECOND << 16 * row
    one = f"(x & {~second}L)" if before else "x"
    sum_ = f"if((x & {second}L) = 0L, a.s - {tag(one)}, a.s + {tag(one)})" if before else f"a.s + {tag(one)}"
    start = f"{before}[c]" if before else "named_struct('k', 0L, 's', 0L)"
    cell = f"aggregate(slice(z, p[c] + 2, p[c + 1] - p[c] - 1), {start}, (a, x) -> named_struct('k', a.k ^ {one}, 's', {sum_}))"
    places = "concat(filter(sequence(0, size(z) - 1), i -> (z[i] & 1L) = 0L), array(size(z)))"
    cells = let("p", places, f"transform(sequence(0, size(p) - 2), c -> if(p[c + 1] - p[c] = 1, {start}, {cell}))")
    return let("z", f"sort_array(concat(transform({digests}, d -> {turned('d', row)}), {marked}))", cells)


def sketch(digests: str, marked: str) -> str:
    """Three rows of cells."""
    return f"array({', '.join(row_cells(digests, r, marked) for r in range(TABLE_ROWS))})"


def taken_out(cells: str, digests: str, marked: str) -> str:
    """Cells without digests that were found in them."""
    return f"array({', '.join(row_cells(digests, r, marked, f'{cells}[{r}]') for r in range(TABLE_ROWS))})"


def minus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (u, v) -> zip_with(u, v, (p, q) -> named_struct('k', p.k ^ q.k, 's', p.s - q.s)))"


def peeled(cells: str, marked: str) -> str:
    """The digests that a difference of sketches holds, those of the second text with the bit SECOND, or null if it can't be peeled."""

    def singles(row: int) -> str:
        # a sum between 2^32 and 2^33 can be one digest's; the hash decides
        hit = f"filter(s.c[{row}], x -> abs(x.s) >= 4294967296L and abs(x.s) < 8589934592L and abs(x.s) = {tag('x.k')})"
        return f"transform({hit}, x -> if(x.s > 0L, {turned('x.k', 4 - row)}, {turned('x.k', 4 - row)} | {SECOND}L))"

    found = f"array_distinct(concat({', '.join(map(singles, range(TABLE_ROWS)))}))"
    more = f"named_struct('c', {taken_out('s.c', 'f', marked)}, 'd', concat(s.d, f), 'go', true)"
    step = let("f", found, f"if(size(f) = 0, named_struct('c', s.c, 'd', s.d, 'go', false), {more})")
    start = f"named_struct('c', {cells}, 'd', cast(array() as array<bigint>), 'go', true)"
    clear = "if(exists(s.c, u -> exists(u, x -> x.k <> 0L or x.s <> 0L)), null, s.d)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, n) -> if(s.go, {step}, s), s -> {clear})"


def folded(cells: str, bits: str, to: str) -> str:
    """A sketch of 2^bits cells a row brought to 2^to."""
    sum_ = "(a, x) -> named_struct('k', a.k ^ x.k, 's', a.s + x.s)"
    own = f"aggregate(slice(u, c * shiftleft(1, {bits} - {to}) + 1, shiftleft(1, {bits} - {to})), named_struct('k', 0L, 's', 0L), {sum_})"
    return f"if({bits} = {to}, {cells}, transform({cells}, u -> transform(sequence(0, shiftleft(1, {to}) - 1), c -> {own})))"


def differing(cells: str, first: str, bits: str) -> str:
    """How many digests a difference of sketches of 2^bits cells a row holds, peeled at 2^first cells, then twice that, up to all; null if none can be."""
    found = let("w", marks("t"), peeled(folded(cells, bits, "t"), "w"))
    return f"aggregate(sequence({first}, {bits}), cast(null as int), (d, t) -> if(d is not null, d, {let('y', found, 'if(y is null, null, size(y))')}))"


def apart(cells_a: str, bits_a: str, cells_b: str, bits_b: str) -> str:
    """The same for two sketches that are opened, each at its own size, and compared by the digests they hold; null if one can't be opened."""
    opened = [let("w", marks(bits), peeled(cells, "w")) for cells, bits in ((cells_a, bits_a), (cells_b, bits_b))]
    unshared = "size(mine) + size(other) - 2 * size(array_intersect(mine, other))"
    return let("mine", opened[0], f"if(mine is null, null, {let('other', opened[1], f'if(other is null, null, {unshared})')})")


def with_likeness(df: DataFrame, name: str, a: str, cells_a: str, b: str, cells_b: str) -> DataFrame:
    """Add the likeness of two columns of numbers of digests, given the columns of their sketches."""
    bits = [f"cast(round(log2(size({c}[0]))) as int)" for c in (cells_a, cells_b)]
    df = df.withColumn("__bits", F.expr(f"least({bits[0]}, {bits[1]})"))
    own = [folded(c, n, "__bits") for c, n in zip((cells_a, cells_b), bits)]
    df = df.withColumn("__minus", F.expr(minus(*own)))
    # in each row the squared deviations of the counts add up to the number of differing digests, but for the spread of tags and the mean
    even, cells = f"(({a} - {b}) / shiftleft(1, __bits))", "shiftleft(1, __bits)"
    squares = f"aggregate(flatten(__minus), 0D, (t, x) -> t + power(x.s / 6442450943D - {even}, 2D))"
    df = df.withColumn("__guess", F.expr(f"{squares} / {TABLE_ROWS}D / (28D / 27D - 1D / {cells})"))
    df = df.withColumn("__first", F.expr(f"cast(ceil(log2(greatest(1D, __guess) / {PEELED_PER_CELL}D)) as int)"))
    common = differing("__minus", f"least(__bits, greatest({FIRST_BITS}, __first))", "__bits")
    larger = apart(cells_a, bits[0], cells_b, bits[1])
    guess = f"least({a} + {b}, greatest(abs({a} - {b}), cast(round(__guess) as int)))"
    df = df.withColumn("__d", F.expr(f"coalesce({common}, {larger}, {guess})"))
    total = F.col(a) + F.col(b)
    return df.withColumn(name, F.when(total == 0, F.lit(1.0)).otherwise((total - F.col("__d")) / (total + F.col("__d")))).drop("__bits", "__minus", "__guess", "__first", "__d")


def digested(df: DataFrame, text: str, count: str, cells: str) -> DataFrame:
    """Add the number of digests and the sketch of a text column."""
    cut = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    df = df.withColumn("__digests", F.array_distinct(F.transform(cut, lambda p: F.xxhash64(p).bitwiseOR(F.lit(ODD)).bitwiseAND(F.lit(~SECOND)))))
    bits = f"cast(greatest({FIRST_BITS}, ceil(log2(greatest(1, size(__digests)) / {PER_CELL}D))) as int)"
    return df.withColumn(count, F.size("__digests")).withColumn(cells, F.expr(let("w", marks(bits), sketch("__digests", "w")))).drop("__digests")


def written(text: str, count: str, cells: str) -> Column:
    """The fingerprint as text: length and hash of the text, number of digests, and the rows of cells (xor and sum, nothing for an empty one)."""
    row = "array_join(transform(u, x -> if(x.s = 0L, '', concat(lower(hex(x.k)), '.', lower(hex(x.s))))), ',')"
    return F.concat_ws(":", F.length(text), F.lower(F.hex(F.xxhash64(text))), count, F.expr(f"array_join(transform({cells}, u -> {row}), ';')"))


def ranged(docs: DataFrame) -> DataFrame:
    """docs with __hash and __range: a number that follows the order of rows, by quantiles of doc_id; a doc_id that holds several of them, and null, are cut by hash."""
    docs = docs.withColumn("__hash", F.xxhash64("text"))
    count, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = min(MAX_RANGES, max(1, math.ceil(count / ROWS_PER_RANGE)))
    fractions = [k / ranges for k in range(1, ranges)]
    found = (docs.agg(F.percentile_approx("doc_id", fractions, max(10_000, 20 * ranges))).first()[0] or []) if fractions else []
    bounds = sorted(set(found))
    often = {b: n for b, n in Counter(found).items() if n > 1}
    last = len(bounds)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    place = F.lit(0)
    if groups:  # first among the groups' first bounds, then inside the group
        tops = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
        inner = F.from_json(F.lit(json.dumps([[], *groups])), "array<array<bigint>>")
        docs = docs.withColumn("__top", F.size(F.filter(tops, lambda b: b <= F.col("doc_id"))))
        place = F.greatest(F.lit(0), F.col("__top") - 1) * step + F.size(F.filter(F.get(inner, F.col("__top")), lambda b: b <= F.col("doc_id")))
    own = F.when(F.col("doc_id").isNull(), F.lit(last + 1)).otherwise(last - place)
    # of each range into how many it is cut: one, but for those that begin with a doc_id of several and for null
    cuts = {last - bounds.index(b) - 1: n for b, n in often.items()} | {last + 1: max(1, math.ceil(nulls / ROWS_PER_RANGE))}
    many = F.from_json(F.lit(json.dumps([cuts.get(k, 1) for k in range(last + 2)])), "array<bigint>")
    docs = docs.withColumn("__own", own.cast("int"))
    part = F.least(F.get(many, F.col("__own")) - 1, F.floor((F.shiftright("__hash", 12) + (1 << 51)) * F.get(many, F.col("__own")) / float(1 << 52)))
    held = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    # rows of such a range with other doc_ids are greater than its first one, so they stand before its cuts
    alone = F.col("doc_id").isNull() | F.col("doc_id").eqNullSafe(F.get(held, F.lit(last - 1) - F.col("__own")))
    return docs.withColumn("__range", F.struct("__own", F.when(alone, part).otherwise(F.lit(-1)).cast("long").alias("__part"))).drop("__top", "__own")


def with_next(docs: DataFrame, add: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """Each row, with what add gives it, and the carried columns of the next one, as next_<name>. Neighbours meet in windows of one range; the ranges' last rows are joined to the next range's first."""
    placed = ranged(docs)
    order = Window.partitionBy("__range").orderBy(F.col("doc_id").desc_nulls_last(), "__hash", "text")
    # numbered first (all numbers pass), so that rows are exchanged before add widens them
    placed = placed.withColumn("__k", F.row_number().over(order))
    rows = add(placed.filter("__k > 0"))
    names = [c for c in rows.columns if c not in ("__range", "__hash", "__k")]
    rows = rows.withColumn("__next", F.lead(F.struct(*carried)).over(order))
    heads = add(placed.filter("__k = 1"))
    heads = heads.select(F.col("__range").alias("__of"), F.struct(*carried).alias("__head"))
    there = placed.select("__range").distinct()
    wrap = Window.orderBy("__range")  # a row for each range
    follows = there.select("__range", F.coalesce(F.lead("__range").over(wrap), F.min("__range").over(wrap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__of"))
    heads = follows.join(heads, "__of").select(F.col("__range").alias("__r"), "__head")
    joined = rows.join(heads, F.col("__range") == F.col("__r"), "left")
    follower = F.coalesce("__next", "__head")
    return joined.withColumn("__follower", follower).select(*names, *[F.col("__follower")[c].alias(f"next_{c}") for c in carried])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document."""
    own = docs.select("doc_id", text_or_empty().alias("text"))
    rows = with_next(own, lambda df: digested(df, "text", "count", "cells"), ["text", "count", "cells"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("next_text")
    rows = digested(rows, "edited", "edited_count", "edited_cells")
    rows = rows.withColumns(
        {
            "n_chars": F.length("text").cast("long"),
            "edited_sha256": F.sha2(F.encode("edited", "UTF-8"), 256),
            "fingerprint": written("text", "count", "cells"),
            "edited_fingerprint": written("edited", "edited_count", "edited_cells"),
        }
    ).drop("text", "edited")
    rows = with_likeness(rows, "near_edited", "count", "cells", "edited_count", "edited_cells")
    rows = with_likeness(rows, "near_next", "count", "cells", "next_count", "next_cells")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
