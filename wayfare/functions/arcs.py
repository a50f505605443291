"""Expressions and transforms over arcs (src, dst) and raw arc lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.sources.shared import discard, settled

#: Rows that one task ranks.
RANGE_ROWS = 200_000


def tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Arcs of raw lines, duplicates included: lines with a dot or without two whole numbers are left out; targets lose their sign."""
    parts = tokens(F.col(value))
    number = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    rest = [c for c in lines.columns if c != value]
    out = lines.filter(~F.col(value).contains(".")).select(*rest, number(0).alias("src"), F.abs(number(1)).alias("dst"))
    return out.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())


def rebased(arcs: DataFrame) -> DataFrame:
    """Arcs counted from 0 if their least end is 1."""
    least = arcs.agg(F.min(F.least("src", "dst"))).first()[0]
    shift = 1 if least == 1 else 0
    return arcs.select((F.col("src") - shift).alias("src"), (F.col("dst") - shift).alias("dst"))


def cleaned(lines: DataFrame, value: str = "value") -> DataFrame:
    return rebased(parsed(lines, value).select("src", "dst").distinct())


def duplicates(lines: DataFrame, value: str = "value") -> DataFrame:
    """src, dst (as given) and n of arcs that more than one line holds."""
    return parsed(lines, value).groupBy("src", "dst").agg(F.count("*").alias("n")).filter("n > 1")


def symmetrized(arcs: DataFrame) -> DataFrame:
    """The union with the transpose, in one reading of the arcs; both ways of an arc are exchanged as one. Self-loops stay, once."""
    turn = F.coalesce(F.col("src") > F.col("dst"), F.col("src").isNull())
    one = arcs.select(F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("dst")).distinct()
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = F.when(F.col("src").eqNullSafe(F.col("dst")), F.array(there)).otherwise(F.array(there, back))
    return one.select(F.explode(both).alias("e")).select("e.*")


def transposed(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def vertices_of(arcs: DataFrame) -> DataFrame:
    return arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def in_ranges(df: DataFrame, order: list[Column | str]) -> tuple[DataFrame, DataFrame]:
    """df, written in ranges of the given order with __range_no and __range_own (the place there, from 0), and __range_first, the rows before each range.

    As many ranges as rows need, RANGE_ROWS each; all ties of the order may share one, so it should end in a unique column.
    """
    written = hasattr(df, "settled_path")
    held = df if written else settled(df, "unranged")
    parts = max(1, -(-held.count() // RANGE_ROWS))
    ranged = settled(held.repartitionByRange(parts, *order).withColumn("__range_no", F.spark_partition_id()), "ranged")
    if not written:
        discard(held)
    sizes = ranged.groupBy("__range_no").count()
    before = Window.orderBy("__range_no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    firsts = sizes.select("__range_no", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__range_first"))
    own = F.row_number().over(Window.partitionBy("__range_no").orderBy(*order)) - 1
    return ranged.withColumn("__range_own", own), firsts


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with its rank from 0 in the given order, without sorting all rows in one task: ranges are ranked apart and shifted by the sizes of those before."""
    held = df if hasattr(df, "settled_path") else settled(df, "unranged")
    if held.count() <= RANGE_ROWS:  # one range
        return held.withColumn(name, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).cast("bigint"))
    ranged, firsts = in_ranges(held, order)
    if held is not df:
        discard(held)
    return ranged.join(F.broadcast(firsts), "__range_no").select(*df.columns, (F.col("__range_first") + F.col("__range_own")).alias(name))


def numbered_within(df: DataFrame, group: str, order: list[Column | str], name: str) -> DataFrame:
    """df with its rank from 0 among the rows that share group (nulls together). A large group spans ranges; each range learns where the group that enters it began."""
    ranged, firsts = in_ranges(df, [F.col(group).asc_nulls_first(), *order])
    ranged = ranged.join(F.broadcast(firsts), "__range_no").withColumn("__at", F.col("__range_first") + F.col("__range_own"))
    starts = ranged.groupBy(F.col("__range_no").alias("__no"), F.col(group).alias("__group")).agg(F.min("__at").alias("__start"))
    ends = starts.groupBy("__no").agg(F.min_by(F.struct("__group", "__start"), "__start").alias("__low"), F.max_by(F.struct("__group", "__start"), "__start").alias("__high"))
    # a range for each row: the group at its beginning goes on if it is the last one of the range before; where it began is the start of that run
    walk = Window.orderBy("__no")
    goes_on = F.col("__low")["__group"].eqNullSafe(F.lag("__high").over(walk)["__group"]) & F.lag("__high").over(walk).isNotNull()
    ends = ends.withColumn("__on", goes_on)
    fresh = F.when(~F.col("__on") | (F.col("__high")["__start"] > F.col("__low")["__start"]), F.col("__high")["__start"])  # the last group of this range begins in it
    ends = ends.withColumn("__fresh", fresh)
    entered = F.when(F.col("__on"), F.last("__fresh", True).over(walk.rowsBetween(Window.unboundedPreceding, -1)))
    carried = ends.select(F.col("__no").alias("__range_no"), F.col("__low")["__group"].alias("__enters"), entered.alias("__began"))
    here = F.min("__at").over(Window.partitionBy("__range_no", group))
    joined = ranged.withColumn("__here", here).join(F.broadcast(carried), "__range_no")
    began = F.when(F.col("__began").isNotNull() & F.col(group).eqNullSafe(F.col("__enters")), F.col("__began")).otherwise(F.col("__here"))
    return joined.select(*df.columns, (F.col("__at") - began).alias(name))


def dense_ids(lines: DataFrame, line_no: str = "line_no", value: str = "value") -> DataFrame:
    """raw_id and id: numbers from 0 in the order in which ids first appear, sources before targets of a line."""
    arcs = parsed(lines.select(line_no, value), value)
    seen = arcs.select(F.explode(F.array(F.struct(F.col("src").alias("raw_id"), (2 * F.col(line_no)).alias("at")), F.struct(F.col("dst").alias("raw_id"), (2 * F.col(line_no) + 1).alias("at")))).alias("s")).select("s.*")
    return numbered(seen.groupBy("raw_id").agg(F.min("at").alias("at")), ["at", "raw_id"], "id").select("raw_id", "id")


def with_dense_ids(arcs: DataFrame, ids: DataFrame) -> DataFrame:
    """Arcs between the new ids."""
    a, b = (ids.select(F.col("raw_id").alias(f"raw_{c}"), F.col("id").alias(f"new_{c}")) for c in ("src", "dst"))
    joined = arcs.join(a, F.col("src") == F.col("raw_src")).join(b, F.col("dst") == F.col("raw_dst"))
    return joined.select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst")).distinct()
