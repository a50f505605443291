"""Conversations in reply order, linked by what their messages quote.

A line's level is the number of > signs it begins with (blanks between them allowed). Runs of lines of one level, cut
at empty lines, are passages. A message's own passages have level 0; a passage of level 1 or more is a quotation. Passages
are normalised (lower case, white space collapsed) and hashed; a quotation links to the latest earlier message of its
conversation with an own passage of that hash. A message answers the message that its outermost linked quotation comes
from. Answers stand in the thread of the first message of their chain. The text is left without quotations and without
the attribution lines before them.

Null or empty texts stay as they are and link to nothing; rows without conv_id or turn link to nothing. Repeated rows are kept each;
a turn that several rows share answers the latest turn that any of them answers. place counts from 0 in each conversation
by thread and turn; rows alike in both are ordered by role and the text's md5. Places are taken in ranges of all rows and sources
are looked for in ranges of turns, so that neither a long conversation nor a passage that comes again and again in it is one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.functions.arcs import numbered_within

from .common import discard, settled, table

TURNS = 4096
QUOTE = "^[ \\t]*>[> \\t]*"
#: How mail programs introduce a quotation in the four languages of the corpus.
ATTRIBUTION = "^(On|Am|Le|El) .*(wrote|schrieb|écrit|escribió)[^:]*:[ \\t]*$"


def _sql(text: str) -> str:
    """A pattern as a Spark SQL raw string."""
    return "r'" + text + "'"


def passages(messages: DataFrame) -> DataFrame:
    """(the columns of messages but text), level and digest of each passage of the column text; messages has a unique column __id."""
    rest = [c for c in messages.columns if c != "text"]
    lines = messages.select(*rest, F.posexplode(F.split("text", "\n")).alias("__k", "__line"))
    lines = lines.select(
        *rest,
        "__k",
        F.length(F.regexp_replace(F.regexp_extract("__line", QUOTE, 0), "[^>]", "")).alias("level"),
        F.trim(F.regexp_replace(F.lower(F.regexp_replace("__line", QUOTE, "")), "[ \\t\\r]+", " ")).alias("__said"),
    )
    ordered = Window.partitionBy("__id").orderBy("__k")  # no more rows than one message has lines
    begins = (F.col("__said") == "") | (F.lag("__said").over(ordered) == "") | (F.lag("level").over(ordered) != F.col("level"))
    lines = lines.withColumn("__begins", F.when(begins, 1).otherwise(0))
    lines = lines.withColumn("__passage", F.sum("__begins").over(ordered)).filter(F.col("__said") != "")
    joined = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("__k", "__said"))), lambda x: x["__said"]))
    return lines.groupBy(*rest, "__passage", "level").agg(F.xxhash64(joined).alias("digest")).drop("__passage")


def unquoted(messages: DataFrame) -> DataFrame:
    """messages with their quotations and attribution lines taken out of text. A text without quotations is untouched."""
    quoted, said = _sql(QUOTE), _sql(ATTRIBUTION)
    kept = f"filter(lines, (x, k) -> not x rlike {quoted} and not (x rlike {said} and coalesce(get(lines, k + 1) rlike {quoted}, false)))"
    body = F.regexp_replace(F.array_join(F.expr(kept), "\n"), "^(?:[ \\t\\r]*\\n)+|(?:\\n[ \\t\\r]*)+$", "")
    out = messages.withColumn("lines", F.split("text", "\n"))
    has = F.exists("lines", lambda x: x.rlike(QUOTE))
    return out.withColumn("text", F.when(has, body).otherwise(F.col("text"))).drop("lines")


def latest_sources(quotes: DataFrame, sources: DataFrame, turns: int = TURNS) -> DataFrame:
    """conv_id, digest, turn and __from for each place (conv_id, digest, turn) of a quotation: the latest earlier turn with such a passage, if any.

    Both sides pass once in order of turns, in ranges of turns; a range begins with the latest source of those before it.
    """
    both = quotes.select("conv_id", "digest", "turn", F.lit(0).alias("__kind")).union(sources.select("conv_id", "digest", "turn", F.lit(1))).distinct()
    both = both.withColumn("__range", F.floor(F.col("turn") / turns)).withColumn("__at", F.when(F.col("__kind") == 1, F.col("turn")))
    tops = both.groupBy("conv_id", "digest", "__range").agg(F.max("__at").alias("__top"))
    earlier = Window.partitionBy("conv_id", "digest").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of turns
    tops = tops.withColumn("__before", F.max("__top").over(earlier)).drop("__top")
    so_far = Window.partitionBy("conv_id", "digest", "__range").orderBy("turn", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("__own", F.last("__at", True).over(so_far)).filter("__kind = 0")
    return own.join(tops, ["conv_id", "digest", "__range"]).select("conv_id", "digest", "turn", F.coalesce("__own", "__before").alias("__from"))


def replies(messages: DataFrame) -> DataFrame:
    """For messages that quote: __id, conv_id, turn, n_quotes, n_linked, reply_to. messages has a unique column __id."""
    quoting = messages.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").rlike("(?m)" + QUOTE))
    quotes = passages(quoting.select("__id", "conv_id", "turn", "text")).filter("level > 0").select("__id", "conv_id", "turn", "level", "digest").distinct()
    talks = quoting.select("conv_id").distinct()
    own = messages.filter(F.col("turn").isNotNull()).join(talks, "conv_id", "left_semi")
    sources = passages(own.select("__id", "conv_id", "turn", "text")).filter("level = 0").select("conv_id", "digest", "turn").distinct()
    # the latest source of each quotation; of a message's linked quotations, one of the lowest level and there the latest source
    latest = quotes.join(latest_sources(quotes, sources), ["conv_id", "digest", "turn"])
    return latest.groupBy("__id", "conv_id", "turn").agg(
        F.count("*").alias("n_quotes"),
        F.count("__from").alias("n_linked"),
        F.max(F.when(F.col("__from").isNotNull(), F.struct((-F.col("level")).alias("l"), F.col("__from").alias("t"))))["t"].alias("reply_to"),
    )


def threads(answers: DataFrame) -> DataFrame:
    """conv_id, turn and thread (the first turn of the chain of answers) for turns that answer another, by doubling pointers."""
    at = settled(answers.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("thread")), "threads")
    while True:
        up = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("__above"))
        moved = settled(at.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("__above", "thread").alias("thread"), F.col("__above").isNotNull().alias("__moved")), "threads")
        discard(at)
        at = moved
        if at.filter("__moved").isEmpty():
            out = at.drop("__moved")
            out.settled_path = at.settled_path
            return out


def reply_ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotations), n_quotes, n_linked, reply_to, thread and place of each message."""
    numbered = settled(messages.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("__id")), "messages")
    answers = settled(replies(numbered), "replies")
    roots = threads(answers.filter("reply_to is not null"))
    linked = unquoted(numbered).join(answers.drop("conv_id", "turn"), "__id", "left").join(roots, ["conv_id", "turn"], "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_quotes", "n_linked")}
    linked = settled(linked.withColumns(zero | {"thread": F.coalesce("thread", "turn"), "__text": F.md5("text")}), "linked")
    order = [F.col(c).asc_nulls_first() for c in ("thread", "turn", "role", "__text", "__id")]
    placed = numbered_within(linked, "conv_id", order, "place")
    for done in (numbered, answers, roots):
        discard(done)
    return placed.select("conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", "thread", "place")


def chat_texts(ordered: DataFrame, turns: int = 256) -> DataFrame:
    """Conversations as text, a role line before each message; a conversation of more messages comes in parts of that many."""
    said = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")))
    parts = ordered.withColumn("part", F.floor(F.col("place") / turns)).groupBy("conv_id", "part")
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", said.alias("said")))), lambda x: x["said"]), "\n").alias("chat"))


def op10_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(table(spark, sf_dir, "conversations"))


#: Conversations in which each message quotes one of the two before it, if there is one; both engines run this text.
QUOTING = """SELECT m.conv_id, m.turn, m.role, CASE WHEN p.text IS NULL THEN m.text ELSE concat('> ', replace(p.text, chr(10), concat(chr(10), '> ')), chr(10), chr(10), coalesce(m.text, '')) END AS text
FROM {messages} m LEFT JOIN {messages} p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1 - (m.conv_id + m.turn) % 2"""


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reply_ordered over the whole table, with quotations put in, as the table itself holds none."""
    return reply_ordered(spark.sql(QUOTING, messages=table(spark, sf_dir, "conversations")))


#: DuckDB SQL for op10_quotation over conversations. md5 stands for the hash of passages.
OP10_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text FROM conversations),
l AS (SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM m),
s AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*>[> \t]*'), '[^>]', '', 'g')) AS level,
        trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*>[> \t]*', '')), '[ \t\r]+', ' ', 'g')) AS said,
        line LIKE '%:%' AND regexp_matches(line, '^(On|Am|Le|El) .*(wrote|schrieb|écrit|escribió)[^:]*:[ \t]*$') AS attribution FROM l),
b AS (SELECT *, lead(level) OVER o AS next_level,
        CASE WHEN said = '' OR lag(said) OVER o = '' OR lag(level) OVER o <> level THEN 1 ELSE 0 END AS begins FROM s WINDOW o AS (PARTITION BY id ORDER BY k)),
g AS (SELECT *, sum(begins) OVER (PARTITION BY id ORDER BY k) AS passage FROM b),
p AS (SELECT id, conv_id, turn, level, md5(string_agg(said, ' ' ORDER BY k)) AS digest FROM g WHERE said <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY id, conv_id, turn, level, passage),
f AS (SELECT q.id, q.conv_id, q.turn, q.level, q.digest, max(o.turn) FILTER (WHERE o.turn < q.turn) AS source
      FROM p q LEFT JOIN (SELECT DISTINCT conv_id, turn, digest FROM p WHERE level = 0) o ON q.conv_id = o.conv_id AND q.digest = o.digest
      WHERE q.level > 0 GROUP BY ALL),
a AS (SELECT id, conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked,
        (arg_max(source, -level * 1e12::DOUBLE + source) FILTER (WHERE source IS NOT NULL)) AS reply_to FROM f GROUP BY ALL),
e AS (SELECT conv_id, turn, max(reply_to) AS up FROM a WHERE reply_to IS NOT NULL GROUP BY ALL),
r AS (SELECT conv_id, turn, up AS thread FROM e UNION ALL SELECT r.conv_id, r.turn, e.up FROM r JOIN e ON r.conv_id = e.conv_id AND r.thread = e.turn),
t AS (SELECT conv_id, turn, min(thread) AS thread FROM r GROUP BY ALL),
u AS (SELECT id, bool_or(level > 0) AS quotes,
        regexp_replace(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE level = 0 AND NOT (attribution AND coalesce(next_level, 0) > 0)), '^([ \t\r]*\n)+|(\n[ \t\r]*)+$', '', 'g') AS body
      FROM b GROUP BY id),
x AS (SELECT m.conv_id, m.turn, m.role, CASE WHEN quotes THEN coalesce(body, '') ELSE text END AS text, coalesce(n_quotes, 0)::BIGINT AS n_quotes,
        coalesce(n_linked, 0)::BIGINT AS n_linked, reply_to, coalesce(t.thread, m.turn) AS thread
      FROM m LEFT JOIN u USING (id) LEFT JOIN a USING (id) LEFT JOIN t ON t.conv_id = m.conv_id AND t.turn = m.turn)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) - 1 AS place FROM x
"""
QUOTED_SQL = OP10_SQL.replace("WITH RECURSIVE m AS", f"WITH RECURSIVE quoting AS ({QUOTING.format(messages='conversations')}), m AS").replace("text FROM conversations)", "text FROM quoting)")
