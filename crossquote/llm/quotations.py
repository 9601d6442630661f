"""Quotation linking in conversations.

Lines that start with ``>`` signs are quotes, nested as deep as there are signs. Each quoted line is
normalised (lower case, single blanks) and hashed, and so are the unquoted lines of all messages. A quoted line
comes from the first message of its conversation that says it earlier, or else from the
first message of any other conversation. What most lines of level 1 come from is the message replied
to. Replies form threads; messages are returned without quotes, with their place in the reply order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossquote.session import materialize

MARK = r"^(?:[ \t]*>)+"


def level(line: Column) -> Column:
    """Number of quote signs before the text of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), r"[^>]", ""))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARK, "")), r"[ \t\r]+", " "))


def own_text(text: Column) -> Column:
    """The unquoted lines; a null text has none."""
    return F.coalesce(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(MARK)), "\n"), F.lit(""))


def quoted_lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash) of all lines with text; level 0 lines are the message's own."""
    lines = messages.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    return (lines.select("conv_id", "turn", level(F.col("line")).alias("level"), normalised(F.col("line")).alias("line"))
            .where("line <> ''").select("conv_id", "turn", "level", F.md5(F.col("line").cast("binary")).alias("hash")))


def line_sources(lines: DataFrame) -> DataFrame:
    """Quoted lines with the message each comes from (source_conv, source_turn), null where there is none.

    The originals are reduced to one message per line and conversation, and one per line, before the
    join: a line that very many messages say costs one combined row.
    """
    said = lines.where("level = 0 and conv_id is not null and turn is not null").groupBy("conv_id", "hash").agg(
        F.min("turn").alias("turn"))
    anywhere = said.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"),
                                        F.max(F.struct("conv_id", "turn")).alias("last"))
    here = said.select(F.col("conv_id").alias("c"), F.col("hash").alias("h"), F.col("turn").alias("said_here"))
    quoted = lines.where("level > 0")
    found = (quoted.join(here, (F.col("conv_id") == F.col("c")) & (F.col("hash") == F.col("h"))
                         & (F.col("said_here") < F.col("turn")), "left").drop("c", "h")
             .join(anywhere, "hash", "left"))
    # of the first and the last conversation that say it, one at least is not the quoting one, if any is
    other = (F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first"))
             .when(F.col("last.conv_id") != F.col("conv_id"), F.col("last")))
    source = F.when(F.col("said_here").isNotNull(), F.struct("conv_id", F.col("said_here").alias("turn"))).otherwise(other)
    return found.withColumn("source", source).select(
        "conv_id", "turn", "level", "hash", F.col("source.conv_id").alias("source_conv"), F.col("source.turn").alias("source_turn"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) of messages with a parent, by pointer jumping.

    ``replies`` has conv_id, turn, parent (a smaller turn). Rounds grow with the logarithm of the longest chain.
    """
    current = materialize(replies.select("conv_id", "turn", F.col("parent").alias("thread_turn"), F.lit(1).alias("depth")))
    while True:
        above = current.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread_turn").alias("higher"),
                               F.col("depth").alias("more"))
        joined = current.join(above, (F.col("conv_id") == F.col("c")) & (F.col("thread_turn") == F.col("t")), "left")
        if joined.where("higher is not null").isEmpty():
            return current
        current = materialize(joined.select("conv_id", "turn", F.coalesce("higher", "thread_turn").alias("thread_turn"),
                                            (F.col("depth") + F.coalesce("more", F.lit(0))).cast("int").alias("depth")))


def link_quotations(messages: DataFrame) -> DataFrame:
    """Per row of ``messages`` (conv_id, turn, role, text): its quotes, links and own text.

    Columns: n_quoted and n_linked count quoted lines, max_level their deepest nesting, source_conv and source_turn name the
    message replied to, thread_turn and depth its thread (the first turn of it, and the replies
    since). A conversation in reply order is sorted by thread_turn, then turn: a reply
    follows what it replies to. Rows of one (conv_id, turn) are one message, whose lines are
    those of all of them. Messages with a null conv_id or turn link with nothing and have no thread. Of
    messages that as many lines come from, the latest counts.
    """
    own = messages.select("conv_id", "turn", "role", "text")
    sources = line_sources(quoted_lines(own))
    linked = sources.groupBy("conv_id", "turn", "source_conv", "source_turn").agg(
        F.count("*").alias("lines"), F.count_if(F.col("level") == 1).alias("direct"), F.max("level").alias("deepest"))
    source = F.struct("source_conv", "source_turn")
    per_message = materialize(linked.groupBy("conv_id", "turn").agg(
        F.sum("lines").alias("n_quoted"), F.sum(F.when(F.col("source_turn").isNotNull(), F.col("lines")).otherwise(0)).alias("n_linked"),
        F.max("deepest").alias("max_level"),
        F.max_by(source, F.when(F.col("source_turn").isNotNull() & (F.col("direct") > 0),
                                F.struct("direct", "source_conv", "source_turn"))).alias("source"))
        .where("conv_id is not null and turn is not null"))
    replies = per_message.where("source.source_conv = conv_id").select("conv_id", "turn", F.col("source.source_turn").alias("parent"))
    result = own.join(per_message, ["conv_id", "turn"], "left").join(threads(replies), ["conv_id", "turn"], "left")
    return result.select(
        "conv_id", "turn", "role", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_quoted", "n_linked", "max_level")],
        F.col("source.source_conv").alias("source_conv"), F.col("source.source_turn").alias("source_turn"),
        F.when(F.col("conv_id").isNotNull(), F.coalesce("thread_turn", "turn")).alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), own_text(F.col("text")).alias("own_text"))


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH RECURSIVE l AS (
  SELECT conv_id, turn, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '[ \t\r]+', ' ', 'g')) AS line
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations)),
own AS (SELECT conv_id, turn, line FROM l WHERE level = 0 AND line <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
here AS (SELECT conv_id, line, min(turn) AS turn FROM own GROUP BY ALL),
q AS (SELECT *, row_number() OVER () AS k FROM l WHERE level > 0 AND line <> ''),
o AS (SELECT q.k, min({'c': h.conv_id, 't': h.turn}) AS f, max({'c': h.conv_id, 't': h.turn}) AS g
      FROM q JOIN here h ON q.line = h.line GROUP BY q.k),
s AS (SELECT q.conv_id, q.turn, q.level, CASE WHEN h.turn IS NOT NULL THEN {'c': q.conv_id, 't': h.turn}
        WHEN o.f.c <> q.conv_id THEN o.f WHEN o.g.c <> q.conv_id THEN o.g END AS src
      FROM q LEFT JOIN here h ON q.conv_id = h.conv_id AND q.line = h.line AND h.turn < q.turn LEFT JOIN o ON q.k = o.k),
c AS (SELECT conv_id, turn, src, count(*) AS lines, count(*) FILTER (WHERE level = 1) AS direct, max(level) AS deepest
      FROM s GROUP BY ALL),
m AS (SELECT conv_id, turn, sum(lines) AS n_quoted, coalesce(sum(lines) FILTER (WHERE src IS NOT NULL), 0) AS n_linked,
        max(deepest) AS max_level, arg_max(src, {'d': direct, 'c': src.c, 't': src.t})
          FILTER (WHERE src IS NOT NULL AND direct > 0) AS src
      FROM c WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
t AS (SELECT conv_id, turn, src.t AS root, 1 AS depth FROM m WHERE src.c = conv_id
      UNION ALL SELECT t.conv_id, t.turn, m.src.t, t.depth + 1 FROM t JOIN m ON t.conv_id = m.conv_id AND t.root = m.turn
      WHERE m.src.c = m.conv_id),
d AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM t GROUP BY conv_id, turn)
SELECT v.conv_id, v.turn, v.role, CAST(coalesce(m.n_quoted, 0) AS BIGINT) AS n_quoted,
  CAST(coalesce(m.n_linked, 0) AS BIGINT) AS n_linked, CAST(coalesce(m.max_level, 0) AS BIGINT) AS max_level,
  m.src.c AS source_conv, m.src.t AS source_turn,
  CASE WHEN v.conv_id IS NOT NULL THEN coalesce(d.root, v.turn) END AS thread_turn,
  CAST(coalesce(d.depth, 0) AS BIGINT) AS depth,
  coalesce(array_to_string([x FOR x IN string_split(v.text, chr(10)) IF NOT regexp_matches(x, '^(?:[ \t]*>)+')], chr(10)), '') AS own_text
FROM conversations v LEFT JOIN m ON v.conv_id = m.conv_id AND v.turn = m.turn
LEFT JOIN d ON v.conv_id = d.conv_id AND v.turn = d.turn
"""
