"""Quotation linking: reply-ordered conversations without the quoted text.

Lines of a message are parsed into quote levels. Runs of lines of one level between blank lines are
passages; each passage, and each of its lines, is normalised and hashed. A quoted hash is linked to
the latest earlier message of the conversation that holds it unquoted. Replies hang below what they
quote, and a conversation reads: roots in turn order, each followed by its replies level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import stored
from gridloom.operators.ranking import prefix_sums

# Up to the last mark of those a line begins with. No groups are repeated, so lines may be of any length.
MARKS = r"^[ \t>]*>"
# End of a line that introduces a quotation and goes with it.
INTRODUCTION = " wrote:"
# White space at the ends; a run within is passed once.
ENDS = r"^\s+|(?<!\s)\s++$"
# Turns are looked up in stretches of this many, so a passage repeated all along a long conversation is split.
STRETCH = 1024
NO_ID = -(1 << 63)


def level_of(line: Column) -> Column:
    """How often a line is quoted: the marks it begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def messages_of(conversations: DataFrame) -> DataFrame:
    """Distinct messages with ``c, t`` (ids without NULL) and ``m``, a number of its own."""
    known = conversations.select("conv_id", "turn", "role", "text").distinct()
    keyed = known.withColumns({"c": F.coalesce("conv_id", F.lit(NO_ID)), "t": F.coalesce("turn", F.lit(NO_ID))})
    return keyed.withColumn("m", F.xxhash64("c", "t", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))


def parsed_lines(messages: DataFrame) -> DataFrame:
    """``c, t, m, pos, level, line`` of each line, and ``run``, the passage it is in (NULL for blank lines)."""
    lines = messages.select("c", "t", "m", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("pos", "raw"))
    leveled = lines.select("c", "t", "m", "pos", level_of(F.col("raw")).alias("level"), F.regexp_replace("raw", MARKS, "").alias("line"))
    # A window is one message.
    order = Window.partitionBy("m").orderBy("pos")
    blank = ~F.col("line").rlike(r"\S")
    fresh = F.when(blank | (F.lag("level").over(order) != F.col("level")) | F.lag("pos").over(order).isNull(), 1).otherwise(0)
    marked = leveled.withColumns({"blank": blank, "fresh": fresh, "next": F.lead("level").over(order)})
    lead_in = (F.col("level") == 0) & F.rtrim("line", F.lit(" \t")).endswith(INTRODUCTION) & (F.coalesce("next", F.lit(0)) > 0)
    runs = marked.withColumn("run", F.when(~F.col("blank"), F.sum("fresh").over(order)))
    return runs.select("c", "t", "m", "pos", "level", "line", "run", lead_in.alias("lead_in"))


def passages(lines: DataFrame) -> DataFrame:
    """``c, t, m, level, hash, size`` of every passage and of every line of it."""
    filled = lines.where(F.col("run").isNotNull() & ~F.col("lead_in"))
    whole = filled.groupBy("c", "t", "m", "level", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("p"))
    texts = whole.select("c", "t", "m", "level", F.explode(F.array_distinct(F.concat(
        F.array(F.concat_ws(" ", F.transform("p", lambda p: p["line"]))), F.transform("p", lambda p: p["line"])
    ))).alias("text"))
    clean = texts.select("c", "t", "m", "level", normalised(F.col("text")).alias("text")).where("text != ''").distinct()
    return clean.select("c", "t", "m", "level", F.xxhash64("text").alias("hash"), F.length("text").alias("size"))


def latest_origins(quoted: DataFrame, originals: DataFrame) -> DataFrame:
    """Adds ``origin (t, m)``, the latest earlier message that holds the passage; rows without one go.

    Within a stretch of turns by a window, before it by the last message of the stretches passed.
    """
    stretch = F.floor(F.col("t") / STRETCH)
    here = originals.select("c", "hash", "t", F.struct("t", "m").alias("o")).distinct()
    both = quoted.select("c", "hash", "t", "m", "level", "size", F.lit(None).cast(here.schema["o"].dataType).alias("o")).unionByName(
        here.select("c", "hash", "t", F.lit(None).cast("long").alias("m"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("size"), "o")
    ).withColumn("s", stretch)
    near = Window.partitionBy("c", "hash", "s").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    looked = both.withColumn("near", F.max("o").over(near)).where("m IS NOT NULL")
    ends = both.groupBy("c", "hash", "s").agg(F.max("o").alias("end"))
    passed = Window.partitionBy("c", "hash").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.withColumn("far", F.max("end").over(passed)).select("c", "hash", "s", "far")
    found = looked.join(before, ["c", "hash", "s"])
    return found.select("c", "t", "m", "level", "size", F.coalesce("near", "far").alias("origin")).where("origin IS NOT NULL")


def reply_links(lines: DataFrame) -> DataFrame:
    """``m, parent, parent_t``: the message each quoting message answers.

    The innermost reply counts: of the lowest quote level with a link, the message with most quoted
    text, the later one on a tie.
    """
    units = stored(passages(lines), "passages")
    origins = latest_origins(units.where("level > 0"), units.where("level = 0"))
    weighed = origins.groupBy("m", "level", "origin").agg(F.sum("size").alias("size"))
    best = F.max(F.struct((-F.col("level")).alias("l"), "size", "origin")).alias("best")
    return weighed.groupBy("m").agg(best).select("m", F.col("best.origin.m").alias("parent"), F.col("best.origin.t").alias("parent_t"))


def threads(links: DataFrame, messages: DataFrame) -> DataFrame:
    """``m, root, root_t, depth`` of every message that answers another, by doubling the steps to the root."""
    reached = stored(links.select("m", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        # A parent is always an earlier turn, so there are no circles.
        ahead = reached.select(F.col("m").alias("root"), F.col("root").alias("further"), F.col("depth").alias("steps"))
        joined = reached.join(ahead, "root", "left")
        if joined.where("further IS NOT NULL").isEmpty():
            break
        reached = stored(joined.select("m", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("steps", F.lit(0))).alias("depth")), "threads")
    return reached.join(messages.select(F.col("m").alias("root"), F.col("t").alias("root_t")), "root")


def linked_conversations(conversations: DataFrame) -> DataFrame:
    """One row per distinct message: ``conv_id, turn, role, position, reply_to, root_turn, depth, n_quotes,
    max_level, body``.

    ``position`` counts from 0 in reply order within the conversation; ``body`` is the message without
    quoted lines and the lines that introduce them. NULL texts have an empty body, NULL conversations
    and turns are a conversation and a first turn of their own; exactly repeated rows are one message.
    A quote without a source stays unlinked and is removed all the same.
    """
    messages = stored(messages_of(conversations), "messages")
    quoting = F.coalesce("text", F.lit("")).rlike(r"(^|\n)[ \t]*>")
    quoted = messages.where(quoting).select("c").distinct()
    lines = stored(parsed_lines(messages.join(quoted, "c", "left_semi")), "lines")
    links = stored(reply_links(lines), "reply-links")
    trees = threads(links, messages)
    own = lines.groupBy("m").agg(
        F.sort_array(F.collect_list(F.when((F.col("level") == 0) & ~F.col("lead_in"), F.struct("pos", "line")))).alias("kept"),
        F.count_distinct(F.when(F.col("level") > 0, F.col("run"))).alias("n_quotes"), F.max("level").alias("max_level"),
    ).select("m", F.concat_ws("\n", F.transform("kept", lambda k: k["line"])).alias("body"), "n_quotes", "max_level")
    rows = messages.join(own, "m", "left").join(links, "m", "left").join(trees, "m", "left").select(
        "conv_id", "turn", "role", "c", "t", "m",
        F.regexp_replace(F.coalesce("body", "text", F.lit("")), ENDS, "").alias("body"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("max_level", F.lit(0)).cast("int").alias("max_level"), F.col("parent_t").alias("reply_to"),
        F.coalesce("root_t", "t").alias("root_turn"), F.coalesce("root", "m").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    # Ranges of the order over all conversations, so a long conversation is split.
    order = [F.col(k) for k in ("c", "root_turn", "root", "depth", "t", "m")]
    placed = prefix_sums(rows, order, {"before": F.lit(1).cast("long")})
    first = placed.groupBy("c").agg(F.min("before").alias("first"))
    return placed.join(first, "c").select(
        "conv_id", "turn", "role", (F.col("before") - F.col("first")).alias("position"), "reply_to", F.when(F.col("root_turn") != NO_ID, F.col("root_turn")).alias("root_turn"),
        "depth", "n_quotes", "max_level", "body",
    )
