"""Quotation linking: chat messages to reply-ordered conversations without quotes.

Lines that begin with one or more ``>`` are quoted, at the level that the number of
marks gives.  A quoted block (consecutive lines of one level) and each of its lines
are units; so are the blocks and lines a message wrote itself.  Units are
normalised (lower case, white space collapsed) and met by hash and text within a
conversation: a quoted unit links to the latest earlier message that wrote it.
A message replies to the message from which most characters of its outermost
linked level come; ties go to the later one.

``thread`` returns one row for each message: its parent, the root of its thread,
its depth, and its own words.  Sorted by (conv_id, root_turn, turn) messages stand in
reply order: a quote links to an earlier turn, so each reply follows its parent.

Only built-in functions; nothing is gathered by conversation.  Common lines and
long conversations are dealt by turn buckets: the latest writer in earlier
buckets comes from one row per unit and bucket.  Roots are found by pointer
jumping, in a number of rounds that is the logarithm of the longest chain.

Messages without quotes, or whose quotes nobody wrote, are their own root.  A
null text is empty; a null conv_id or turn links with nothing; rows that share
conv_id and turn count as one message for links and stay separate rows.  Columns
beyond the four are kept unless they have a name of a result column.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.llm.common import shield, stage

KEY = ("conv_id", "turn")
RESULT = ("parent_turn", "root_turn", "depth", "n_quotes", "body", "rendered")
#: Turns that share a bucket of the latest-writer search.
BUCKET = 1024
_MARKS = r"^\s*((?:>\s?)+)"
_ANY_QUOTE = r"(?m)^\s*>"


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _lines(messages: DataFrame) -> DataFrame:
    """(message, pos, level, line) of quoting messages; a message keeps its row id."""
    split = messages.select(*KEY, "_row", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    marks = F.regexp_extract("raw", _MARKS, 1)
    return split.select(
        *KEY,
        "_row",
        "pos",
        F.length(F.regexp_replace(marks, r"[^>]", "")).alias("level"),
        F.regexp_replace("raw", _MARKS, "").alias("line"),
    )


def _blocks(lines: DataFrame) -> DataFrame:
    """Consecutive lines of one level of a message, with its lines in order."""
    order = Window.partitionBy("_row").orderBy("pos")
    new = (F.col("level") != F.lag("level", 1, -1).over(order)).cast("int")
    numbered = lines.withColumn("new", new).withColumn("block", F.sum("new").over(order))
    return numbered.groupBy(*KEY, "_row", "block", "level").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("parts")
    )


def _units(blocks: DataFrame) -> DataFrame:
    """(conv_id, turn, level, unit) of blocks and lines; each unit once per message and level."""
    lines = F.transform("parts", lambda p: _normal(p["line"]))
    whole = _normal(F.array_join(F.transform("parts", lambda p: p["line"]), " "))
    every = F.array_distinct(F.concat(F.array(whole), lines))
    units = blocks.select(*KEY, "level", F.explode(every).alias("unit"))
    return units.filter(F.col("unit") != "").distinct()


def _latest_writer(quoted: DataFrame, written: DataFrame) -> DataFrame:
    """Quoted units with the latest earlier turn that wrote the same unit."""
    unit = ("conv_id", "hash", "unit")
    hashed = [F.xxhash64("unit").alias("hash"), F.floor(F.col("turn") / BUCKET).alias("bucket")]
    asks = quoted.select("*", *hashed, F.lit(None).cast("long").alias("writer"))
    gives = written.select(
        "conv_id", "turn", F.lit(None).cast("int").alias("level"), "unit", *hashed,
        F.col("turn").alias("writer"),
    )
    both = asks.unionByName(gives)
    lasts = gives.groupBy(*unit, "bucket").agg(F.max("writer").alias("last"))
    # a row for each unit and bucket: a unit of n turns has at most n / BUCKET + 1
    stops = both.groupBy(*unit, "bucket").agg(F.count("level").alias("asked"))
    earlier = Window.partitionBy(*unit).orderBy("bucket")
    before = (
        stops.join(lasts, [*unit, "bucket"], "left")
        .withColumn("before", F.last("last", True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
        .filter("asked > 0")
        .select(*unit, "bucket", "before")
    )
    within = Window.partitionBy(*unit, "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near", F.max("writer").over(within)).filter("level IS NOT NULL")
    return found.join(before, [*unit, "bucket"], "left").select(
        *KEY, "level", "unit", F.coalesce("near", "before").alias("writer")
    )


def links(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_quotes) of the messages whose quotes have an author."""
    messages = (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .filter("conv_id IS NOT NULL AND turn IS NOT NULL")
        .withColumn("_row", F.struct("conv_id", "turn", F.xxhash64("text")))
    )
    quoting = messages.filter(F.col("text").rlike(_ANY_QUOTE))
    asked = quoting.select("conv_id").distinct()
    blocks = _blocks(_lines(messages.dropDuplicates(["_row"]).join(asked, "conv_id", "left_semi")))
    quoted = _units(blocks.filter("level > 0"))
    written = _units(blocks.filter("level = 0")).select(*KEY, "unit")
    found = _latest_writer(quoted, written).filter("writer IS NOT NULL")
    votes = found.groupBy(*KEY, "level", "writer").agg(F.sum(F.length("unit")).alias("chars"))
    outermost = F.struct(-F.col("level"), "chars", "writer")
    return votes.groupBy(*KEY).agg(
        F.max(outermost)["writer"].alias("parent_turn"), F.count("*").alias("n_quotes")
    )


def roots(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of linked messages, by pointer jumping."""
    at = stage(
        linked.select(*KEY, F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth")),
        "roots",
    )
    while True:
        up = at.select(
            "conv_id", F.col("turn").alias("root_turn"),
            F.col("root_turn").alias("higher"), F.col("depth").alias("more"),
        )
        step = at.join(up, ["conv_id", "root_turn"], "left").select(
            *KEY,
            F.coalesce("higher", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("higher").isNotNull().alias("moved"),
        )
        step = stage(step, "roots")
        at = step.drop("moved")
        if step.filter("moved").isEmpty():
            return at


def _body(text: Column) -> Column:
    """A text without its quoted lines and the line that introduces them."""
    lines = F.split(text, "\n")
    quoted = lambda line: line.rlike(r"^\s*>")
    own = F.filter(
        lines,
        lambda line, i: ~quoted(line)
        & ~(line.rlike(r"(?i)\b(wrote|said)\s*:\s*$") & F.coalesce(quoted(F.get(lines, i + 1)), F.lit(False))),
    )
    return F.when(text.rlike(_ANY_QUOTE), F.trim(F.array_join(own, "\n"))).otherwise(text)


def thread(conversations: DataFrame) -> DataFrame:
    """Every message with parent_turn, root_turn, depth, n_quotes, body and rendered."""
    linked = stage(links(conversations), "links")
    known = linked.join(roots(linked), list(KEY), "left")
    conversations, back = shield(conversations, "_c", "_t")
    rest = [c for c in conversations.columns if c not in RESULT]
    rows = conversations.select(*rest).withColumn("_c", F.col("conv_id").cast("long"))
    rows = rows.withColumn("_t", F.col("turn").cast("long"))
    known = known.withColumnsRenamed({"conv_id": "_c", "turn": "_t"})
    body = _body(F.coalesce("text", F.lit("")))
    return rows.join(known, ["_c", "_t"], "left").select(
        *rest,
        "parent_turn",
        F.coalesce("root_turn", "_t").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        body.alias("body"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), body).alias("rendered"),
    ).withColumnsRenamed(back)
