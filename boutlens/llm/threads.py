"""Conversations without quotes, in reply order, from quoted passages.  DataFrame operations only.

A quote line starts with one or more ``>`` (blanks between them are allowed); their number is its level.  Consecutive lines of one level
are a passage; lines without letters or digits part it into paragraphs.  Texts are compared in a normal form: lower case, without anything
but letters and digits and without line ends, as a hash, so a re-wrapped passage stays the same.

A message *has* a text if that is one of its own lines, paragraphs or passages, or its whole own text.  A quoted line belongs to the
latest earlier message of the conversation that has its passage, else its paragraph, else the line.  A message replies to the message
from which most lines of the outermost level with an author come, the latest of equals: deeper levels speak where the outer ones find
nobody.  Parts of a paragraph that were re-wrapped after cutting have no whole line or paragraph left and are not linked.

Messages without a linked quote begin threads.  ``thread`` (the root) and ``depth`` are scalars found by doubling.  ``path`` holds
the turns from the beginning of the thread to the message and is the reply order within a conversation; in a thread in which each
message quotes the one before, all paths together are as long as the square of the thread.  ``path=False`` leaves them out, and no row
then grows with its thread.

Hot conversations and lines: each (message, text) gets one author before it is joined, so no join multiplies rows.  The latest earlier
message is found within blocks of 2**``BLOCK_BITS`` turns and over the blocks, so no window runs over all messages with one text.

Defined cases: a null text is empty; attribution lines ("... wrote:", "... schrieb:", "... a écrit :", "... escribió:") directly before a
deeper quote go with it; a message with only quotes is left with an empty text; null conv_id or turn link with nothing and
are their own thread; rows are told apart by (conv_id, turn, role, text), so repeated rows get equal results; of rows with one
(conv_id, turn), each can be replied to, and quotes of the message are counted over all of them; a very long text is parsed whole, in time by its length; an empty table
gives no rows; columns named like the results are replaced, all others, whatever their names, come back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlens.llm.columns import set_aside
from boutlens.session import materialize

QUOTE = r"^[ \t]*(>[ \t]*)+"
WROTE = r"(wrote|schrieb|a écrit|escribió) ?:[ \t]*$"
BLOCK_BITS = 12
RUN, GAP, LINE = "\x01", "\x02", "\n"
RESULT = ("body", "quoted_lines", "levels", "reply_to", "thread", "depth", "path")


def _digest(text: Column) -> Column:
    return F.md5(F.translate(text, GAP + LINE, "").cast("binary"))


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with ``body`` (the text without quotes), ``quoted_lines``, ``levels``, ``_quotes`` and ``_units``.

    ``_quotes``: (level, hashes of passage, paragraph and line) of each quoted line with letters or digits.  ``_units``: hashes of all
    texts that the message has.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    rows = messages.withColumn("_raw", F.transform(lines, lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(x, QUOTE, "").alias("s"))))
    ahead = F.concat(F.slice("_raw", 2, F.size("_raw")), F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("s"))))
    rows = rows.withColumn("_own", F.zip_with("_raw", ahead, lambda x, y: F.struct(
        x["level"].alias("level"), x["s"].alias("s"), ((x["level"] < y["level"]) & x["s"].rlike(WROTE)).alias("wrote"),
        F.regexp_replace(F.lower(x["s"]), r"[^\p{L}\p{N}]+", "").alias("form"))))
    rows = rows.withColumn("body", F.trim(F.array_join(F.transform(F.filter("_own", lambda x: (x["level"] == 0) & ~x["wrote"]), lambda x: x["s"]), "\n")))
    worded = F.filter("_own", lambda x: (x["form"] != "") & ((x["level"] > 0) | ~x["wrote"]))
    rows = rows.withColumn("_worded", F.transform(worded, lambda x: x["level"]))
    rows = rows.withColumn("quoted_lines", F.size(F.filter("_worded", lambda x: x > 0)).cast("long"))
    rows = rows.withColumn("levels", F.coalesce(F.array_max("_worded"), F.lit(0)).cast("long"))

    # one string of all lines, with a mark where the level changes, is split into passages: linear in the text
    rows = rows.withColumn("_kept", F.filter("_own", lambda x: ~x["wrote"]))
    before = F.slice(F.concat(F.array(F.lit(-1)), F.transform("_kept", lambda x: x["level"])), F.lit(1), F.size("_kept"))
    marked = F.zip_with("_kept", before, lambda x, y: F.when(x["level"] != y, F.concat(F.lit(RUN), x["level"].cast("string"), F.lit(":"), x["form"]))
                        .when(x["form"] == "", F.lit(GAP)).otherwise(F.concat(F.lit(LINE), x["form"])))
    rows = rows.withColumn("_runs", F.transform(F.filter(F.split(F.array_join(marked, ""), RUN), lambda x: x != ""), lambda x: F.struct(
        F.substring_index(x, ":", 1).cast("int").alias("level"), F.substring_index(x, ":", -1).alias("s"))))
    rows = rows.withColumn("_tree", F.transform("_runs", lambda r: F.struct(
        r["level"].alias("level"), _digest(r["s"]).alias("passage"), F.transform(F.split(r["s"], GAP), lambda p: F.struct(
            _digest(p).alias("paragraph"), F.transform(F.filter(F.split(p, LINE), lambda x: x != ""), _digest).alias("lines"))).alias("parts"))))
    rows = rows.withColumn("_quotes", F.flatten(F.transform(F.filter("_tree", lambda r: r["level"] > 0), lambda r: F.flatten(
        F.transform(r["parts"], lambda p: F.transform(p["lines"], lambda x: F.struct(
            r["level"].alias("level"), r["passage"].alias("passage"), p["paragraph"].alias("paragraph"), x.alias("line"))))))))
    own = F.filter("_tree", lambda r: r["level"] == 0)
    whole = F.array_join(F.transform(F.filter("_runs", lambda r: r["level"] == 0), lambda r: r["s"]), "")
    units = F.concat(F.array(_digest(whole)), F.flatten(F.transform(own, lambda r: F.concat(F.array(r["passage"]), F.flatten(
        F.transform(r["parts"], lambda p: F.concat(F.array(p["paragraph"]), p["lines"])))))))
    rows = rows.withColumn("_units", F.array_except(units, F.array(F.md5(F.lit("").cast("binary")))))
    return rows.drop("_raw", "_own", "_worded", "_kept", "_runs", "_tree")


def latest_before(asked: DataFrame, owned: DataFrame) -> DataFrame:
    """(conv_id, h, turn) of ``asked`` with ``author``, the largest smaller turn of (conv_id, h) in ``owned``.  Both without repeated rows."""
    events = asked.withColumn("own", F.lit(None).cast("long")).unionByName(owned.withColumn("own", F.col("turn").cast("long")))
    events = events.withColumn("blk", F.shiftright(F.col("turn").cast("long"), BLOCK_BITS))
    inside = Window.partitionBy("conv_id", "h", "blk").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv_id", "h").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = events.groupBy("conv_id", "h", "blk").agg(F.max("own").alias("top")).select("conv_id", "h", "blk", F.max("top").over(across).alias("top"))
    near = events.withColumn("near", F.max("own").over(inside)).where("own IS NULL")
    return near.join(blocks, ["conv_id", "h", "blk"]).select("conv_id", "h", "turn", F.coalesce("near", "top").alias("author")).where("author IS NOT NULL")


def replies(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) of the messages of ``rows`` (as `parsed`) that reply."""
    known = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoted = known.where("quoted_lines > 0").select("conv_id", "turn", F.explode("_quotes").alias("x")).groupBy(
        "conv_id", "turn", F.col("x").alias("line")).agg(F.count("*").alias("n"))
    tries = quoted.select("*", F.posexplode(F.array("line.line", "line.paragraph", "line.passage")).alias("rank", "h"))
    tries = materialize(tries, "threads-quoted")
    # only texts that somebody quotes need an author
    wanted = tries.select("conv_id", "h").distinct()
    owned = known.select("conv_id", "turn", F.explode("_units").alias("h")).join(wanted, ["conv_id", "h"], "left_semi").distinct()
    authors = latest_before(tries.select("conv_id", "h", "turn").distinct(), owned)
    best = tries.join(authors, ["conv_id", "h", "turn"]).groupBy("conv_id", "turn", "line").agg(
        F.max_by("author", "rank").alias("author"), F.first("n").alias("n"))
    linked = best.groupBy("conv_id", "turn", F.col("line.level").alias("level"), "author").agg(F.sum("n").alias("n"))
    return linked.groupBy("conv_id", "turn").agg(F.max_by("author", F.struct(-F.col("level"), "n", "author")).alias("reply_to"))


def ancestry(reply: DataFrame, path: bool = False) -> DataFrame:
    """(conv_id, turn, reply_to) with ``thread``, the root, and ``depth`` by pointer doubling: scalars, whatever the depth.

    ``path``: also the turns from the root to the message, an array as long as the thread is deep.
    """
    more = ["path"] if path else []
    # ``up`` is an ancestor ``depth`` steps above, the root once nothing is found for it
    found = reply.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moved"))
    found = materialize(found.withColumn("path", F.array("up", "turn")) if path else found, "threads-replies")
    step = 0
    while not found.where("moved").isEmpty():
        above = found.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), *[F.col(c).alias("path2") for c in more])
        met = found.join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")), "left")
        whole = [F.when(F.col("t").isNull(), F.col("path")).otherwise(F.concat("path2", F.slice("path", F.lit(2), F.size("path")))).alias("path") for _ in more]
        found = materialize(met.select("conv_id", "turn", "reply_to", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
                                       F.col("t").isNotNull().alias("moved"), *whole), f"threads-paths-{step}")
        step += 1
    return found.select("conv_id", "turn", "reply_to", F.col("up").alias("thread"), "depth", *more)


def conversations(messages: DataFrame, text: str = "text", path: bool = True) -> DataFrame:
    """``messages``, all rows and columns, with body, quoted_lines, levels, reply_to, thread, depth and, unless turned off, path."""
    messages, own_columns = set_aside(messages, ("conv_id", "turn", text), RESULT if path else RESULT[:-1])
    rows = materialize(parsed(messages, text), "threads-parsed")
    found = ancestry(replies(rows), path).withColumnsRenamed({"conv_id": "_c", "turn": "_t"})
    rows = rows.join(found, (rows.conv_id == found._c) & (rows.turn == found._t), "left")
    written = [F.coalesce(F.array_join(F.col("path").cast("array<string>"), "/"), F.array_join(F.array(F.col("turn").cast("string")), "/")).alias("path")] if path else []
    return rows.select(*own_columns, "body", "quoted_lines", "levels", "reply_to", F.coalesce("thread", "turn").alias("thread"),
                       F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), *written)
