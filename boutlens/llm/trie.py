"""The tree of all beginnings of conversations, by ROLLUP over columns of turns.

A turn is named by a 128-bit hash of role and text.  Each conversation is cut into blocks of ``WIDTH`` turns, one row per block with one
column per place, and one GROUP BY with ROLLUP over these columns makes the rows of all beginnings at once; its grouping id
tells how many turns a row holds.  A later block continues at the node that the block before ended in: its rows carry
that node as a running hash over all earlier turns, which is counted in ranges (`ordering`), so blocks of all depths are grouped
in the same pass and a conversation of any length takes no more steps.

Sums over subtrees need no walk over the tree.  Along a conversation the nodes whose smallest member it is are those from some depth on;
let its *shared bytes* be the bytes of the turns before that.  Each turn of a member is then either shared or the
first of its node, so for a node with n members and p bytes before its own turn

    saved = sum(shared of members) - least shared - (n - 1) * p

and its leaves are the members that are the smallest member of a childless node.  Both are sums in a second ROLLUP.

Defined cases: rows without a conv_id belong to no conversation and are left out; turns without a number come first; turns with equal
numbers are in the order of their hashes, so that equal rows count twice; null roles and texts are empty; a conversation can be
left without turns and is then a member of the root alone; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlens.llm.ordering import beside, in_order, lookup, numbered, running, runs
from boutlens.session import materialize

WIDTH = 8
#: ids that are joined in one string
CHUNK = 4096
#: conversations that share one beginning, and the number of lengths that beginnings have
FAMILY, HEADS = 5, 9
NOTHING = hashlib.sha256(b"").hexdigest()

_ID = ("a", "b", "n")


def turn_rows(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, n): a turn as two halves of its hash and its bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = messages.where("conv_id IS NOT NULL").select("conv_id", "turn", name.alias("_name"), F.octet_length(text).cast("long").alias("n"))
    half = lambda at: F.conv(F.substring("_name", at, 16), 16, -10).cast("long")
    return rows.select("conv_id", "turn", half(1).alias("a"), half(17).alias("b"), "n")


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("long")


def rebuild(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, a, b, n) of conversations after each has got the head of its family's first; and (conv_id, length) of all.

    Conversation c gets the first h turns of c - c % ``FAMILY`` and then its own after its first h.
    """
    rows = in_order(turn_rows(messages), ["conv_id"], ["turn", "a", "b"], "trie-turns")
    per_run = runs(rows, ["conv_id"])
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = per_run.groupBy("conv_id").agg(F.sum("_n").alias("_own")).withColumns({"_base": base, "_h": head_length(F.col("conv_id"))})
    bases = own.where(F.col("conv_id") == F.col("_base")).select(F.col("conv_id").alias("_base"), F.col("_own").alias("_has"))
    plan = own.join(bases, "_base", "left").withColumn("_got", F.least("_h", F.coalesce("_has", F.lit(0)).cast("long")))
    plan = materialize(plan.select("conv_id", "_base", "_h", "_got", (F.col("_got") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).cast("long").alias("length")), "trie-plan")

    placed = numbered(rows, beside(per_run, plan.select("conv_id", "_h", "_got"), ["conv_id"]), ["conv_id"], "_at")
    tails = placed.where(F.col("_at") >= F.col("_h")).select("conv_id", (F.col("_at") - F.col("_h") + F.col("_got")).alias("pos"), *_ID)
    first = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("_at") < HEADS - 1)).select(F.col("conv_id").alias("_base"), F.col("_at").alias("pos"), *_ID)
    heads = first.join(plan.select("conv_id", "_base", "_h"), "_base").where(F.col("pos") < F.col("_h")).select("conv_id", "pos", *_ID)
    return tails.unionByName(heads), plan.select("conv_id", "length")


def _mark(depth: Column, a: Column, b: Column, seed: int) -> Column:
    """One turn's part of the running hash of a beginning."""
    return F.xxhash64(F.lit(seed), depth, a, b)


def blocks(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per ``WIDTH`` turns: conv_id, length, block, the node before it (ka, kb, its bytes ``pre``) and turns t1, t2, ..

    Conversations without turns have one row without turns.
    """
    place = (F.col("pos") % WIDTH).alias("_k")
    depth = F.col("pos") + 1
    rows = turns.select("conv_id", F.expr(f"pos div {WIDTH}").alias("block"), place, *_ID, _mark(depth, F.col("a"), F.col("b"), 1).alias("_xa"), _mark(depth, F.col("a"), F.col("b"), 2).alias("_xb"))
    cells = [F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"_{c}{k}") for k in range(WIDTH) for c in _ID]
    rows = rows.groupBy("conv_id", "block").agg(F.bit_xor("_xa").alias("_xa"), F.bit_xor("_xb").alias("_xb"), F.sum("n").alias("_bytes"), *cells)
    turn = lambda k: F.when(F.col(f"_a{k}").isNotNull(), F.struct(*(F.col(f"_{c}{k}").alias(c) for c in _ID))).alias(f"t{k + 1}")
    rows = rows.select("conv_id", "block", "_xa", "_xb", "_bytes", *map(turn, range(WIDTH)))
    none = lengths.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("block"))
    rows = in_order(rows.unionByName(none, allowMissingColumns=True), ["conv_id"], ["block"], "trie-sorted")
    chained = running(rows, ["conv_id"], {"ka": ("xor", F.coalesce("_xa", F.lit(0))), "kb": ("xor", F.coalesce("_xb", F.lit(0))), "pre": ("sum", F.coalesce("_bytes", F.lit(0)))})
    return materialize(lookup(chained, lengths, ["conv_id"]).drop("_row"), "trie-blocks")


ROLLED = """
SELECT block, ka, kb, pre, {turns}, grouping_id() AS _out, {what}
FROM {{rows}} GROUP BY block, ka, kb, pre, ROLLUP({turns})"""


def rollup(rows: DataFrame, what: str) -> DataFrame:
    """All nodes below the rows' blocks (and the root), each once: depth, hash (ka, kb), the parent's hash (pa, pb), bytes before
    the node's own turn (``before``), and the aggregates ``what``."""
    names = [f"t{k + 1}" for k in range(WIDTH)]
    out = rows.sparkSession.sql(ROLLED.format(turns=", ".join(names), what=what), rows=rows)
    held = (F.lit(WIDTH) - F.bit_count("_out")).cast("long")
    # a row that holds k turns is a node if the k-th is there; without turns only the root is new
    there = F.when(held == 0, F.col("block") == 0)
    for k, t in enumerate(names, 1):
        there = there.when(held == k, F.col(t).isNotNull())
    out = out.withColumn("_held", held).where(there)
    depth = F.col("block") * WIDTH + F.col("_held")
    here, up, before = [F.col("ka"), F.col("kb")], [F.col("ka"), F.col("kb")], F.col("pre")
    for k, t in enumerate(names, 1):
        for i, seed in enumerate((1, 2)):
            mark = _mark(F.col("block") * WIDTH + k, F.col(f"{t}.a"), F.col(f"{t}.b"), seed)
            here[i] = here[i].bitwiseXOR(F.when(F.col("_held") >= k, mark).otherwise(0))
            up[i] = up[i].bitwiseXOR(F.when(F.col("_held") > k, mark).otherwise(0))
        before = before + F.when(F.col("_held") > k, F.col(f"{t}.n")).otherwise(0)
    kept = [c for c in out.columns if c not in ("block", "ka", "kb", "pre", "_out", "_held", *names)]
    return out.select(depth.alias("depth"), here[0].alias("ka"), here[1].alias("kb"), up[0].alias("pa"), up[1].alias("pb"), before.alias("before"), *kept)


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the chunks of each key, which come in order; one state at a time."""
    key, state = None, None
    for frame in batches:
        done = []
        for depth, ka, kb, chunk, ids in frame.itertuples(index=False):
            if (depth, ka, kb) != key:
                if state is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (depth, ka, kb), hashlib.sha256()
            state.update((b"," if chunk else b"") + ids.encode())
        yield pd.DataFrame(done, columns=["depth", "ka", "kb", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["depth", "ka", "kb", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """(depth, ka, kb, ends_sha256) of nodes where conversations end.

    Ids are numbered per node and joined in chunks; a node with more than one chunk is hashed as a stream of chunks.
    """
    hashed = [F.col("ka"), F.col("kb")]
    for k in range(1, WIDTH + 1):
        for i, seed in enumerate((1, 2)):
            t = F.col(f"t{k}")
            hashed[i] = hashed[i].bitwiseXOR(F.when(t.isNotNull(), _mark(F.col("block") * WIDTH + k, t["a"], t["b"], seed)).otherwise(0))
    last = rows.where(F.expr(f"greatest(length - 1, 0) div {WIDTH}") == F.col("block"))
    key = ["depth", "ka", "kb"]
    last = in_order(last.select(F.col("length").alias("depth"), hashed[0].alias("ka"), hashed[1].alias("kb"), "conv_id"), key, ["conv_id"], "trie-ends")
    placed = numbered(last, runs(last, key), key, "_at").withColumn("_chunk", F.expr(f"_at div {CHUNK}"))
    chunks = placed.groupBy(*key, "_chunk").agg(F.sort_array(F.collect_list("conv_id")).alias("_ids"))
    chunks = materialize(chunks.select(*key, "_chunk", F.concat_ws(",", F.col("_ids").cast("array<string>")).alias("_ids")), "trie-chunks")
    long = materialize(chunks.where("_chunk > 0").select(*key).distinct(), "trie-long")
    short = beside(chunks, long, key, "left_anti").select(*key, F.sha2(F.col("_ids").cast("binary"), 256).alias("ends_sha256"))
    streams = beside(chunks, long, key, "left_semi").repartition(*key).sortWithinPartitions(*key, "_chunk")
    return short.unionByName(streams.select(*key, "_chunk", "_ids").mapInPandas(_stream, "depth long, ka long, kb long, ends_sha256 string"))


def nodes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the tree over conversations (turns: conv_id, pos from 0, a, b, n; lengths: conv_id, length)."""
    rows = blocks(turns, lengths)
    first = rollup(rows, "min(conv_id) AS conv_id, max(length) AS _longest")
    leading = first.groupBy("conv_id").agg(
        F.min(F.struct("depth", "pa", "pb", "before")).alias("_top"), F.max(F.col("_longest") == F.col("depth")).alias("_leaf"))
    leading = materialize(leading.select("conv_id", "_top.*", "_leaf"), "trie-leading")

    total = rows.groupBy("conv_id").agg(F.sum(sum((F.coalesce(F.col(f"t{k + 1}.n"), F.lit(0)) for k in range(WIDTH)), F.lit(0))).alias("_all"))
    shared = total.join(leading, "conv_id", "left").select("conv_id", F.coalesce("before", "_all").alias("shared"), F.coalesce(F.col("_leaf").cast("long"), F.lit(0)).alias("leaf"))
    what = "count(*) AS n_convs, min(conv_id) AS conv_id, sum(leaf) AS n_leaves, sum(shared) - min(shared) AS _shared"
    made = rollup(lookup(rows, shared, ["conv_id"]), what)
    made = materialize(made.withColumn("saved_tokens", F.col("_shared") - (F.col("n_convs") - 1) * F.col("before")).drop("_shared", "before"), "trie-nodes")

    # below the first node it leads, a conversation also leads the parent; above, the parent is looked up once per conversation
    up = in_order(leading.where("depth > 0").select("conv_id", "depth", (F.col("depth") - 1).alias("_d"), "pa", "pb"), ["_d", "pa", "pb"], ["conv_id"], "trie-up")
    of = made.select(F.col("depth").alias("_d"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent"))
    up = lookup(up, of, ["_d", "pa", "pb"]).select("conv_id", "depth", "parent")
    linked = made.join(up, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    linked = materialize(linked.withColumn("parent_conv_id", parent).drop("parent", "pa", "pb"), "trie-linked")
    below = linked.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    out = linked.join(below, ["conv_id", "depth"], "left").join(ends(rows), ["depth", "ka", "kb"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def prefix_tree(messages: DataFrame) -> DataFrame:
    """Nodes of the conversations as `rebuild` makes them."""
    return nodes(*rebuild(messages))
