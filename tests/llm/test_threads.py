"""Quotation linking."""

import duckdb
from pyspark.sql import functions as F

from boutlens.llm import queries_threads, threads

MESSAGES = [
    (1, 0, "user", "Hello there!\nHow are you?"),
    (1, 1, "assistant", "user wrote:\n> How are   you?\n\nFine, thanks.\nAnd you?"),
    (1, 2, "user", "> > how are you\n> Fine, thanks.\n> and you?\nGood."),
    (1, 3, "user", "> Hello THERE\nbump"),
    (1, 4, "assistant", "Unrelated"),
    (1, 5, "user", ">>> how are you?\n>> fine thanks\n> Good.\nok wrote:\nlast"),
    (1, 6, "user", "> nobody said this\n"),
    (1, 7, "user", "> later words\nx"),
    (1, 8, "user", "later words"),
    (2, 0, "user", None), (2, 1, "user", ""), (2, 2, "user", "> How are you?"),
    (2, 3, "user", "same"), (2, 3, "user", "same"), (None, 1, "user", "> same"), (2, None, "user", "> same\nbody"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def rows(spark, data, **more):
    frame = spark.createDataFrame(data, SCHEMA)
    return threads.conversations(frame.withColumns(more)) if more else threads.conversations(frame)


def test_replies_paths_and_bodies(spark):
    got = {(r.conv_id, r.turn): r for r in rows(spark, MESSAGES, path=F.lit("clash"), h=F.lit(1)).collect()}
    replies = {k[1]: r.reply_to for k, r in got.items() if k[0] == 1}
    assert replies == {0: None, 1: 0, 2: 1, 3: 0, 4: None, 5: 2, 6: None, 7: None, 8: None}
    assert got[1, 5].path == "0/1/2/5" and got[1, 5].depth == 3 and got[1, 5].thread == 0 and got[1, 5].levels == 3
    assert got[1, 1].body == "\nFine, thanks.\nAnd you?" or got[1, 1].body == "Fine, thanks.\nAnd you?"
    assert got[1, 5].body == "ok wrote:\nlast" and got[1, 2].body == "Good." and got[2, 2].body == ""
    assert got[None, 1].reply_to is None and got[2, None].body == "body" and got[2, 0].body == ""
    assert len(rows(spark, MESSAGES).collect()) == len(MESSAGES) and rows(spark, []).count() == 0


def test_a_long_chain_of_quotes(spark):
    chain = [(7, i, "user", (f"> line number {i - 1}\n" if i else "") + f"line number {i}") for i in range(70)]
    got = {r.turn: r for r in rows(spark, chain).collect()}
    assert got[69].depth == 69 and got[69].path == "/".join(map(str, range(70))) and all(r.thread == 0 for r in got.values())


def test_a_deep_thread_without_paths(spark):
    chain = [(7, i, "user", (f"> line number {i - 1}\n" if i else "") + f"line number {i}") for i in range(300)] + MESSAGES
    frame = threads.conversations(spark.createDataFrame(chain, SCHEMA), path=False)
    assert not [f for f in frame.schema if f.dataType.typeName() == "array"] and "path" not in frame.columns
    got = {(r.conv_id, r.turn): (r.thread, r.depth) for r in frame.collect()}
    assert all(got[7, i] == (0, i) for i in range(300)) and got[1, 5] == (0, 3) and got[1, 4] == (4, 0) and got[2, None] == (None, 0)


def test_passages_levels_and_latest(spark):
    data = [
        (1, 0, "user", "The quick brown fox\njumps over the lazy dog.\n\nSecond part of it"),
        (1, 1, "user", "Thanks!"),
        (1, 2, "user", "Bob wrote:\n> Alice wrote:\n>> Thanks!\nonly a deeper quote has an author"),
        (1, 3, "user", "> The quick\n> brown fox jumps over\n> the lazy dog.\nre-wrapped"),
        (1, 4, "user", "Thanks!"),
        (1, 5, "user", "> Thanks!\nof turn 4"),
        (1, 6, "user", "jumps over the lazy dog."),
        (1, 7, "user", "> The quick brown fox\n> jumps over the lazy dog.\n>\n> Second part\n> of it\nall of turn 0"),
        (1, 8, "user", "> Cat wrote:\n>> Thanks!\n> of turn 4\nouter first"),
        (1, 5000, "user", "Thanks!"), (1, 9000, "user", "> thanks"), (1, 9001, "user", "> re wrapped"),
    ]
    got = {r.turn: r.reply_to for r in rows(spark, data).collect()}
    assert got == {0: None, 1: None, 2: 1, 3: 0, 4: None, 5: 4, 6: None, 7: 0, 8: 5, 5000: None, 9000: 5000, 9001: 3}


def test_sql_twin_on_quotes(spark, tmp_path):
    data = [m for m in MESSAGES if m[0] is not None and m[1] is not None]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    frame = con.execute(queries_threads.THREADS_SQL)
    names = [d[0] for d in frame.description]
    want = sorted((dict(zip(names, r, strict=True)) for r in frame.fetchall()), key=repr)
    got = sorted((r.asDict() for r in queries_threads.op7_chat_threads(spark, str(tmp_path)).select(*names).collect()), key=repr)
    assert got == want


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame(MESSAGES, SCHEMA).select("conv_id", "turn", "role", "text")
    assert "Python" not in threads.parsed(frame)._jdf.queryExecution().executedPlan().toString()


def test_columns_of_any_name_come_back(spark):
    names = ["_raw", "_own", "_worded", "_kept", "_runs", "_tree", "_quotes", "_units", "_c", "_t", "h", "up", "x", "caller_0"]
    rows = spark.createDataFrame([(1, 0, "hello there"), (1, 1, "> hello there\nyes"), (None, 2, None)], "conv_id long, turn int, text string")
    plain = sorted(threads.conversations(rows).collect(), key=str)
    for name in names:
        rows = rows.withColumn(name, F.lit("mine"))
    got = threads.conversations(rows)
    assert got.columns == [*rows.columns, *threads.RESULT]
    assert all(r[c] == "mine" for r in got.collect() for c in names)
    assert sorted(got.drop(*names).collect(), key=str) == plain
