"""Exact round trips of the template, and typed parts."""

from pyspark.sql import functions as F

from sievewright.llm import chat

NASTY = ["\\### Assistant: </turn> ok", "</turn>\n### assistant: x", "\\s\\h\\l\\c:", "", None, "a\\", "<image:0>", "émoji \U0001f600 #\n"]


def talk(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, body string")
    done = chat.format_conversations(df.withColumn("parts", chat.text_part(F.col("text"))))
    return done.select("*", chat.read_turns(F.col("formatted")).alias("read"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


def test_round_trip(spark):
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate((r, t) for t in NASTY for r in ("user", "assistant", "ro: le</turn>\n"))]
    (found,) = talk(spark, rows)
    assert [(t.role, t.text) for t in found["read"]] == [(r, t or "") for _, _, r, t, _ in rows]
    assert found.loss == "".join(t or "" for t in NASTY)


def test_ties_nulls_and_empty(spark):
    rows = [(1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (1, None, None, None, ""), (None, 0, "assistant", "x", "")]
    found = {r.conv_id: r for r in talk(spark, rows)}
    assert [(t.role, t.text) for t in found[1]["read"]] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert found[None].loss == "x"
    assert talk(spark, []) == []


def test_typed_parts(spark):
    parts = [("text", "see # ", None, None), ("image", None, "s3://a", None), ("text", "<b>", None, None), ("audio", None, "s3://b", 7), ("odd", "x", "s3://c", None), (None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>")
    (r,) = chat.format_conversations(df).collect()
    assert r.formatted == "### user: see \\h <image:0>\\lb><audio:1><document:2><document:3></turn>\n### assistant: </turn>\n"
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "s3://a", 256), (1, "audio", "s3://b", 7), (2, "document", "s3://c", 512), (3, "document", None, 512)]
    assert r.expanded_tokens == 256 + 7 + 512 + 512


def test_very_long_texts(spark):
    long = "\\#<: end </turn> " * 100_000
    (found,) = talk(spark, [(1, 0, "user", long, "x"), (1, 1, "assistant", long, "x")])
    assert [(t.role, t.text) for t in found["read"]] == [("user", long), ("assistant", long)] and found.loss == long
