"""Named data sets against plain Python."""

import json

import pytest

from sievewright.sources import datasets as D
from sievewright.sources import io


def test_resolver(spark, tmp_path):
    a = spark.createDataFrame([("q1", None), ("q2", "own")], "question string, domain string")
    io.write_table(a, f"{tmp_path}/set/train.jsonl")
    io.write_table(spark.createDataFrame([("q3", 4)], "question string, extra int"), f"{tmp_path}/set/val.parquet")
    io.write_table(a, f"{tmp_path}/one.csv")
    rows = {(r.question, r.domain, r.extra) for r in D.resolve(spark, "set", str(tmp_path)).collect()}
    assert rows == {("q1", "train", None), ("q2", "own", None), ("q3", "val", 4)}
    assert D.resolve(spark, "one", str(tmp_path)).count() == 2 == D.resolve(spark, f"{tmp_path}/one.csv").count()
    with pytest.raises(FileNotFoundError):
        D.resolve(spark, "other", str(tmp_path))
    with pytest.raises(ValueError, match="unknown data set"):
        D.load(spark, "other", str(tmp_path))


def test_answers_and_pairs(spark, tmp_path):
    rows = [("what ?", json.dumps([" a , b ", "", "c"]), json.dumps(["m", "n", "o"])), (None, json.dumps(["alone"]), "[]"), ("q", "no list", None)]
    io.write_table(spark.createDataFrame(rows, "question string, human_answers string, chatgpt_answers string").coalesce(1), f"{tmp_path}/hc3_all.parquet")
    io.write_table(io.read_table(spark, f"{tmp_path}/hc3_all.parquet"), f"{tmp_path}/hc3_perturbed.jsonl")
    got = D.load(spark, "hc3_all", str(tmp_path)).orderBy("id").collect()
    assert [r.id for r in got] == [0, 1, 2] and {r.text for r in got} == {"Question: what? Answer: a, b", "Question: what? Answer: c", "alone"}
    assert [r.text for r in D.load(spark, "hc3_all", str(tmp_path)).orderBy("id").collect()] == [r.text for r in got]
    pairs = {(r.original, r.sampled) for r in D.load(spark, "hc3_perturbed", str(tmp_path)).collect()}
    assert pairs == {("Question: what? Answer: a, b", "Question: what? Answer: m"), ("Question: what? Answer: c", "Question: what? Answer: n")}


def test_languages_questions_and_stories(spark, tmp_path):
    texts = [" ".join(["wort"] * n) for n in (100, 101, 149, 150)]
    df = spark.createDataFrame([(i, {"de": t, "en": "short"}) for i, t in enumerate(texts)] + [(9, None)], "k int, translation map<string,string>")
    assert {r.source_k for r in D.language(df, "k", "de").collect()} == {1, 2} and D.language(df, "k", "en").count() == 0
    q = spark.createDataFrame([(1, "why", "so"), (2, None, None)], "k int, question string, long_answer string")
    assert {r.text for r in D.questions(q, "k").collect()} == {"Question: why Answer:<<<SEP>>>so", "Question:  Answer:<<<SEP>>>"}
    (tmp_path / "p").write_text("[ WP ] Once upon\n[ OT ] two\nthree nsfw\n")
    (tmp_path / "s").write_text("a time , <newline> there .\nyes !\nno\n")
    lines = D.aligned_lines(spark, f"{tmp_path}/p", f"{tmp_path}/s")
    assert {r.text for r in D.stories(lines, "line").collect()} == {"Once upon\na time, \nthere.", "two\nyes!"}
    assert D.stories(lines.limit(0), "line").count() == 0
