"""Ordinary identifiers come from every word of the corpus."""

from pyspark.sql import functions as F

from sievewright.llm import secrets as S


def letters(n):
    return "".join("abcdefghij"[int(d)] for d in f"{n:06d}")


def test_every_word_of_every_document(spark):
    rows = [(i, " ".join(letters(i * 12 + k) for k in range(12)) + f" and x9 {letters(0)}") for i in range(700)]
    docs = spark.createDataFrame([*rows, (700, None), (701, "")], "doc_id long, text string")
    words = [r.word for r in S.corpus_words(docs).collect()]
    assert len(words) == len(set(words)) and set(words) == {letters(n) for n in range(8400)} | {"and"}
    samples = S.labelled_samples(spark, docs)
    assert samples.filter("not random").count() == S.SAMPLES + 8401
    some = samples.filter(~F.col("random") & F.lower("sample").contains(letters(8399))).count()
    assert some == 1


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.labelled_samples(spark, docs).count() == 2 * S.SAMPLES and len(S.train(S.labelled_samples(spark, docs))) == S.SIZE**2
