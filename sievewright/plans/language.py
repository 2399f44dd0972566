"""Registered queries of the language model and of loaders, each beside its DuckDB query. Imported for its registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import language as L
from ..operators import metrics as M
from ..operators import models
from ..operators import perturb as B
from ..operators import quality as Q
from ..session import stored, table
from ..sources import datasets as D
from ..sources import io
from .queries import ORACLES, WIDE_SQL, _detok_sql, _wide, q_burstiness, query, rounded
from .views import DOCS_SQL, QA_SQL, docs, norm_sql, normal, qa

MAX_LENGTH, STRIDE = 128, 64

GRAM_SQL = """
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,}') AS t FROM documents),
g AS (SELECT doc_id, CASE WHEN i > 1 THEN t[i - 1] END AS u, t[i] AS v, t[i + 1] AS w, least(2, i - greatest(0, ceil((i - 127) / 64.0)) * 64) AS seen FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM t)),
vocab AS (SELECT v AS w FROM g UNION SELECT w FROM g)"""


def _tokens() -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{2,})"), F.lit(1))


@query(f"""
WITH {GRAM_SQL},
tri AS (SELECT u, v, w, count(*) AS c FROM g GROUP BY ALL), two AS (SELECT v, w, count(*) AS c FROM tri GROUP BY ALL), one AS (SELECT w, count(*) AS c FROM two GROUP BY w),
z AS (SELECT sum(c) AS total, 0.75 * count(*) / sum(c) / ((SELECT count(*) FROM vocab) + 1) AS even FROM one),
p1 AS (SELECT w, (c - 0.75) / total + even AS p FROM one, z),
b2 AS (SELECT v, sum(c) AS total, 0.75 * count(*) / sum(c) AS back FROM two GROUP BY v),
p2 AS (SELECT v, w, (c - 0.75) / total + back * p AS p FROM two JOIN b2 USING (v) JOIN p1 USING (w)),
t3 AS (SELECT * FROM tri WHERE u IS NOT NULL), b3 AS (SELECT u, v, sum(c) AS total, 0.75 * count(*) / sum(c) AS back FROM t3 GROUP BY u, v),
p3 AS (SELECT u, v, w, (c - 0.75) / total + back * p AS p FROM t3 JOIN b3 USING (u, v) JOIN p2 USING (v, w)),
s AS (SELECT g.doc_id, ln(CASE WHEN g.seen = 2 THEN p3.p ELSE p2.p END) AS lp FROM g JOIN p2 USING (v, w) LEFT JOIN p3 ON p3.u = g.u AND p3.v = g.v AND p3.w = g.w WHERE g.seen > 0)
SELECT d.doc_id, count(lp) AS tokens, round(coalesce(exp(-avg(lp)), 1), 5) AS perplexity FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
""")
def q_kn_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: Kneser-Ney trigrams over windows of 128 tokens that move by 64; each token is scored once, in the first window that holds it."""
    return rounded(L.kn_perplexity(table(spark, sf_dir, "documents"), "doc_id", _tokens(), 3, MAX_LENGTH, STRIDE), 5)


def _cross_sql(grams: str) -> str:
    """CTEs up to ``ce(v, ce)`` and ``pb(v, w, pb)``: models 0 (observer) and 1 (performer) of the rows of ``gm(m, v, w)``."""
    return f"""{GRAM_SQL}, gm AS ({grams}),
two AS (SELECT m, v, w, count(*) AS c FROM gm GROUP BY ALL), one AS (SELECT m, w, count(*) AS c FROM two GROUP BY ALL),
e AS (SELECT m, sum(c) AS total, 0.75 * count(*) / sum(c) / ((SELECT count(*) FROM vocab) + 1) AS even FROM one GROUP BY m),
p1 AS (SELECT e.m, vocab.w, coalesce((c - 0.75) / total, 0) + even AS p FROM e CROSS JOIN vocab LEFT JOIN one ON one.m = e.m AND one.w = vocab.w),
w1 AS (SELECT a.w, a.p AS a1, b.p AS b1 FROM p1 a JOIN p1 b ON a.w = b.w WHERE a.m = 0 AND b.m = 1),
tot AS (SELECT sum(a1) + any_value(e0.even) AS alla, sum(a1 * ln(b1)) + any_value(e0.even) * ln(any_value(e1.even)) AS allx FROM w1, e e0, e e1 WHERE e0.m = 0 AND e1.m = 1),
b AS (SELECT m, v, 0.75 * count(*) / sum(c) AS back, sum(c) AS total FROM two GROUP BY ALL),
k AS (SELECT v, coalesce(max(back) FILTER (m = 0), 1) AS ka, coalesce(max(back) FILTER (m = 1), 1) AS kb FROM b GROUP BY v),
s AS (SELECT v, w, coalesce(sum((c - 0.75) / total) FILTER (m = 0), 0) AS a, coalesce(sum((c - 0.75) / total) FILTER (m = 1), 0) AS b FROM two JOIN b USING (m, v) GROUP BY v, w),
pb AS (SELECT v, w, a + ka * a1 AS pa, b + kb * b1 AS pb, a1, b1 FROM s JOIN k USING (v) JOIN w1 USING (w)),
own AS (SELECT v, sum(pa * ln(pb)) AS own, sum(a1) AS a1, sum(a1 * ln(b1)) AS x1 FROM pb GROUP BY v),
ce AS (SELECT v, -(own + ka * (ln(kb) * (alla - a1) + (allx - x1))) AS ce FROM k JOIN own USING (v), tot)"""


@query(f"""
WITH {_cross_sql("SELECT doc_id % 2 AS m, v, w FROM g")}, r AS (SELECT doc_id, count(*) AS tokens, -avg(ln(pb)) AS nll, avg(ce) AS ce FROM g JOIN ce USING (v) JOIN pb USING (v, w) WHERE seen > 0 GROUP BY doc_id)
SELECT doc_id, tokens, round(nll, 5) AS nll, round(ce, 5) AS cross_entropy, round(nll / ce, 5) AS ratio, nll / ce < 0.9015310749276843 AS accuracy, nll / ce < 0.8536432310785527 AS low_fpr FROM r
""")
def q_perplexity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: the model of odd documents against that of even ones as observer, and the decisions at both fixed thresholds."""
    found = L.own_ratio(table(spark, sf_dir, "documents"), "doc_id", _tokens(), F.col("doc_id") % 2, MAX_LENGTH, STRIDE)
    said = M.ratio_decisions(F.col("ratio"))
    return rounded(found.select("*", *[c.alias(n) for n, c in said.items()]), 5)


@query(f"""
WITH {_cross_sql("SELECT 0 AS m, v, w FROM g UNION ALL SELECT 1, v, w FROM g")}
SELECT doc_id, count(*) AS tokens, round(avg(ce), 5) AS entropy FROM g JOIN ce USING (v) WHERE seen > 0 GROUP BY doc_id
""")
def q_predicted_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean entropy of what the model of all documents predicts at each place."""
    return rounded(L.own_entropies(table(spark, sf_dir, "documents"), "doc_id", _tokens(), MAX_LENGTH, STRIDE), 5)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents")
def q_row_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column of a file's rows (they lie in the order of their ids) in batches of 64, as the scan numbers them."""
    return io.read_batches(spark, f"{sf_dir}/documents.parquet", 64, ["doc_id"])


def _eager(df: DataFrame) -> DataFrame:
    """A filler that answers seven of eight attempts, by a hash, and names the place of each mask."""
    ok = F.md5(F.concat_ws("|", "attempt", "key", "copy")) < "e"
    return df.withColumn("fills", F.when(ok, F.transform("starts", lambda a, i: F.concat(F.lit("f"), i.cast("string")))))


@query("""
WITH c AS (SELECT doc_id, copy, string_split(coalesce(text, ''), ' ') AS w FROM documents, range(2) AS t(copy)),
a AS (SELECT doc_id, copy, w, CASE WHEN len(w) < 4 OR floor(0.3::DOUBLE * len(w) / 4) = 0 THEN 0 ELSE (SELECT min(i) FROM range(20) AS n(i) WHERE md5(i || '|' || doc_id || '|' || copy) < 'e') END AS a FROM c),
r AS (SELECT doc_id, copy, i, row_number() OVER (PARTITION BY doc_id, copy ORDER BY md5('7|0|' || a || '|' || doc_id || '|' || copy || '|' || i), i) <= floor(0.3::DOUBLE * len(w) / 4) AS taken FROM (SELECT *, unnest(range(len(w) // 4)) AS i FROM a WHERE a IS NOT NULL)),
p AS (SELECT doc_id, copy, list(i ORDER BY i) AS p FROM r WHERE taken GROUP BY ALL),
t AS (SELECT doc_id, copy, w, a, coalesce(p, []) AS p FROM a LEFT JOIN p USING (doc_id, copy))
SELECT doc_id, copy::INTEGER AS copy, coalesce(a + 1, 20) AS attempts, len(p)::BIGINT AS spans, CASE WHEN a IS NULL THEN 1 ELSE 0 END::BIGINT AS given_up,
       md5(array_to_string(list_filter(list_transform(w, lambda x, k: CASE WHEN (k - 1) % 4 IN (1, 2) AND list_contains(p, (k - 1) // 4) THEN CASE WHEN (k - 1) % 4 = 1 THEN 'f' || (list_position(p, (k - 1) // 4) - 1) ELSE NULL END ELSE x END), lambda x: x IS NOT NULL), ' ')) AS text FROM t
""")
def q_perturb_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two perturbed copies of every text; attempts that fail are masked anew at other places."""
    done = B.perturb(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", _eager, copies=2, seed=7)
    return done.select("doc_id", "copy", "attempts", "spans", "given_up", F.md5("text").alias("text"))


def _numbered_sql(frm: str, key: str, text: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY sha1('3|' || {key.replace(', ', " || '|' || ")}), {key}) - 1 AS id, md5({text}) AS text FROM ({frm})"


_STRIP = r"regexp_replace({0}, '^[\s\x{{1C}}-\x{{1F}}]+|[\s\x{{1C}}-\x{{1F}}]+$', '', 'g')"
_TIDY = lambda c: f"trim({_detok_sql(c)}, ' ' || chr(10) || chr(9))"
_LIST = lambda c: f"list_filter(list_transform({c}, lambda x: {_STRIP.format('x')}), lambda x: x <> '')"
_ASKED = "'Question: ' || domain || ' Answer: ' || {0}"


@query(f"""
WITH {WIDE_SQL}, a AS (SELECT conv_id, domain, {_LIST('human')} AS h, {_LIST('ai')} AS m FROM wide),
x AS (SELECT conv_id, domain, unnest(h) AS t, unnest(range(len(h))) AS i FROM a)
{_numbered_sql(f"SELECT * FROM (SELECT conv_id, i, {_TIDY(_ASKED.format('t'))} AS text FROM x) WHERE text <> ''", 'conv_id, i', 'text')}
""")
def q_human_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The human answers of wide rows as a data set, its question before each."""
    wide = _wide(spark, sf_dir).select("conv_id", F.col("domain").alias("question"), F.col("human").alias("human_answers"))
    return D.human_answers(wide, "conv_id", 3).select("id", F.md5("text").alias("text"))


@query(f"""
WITH {WIDE_SQL}, a AS (SELECT conv_id, domain, {_LIST('human')} AS h, {_LIST('ai')} AS m FROM wide),
x AS (SELECT conv_id, domain, unnest(h[1 : least(len(h), len(m))]) AS t, unnest(m[1 : least(len(h), len(m))]) AS u, unnest(range(least(len(h), len(m)))) AS i FROM a)
{_numbered_sql(f"SELECT * FROM (SELECT conv_id, i, {_TIDY(_ASKED.format('t'))} AS o, {_TIDY(_ASKED.format('u'))} AS s FROM x) WHERE o <> '' AND s <> ''", 'conv_id, i', "o || chr(10) || s")}
""")
def q_answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th human and machine answers of wide rows as pairs."""
    wide = _wide(spark, sf_dir).select("conv_id", F.col("domain").alias("question"), F.col("human").alias("human_answers"), F.col("ai").alias("chatgpt_answers"))
    return D.answer_pairs(wide, "conv_id", 3).select("id", F.md5(F.concat_ws("\n", "original", "sampled")).alias("text"))


@query(rf"""
WITH w AS (SELECT doc_id, text, len(list_filter(string_split(regexp_replace({_STRIP.format('text')}, '[\s\x{{1C}}-\x{{1F}}]+', ' ', 'g'), ' '), lambda x: x <> '')) AS n FROM documents WHERE lang = 'de')
{_numbered_sql("SELECT * FROM w WHERE n > 100 AND n < 150", 'doc_id', 'text')}
""")
def q_language_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The German side of translations with more than 100 and fewer than 150 words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct(F.when(F.col("lang") == "de", F.col("text")).alias("de")).alias("translation"))
    return D.language(d, "doc_id", "de", 3).select("id", F.md5("text").alias("text"))


@query(f"WITH {QA_SQL} {_numbered_sql(f"SELECT conv_id, turn, 'Question: ' || prompt || ' Answer:<<<SEP>>>' || text AS text FROM qa WHERE label = 'ai'", "conv_id || '-' || turn", 'text')}")
def q_question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their long answers, a separator between them."""
    rows = qa(spark, sf_dir).filter("label = 'ai'").select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("prompt").alias("question"), F.col("text").alias("long_answer"))
    return D.questions(rows, "key", 3).select("id", F.md5("text").alias("text"))


@query(f"WITH {QA_SQL}, s AS (SELECT conv_id, turn, {_TIDY("replace(replace('[ WP ] ' || prompt, '[ WP ]', ''), '[ OT ]', '') || chr(10) || ' ' || text")} AS text FROM qa WHERE label = 'ai') {_numbered_sql("SELECT * FROM s WHERE NOT contains(text, 'nsfw') AND NOT contains(text, 'NSFW')", "conv_id || '-' || turn", 'text')}")
def q_story_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories after their prompts, whose tags are dropped."""
    rows = qa(spark, sf_dir).filter("label = 'ai'").select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.concat(F.lit("[ WP ] "), "prompt").alias("prompt"), F.col("text").alias("story"))
    return D.stories(rows, "key", 3).select("id", F.md5("text").alias("text"))


@query("""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents), b AS (SELECT doc_id AS other, md5(coalesce(text, '')) AS digest, row_number() OVER (ORDER BY md5('p' || doc_id)) AS n FROM documents)
SELECT doc_id, other, digest FROM a JOIN b USING (n)
""")
def q_position_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of their ids beside the rows in the order of a hash, place by place."""
    d = table(spark, sf_dir, "documents")
    right = d.select(F.col("doc_id").alias("other"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), F.md5(F.concat(F.lit("p"), F.col("doc_id").cast("string"))).alias("_h"))
    return Q.join_by_position(d.select("doc_id"), right, "doc_id", "_h").select("doc_id", "other", "digest")


@query(f"""
WITH {DOCS_SQL}, k AS (SELECT y, md5({norm_sql('text')}) AS t FROM docs), one AS (SELECT t FROM k GROUP BY t HAVING count(DISTINCT y) = 1), o AS (SELECT * FROM k SEMI JOIN one USING (t))
SELECT count(*) - count(DISTINCT t) AS duplicate_texts, count(*) - count(DISTINCT (t, y)) AS duplicate_text_labels, 0::BIGINT AS conflicting_texts, 0::BIGINT AS text_train_test, 0::BIGINT AS prompt_train_val FROM o
""")
def q_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks pass for texts with one label each, split by a hash of the text; with what they count."""
    d = docs(spark, sf_dir).select("y", F.md5(normal("text")).alias("t"))
    one = d.groupBy("t").agg(F.count_distinct("y").alias("n")).filter("n = 1").select("t")
    first = F.substring("t", 1, 1)
    rows = stored(d.join(one, "t", "left_semi").withColumn("split", F.when(first < "2", "test").when(first == "2", "val").otherwise("train")), "rows")
    found = Q.check_integrity(rows, "split", F.col("t"), F.col("t"), "y", deduplicated=False)
    values = {k: found[k] for k in ("duplicate_texts", "duplicate_text_labels", "conflicting_texts")} | {"text_train_test": found["overlap"]["text"]["train_test"], "prompt_train_val": found["overlap"]["prompt"]["train_val"]}
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in values.items()])


@query("SELECT doc_id, round(ln(1 + doc_perplexity), 6) AS x_doc, round(ln(1 + sentence_perplexity_mean), 6) AS x_mean, sentence_perplexity_std AS x_std, burstiness AS x_burst FROM (" + ORACLES["q_burstiness"] + ") AS f")
def q_perplexity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the perplexity detector learns from: logarithms of the perplexities, the others as they are."""
    m = models.perplexity_matrix(q_burstiness(spark, sf_dir))
    return m.select("doc_id", F.round("x_doc_perplexity", 6).alias("x_doc"), F.round("x_sentence_perplexity_mean", 6).alias("x_mean"), F.col("x_sentence_perplexity_std").alias("x_std"), F.col("x_burstiness").alias("x_burst"))
