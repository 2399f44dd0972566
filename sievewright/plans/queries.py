"""Registered queries of the library's own operators, each beside the DuckDB query that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import features as X
from ..operators import metrics as M
from ..operators import models
from ..operators import quality as Q
from ..operators import reshape as R
from ..operators import rewrite as W
from ..operators import sampling as S
from ..session import stored, table
from ..streaming.checkpoints import windowed_counts
from .views import DOCS_SQL, PREDS_SQL, QA_SQL, docs, norm_sql, normal, preds, qa

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BY = ["detector", "split"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 8) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- evaluation

COUNT_SQL = """sum(CASE WHEN NOT said AND y <> 1 THEN 1 ELSE 0 END)::BIGINT AS tn, sum(CASE WHEN said AND y <> 1 THEN 1 ELSE 0 END)::BIGINT AS fp,
         sum(CASE WHEN NOT said AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN said AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS tp"""
RATES_SQL = """round((tp + tn) / (tn + fp + fn + tp)::DOUBLE, 8) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 8) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 8) AS f1"""


@query(f"""
WITH {PREDS_SQL}, said AS (SELECT *, score >= 0.5 AS said FROM preds), c AS (SELECT detector, split, {COUNT_SQL} FROM said GROUP BY ALL)
SELECT detector, split, tn, fp, fn, tp, {RATES_SQL} FROM c
""")
def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: counts and rates of every detector and split at one threshold."""
    return rounded(M.confusion(preds(spark, sf_dir), BY))


@query(f"""
WITH {PREDS_SQL}, t AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 0.3 + (doc_id % 5) / 10.0::DOUBLE END AS cut FROM preds),
m AS (SELECT detector, split, domain, coalesce(median(cut), 0.5) AS threshold FROM t GROUP BY ALL),
said AS (SELECT t.*, m.threshold, score >= m.threshold AS said FROM t JOIN m USING (detector, split, domain)),
c AS (SELECT detector, split, domain, threshold, {COUNT_SQL} FROM said GROUP BY ALL)
SELECT detector, split, domain, round(threshold, 8) AS threshold, tn, fp, fn, tp, {RATES_SQL} FROM c
""")
def q_metrics_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: every domain at its own median decision threshold."""
    cut = F.when(F.col("doc_id") % 3 != 0, 0.3 + (F.col("doc_id") % 5) / 10.0)
    return rounded(M.evaluate(preds(spark, sf_dir).withColumn("decision_threshold", cut), ["detector", "split", "domain"]))


@query(f"""
WITH {PREDS_SQL} SELECT detector, y, sum(CASE WHEN score < 0.5 THEN 1 ELSE 0 END)::BIGINT AS predicted_human, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS predicted_ai
FROM preds GROUP BY ALL
""")
def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-by-two table by pivot."""
    said = F.when(F.col("score") >= 0.5, "predicted_ai").otherwise("predicted_human")
    return preds(spark, sf_dir).withColumn("said", said).groupBy("detector", "y").pivot("said", ["predicted_human", "predicted_ai"]).count().fillna(0)


TABLE_SQL = (
    PREDS_SQL
    + """, own AS (
  SELECT detector, split, score AS threshold, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS n FROM preds GROUP BY ALL
), run AS (
  SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER g AS positives, sum(n) OVER g AS negatives FROM own
  WINDOW w AS (PARTITION BY detector, split ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY detector, split)
)"""
)
ROC_SQL = (
    TABLE_SQL
    + """, bent AS (
  SELECT *, lead(tp) OVER w - 2 * tp + lag(tp) OVER w AS bt, lead(fp) OVER w - 2 * fp + lag(fp) OVER w AS bf FROM run WHERE positives > 0 AND negatives > 0
  WINDOW w AS (PARTITION BY detector, split ORDER BY threshold DESC)
), points AS (
  SELECT detector, split, fp / negatives::DOUBLE AS fpr, tp / positives::DOUBLE AS tpr, threshold, tp, fp, positives, negatives FROM bent WHERE coalesce(bt, 1) <> 0 OR coalesce(bf, 1) <> 0
  UNION ALL SELECT DISTINCT detector, split, 0.0, 0.0, 'Infinity'::DOUBLE, 0, 0, positives, negatives FROM bent
)"""
)


def _roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.roc_points(preds(spark, sf_dir), BY)


@query(f"WITH {ROC_SQL} SELECT detector, split, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr, CASE WHEN isinf(threshold) THEN NULL ELSE round(threshold, 8) END AS threshold FROM points")
def q_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curve points, points on straight lines dropped; the origin's infinite threshold is shown as null."""
    points = _roc(spark, sf_dir).select(*BY, "fpr", "tpr", F.when(F.col("threshold") != float("inf"), F.col("threshold")).alias("threshold"))
    return rounded(points)


@query(f"WITH {TABLE_SQL} SELECT detector, split, round(sum(p * (2 * (negatives - fp) + n)) / (2.0 * any_value(positives) * any_value(negatives)), 8)::DOUBLE AS roc_auc FROM run GROUP BY ALL")
def q_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve from ranks."""
    return rounded(M.roc_auc(preds(spark, sf_dir), BY))


@query(f"""
WITH {TABLE_SQL}, pr AS (
  SELECT detector, split, tp / (tp + fp)::DOUBLE AS pc, tp / positives::DOUBLE AS rc, threshold FROM run WHERE positives > 0
  UNION ALL SELECT DISTINCT detector, split, 1.0, 0.0, 'Infinity'::DOUBLE FROM run WHERE positives > 0
), a AS (SELECT detector, split, (pc + lag(pc) OVER w) / 2 * (rc - lag(rc) OVER w) AS a FROM pr WINDOW w AS (PARTITION BY detector, split ORDER BY threshold DESC))
SELECT detector, split, round(sum(a), 8) AS pr_auc FROM a GROUP BY ALL
""")
def q_pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under precision by recall."""
    return rounded(M.pr_auc(preds(spark, sf_dir), BY))


POINT_SQL = f"detector, split, CASE WHEN isinf(threshold) THEN NULL ELSE round(threshold, 8) END AS threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr, (negatives - fp)::BIGINT AS tn, fp::BIGINT AS fp, (positives - tp)::BIGINT AS fn, tp::BIGINT AS tp, {RATES_SQL.replace('tn', '(negatives - fp)').replace('fn', '(positives - tp)')}"


def _point(df: DataFrame) -> DataFrame:
    shown = F.when(F.abs("threshold") != float("inf"), F.col("threshold"))
    return rounded(df.withColumn("threshold", shown))


@query(f"WITH {ROC_SQL} SELECT {POINT_SQL} FROM points WHERE fpr <= 0.1 QUALIFY row_number() OVER (PARTITION BY detector, split ORDER BY tpr DESC, fpr DESC) = 1")
def q_tpr_at_fpr_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule A, the last point of the largest tpr."""
    return _point(M.operating_point_a(_roc(spark, sf_dir), BY, 0.1))


@query(f"WITH {ROC_SQL} SELECT {POINT_SQL} FROM points WHERE fpr <= 0.1 QUALIFY row_number() OVER (PARTITION BY detector, split ORDER BY tpr DESC, fpr) = 1")
def q_tpr_at_fpr_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule B, the first point of the largest tpr."""
    return _point(M.operating_point_b(_roc(spark, sf_dir), BY, 0.1))


@query(f"""
WITH {PREDS_SQL}, own AS (
  SELECT detector, split, 1 - score AS raw, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS n FROM preds GROUP BY ALL
), run AS (
  SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER g AS positives, sum(n) OVER g AS negatives, min(raw) OVER g AS least FROM own
  WINDOW w AS (PARTITION BY detector, split ORDER BY raw ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY detector, split)
), cuts AS (
  SELECT detector, split, raw + 1e-12 AS threshold, tp, fp, positives, negatives FROM run
  UNION ALL SELECT DISTINCT detector, split, least - 1e-12, 0, 0, positives, negatives FROM run
), rated AS (SELECT *, coalesce(fp / nullif(negatives, 0)::DOUBLE, 0) AS fpr, coalesce(tp / nullif(positives, 0)::DOUBLE, 0) AS tpr, coalesce(2 * tp / nullif(tp + fp + positives, 0)::DOUBLE, 0) AS f FROM cuts)
SELECT {POINT_SQL} FROM rated WHERE fpr <= 0.1 + 1e-12 QUALIFY row_number() OVER (PARTITION BY detector, split ORDER BY f DESC, tpr DESC, fpr, threshold DESC) = 1
""")
def q_tpr_at_fpr_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule C on raw scores where low means positive."""
    return _point(M.operating_point_c(preds(spark, sf_dir).withColumn("raw", 1 - F.col("score")), BY, 0.1))


@query(f"""
WITH {ROC_SQL}, best AS (SELECT * FROM points WHERE fpr <= 0.001 QUALIFY row_number() OVER (PARTITION BY detector, split ORDER BY tpr DESC, fpr DESC) = 1),
d AS (SELECT *, tpr * positives AS t, fpr * negatives AS f FROM best), e AS (SELECT *, coalesce(t / nullif(t + f, 0), 0) AS pc FROM d)
SELECT detector, split, CASE WHEN isinf(threshold) THEN 0.0 ELSE round(threshold, 8) END AS threshold, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr,
       round((t + negatives - f) / (positives + negatives), 8) AS accuracy, round(pc, 8) AS precision, round(coalesce(2 * pc * tpr / nullif(pc + tpr, 0), 0), 8) AS f1 FROM e
""")
def q_tpr_at_fpr_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule D from stored curve rows, with fractional counts."""
    return rounded(M.operating_point_d(_roc(spark, sf_dir), BY, 0.001))


@query(f"WITH {ROC_SQL} SELECT detector, split, round(coalesce(min(fpr) FILTER (tpr >= 0.8), 0), 8) AS fpr FROM points GROUP BY ALL")
def q_fpr_at_80tpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R8."""
    return rounded(M.fpr_at_tpr(_roc(spark, sf_dir), BY))


@query(f"""
WITH {TABLE_SQL}, every AS (
  SELECT detector, split, threshold, tp, fp, positives, negatives FROM run
  UNION ALL SELECT detector, split, 0.5, sum(CASE WHEN threshold >= 0.5 THEN p ELSE 0 END), sum(CASE WHEN threshold >= 0.5 THEN n ELSE 0 END), any_value(positives), any_value(negatives) FROM run GROUP BY detector, split
), r AS (
  SELECT *, (tp + negatives - fp) / (positives + negatives)::DOUBLE AS acc, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS pc, coalesce(tp / nullif(positives, 0)::DOUBLE, 0) AS rc,
         coalesce(2 * tp / nullif(tp + fp + positives, 0)::DOUBLE, 0) AS f1 FROM every
)
SELECT detector, split, CASE WHEN positives > 0 AND negatives > 0 THEN round(threshold, 8) ELSE 0.5 END AS threshold, round(f1, 8) AS best_f1
FROM r QUALIFY row_number() OVER (PARTITION BY detector, split ORDER BY f1 DESC, acc DESC, pc DESC, rc DESC, threshold) = 1
""")
def q_best_f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold search in one sort."""
    return rounded(M.best_f1_threshold(preds(spark, sf_dir), BY))


@query(f"""
WITH {PREDS_SQL}, c AS (SELECT detector, domain, sum(CASE WHEN score >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS p FROM preds GROUP BY ALL),
v AS (SELECT * FROM (VALUES ('src0'), ('src1'), ('src2'), ('none')) AS v(domain)), m AS (SELECT * FROM (VALUES ('coarse'), ('fine')) AS m(detector))
SELECT domain, max(round(tp / p::DOUBLE, 8)) FILTER (detector = 'coarse') AS coarse, max(round(tp / p::DOUBLE, 8)) FILTER (detector = 'fine') AS fine
FROM v CROSS JOIN m LEFT JOIN c USING (domain, detector) GROUP BY domain
""")
def q_report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants by detectors, absent cells null, as a table."""
    cells = spark.sql("SELECT * FROM VALUES ('src0'), ('src1'), ('src2'), ('none') AS v(domain) CROSS JOIN VALUES ('coarse'), ('fine') AS m(detector)")
    got = M.confusion(preds(spark, sf_dir), ["domain", "detector"]).select("domain", "detector", "recall")
    return rounded(cells.join(got, ["domain", "detector"], "left").groupBy("domain").pivot("detector", ["coarse", "fine"]).agg(F.max("recall")))


@query(f"WITH {PREDS_SQL} SELECT detector, least(floor(score * 10), 9)::INTEGER AS bin, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y <> 1) AS negatives FROM preds GROUP BY ALL")
def q_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: histograms of both classes."""
    b = F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("int").alias("bin")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return preds(spark, sf_dir).groupBy("detector", b).agg(count(F.col("y") == 1).alias("positives"), count(F.col("y") != 1).alias("negatives"))


# ---- text

@query(f"SELECT doc_id, sha1({norm_sql('text')}) AS norm_sha1, length({norm_sql('text')}) AS norm_chars FROM documents")
def q_norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5, X6, P9."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(normal("text")).alias("norm_sha1"), F.length(normal("text")).cast("long").alias("norm_chars"))


@query(f"""
WITH {DOCS_SQL}, k AS (SELECT doc_id, y, md5({norm_sql('text')}) AS t, md5({norm_sql('domain')}) AS p FROM docs)
SELECT count(*) - count(DISTINCT t) AS duplicate_texts, count(*) - count(DISTINCT (t, y)) AS duplicate_text_labels, count(*) - count(DISTINCT (p, t, y)) AS duplicate_rows,
       (SELECT count(*) FROM (SELECT t FROM k GROUP BY t HAVING count(DISTINCT y) > 1)) AS conflicting_texts FROM k
""")
def q_text_key_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    d = docs(spark, sf_dir).select("y", F.md5(normal("text")).alias("t"), F.md5(normal("domain")).alias("p"))
    return Q.duplicate_summary(d, "p", "t", "y")


@query(f"SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY {norm_sql('text')}, lang ORDER BY doc_id) = 1")
def q_dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each text and label; keys are hashed, so windows sort no texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2(normal("text"), 256).alias("k"))
    return Q.keep_first(d, [F.col("k"), F.col("lang")], [F.col("doc_id")]).drop("k")


SENTENCES_SQL = f"list_filter(string_split(regexp_replace({norm_sql('text')}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0)"


@query(f"SELECT doc_id, len({SENTENCES_SQL})::BIGINT AS sentences, list_sum(list_transform({SENTENCES_SQL}, lambda x: length(x)))::BIGINT AS chars, {SENTENCES_SQL}[1] AS first FROM documents")
def q_sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7."""
    s = T.sentences(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    total = F.when(F.size("s") > 0, F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)))
    return d.select("doc_id", F.size("s").cast("long").alias("sentences"), total.alias("chars"), F.get("s", F.lit(0)).alias("first"))


TOKENS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}')"
FOLD = "translate(lower(coalesce(text, '')), '{}', '{}')".format(*[x.replace("'", "''") for x in X.ACCENTS])
MODEL_SQL = f"""tok AS (SELECT doc_id, unnest({TOKENS.format(FOLD)}) AS token FROM documents),
own AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
model AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rank, ln((n + 1.0) / (sum(n) OVER () + count(*) OVER ())) AS logp FROM own)"""


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.unigram_model(table(spark, sf_dir, "documents"), X.word_tokens(X.fold(F.col("text"))))


@query(f"""
WITH {MODEL_SQL}, l AS (SELECT doc_id, CASE WHEN len({SENTENCES_SQL}) = 0 THEN [''] ELSE {SENTENCES_SQL} END AS l FROM documents), s AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS s FROM l),
st AS (SELECT doc_id, s, unnest({TOKENS.format(FOLD)}) AS token FROM s), j AS (SELECT doc_id, s, logp FROM st JOIN model USING (token)),
per AS (SELECT doc_id, s, coalesce(sum(logp), 0) AS lp, count(logp) AS n, CASE WHEN count(logp) = 0 THEN 1.0 ELSE exp(-sum(logp) / count(logp)) END AS ppl FROM s LEFT JOIN j USING (doc_id, s) GROUP BY doc_id, s)
SELECT doc_id, round(CASE WHEN sum(n) = 0 THEN 1.0 ELSE exp(-sum(lp) / sum(n)) END, 5) AS doc_perplexity, round(avg(ppl), 5) AS sentence_perplexity_mean, round(stddev_pop(ppl), 5) AS sentence_perplexity_std,
       CASE WHEN count(*) < 2 THEN 0.0 ELSE round(stddev_pop(ppl) / avg(ppl), 5) END AS burstiness FROM per GROUP BY doc_id
""")
def q_burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity features under the unigram model."""
    return rounded(X.sentence_perplexities(table(spark, sf_dir, "documents"), "doc_id", "text", _model(spark, sf_dir)), 5)


@query(f"""
WITH {MODEL_SQL} SELECT doc_id, count(*) AS tokens, round(avg(logp), 7) AS ll, round(avg(rank), 5) AS mean_rank, round(avg(ln(rank)), 7) AS mean_log_rank
FROM tok JOIN model USING (token) GROUP BY doc_id
""")
def q_token_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood, rank and log-rank."""
    counts = X.term_counts(table(spark, sf_dir, "documents"), "doc_id", X.word_tokens(X.fold(F.col("text"))))
    got = X.model_means(counts, X.with_rank(_model(spark, sf_dir)).select("token", "logp", "rank"), ["doc_id"], {"ll": F.col("logp"), "mean_rank": F.col("rank"), "mean_log_rank": F.log("rank")})
    return got.select("doc_id", "tokens", F.round("ll", 7).alias("ll"), F.round("mean_rank", 5).alias("mean_rank"), F.round("mean_log_rank", 7).alias("mean_log_rank"))


@query(f"""
WITH tok AS (SELECT doc_id, {TOKENS.format(FOLD)} AS t FROM documents), pairs AS (SELECT doc_id, t[i] AS a, t[i + 1] AS b FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM tok)),
both_ AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b), first AS (SELECT a, sum(n) AS na FROM both_ GROUP BY a),
model AS (SELECT a, b, ln((n + 1.0) / (na + (SELECT count(DISTINCT b) FROM both_))) AS logp FROM both_ JOIN first USING (a))
SELECT doc_id, count(*) AS tokens, round(avg(logp), 7) AS ll FROM pairs JOIN model USING (a, b) GROUP BY doc_id
""")
def q_ngram_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram log-likelihood."""
    return rounded(X.bigram_scores(table(spark, sf_dir, "documents"), "doc_id", X.word_tokens(X.fold(F.col("text")))), 7)


@query(f"""
WITH {MODEL_SQL}, c AS (SELECT doc_id, token, count(*) AS n FROM tok GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
SELECT doc_id, round(-sum(n / total::DOUBLE * ln(n / total::DOUBLE)), 7) + 0.0 AS entropy FROM c JOIN t USING (doc_id) GROUP BY doc_id
""")
def q_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of a document's tokens."""
    lists = X.term_lists(table(spark, sf_dir, "documents"), "doc_id", X.word_tokens(X.fold(F.col("text"))))
    return X.entropies(lists, "doc_id").select("doc_id", (F.round("entropy", 7) + F.lit(0.0)).alias("entropy"))


@query(f"""
WITH {MODEL_SQL}, c AS (SELECT doc_id, token AS term, count(*) AS n FROM tok GROUP BY ALL), v AS (SELECT term, count(*) AS df, sum(n) AS total FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 2000),
w AS (SELECT doc_id, term, (1 + ln(n)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term)), s AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
SELECT term, count(*) AS documents, round(sum(w / norm), 5) AS weight FROM w JOIN s USING (doc_id) GROUP BY term
""")
def q_tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: TF-IDF of the most frequent terms; a bounded vocabulary is the operator's feature."""
    d = table(spark, sf_dir, "documents")
    lists = X.term_lists(d, "doc_id", X.word_tokens(X.fold(F.col("text"))))
    vocab = X.vocabulary(X.list_counts(lists, "doc_id"), 2, 2000)
    return X.tfidf(lists, vocab, d.count(), "doc_id").groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("weight"), 5).alias("weight"))


@query(f"""
WITH w AS (SELECT item_id, ' ' || w || ' ' AS w FROM (SELECT doc_id AS item_id, unnest(string_split({norm_sql('text')}, ' ')) AS w FROM documents) WHERE w <> ''),
g AS (
  SELECT item_id, substr(w, i, n) AS term FROM (SELECT item_id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM w, (VALUES (3), (4), (5)) AS v(n) WHERE length(w) > n)
  UNION ALL SELECT item_id, w FROM w WHERE length(w) <= 5
)
SELECT term, count(DISTINCT item_id) AS df, count(*) AS total FROM g GROUP BY term
""")
def q_char_wb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: character n-grams inside padded words."""
    return X.char_term_totals(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), 3, 5)


@query("""
WITH m AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS words, md5(array_to_string(w[1:len(w) - 1], ' ')) AS dropped, md5(array_to_string(w[1:least(len(w), 30)], ' ')) AS prompt30,
       len(w) > 100 AND len(w) < 150 AS in_band, CASE WHEN max(len(w)) OVER () > 250 THEN len(w) > 250 ELSE true END AS long_enough, contains(array_to_string(w, ' '), 'nsfw') AS excluded
FROM m
""")
def q_word_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word bands, last word dropped, first words kept, a marked substring excluded."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.size(T.words(F.col("text"))).cast("long"))
    # one number decides for all rows whether the long texts are enough
    most = d.agg(F.max("n").alias("most"))
    d = d.join(F.broadcast(most))
    return d.select(
        "doc_id", F.col("n").alias("words"), F.md5(T.drop_last_word(F.col("text"))).alias("dropped"), F.md5(T.first_words(F.col("text"), F.lit(30))).alias("prompt30"),
        T.word_count_between(F.col("text"), 100, 150).alias("in_band"), F.when(F.col("most") > 250, F.col("n") > 250).otherwise(True).alias("long_enough"), F.contains("text", F.lit("nsfw")).alias("excluded"),
    )


@query(r"""
SELECT page_id, trim(regexp_replace(lower(url), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS slug, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS file FROM pages
""")
def q_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X16."""
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), T.file_part(F.col("url")).alias("file"))


STYLE_IN = "'Intro — a note' || chr(10) || '- first item' || chr(10) || '- second' || chr(10) || text"


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\s+—\s+', ', ', 'g'), '—\s*', ', ', 'g') AS t FROM documents),
e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\s+–\s+', ', ', 'g'), '–\s*', ', ', 'g') AS t FROM d)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, ',\s*,', ',', 'g'), '^\s*,\s*', ''), '\s{2,}', ' ', 'g'))) AS dashes FROM e
""")
def q_style_dashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X19."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.drop_dashes(F.coalesce("text", F.lit("")))).alias("dashes"))


@query()
def q_style_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three passes; tests hold hand-made texts against expected ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", T.cleanup_style(F.col("text")).alias("clean")).select("doc_id", F.md5("clean").alias("clean_md5"), F.length("clean").alias("chars"))


def _detok_sql(c: str) -> str:
    for old, new in T.DETOKENIZE:
        q = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        c = f"replace({c}, {q(old)}, {q(new)})"
    return c


@query(f"SELECT conv_id, turn, md5(trim({_detok_sql('text')}, ' ' || chr(10) || chr(9))) AS plain FROM conversations WHERE text IS NOT NULL")
def q_detok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X22."""
    return table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.md5(T.detokenize(F.col("text"))).alias("plain"))


CELL = "CASE doc_id % 5 WHEN 0 THEN '[\"a' || doc_id || '\", null, \" b \", \"\"]' WHEN 1 THEN 'plain ' || doc_id WHEN 2 THEN '[\"x\",\"y\"]' WHEN 3 THEN '' ELSE 'nan' END"


@query(f"""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END::BIGINT AS rewrite, CASE doc_id % 5 WHEN 0 THEN 'a' || doc_id || '|b' WHEN 1 THEN 'plain ' || doc_id WHEN 2 THEN 'x|y' ELSE '' END AS strict,
       CASE doc_id % 5 WHEN 0 THEN 'a' || doc_id || '| b |' WHEN 1 THEN 'plain ' || doc_id WHEN 2 THEN 'x|y' ELSE '' END AS perturb, CASE doc_id % 5 WHEN 0 THEN 'a' || doc_id || '|b' WHEN 2 THEN 'x|y' ELSE '' END AS json
FROM documents
""")
def q_list_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List cells by four readers."""
    c = F.expr(CELL)
    d = table(spark, sf_dir, "documents").select("doc_id", c.alias("c"))
    return d.select("doc_id", F.size(T.decode_list(F.col("c"))).cast("long").alias("rewrite"), *[F.array_join(T.decode_list(F.col("c"), v), "|").alias(v) for v in ("strict", "perturb", "json")])


@query("""
SELECT label, y, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'ai' WHEN 2 THEN 'human' ELSE 'ai' END AS label, CASE doc_id % 4 WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS y FROM documents) GROUP BY ALL
""")
def q_label_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12."""
    raw = F.expr("CASE doc_id % 4 WHEN 0 THEN ' Human ' WHEN 1 THEN 'ChatGPT' WHEN 2 THEN 'human' ELSE 'machine' END")
    d = table(spark, sf_dir, "documents").select(raw.alias("raw"))
    return d.select(T.coerce_label(F.col("raw")).alias("label"), T.label_number(F.col("raw")).alias("y")).groupBy("label", "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PREDS_SQL} SELECT detector, doc_id, round(ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6))), 7) AS margin, CASE WHEN score < 0.25 THEN NULL ELSE score END AS kept FROM preds")
def q_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14, F10, X13."""
    p = preds(spark, sf_dir)
    kept = N.finite_or(F.when(F.col("score") < 0.25, float("nan")).otherwise(F.col("score")), None)
    return p.select("detector", "doc_id", F.round(N.clipped_logit(F.col("score")), 7).alias("margin"), kept.alias("kept"))


@query("""
WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents),
h AS (SELECT doc_id, w, i, md5('7|' || doc_id || '|' || i) AS h FROM (SELECT doc_id, w, unnest(range(greatest(least(len(w), 256), 1))) AS i FROM w)),
p AS (SELECT doc_id, any_value(w) AS w, list(i ORDER BY i) AS p FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h, i) <= 20) GROUP BY doc_id)
SELECT doc_id, len(p)::BIGINT AS masked, md5(array_to_string(list_transform(w, lambda x, k: CASE WHEN list_contains(p, k - 1) THEN '_' ELSE x END), ' ')) AS changed FROM p
""")
def q_perturb_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X24-X27, M11 (random fill): seeded single-word changes, at most 20 among the first 256 words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("p", T.seeded_positions(F.size(T.words(F.col("text"))), 256, 20, F.lit("7"), F.col("doc_id")))
    masked = T.mask_words(F.col("text"), F.col("p"))
    fills = F.transform("p", lambda _: F.lit("_"))
    return d.select("doc_id", T.count_masks(masked).cast("long").alias("masked"), F.md5(T.apply_fills(masked, fills)).alias("changed"))


@query(f"""
WITH {MODEL_SQL}, o AS (SELECT doc_id, avg(logp) AS ll FROM tok JOIN model USING (token) GROUP BY doc_id),
v AS (SELECT doc_id, k, unnest(list_filter({TOKENS.format(FOLD)}, lambda x, i: i % 5 <> k)) AS token FROM documents, range(5) AS r(k)), p AS (SELECT doc_id, k, avg(logp) AS ll FROM v JOIN model USING (token) GROUP BY doc_id, k),
s AS (SELECT doc_id, avg(ll) AS m, CASE WHEN count(*) > 1 THEN stddev_pop(ll) ELSE 1.0 END AS sd FROM p GROUP BY doc_id)
SELECT doc_id, round(ll - m, 6) + 0.0 AS d, CASE WHEN sd < 1e-9 THEN 0.0 ELSE round((ll - m) / sd, 4) + 0.0 END AS z FROM o JOIN s USING (doc_id)
""")
def q_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihood against five perturbed copies that leave out every fifth token."""
    # sums for each fifth of a document's tokens (they count from 1); a copy leaves one out
    fifths = X.part_sums(table(spark, sf_dir, "documents"), "doc_id", X.word_tokens(X.fold(F.col("text"))), _model(spark, sf_dir), 5)
    every = fifths.groupBy("doc_id").agg(F.sum("lp").alias("all_lp"), F.sum("n").alias("all_n"), F.map_from_entries(F.collect_list(F.struct("k", F.struct("lp", "n")))).alias("of"))
    own = every.select("doc_id", (F.col("all_lp") / F.col("all_n")).alias("ll"))
    left = every.select("doc_id", "all_lp", "all_n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.struct(k.alias("k"), F.try_element_at("of", k.cast("bigint")).alias("o")))).alias("x"))
    lp, n = F.col("all_lp") - F.coalesce("x.o.lp", F.lit(0.0)), F.col("all_n") - F.coalesce("x.o.n", F.lit(0))
    per = left.filter(n > 0).select("doc_id", F.col("x.k").alias("k"), (lp / n).alias("ll"))
    stats = X.perturbation_statistics(per, "doc_id", "ll")
    both = own.join(stats, "doc_id")
    d1 = N.curvature(F.col("ll"), F.col("mean_ll"))
    # a deviation that is rounding error alone is none
    z = F.when(F.col("std_ll") < 1e-9, 0.0).otherwise(F.round(N.curvature(F.col("ll"), F.col("mean_ll"), F.col("std_ll")), 4) + F.lit(0.0))
    return both.select("doc_id", (F.round(d1, 6) + F.lit(0.0)).alias("d"), z.alias("z"))


# ---- answers

WIDE_SQL = QA_SQL + ", wide AS (SELECT conv_id, any_value(domain) AS domain, list(text ORDER BY turn) FILTER (label = 'human') AS human, list(text ORDER BY turn) FILTER (label = 'ai') AS ai FROM qa GROUP BY conv_id)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == name, F.struct("turn", "text")))), lambda s: s["text"])
    return qa(spark, sf_dir).groupBy("conv_id").agg(F.first("domain").alias("domain"), side("human").alias("human"), side("ai").alias("ai"))


@query(f"""
WITH {WIDE_SQL}, b AS (SELECT conv_id, 'human' AS label, human AS a FROM wide UNION ALL SELECT conv_id, 'ai', ai FROM wide),
n AS (SELECT conv_id, label, list_filter(list_transform(a, lambda x: {norm_sql('x')}), lambda x: x <> '') AS a FROM b)
SELECT conv_id, label, unnest(range(len(a)))::INTEGER AS answer_index, md5(unnest(a)) AS text_md5 FROM n
""")
def q_answer_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3, F2, F4."""
    return R.explode_answers(_wide(spark, sf_dir), ["conv_id"], "human", "ai").select("conv_id", "label", "answer_index", F.md5("text").alias("text_md5"))


@query(f"""
WITH {QA_SQL} SELECT conv_id, turn, substr(sha1('qa||' || domain || '||' || {norm_sql('prompt')} || '||' || {norm_sql('text')} || '||' || label || '||' || conv_id || '||' || turn), 1, 20) AS sample_id FROM qa
""")
def q_sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids from the parts."""
    return qa(spark, sf_dir).select("conv_id", "turn", T.stable_id(F.lit("qa"), F.col("domain"), normal("prompt"), normal("text"), F.col("label"), F.col("conv_id"), F.col("turn")).alias("sample_id"))


@query(f"""
WITH {QA_SQL}, f AS (SELECT * FROM qa QUALIFY row_number() OVER (PARTITION BY conv_id, label, {norm_sql('text')} ORDER BY turn) = 1)
SELECT conv_id, md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (label = 'human'), '')) AS human, md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (label = 'ai'), '')) AS ai,
       count(*) FILTER (label = 'human') AS n_human, count(*) FILTER (label = 'ai') AS n_ai FROM f GROUP BY conv_id
""")
def q_renest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers back to lists of unique texts."""
    w = R.renest(qa(spark, sf_dir), ["conv_id"], "label", "text", "turn")
    joined = lambda c: F.md5(F.array_join(c, "\n"))
    return w.select("conv_id", joined("human_answers").alias("human"), joined("ai_answers").alias("ai"), F.size("human_answers").cast("long").alias("n_human"), F.size("ai_answers").cast("long").alias("n_ai"))


@query(f"""
WITH {WIDE_SQL}, p AS (SELECT conv_id, unnest(range(least(len(human), len(ai))))::INTEGER AS pair, unnest(human[1:least(len(human), len(ai))]) AS h, unnest(ai[1:least(len(human), len(ai))]) AS a FROM wide WHERE len(human) > 0 AND len(ai) > 0),
n AS (SELECT *, least(len(string_split(h, ' ')), len(string_split(a, ' '))) AS n FROM p)
SELECT conv_id, pair, n::BIGINT AS words, md5(array_to_string(string_split(h, ' ')[1:n], ' ')) AS original, md5(array_to_string(string_split(a, ' ')[1:n], ' ')) AS sampled FROM n
""")
def q_pair_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of both lists cut to the same number of words."""
    p = R.zip_pairs(_wide(spark, sf_dir), ["conv_id"], "human", "ai")
    a, b = T.trim_pair(F.col("original"), F.col("sampled"))
    return p.select("conv_id", "pair", F.size(T.words(a)).cast("long").alias("words"), F.md5(a).alias("original"), F.md5(b).alias("sampled"))


@query(f"WITH {QA_SQL} SELECT conv_id, turn, md5(CASE WHEN prompt <> '' THEN 'Question: ' || prompt || ' Answer: ' || text ELSE text END) AS qa FROM qa WHERE label = 'ai'")
def q_question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4."""
    return qa(spark, sf_dir).filter("label = 'ai'").select("conv_id", "turn", F.md5(T.question_answer(F.col("prompt"), F.col("text"))).alias("qa"))


@query(f"""
WITH {QA_SQL}, k AS (SELECT DISTINCT domain, {norm_sql('prompt')} AS p FROM qa WHERE conv_id % 4 = 0)
SELECT conv_id, turn, label FROM qa WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.domain = qa.domain AND k.p = {norm_sql('qa.prompt')})
""")
def q_holdout_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose (domain, prompt) key is not held out."""
    rows = qa(spark, sf_dir).select("conv_id", "turn", "label", "domain", F.md5(normal("prompt")).alias("key"))
    return Q.hold_out(rows, rows.filter("conv_id % 4 = 0"), ["domain", "key"]).select("conv_id", "turn", "label")


@query(f"""
WITH {PREDS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY domain, y ORDER BY doc_id) - 1 AS occurrence FROM preds WHERE detector = 'coarse'),
b AS (SELECT domain, y, doc_id AS other_id, row_number() OVER (PARTITION BY domain, y ORDER BY doc_id) - 1 AS occurrence FROM preds WHERE detector = 'fine')
SELECT a.doc_id, a.occurrence::INTEGER AS occurrence, b.other_id FROM a LEFT JOIN b USING (domain, y, occurrence)
""")
def q_cumcount_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th row of a key meets the n-th row of that key."""
    p = preds(spark, sf_dir)
    right = p.filter("detector = 'fine'").select("domain", "y", F.col("doc_id").alias("other_id"))
    return Q.join_by_occurrence(p.filter("detector = 'coarse'").select("domain", "y", "doc_id"), right, ["domain", "y"], "doc_id", "other_id").select("doc_id", "occurrence", "other_id")


@query(f"WITH {PREDS_SQL} SELECT detector, doc_id FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM preds) WHERE pred IS NULL OR pred <> y")
def q_mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong or missing predictions."""
    pred = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("score") >= 0.5, 1).otherwise(0)
    return Q.misclassified(preds(spark, sf_dir).withColumn("pred", pred), "y", "pred").select("detector", "doc_id")


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, A10."""
    return Q.value_counts(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("""
WITH m AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), d AS (SELECT lang, source AS domain FROM m QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) = 1)
SELECT d.lang, d.domain, string_agg(DISTINCT CAST(doc_id % 3 AS VARCHAR), '+' ORDER BY CAST(doc_id % 3 AS VARCHAR)) AS labels FROM d JOIN documents x USING (lang) GROUP BY ALL
""")
def q_group_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    d = table(spark, sf_dir, "documents").withColumn("third", (F.col("doc_id") % 3).cast("string"))
    return R.group_signature(d, "lang", "source", "third")


# ---- sampling and splits

ORDER = "sha1('42|' || doc_id)"


def _alloc_sql(total: str) -> str:
    return f"""c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), e AS (SELECT *, {total} * n / sum(n) OVER () AS share, {total} AS total FROM c),
r AS (SELECT source, n, floor(share)::BIGINT AS base, row_number() OVER (ORDER BY round(share - floor(share), 12) DESC, source) AS rank, total - sum(floor(share)) OVER () AS rest FROM e),
takes AS (SELECT source, n, least(n, base + CASE WHEN rank <= rest THEN 1 ELSE 0 END)::BIGINT AS take FROM r)"""


@query(f"WITH {_alloc_sql('97')} SELECT source, n, take FROM takes")
def q_domain_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest remainders."""
    c = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return S.allocate(c, "source", F.lit(97))


@query(f"""
WITH {_alloc_sql('greatest(1, round_even((SELECT count(*) FROM documents) * 0.13::DOUBLE, 0))')}
SELECT doc_id, source FROM documents JOIN takes USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY {ORDER}, doc_id) <= take
""")
def q_fraction_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proportional sample in hash order; sampling is the feature."""
    return S.sample_fraction(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 0.13, "doc_id")


@query(f"""
WITH t AS (SELECT lang, source, greatest(1, round_even(count(*) * 0.25::DOUBLE, 0)) AS take FROM documents GROUP BY ALL)
SELECT doc_id, lang, source FROM documents JOIN t USING (lang, source) QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {ORDER}, doc_id) <= take
""")
def q_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: a fraction of each stratum, at least one row; sampling is the feature."""
    return S.sample_stratified(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 0.25, "doc_id")


@query(f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {ORDER}, doc_id) <= 20")
def q_label_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 rows a group; the cap is the feature."""
    return S.take_per_group(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], 20, "doc_id")


@query(f"SELECT doc_id FROM documents WHERE doc_id < 10 UNION SELECT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id >= 10 ORDER BY {ORDER}, doc_id LIMIT 40)")
def q_sample_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty rows, ten of them preserved; sampling is the feature."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return S.sample_total(d, 50, "doc_id", preserved=d.filter("doc_id < 10"))


@query("SELECT doc_id, source, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 + 1 AS INTEGER) AS shard FROM documents")
def q_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R18."""
    return S.shard(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 4)


GROUP_SQL = f"""k AS (SELECT doc_id, md5({norm_sql('text')}) AS t, 'p' || (doc_id % 61) AS p, source, lang FROM documents),
g AS (SELECT t, min(doc_id) AS f FROM k GROUP BY t), edges AS (SELECT DISTINCT CAST(k.doc_id % 61 AS BIGINT) AS a, CAST(g.f % 61 AS BIGINT) AS b FROM k JOIN g USING (t))"""


@query(f"""
WITH RECURSIVE {GROUP_SQL}, both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a, a AS r FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.r = both_.a),
comp AS (SELECT a, min(r) AS c FROM reach GROUP BY a), rows_ AS (SELECT doc_id, c FROM k JOIN comp ON comp.a = doc_id % 61)
SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS group_first FROM rows_
""")
def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows joined by equal prompt or text keys; a group is shown by its smallest document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(normal("text")).alias("t"), F.concat(F.lit("p"), (F.col("doc_id") % 61).cast("string")).alias("p"))
    g = S.group_components(d, "p", "t").select("doc_id", "group_id")
    first = g.groupBy("group_id").agg(F.min("doc_id").alias("group_first"))
    return g.join(first, "group_id").select("doc_id", "group_first")


def _split_sql(frm: str, share: str, name: str, size: str) -> str:
    return f"""{name}_c AS (SELECT s, count(*) AS n FROM {frm} GROUP BY s),
{name}_e AS (SELECT s, n, {size} AS size, {size} * n / sum(n) OVER () AS share, min(n) OVER () >= 2 AND {size} >= count(*) OVER () AS fits FROM {name}_c),
{name}_r AS (SELECT *, row_number() OVER (ORDER BY round(share - floor(share), 12) DESC, s) AS rank, size - sum(floor(share)) OVER () AS rest FROM {name}_e),
{name}_t AS (SELECT s, size, fits, least(n, floor(share) + CASE WHEN rank <= rest THEN 1 ELSE 0 END) AS take FROM {name}_r),
{name} AS (SELECT g, s, CASE WHEN fits THEN row_number() OVER (PARTITION BY s ORDER BY sha1('42|' || g), g) <= take ELSE row_number() OVER (ORDER BY sha1('42|' || g), g) <= size END AS inside FROM {frm} JOIN {name}_t USING (s))"""


@query(f"""
WITH rows_ AS (SELECT doc_id AS g, lang AS s FROM documents), {_split_sql('rows_', '0.2', 'a', 'ceil(round(sum(n) OVER () * 0.2::DOUBLE, 9))::BIGINT')},
left_ AS (SELECT g, s FROM a WHERE NOT inside), {_split_sql('left_', '0.125', 'b', 'ceil(round(sum(n) OVER () * (0.1::DOUBLE / (1 - 0.2::DOUBLE)), 9))::BIGINT')}
SELECT g AS doc_id, 'test' AS split FROM a WHERE inside UNION ALL SELECT g, CASE WHEN inside THEN 'val' ELSE 'train' END FROM b
""")
def q_row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified test, val and train by quotas."""
    return S.group_splits(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 0.2, 0.1)


@query(f"""
WITH {DOCS_SQL}, k AS (SELECT split, 'text' AS kind, md5({norm_sql('text')}) AS v FROM docs UNION ALL SELECT split, 'domain', domain FROM docs),
i AS (SELECT kind, v, max((split = 'train')::INT) AS t, max((split = 'val')::INT) AS a, max((split = 'test')::INT) AS e FROM k GROUP BY ALL)
SELECT kind, sum(t * a)::BIGINT AS train_val, sum(t * e)::BIGINT AS train_test, sum(a * e)::BIGINT AS val_test FROM i GROUP BY kind
""")
def q_split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A8, U2."""
    return Q.split_overlap(docs(spark, sf_dir), "split", {"text": F.md5(normal("text")), "domain": F.col("domain")})


# ---- rewrite bookkeeping

@query(f"""
WITH {QA_SQL}, t AS (SELECT domain, CASE WHEN length(trim(prompt)) = 0 THEN 0 ELSE greatest(1, ceil(length(trim(prompt)) / 4.0)) END AS i, CASE WHEN length(trim(text)) = 0 THEN 0 ELSE greatest(1, ceil(length(trim(text)) / 4.0)) END AS o FROM qa WHERE label = 'ai'),
b AS (SELECT domain, count(*) AS requests, sum(i) AS i, sum(o) AS o FROM t GROUP BY domain)
SELECT domain, d::INTEGER AS depth, (requests * d)::BIGINT AS requests, (i * d)::BIGINT AS input_tokens, (o * d)::BIGINT AS output_tokens, ((i + o) * d)::BIGINT AS total_tokens, round((i * d * 0.75::DOUBLE + o * d * 4.5::DOUBLE) / 1e6, 6) AS cost FROM b, range(1, 4) AS r(d)
""")
def q_token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9, A12, A15, D8."""
    rows = qa(spark, sf_dir).filter("label = 'ai'")
    u = W.estimate_usage(rows, ["domain"], F.col("prompt"), F.col("text"), 3)
    return W.with_cost(u, "gpt-5.4-mini").select("domain", "depth", "requests", "input_tokens", "output_tokens", "total_tokens", "cost")


@query(f"""
WITH {QA_SQL}, u AS (SELECT domain, (turn % 3 + 1)::INTEGER AS depth, count(*) AS requests, sum(length(prompt)) AS input_tokens, sum(length(text)) AS output_tokens, sum(length(prompt) + length(text)) AS total_tokens FROM qa GROUP BY ALL)
SELECT domain, depth, requests, input_tokens::BIGINT AS input_tokens, output_tokens::BIGINT AS output_tokens, total_tokens::BIGINT AS total_tokens,
       sum(requests) OVER w::BIGINT AS cumulative_requests, sum(input_tokens) OVER w::BIGINT AS cumulative_input_tokens, sum(output_tokens) OVER w::BIGINT AS cumulative_output_tokens, sum(total_tokens) OVER w::BIGINT AS cumulative_total_tokens
FROM u WINDOW w AS (PARTITION BY domain ORDER BY depth)
""")
def q_usage_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, D7."""
    rows = qa(spark, sf_dir).select("domain", (F.col("turn") % 3 + 1).cast("int").alias("depth"), F.lit(1).cast("long").alias("requests"), F.length("prompt").cast("long").alias("input_tokens"), F.length("text").cast("long").alias("output_tokens"))
    return W.cumulative_usage(rows.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")), ["domain"])


LIKERT_TEXT = "CASE doc_id % 7 WHEN 0 THEN '{\"score\": 4}' WHEN 1 THEN 'Answer: {\"label\":\"Strongly Agree\"}' WHEN 2 THEN 'I would say 2.' WHEN 3 THEN 'great' WHEN 4 THEN '{\"label\":\"neutral\"}' WHEN 5 THEN 'I strongly disagree' ELSE 'Strongly Agree' END"


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 3 THEN NULL WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 4 END::INTEGER AS score FROM documents")
def q_likert_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11."""
    return table(spark, sf_dir, "documents").select("doc_id", T.likert_score(F.expr(LIKERT_TEXT)).alias("score"))


@query("""
WITH s AS (SELECT source, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 5 + 1 END AS score FROM documents)
SELECT source, count(score) AS checked, count(*) FILTER (score >= 3) AS passed, count(*) FILTER (score < 3) AS rejected, count(*) FILTER (score IS NULL) AS missing,
       count(*) FILTER (score = 1) AS score_1, count(*) FILTER (score = 2) AS score_2, count(*) FILTER (score = 3) AS score_3, count(*) FILTER (score = 4) AS score_4, count(*) FILTER (score = 5) AS score_5 FROM s GROUP BY source
""")
def q_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    d = table(spark, sf_dir, "documents").withColumn("score", F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 5 + 1))
    return W.quality_summary(d, ["source"], "score", 3)


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 + 1 < 3 THEN CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END ELSE 3 END::INTEGER AS depth,
       CASE WHEN doc_id % 5 + 1 < 3 THEN CASE doc_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'original' END ELSE 'C' END AS text FROM documents
""")
def q_fallback_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed check falls back to the next lower depth, else to the original."""
    maps = F.expr("CASE doc_id % 3 WHEN 0 THEN map(1, 'A', 2, 'B', 3, 'C') WHEN 1 THEN map(1, 'A', 3, 'C') ELSE map(3, 'C') END")
    d = table(spark, sf_dir, "documents").select("doc_id", maps.alias("m"), (F.col("doc_id") % 5 + 1).alias("s"))
    d = d.withColumn("depth", W.selected_depth(F.col("m"), 3, 3, F.col("s"), 3))
    return d.select("doc_id", "depth", W.selected_text(F.col("m"), F.lit("original"), F.col("depth")).alias("text"))


@query("SELECT user_id, event_id, event_type, round(value, 8) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of every key."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return rounded(Q.keep_latest(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value"))


@query("""
WITH d AS (SELECT user_id, list_distinct(list(event_id % 7 + 1)) AS d FROM events GROUP BY user_id)
SELECT user_id, len(list_filter(range(1, 8), lambda i: len(list_filter(d, lambda x: x <= i)) = i))::INTEGER AS depth FROM d
""")
def q_consecutive_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R17."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set((F.col("event_id") % 7 + 1).cast("int")).alias("d"))
    return e.select("user_id", W.consecutive_depth(F.col("d")).alias("depth"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def q_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra, not among the reference's operators: tumbling windows that also run on streams."""
    return rounded(windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value"), 6)


# ---- detectors: no SQL equivalent; tests hold them against held-out quality

def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = docs(spark, sf_dir).select("doc_id", "text", "y", "split")
    return tuple(d.filter(F.col("split") == s) for s in ("train", "val", "test"))


@query()
def q_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, M5, M7, M8: SVM on TF-IDF with calibrated probabilities, scored on the test split."""
    train, val, test = _parts(spark, sf_dir)
    return models.predict_svm(test, *models.fit_svm(train, val), "doc_id")


@query()
def q_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, M7: boosted trees with early stopping on the val split."""
    train, val, test = _parts(spark, sf_dir)
    fit = train.withColumn("validation", F.lit(False)).unionByName(val.withColumn("validation", F.lit(True)))
    return models.predict_trees(test, models.fit_trees(fit), "doc_id")


@query()
def q_logreg_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M3: logistic regression on perplexity features, told apart at the threshold that is best on the val split."""
    f = X.sentence_perplexities(table(spark, sf_dir, "documents"), "doc_id", "text", _model(spark, sf_dir))
    d = docs(spark, sf_dir).select("doc_id", "y", "split").join(f, "doc_id")
    d = stored(d, "features")
    model = models.fit_logistic(d.filter("split = 'train'"))
    return models.predict_logistic(d.filter("split = 'test'"), model, "doc_id", models.choose_threshold(d.filter("split = 'val'"), model))
