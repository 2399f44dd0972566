"""Further registered queries: metric blocks, remapping, masks, prompts and responses, each beside its DuckDB query. Imported for its registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import exports as E
from ..operators import features as X
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import remap as P
from ..operators import rewrite as W
from ..operators import sampling as S
from ..operators.ranges import numbered
from ..session import stored, table
from .queries import BY, COUNT_SQL, FOLD, RATES_SQL, ROC_SQL, TOKENS, _wide, query, rounded
from .views import PREDS_SQL, QA_SQL, norm_sql, normal, preds, qa

# ---- metric blocks

def _at_sql(name: str, target: float, frm: str = "points") -> str:
    return f"{name} AS (SELECT detector, split, arg_max({{'t': threshold, 'f': fpr, 'r': tpr}}, {{'r': tpr, 'f': fpr}}) AS o, any_value(positives) AS p, any_value(negatives) AS n FROM {frm} WHERE fpr <= {target} GROUP BY ALL)"


@query(f"""
WITH {ROC_SQL}, said AS (SELECT *, score >= 0.5 AS said FROM preds), c AS (SELECT detector, split, count(*) AS num_samples, {COUNT_SQL} FROM said GROUP BY ALL),
auc AS (SELECT detector, split, sum(p * (2 * (negatives - fp) + n)) / (2.0 * any_value(positives) * any_value(negatives)) AS roc_auc FROM run GROUP BY ALL),
{_at_sql('a', 0.01)}, {_at_sql('b', 0.001)}
SELECT c.detector, c.split, num_samples, tn, fp, fn, tp, {RATES_SQL}, round(roc_auc, 8) AS roc_auc, round(a.o.r, 8) AS tpr_at_1pct_fpr, round(a.o.f, 8) AS actual_fpr_at_1pct_fpr, round(b.o.r, 8) AS tpr_at_0_1pct_fpr
FROM c JOIN auc USING (detector, split) LEFT JOIN a USING (detector, split) LEFT JOIN b USING (detector, split)
""")
def q_binary_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: counts, rates, area and fixed-FPR columns of every detector and split."""
    return rounded(M.binary_block(preds(spark, sf_dir), BY, 0.5, [0.01, 0.001]).select(*BY, "num_samples", *M.COUNTS, "accuracy", "precision", "recall", "f1", "roc_auc", "tpr_at_1pct_fpr", "actual_fpr_at_1pct_fpr", "tpr_at_0_1pct_fpr"))


@query(f"""
WITH {PREDS_SQL}, said AS (SELECT *, score >= 0.5 AS said FROM preds), c AS (SELECT detector, split, domain, grouping(domain)::INTEGER AS whole, {COUNT_SQL} FROM said GROUP BY GROUPING SETS ((detector, split), (detector, split, domain)))
SELECT detector, split, domain, whole, tn, fp, fn, tp, {RATES_SQL} FROM c
""")
def q_metrics_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the groups and, inside them, their domains in one pass."""
    return rounded(M.nested(preds(spark, sf_dir), BY, "domain"))


SUMMARY_SQL = f"""
{ROC_SQL}, said AS (SELECT *, score >= 0.5 AS said FROM preds), c AS (SELECT detector, split, count(*) AS num_samples, {COUNT_SQL} FROM said WHERE split = 'test' GROUP BY ALL),
auc AS (SELECT detector, split, sum(p * (2 * (negatives - fp) + n)) / (2.0 * any_value(positives) * any_value(negatives)) AS roc_auc FROM run GROUP BY ALL),
s AS (SELECT c.*, roc_auc, CASE WHEN detector = 'fine' THEN 0.25::DOUBLE ELSE 'nan'::DOUBLE END AS stored_recall FROM c JOIN auc USING (detector, split)),
{_at_sql('a', 0.01)}, {_at_sql('b', 0.001)}, low AS (SELECT detector, split, min(fpr) FILTER (tpr >= 0.8) AS f FROM points GROUP BY ALL),
k AS (SELECT s.*, a.o.r AS ar, a.o.f AS af, b.o.r AS br, low.f AS low, coalesce(a.o.r, 0) * (fn + tp) AS atp, coalesce(a.o.f, 0) * (tn + fp) AS afp FROM s LEFT JOIN a USING (detector, split) LEFT JOIN b USING (detector, split) LEFT JOIN low USING (detector, split)),
q AS (SELECT *, CASE WHEN atp + afp > 0 THEN atp / (atp + afp) ELSE 0 END AS precision_ FROM k)"""


def _summary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = preds(spark, sf_dir)
    rows = M.binary_block(p.filter("split = 'test'"), BY, 0.5, []).withColumnRenamed("detector", "detector_name").withColumn("dataset_name", F.lit("documents"))
    rows = rows.withColumn(N.metric_name("recall", 0.01), F.when(F.col("detector_name") == "fine", 0.25).otherwise(float("nan")))
    return rows, M.roc_points(p, BY).withColumnRenamed("detector", "detector_name")


@query(f"""
WITH {SUMMARY_SQL}
SELECT detector, round(CASE WHEN isnan(stored_recall) THEN coalesce(ar, 0) ELSE stored_recall END, 8) AS recall, round(CASE WHEN isnan(stored_recall) THEN coalesce(ar, 0) ELSE stored_recall END, 8) AS tpr, round(precision_, 8) AS precision,
       round(CASE WHEN precision_ + coalesce(ar, 0) > 0 THEN 2 * precision_ * coalesce(ar, 0) / (precision_ + coalesce(ar, 0)) ELSE 0 END, 8) AS f1,
       round((atp + tn + fp - afp) / (tn + fp + fn + tp), 8) AS accuracy, round(coalesce(roc_auc, 0), 8) AS auc_roc, round(coalesce(br, 0), 8) AS tpr_at_0_1pct_fpr, round(coalesce(low, 0), 8) AS fpr_at_80pct_tpr
FROM q
""")
def q_metric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored metrics where finite, else those of the row's own curve, else 0."""
    rows, curve = _summary(spark, sf_dir)
    done = E.metric_blocks(rows, curve)
    return rounded(done.select(F.col("detector_name").alias("detector"), "metrics_at_1pct_fpr.*", "presentation_metrics.tpr_at_0_1pct_fpr", "presentation_metrics.fpr_at_80pct_tpr").drop("auc_roc").join(done.select(F.col("detector_name").alias("detector"), F.col("presentation_metrics.roc_auc").alias("auc_roc")), "detector"))


@query(f"""
WITH {SUMMARY_SQL}
SELECT 'documents_' || detector AS experiment_name, CASE WHEN detector = 'fine' THEN 'kept model' ELSE detector END AS model_used, CASE WHEN detector = 'fine' THEN 'kept notes' ELSE 'Exported from an evaluation on the test split.' END AS notes,
       num_samples, round(coalesce(br, 0), 6) AS tpr, round((atp + tn + fp - afp) / (tn + fp + fn + tp), 6) AS accuracy FROM q
""")
def q_metric_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared JSON payloads over older ones, read back by label."""
    rows, curve = _summary(spark, sf_dir)
    old = spark.sql("""SELECT 'documents' AS dataset_name, 'fine' AS detector_name, '{"model_used":"kept model","additional_details":{"notes":"kept notes"}}' AS payload""")
    p = E.share_payloads(rows, curve, old).select("payload")
    field = lambda path: F.get_json_object("payload", path)
    return p.select(
        field("$.experiment_name").alias("experiment_name"), field("$.model_used").alias("model_used"), field("$.additional_details.notes").alias("notes"), field("$.num_samples").cast("long").alias("num_samples"),
        F.round(E.block_metric(F.col("payload"), "tpr"), 6).alias("tpr"), F.round(E.block_metric(F.col("payload"), "accuracy", "metrics_at_1pct_fpr"), 6).alias("accuracy"),
    )


@query(f"WITH {ROC_SQL} SELECT CASE detector WHEN 'fine' THEN 'Fine detector' ELSE detector END AS label, split, round(fpr, 8) AS fpr, round(max(tpr), 8) AS tpr FROM points WHERE split IN ('test', 'val') GROUP BY ALL")
def q_roc_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: curves of several detectors under their labels, of chosen data sets."""
    return rounded(M.roc_comparison(M.roc_points(preds(spark, sf_dir), BY), "detector", "split", ["test", "val"], {"fine": "Fine detector"}))


@query(f"WITH {PREDS_SQL}, c AS (SELECT *, ((doc_id * 104729) % 1009 + 1) / 1010.0::DOUBLE AS p FROM preds WHERE detector = 'fine') SELECT doc_id, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / least(greatest(1 - p, 1e-6), 1.0)), 8) AS margin, p < 0.8536432310785527 AS low_fpr, p < 0.9015310749276843 AS accuracy FROM c")
def q_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins with one-sided clipping, and decisions at the two fixed thresholds of the ratio detector."""
    p = ((F.col("doc_id") * 104729) % 1009 + 1) / F.lit(1010.0)
    said = M.ratio_decisions(p)
    return rounded(preds(spark, sf_dir).filter("detector = 'fine'").select("doc_id", N.clipped_margin(p).alias("margin"), *[c.alias(n) for n, c in said.items()]))


# ---- sources and shards

@query("""
WITH s AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 4 + 1 AS shard FROM documents)
SELECT doc_id AS row_index, shard::INTEGER AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS INTEGER) AS shard_row FROM s
""")
def q_shard_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered inside shards, matched again to their source by id, source and question."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_index"), F.col("doc_id").alias("hc3_row_id"), "source", F.md5("text").alias("question"))
    shards = S.shard(rows, "source", "row_index", 4)
    inside = numbered(shards, ["shard"], [F.col("row_index")], "_place").withColumn("shard_row", (F.col("_place") - 1).cast("int")).drop("row_index", "_place")
    return P.remap_rows(inside, rows).select("row_index", "shard", "shard_row")


@query(f"SELECT min(doc_id) AS doc_id, source, md5({norm_sql('text')}) AS question FROM documents GROUP BY source, md5({norm_sql('text')})")
def q_first_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one source and question the first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(normal("text")).alias("question"))
    return P.first_by_key(rows, ["source", "question"], "doc_id")


@query("""
WITH r AS (SELECT doc_id, source, s AS shard, doc_id * 7 % 1000 AS pos FROM documents, range(1, 4) AS t(s) WHERE (doc_id + s) % 3 <> 0)
SELECT doc_id, source, shard::INTEGER AS shard, pos FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, source ORDER BY shard, pos) = 1
""")
def q_merge_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lie in several shards, the earliest shard's stays."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("shard"), (F.col("doc_id") * 7 % 1000).alias("pos"))
    return P.merge_shards(rows.filter((F.col("doc_id") + F.col("shard")) % 3 != 0), ["doc_id", "source"], "shard", "pos")


GEN_SQL = f"""
{QA_SQL}, a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, {norm_sql('text')} AS t FROM qa WHERE label = 'ai'),
g AS (SELECT *, i * 1000000000 + conv_id AS place, 'v' || conv_id || ' ' || t AS new FROM a WHERE conv_id % 3 = 0 AND t <> ''),
direct AS (SELECT conv_id, string_agg(new, chr(10) ORDER BY place) AS answers, count(*) AS n FROM (SELECT conv_id, new, min(place) AS place FROM g GROUP BY ALL) GROUP BY conv_id),
reuse AS (SELECT t, arg_min(new, {{'i': i, 'c': conv_id}}) AS new FROM g GROUP BY t),
again AS (SELECT conv_id, string_agg(new, chr(10) ORDER BY i) AS answers, count(*) AS n FROM (SELECT conv_id, t, min(i) AS i FROM a WHERE t <> '' AND conv_id NOT IN (SELECT conv_id FROM direct) GROUP BY ALL) JOIN reuse USING (t) GROUP BY conv_id),
orig AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (label = 'ai') AS answers, count(*) FILTER (label = 'ai') AS n FROM qa GROUP BY conv_id)"""


@query(f"""
WITH {GEN_SQL} SELECT conv_id, coalesce(direct.n, again.n, orig.n)::BIGINT AS n, md5(coalesce(direct.answers, again.answers, orig.answers, '')) AS answers
FROM orig LEFT JOIN direct USING (conv_id) LEFT JOIN again USING (conv_id)
""")
def q_long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated answers of every third conversation; others reuse those of equal original texts or keep their own."""
    wide = _wide(spark, sf_dir).select("conv_id", "human", "ai")
    source = wide.select(F.col("conv_id").alias("row_index"), F.col("conv_id").alias("hc3_row_id"), F.lit("s").alias("source"), F.col("conv_id").cast("string").alias("question"), F.col("human").alias("human_answers"), F.col("ai").alias("chatgpt_answers"))
    samples = wide.select("conv_id", F.posexplode("ai").alias("answer_order", "text")).select(F.concat_ws("-", "conv_id", "answer_order").alias("sample_id"), F.col("conv_id").alias("row_index"), "answer_order", normal("text").alias("text"))
    some = samples.filter((F.col("row_index") % 3 == 0) & (F.col("text") != ""))
    frame = some.select(F.col("row_index").alias("position"), F.lit("s").alias("domain"), F.lit("").alias("prompt"), F.concat(F.lit("v"), F.col("row_index"), F.lit(" "), F.col("text")).alias("text"), F.lit("AI").alias("label"), F.concat(F.lit("new-"), "sample_id").alias("sample_id"), F.col("sample_id").alias("parent_sample_id"))
    done = P.to_wide(frame, source, samples)
    return done.select(F.col("row_index").alias("conv_id"), F.size("chatgpt_answers").cast("long").alias("n"), F.md5(F.array_join("chatgpt_answers", "\n")).alias("answers"))


@query(f"WITH {QA_SQL}, n AS (SELECT domain, conv_id, count(*) FILTER (label = 'human') AS h, count(*) FILTER (label = 'ai') AS a FROM qa GROUP BY ALL) SELECT domain, count(*) AS \"rows\", sum(h)::BIGINT AS human_answers, sum(a)::BIGINT AS ai_answers FROM n GROUP BY ROLLUP (domain)")
def q_source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: rows and answers of each domain, and of all."""
    return P.source_summary(_wide(spark, sf_dir), "domain", "human", "ai")


@query(f"WITH {QA_SQL} SELECT label, round(avg(len(string_split(text, ' '))), 6) AS words FROM qa GROUP BY label")
def q_side_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average number of words of either side."""
    return rounded(qa(spark, sf_dir).groupBy("label").agg(F.avg(F.size(T.words(F.col("text")))).alias("words")), 6)


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY doc_id) <= count(*) OVER () // 64 * 64")
def q_full_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that fill whole batches of 64; leaving the rest is the feature."""
    return P.full_batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64)


@query("SELECT md5(text) AS text, min(doc_id) AS doc_id FROM documents GROUP BY md5(text)")
def q_distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: distinct texts with their first place."""
    return P.distinct_in_order(table(spark, sf_dir, "documents").select(F.md5("text").alias("text"), "doc_id"), "text", "doc_id")


@query("WITH w AS (SELECT DISTINCT unnest(string_split(coalesce(text, ''), ' ')) AS word FROM documents) SELECT md5(word) AS word, row_number() OVER (ORDER BY md5(word)) AS place FROM w")
def q_word_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: the set of all words, numbered in the order of their hash."""
    words = table(spark, sf_dir, "documents").select(F.explode(T.words(F.coalesce("text", F.lit("")))).alias("word")).select(F.md5("word").alias("word")).distinct()
    return numbered(stored(words, "words"), [], [F.col("word")], "place")


# ---- texts

PLAIN = r"[\x{09}-\x{0D}\x{20}]"


@query(f"""
WITH {QA_SQL}, n AS (SELECT domain, list(text ORDER BY turn) AS a, list({norm_sql('text')} ORDER BY turn) AS b FROM qa GROUP BY conv_id, domain),
c AS (SELECT domain, count(*) AS \"rows\", sum(CASE WHEN a <> b THEN 1 ELSE 0 END)::BIGINT AS changed FROM n GROUP BY domain)
SELECT domain, \"rows\", changed, round(100 * changed / \"rows\"::DOUBLE, 1) AS percent FROM c
""")
def q_changed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in which tidying changes some text."""
    rows = qa(spark, sf_dir).groupBy("conv_id", "domain").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    both = rows.select("domain", F.transform("s", lambda x: x["text"]).alias("a"), F.transform("s", lambda x: normal(x["text"])).alias("b"))
    return P.changed_rate(both, ["domain"], "a", "b")


SPAN_SQL = """
w AS (SELECT doc_id, lang, string_split(coalesce(text, ''), ' ') AS w FROM documents),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY md5('3|' || doc_id || '|' || i), i) <= floor(0.3::DOUBLE * len(w) / 4) AS taken FROM (SELECT doc_id, w, unnest(range(len(w) // 4)) AS i FROM w)),
p AS (SELECT doc_id, list(i ORDER BY i) AS p FROM r WHERE taken GROUP BY doc_id),
t AS (SELECT doc_id, lang, w, coalesce(p, []) AS p FROM w LEFT JOIN p USING (doc_id)),
m AS (SELECT *, list_transform(w, lambda x, k: CASE WHEN (k - 1) % 4 IN (1, 2) AND list_contains(p, (k - 1) // 4) THEN CASE WHEN (k - 1) % 4 = 1 THEN '<extra_id_' || (list_position(p, (k - 1) // 4) - 1) || '>' ELSE NULL END ELSE x END) AS l FROM t)"""


@query(f"WITH {SPAN_SQL} SELECT doc_id, len(p)::BIGINT AS masks, md5(array_to_string(list_filter(l, lambda x: x IS NOT NULL), ' ')) AS masked, md5(array_to_string(list_transform(p, lambda i: w[i * 4 + 2] || ' ' || w[i * 4 + 3]), chr(10))) AS old FROM m")
def q_span_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of two words with a buffer of one become numbered masks; the log keeps what was there."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("at", T.span_starts(F.size(T.words(F.col("text"))), 2, 1, 0.3, F.lit("3"), F.col("doc_id")))
    fills = F.transform("at", lambda _, k: F.concat(F.lit("<extra_id_"), k.cast("string"), F.lit(">")))
    d = d.withColumn("masked", T.mask_spans(F.col("text"), F.col("at"), 2)).withColumn("done", T.replace_spans(F.col("text"), F.col("at"), 2, fills))
    same = F.when(F.col("done.text") == F.col("masked"), F.col("masked"))  # two ways to one text
    return d.select("doc_id", F.size("at").cast("long").alias("masks"), F.md5(same).alias("masked"), F.md5(F.array_join(F.transform("done.log", lambda x: x["old"]), "\n")).alias("old"))


@query(f"WITH {SPAN_SQL} SELECT lang, count(*) AS \"rows\", sum(CASE WHEN len(p) > 0 THEN 1 ELSE 0 END)::BIGINT AS answers, sum(len(p))::BIGINT AS attempts, sum(len(list_filter(p, lambda i: w[i * 4 + 2] || ' ' || w[i * 4 + 3] <> 'x')))::BIGINT AS changes FROM m GROUP BY lang")
def q_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, answers that had spans, attempts and changes of a run that puts ``x`` for each span."""
    d = table(spark, sf_dir, "documents").select("lang", F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("at", T.span_starts(F.size(T.words(F.col("text"))), 2, 1, 0.3, F.lit("3"), F.col("doc_id")))
    log = T.replace_spans(F.col("text"), F.col("at"), 2, F.transform("at", lambda _: F.lit("x")))["log"]
    d = d.select("lang", (F.size("at") > 0).cast("long").alias("answered"), F.size("at").alias("attempts"), F.size(F.filter(log, lambda x: x["old"] != x["new"])).alias("changes"))
    return P.run_counters(d, ["lang"], "answered", "attempts", "changes")


@query(r"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x{09}-\x{0D}\x{20}]')) AS n, coalesce(text, '') AS t FROM documents)
SELECT doc_id, n::BIGINT AS tokens, n <= 512 AS short, NOT contains(t, 'nsfw') AND NOT contains(t, 'NSFW') AS allowed FROM n
""")
def q_token_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of at most 512 rough tokens, and those without either mark."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.rough_tokens(text).cast("long").alias("tokens"), T.within_tokens(text).alias("short"), T.not_excluded(text).alias("allowed"))


def _strip_sql(c: str) -> str:
    blank = norm_sql("x").partition("[")[2].partition("]")[0]
    return f"regexp_replace({c}, '^[{blank}]+|[{blank}]+$', '', 'g')"


PROMPT_SQL = f"'Rewrite this.' || chr(10) || chr(10) || 'Domain: ' || domain || chr(10) || 'Question:' || chr(10) || {_strip_sql('prompt')} || chr(10) || chr(10) || 'Answer to rewrite:' || chr(10) || {_strip_sql('text')}"


@query(f"""
WITH {QA_SQL} SELECT conv_id, turn, md5({_strip_sql(PROMPT_SQL)}) AS prompt,
       substr(sha1('rewrite||' || domain || '||' || text), 1, 16) AS cache_id FROM qa WHERE label = 'ai'
""")
def q_rewrite_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewriting prompts and the 16 digits that a cache names them by."""
    rows = qa(spark, sf_dir).filter("label = 'ai'")
    return rows.select("conv_id", "turn", F.md5(T.rewrite_prompt(F.col("text"), "Rewrite this.", F.col("prompt"), F.col("domain"))).alias("prompt"), T.stable_id(F.lit("rewrite"), F.col("domain"), F.col("text"), size=16).alias("cache_id"))


@query(f"WITH {QA_SQL} SELECT conv_id, turn, md5(trim(text, ' ')) AS text, length(prompt)::BIGINT AS input_tokens, length(text)::BIGINT AS output_tokens, CASE WHEN turn % 2 = 0 THEN 0 ELSE length(text) END::BIGINT AS total_tokens FROM qa")
def q_response_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and usage of response objects, made from the turns in both forms."""
    rows = qa(spark, sf_dir)
    part = F.array(F.struct(F.array(F.struct(F.substr("text", F.lit(1), F.lit(5)).alias("text")), F.struct(F.substr("text", F.lit(6)).alias("text"))).alias("content")))
    usage = F.struct(F.length("prompt").alias("input_tokens"), F.length("text").alias("output_tokens"), F.when(F.col("turn") % 2 != 0, F.length("text")).alias("total_tokens"))
    body = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.col("text").alias("output_text"), usage.alias("usage")))).otherwise(F.to_json(F.struct(part.alias("output"), usage.alias("usage"))))
    return rows.select("conv_id", "turn", body.alias("body")).select("conv_id", "turn", F.md5(T.response_text(F.col("body"))).alias("text"), T.response_usage(F.col("body")).alias("u")).select("conv_id", "turn", "text", "u.input_tokens", "u.output_tokens", "u.total_tokens")


LIST_SQL = f"{QA_SQL}, n AS (SELECT conv_id, list(text ORDER BY turn) AS a FROM qa GROUP BY conv_id)"


@query(f"WITH {LIST_SQL} SELECT conv_id, form, len(a)::BIGINT AS items, md5(array_to_string(a, chr(10))) AS texts FROM n, (VALUES ('json'), ('literal')) AS f(form)")
def q_list_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's texts as one cell, in JSON and as a program prints a list, decoded again; quotes and line ends inside included."""
    rows = qa(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("a"))
    quoted = lambda t: F.concat(F.lit("'"), F.replace(F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("'"))
    literal = F.concat(F.lit("["), F.array_join(F.transform("a", quoted), ", "), F.lit("]"))
    cells = rows.select("conv_id", F.explode(F.array(F.struct(F.lit("json").alias("form"), F.to_json("a").alias("cell")), F.struct(F.lit("literal").alias("form"), literal.alias("cell")))).alias("c")).select("conv_id", "c.*")
    decoded = cells.select("conv_id", "form", F.when(F.col("form") == "json", T.decode_list(F.col("cell"), "perturb")).otherwise(T.decode_list(F.col("cell"), "literal")).alias("a"))
    return decoded.select("conv_id", "form", F.size("a").cast("long").alias("items"), F.md5(F.array_join("a", "\n")).alias("texts"))


TOK = r"list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,}'), lambda x: x)"


@query(f"""
WITH t AS (SELECT doc_id, {TOK} AS t FROM documents), b AS (SELECT doc_id, t[i] AS a, t[i + 1] AS b FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM t)),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, b) AS rank FROM b GROUP BY a, b)
SELECT doc_id, count(*) AS tokens, round(avg(rank), 6) AS mean_rank, round(avg(ln(rank)), 6) AS mean_log_rank FROM b JOIN r USING (a, b) GROUP BY doc_id
""")
def q_context_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each token among those that follow the one before it."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{2,})"), F.lit(1))
    return rounded(P.context_ranks(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", tokens), 6)


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y%m%dT%H%M%SZ') AS run FROM events")
def q_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in UTC as texts and run ids."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", T.utc_iso(ts).alias("iso"), T.run_id(ts).alias("run"))


@query("SELECT m AS model, d AS depth, s AS span, CAST(m || '_' || d || '_' || s AS VARCHAR) AS name FROM (VALUES ('small'), ('large')) AS a(m), (VALUES (1), (10), (100)) AS b(d), (VALUES (2), (5)) AS c(s)")
def q_parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: every combination of a sweep's parameters; reads no table."""
    g = P.parameter_grid(spark, model=["small", "large"], depth=[1, 10, 100], span=[2, 5])
    return g.select("model", F.col("depth").cast("int").alias("depth"), F.col("span").cast("int").alias("span"), F.concat_ws("_", "model", "depth", "span").alias("name"))


BLOCK_SQL = """{0}_c AS (SELECT doc_id, term, count(*) AS n FROM {1} GROUP BY ALL), {0}_v AS (SELECT term, count(*) AS df, sum(n) AS total FROM {0}_c GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT {2}),
{0}_w AS (SELECT doc_id, term, (1 + ln(n)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM {0}_c JOIN {0}_v USING (term)), {0} AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM {0}_w)"""


@query(f"""
WITH t AS (SELECT doc_id, {TOKENS.format(FOLD)} AS t FROM documents),
wt AS (SELECT doc_id, unnest(t) AS term FROM t UNION ALL SELECT doc_id, t[i] || ' ' || t[i + 1] FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM t)),
w AS (SELECT doc_id, ' ' || w || ' ' AS w FROM (SELECT doc_id, unnest(string_split({norm_sql(FOLD)}, ' ')) AS w FROM documents) WHERE w <> ''),
ct AS (SELECT doc_id, substr(w, i, n) AS term FROM (SELECT doc_id, w, n, unnest(range(1, length(w) - n + 2)) AS i FROM w, (VALUES (3), (4), (5)) AS v(n) WHERE length(w) > n) UNION ALL SELECT doc_id, w FROM w WHERE length(w) <= 5),
{BLOCK_SQL.format('a', 'wt', 20000)}, {BLOCK_SQL.format('b', 'ct', 15000)}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT doc_id, count(*) AS terms, round(sum(weight * weight), 6) AS squares, arg_max(term, {{'w': round(weight, 9), 't': term}}) AS heaviest FROM u GROUP BY doc_id
""")
def q_stacked_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: word (1, 2) and in-word character (3, 5) blocks over all documents, each scaled to length 1 before they are stacked; one row a document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms = X.stacked_terms(d, "doc_id", "text")
    stacked = X.stacked_lists(terms, X.stacked_vocabulary(terms, "doc_id"), d.count(), "doc_id").filter(F.size("weights") > 0)
    heaviest = F.array_max(F.transform("weights", lambda w: F.struct(F.round(w["weight"], 9).alias("w"), w["term"].alias("t"))))
    blocks = stacked.select("doc_id", F.size("weights").alias("terms"), F.aggregate("weights", F.lit(0.0), lambda a, w: a + w["weight"] * w["weight"]).alias("squares"), heaviest.alias("top"))
    # two rows a document at most
    return rounded(blocks.groupBy("doc_id").agg(F.sum("terms").alias("terms"), F.sum("squares").alias("squares"), F.max("top")["t"].alias("heaviest")), 6)


@query(f"WITH {ROC_SQL} SELECT detector, split, round(max(tpr) FILTER (fpr <= 0.2), 8) AS tpr FROM points GROUP BY ALL")
def q_tpr_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest tpr whose fpr is low enough."""
    return rounded(M.tpr_at(M.roc_points(preds(spark, sf_dir), BY), BY, 0.2))


@query("SELECT d.doc_id, round(((d.doc_id * 104729) % 1009) / 1009.0::DOUBLE, 8) AS score, d.source AS domain, l.quality AS y FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_prediction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents joined one to one with their labels; a document without one keeps a null."""
    scored = table(spark, sf_dir, "documents").select("doc_id", F.round(((F.col("doc_id") * 104729) % 1009) / F.lit(1009.0), 8).alias("score"), F.col("source").alias("domain"))
    return Q.join_one_to_one(scored, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


@query(f"""
WITH {QA_SQL}, s AS (SELECT conv_id || '-' || turn AS id, domain, text FROM qa WHERE label = 'ai'), n AS (SELECT *, 'new ' || text AS new FROM s)
SELECT substr(sha1(id || '||m||2||42||' || new), 1, 20) AS sample_id, id AS parent_sample_id, domain, md5(new) AS text, 'recursive_rewrite_depth_2' AS attack_name, '{{"depth":2,"model":"m","seed":42}}' AS attack_metadata FROM n
""")
def q_variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples joined with their rewrite records; each gives a variant with an id, parent and metadata of its own."""
    samples = qa(spark, sf_dir).filter("label = 'ai'").select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), "domain", "text")
    joined = P.lookup_records(samples, samples.select("sample_id", F.concat(F.lit("new "), "text").alias("new")))
    out = W.variant_rows(joined, "m", 2, 42, F.col("new"))
    return out.select("sample_id", "parent_sample_id", "domain", F.md5("text").alias("text"), "attack_name", "attack_metadata")


@query(r"""
WITH t AS (SELECT doc_id, '[ WP ] ' || coalesce(text, '') || ' [ OT ]' AS t FROM documents)
SELECT doc_id, md5(replace(replace(t, '[ WP ]', ''), '[ OT ]', '')) AS untagged, md5(array_to_string(string_split(t, '. ')[1:2], '. ')) AS two_parts,
       md5(array_to_string(list_transform(string_split(t, ' '), lambda x, k: CASE WHEN k - 1 IN (1, 3, 5) THEN '_' ELSE x END), ' ')) AS replaced FROM t
""")
def q_text_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt tags removed, texts cut at the second mark, words at given places replaced."""
    t = F.concat(F.lit("[ WP ] "), F.coalesce("text", F.lit("")), F.lit(" [ OT ]"))
    places = F.array(*[F.lit(k) for k in (1, 3, 5)])
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.drop_prompt_tags(t)).alias("untagged"), F.md5(T.truncate_at(t, ". ", 2)).alias("two_parts"), F.md5(T.replace_words(t, places, F.lit("_"))).alias("replaced"))


def _est_sql(c: str) -> str:
    return f"CASE WHEN length(trim({c}, ' ')) = 0 THEN 0 ELSE greatest(1, ceil(length(trim({c}, ' ')) / 4.0)) END"


@query(f"""
WITH {QA_SQL}, b AS (SELECT domain, count(*) AS r, sum({_est_sql("'Rewrite ' || prompt || text")}) AS i, sum({_est_sql('text')}) AS o, sum({_est_sql("'Check ' || text")}) AS c FROM qa WHERE label = 'ai' GROUP BY domain)
SELECT domain, d::INTEGER AS depth, (r + CASE WHEN d = 2 THEN r ELSE 0 END)::BIGINT AS requests, (i + CASE WHEN d = 2 THEN c ELSE 0 END)::BIGINT AS input_tokens, (o + CASE WHEN d = 2 THEN r * 64 ELSE 0 END)::BIGINT AS output_tokens,
       (i * d + CASE WHEN d >= 2 THEN c ELSE 0 END)::BIGINT AS cumulative_input_tokens, (o * d + CASE WHEN d >= 2 THEN r * 64 ELSE 0 END)::BIGINT AS cumulative_output_tokens, CASE WHEN d = 2 THEN c + r * 64 ELSE 0 END::BIGINT AS quality_total_tokens
FROM b, range(1, 4) AS t(d)
""")
def q_check_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of three depths with a quality call at the second."""
    rows = qa(spark, sf_dir).filter("label = 'ai'")
    out = W.estimate_with_checks(rows, ["domain"], F.concat(F.lit("Rewrite "), "prompt", "text"), F.col("text"), 3, F.concat(F.lit("Check "), "text"), 2)
    return out.select("domain", "depth", "requests", "input_tokens", "output_tokens", "cumulative_input_tokens", "cumulative_output_tokens", "quality_total_tokens")


@query(f"""
WITH {QA_SQL}, c AS (SELECT domain, (turn % 3 + 1)::INTEGER AS depth, label = 'human' AS q, length(prompt) AS i, length(text) AS o FROM qa),
s AS (SELECT domain, depth, count(*) AS requests, count(*) FILTER (q) AS quality_requests, sum(i + o)::BIGINT AS total_tokens, coalesce(sum(i + o) FILTER (NOT q), 0)::BIGINT AS rewrite_total_tokens FROM c GROUP BY ALL)
SELECT *, sum(total_tokens) OVER w::BIGINT AS cumulative_total_tokens, sum(rewrite_total_tokens) OVER w::BIGINT AS cumulative_rewrite_total_tokens FROM s WINDOW w AS (PARTITION BY domain ORDER BY depth)
""")
def q_check_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage with and without quality calls, and their running sums."""
    rows = qa(spark, sf_dir).select("domain", (F.col("turn") % 3 + 1).cast("int").alias("depth"), (F.col("label") == "human").alias("quality"), F.lit(1).cast("long").alias("requests"), F.length("prompt").cast("long").alias("input_tokens"), F.length("text").cast("long").alias("output_tokens"))
    out = W.usage_with_checks(rows.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")), ["domain"])
    return out.select("domain", "depth", "requests", "quality_requests", "total_tokens", "rewrite_total_tokens", "cumulative_total_tokens", "cumulative_rewrite_total_tokens")
