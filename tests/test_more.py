"""Operators without a registered query, and their defined errors."""

import json

import pytest
from pyspark.sql import functions as F

from sievewright import cli
from sievewright.functions import fresh
from sievewright.functions import text as T
from sievewright.operators import exports as E
from sievewright.operators import metrics as M
from sievewright.operators import models
from sievewright.operators import remap as P
from sievewright.operators import rewrite as W
from sievewright.operators.ranges import numbered, running
from sievewright.sources import io


def texts(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string")


def test_folders(spark, tmp_path):
    root = f"{tmp_path}/work"
    io.ensure_folder(spark, root)
    for name in ("a", "b", ".keep"):
        io.ensure_folder(spark, f"{root}/{name}")
    assert io.reset_folder(spark, root, [".keep"]) == ["a", "b"]
    assert not io.exists(spark, f"{root}/a") and io.exists(spark, f"{root}/.keep")
    spark.range(2).write.parquet(f"{root}/found")
    assert io.copy_first(spark, [f"{root}/none", f"{root}/found"], f"{root}/copy") == f"{root}/copy"
    assert spark.read.parquet(f"{root}/copy").count() == 2
    with pytest.raises(FileNotFoundError):
        io.copy_first(spark, [f"{root}/none"], f"{root}/other")


def test_json_lines(spark, tmp_path):
    path = f"{tmp_path}/rows.jsonl"
    io.append_jsonl(spark.sql("SELECT 1 AS a").coalesce(1), path)
    io.append_jsonl(spark.sql("SELECT 2 AS a").coalesce(1), path)
    assert sorted(r.a for r in io.read_jsonl(spark, path, check=True).collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": \n[1]\n')
    assert [(r.line, r.text) for r in io.broken_lines(spark, f"{tmp_path}/bad.jsonl").orderBy("line").collect()] == [(3, '{"a": '), (4, "[1]")]
    with pytest.raises(ValueError, match=r"bad.jsonl:3: no JSON object"):
        io.read_jsonl(spark, f"{tmp_path}/bad.jsonl", check=True)


def test_settings_and_defaults(spark, tmp_path):
    (tmp_path / ".settings").write_text("# note\nA=1\nB = 'two words'\nnothing\n#C=3\n")
    assert io.read_environment(spark, f"{tmp_path}/.settings") == {"A": "1", "B": "two words"}
    assert io.read_environment(spark, f"{tmp_path}/none") == {}
    (tmp_path / "prefix.txt").write_text(" Rewrite\nthis. \n")
    assert io.read_prefix(spark, f"{tmp_path}/prefix.txt", "x") == "Rewrite\nthis." and io.read_prefix(spark, None, "x") == "x"
    df = spark.createDataFrame([(1, " "), (2, "law"), (3, None)], "id long, domain string")
    assert [r.domain for r in io.with_default_domain(df, "finance").orderBy("id").collect()] == ["finance", "law", "finance"]
    assert {r.domain for r in io.with_default_domain(df.drop("domain"), "all").collect()} == {"all"}


def test_by_source_and_curve(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, source string")
    assert io.write_by_source(df, f"{tmp_path}/s") == {"a": 2, "b": 1}
    assert io.count_rows(spark, f"{tmp_path}/s/unified_3.parquet") == 3 and spark.read.parquet(f"{tmp_path}/s/by_source/source=a").count() == 2
    curve = spark.createDataFrame([(0.0, 0.0, float("inf")), (1.0, 1.0, 0.25)], "fpr double, tpr double, threshold double")
    for tab in (False, True):
        io.write_curve(curve, f"{tmp_path}/curve{tab}", tab)
        assert io.read_curve(spark, f"{tmp_path}/curve{tab}", tab).orderBy("fpr").collect() == curve.orderBy("fpr").collect()


def test_literal_lists(spark):
    rows = ["['it\\'s', \"say \\\"x\\\"\", 'a\\nb', '\\u00e9', None, 3]", '["x, y", \'z\']', "[]", "[ ]", "no list", "['open'", "[hello world]", '["j\\"q"]', "['a' 'b' 'c']"]
    got = {r.id: r.a for r in texts(spark, rows).select("id", T.literal_list(F.col("text")).alias("a")).collect()}
    assert got == {0: ["it's", 'say "x"', "a\nb", "é", None, "3"], 1: ["x, y", "z"], 2: [], 3: [], 4: None, 5: None, 6: None, 7: ['j"q'], 8: None}
    long = "[" + ", ".join(["'a\\'b'"] * 30_000) + "]"
    assert texts(spark, [long]).select(F.size(T.literal_list(F.col("text"))).alias("n")).first().n == 30_000
    answers = texts(spark, [" ", "nan", "['a ', '']", None]).select(T.decode_list(F.col("text"), "answers").alias("a")).collect()
    assert [r.a for r in answers] == [[], ["nan"], ["a"], []]


def test_prompts(spark):
    df = texts(spark, [" answer ", None])
    a, b = (r.p for r in df.select(T.rewrite_prompt(F.col("text"), "Do it. ", F.lit(" q "), F.lit("")).alias("p")).collect())
    assert a == "Do it.\n\nDomain: unknown\nQuestion:\nq\n\nAnswer to rewrite:\nanswer" and b.endswith("Answer to rewrite:")
    q = df.select(T.quality_prompt(F.col("text"), "It reads well.").alias("p")).first().p
    assert '"It reads well."' in q and "5 = Strongly Agree" in q and q.endswith("Document:\nanswer")


def test_spans_edge_cases(spark):
    df = texts(spark, ["", "one", "a b c", "a b c d", " ".join("abcdefghijklmnop")])
    rows = df.select("id", T.span_starts(F.size(T.words(F.col("text"))), 2, 1, 1.0, F.col("id")).alias("at"), "text")
    got = {r.id: (r.at, r.m) for r in rows.select("id", "at", T.mask_spans(F.col("text"), F.col("at"), 2).alias("m")).collect()}
    assert got == {0: ([], ""), 1: ([], "one"), 2: ([], "a b c"), 3: ([1], "a <extra_id_0> d"), 4: ([1, 5, 9, 13], "a <extra_id_0> d e <extra_id_1> h i <extra_id_2> l m <extra_id_3> p")}
    done = rows.filter("id = 4").select(T.replace_spans(F.col("text"), F.col("at"), 2, F.array(F.lit("X Y Z"), F.lit(None))).alias("d")).first().d
    assert done.text == "a X Y Z d e f g h i j k l m n o p" and [(x.start, x.old, x.new) for x in done.log][:2] == [(1, "b c", "X Y Z"), (5, "f g", "f g")]


def test_shared_payloads_on_disk(spark, tmp_path):
    rows = spark.createDataFrame([("d.1", "gptzero_like", "test", 5, 1, 2, 7, 0.9, 15), ("d.1", "svm_tfidf", "test", 5, 1, 2, 7, None, 15), ("d.1", "svm_tfidf", "val", 5, 1, 2, 7, 0.5, 15)], "dataset_name string, detector_name string, split string, tn long, fp long, fn long, tp long, roc_auc double, num_samples long")
    curve = spark.createDataFrame([("svm_tfidf", "test", "0.0", "0.5", "1.5"), ("svm_tfidf", "test", "0.005", "0.5", "1.0"), ("svm_tfidf", "test", "0.5", "0.9", "x"), ("svm_tfidf", "test", "bad", "1.0", "0")], "detector_name string, split string, fpr string, tpr string, threshold string")
    first = E.share_payloads(rows, curve, language_model="lm")
    E.write_shared(first, f"{tmp_path}/a")
    got = {r.detector_name: json.loads(r.payload) for r in E.read_shared(spark, f"{tmp_path}/a").collect()}
    assert set(got) == {"gptzero_like", "svm_tfidf"} and got["gptzero_like"]["additional_details"]["additional_models_used"] == ["lm"]
    assert got["gptzero_like"]["metrics_at_1pct_fpr"] == {"f1": 0, "accuracy": 0, "precision": 0, "recall": 0, "tpr": 0, "auc_roc": 0.9}
    svm = got["svm_tfidf"]
    assert svm["model_used"] == "linear_svm_tfidf" and svm["metrics_at_1pct_fpr"]["recall"] == 0.5 and svm["presentation_metrics"] == {"tpr_at_0_1pct_fpr": 0.5, "fpr_at_80pct_tpr": 0.5, "roc_auc": 0}
    assert svm["metrics_at_1pct_fpr"]["precision"] == pytest.approx(4.5 / (4.5 + 0.03))
    E.rewrite_shared(rows.withColumn("roc_auc", F.lit(0.7)), curve, f"{tmp_path}/a", f"{tmp_path}/b")
    new = {r.detector_name: json.loads(r.payload) for r in E.read_shared(spark, f"{tmp_path}/b").collect()}
    assert new["gptzero_like"]["additional_details"]["additional_models_used"] == ["lm"] and new["svm_tfidf"]["metrics_at_1pct_fpr"]["auc_roc"] == 0.7
    with pytest.raises(ValueError, match="in place"):
        E.rewrite_shared(rows, curve, f"{tmp_path}/a", f"{tmp_path}/a/")
    assert E.load_metrics(rows.select("split", "detector_name"), rows.select("split", "detector_name", "tp")).count() == 6


def test_first_metric_and_results(spark, tmp_path):
    blocks = ['{"recall": 0.5, "tpr": null}', '{"tpr": 0, "recall": 0.7}', '{"tpr_at_0_1pct_fpr": "0.25"}', '{"tpr": "x"}', "[1]", None]
    got = texts(spark, blocks).select("id", E.first_metric(F.col("text"), "tpr").alias("v")).orderBy("id").collect()
    assert [r.v for r in got] == [0.5, 0.0, 0.25, None, None, None]
    for run in ("r1", "r2"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "results.json").write_text(json.dumps({"name": run}))
    (tmp_path / "r1" / "args.json").write_text('{"seed": 3}')
    rows = {json.loads(r.result)["name"]: r.args for r in E.read_results(spark, f"{tmp_path}/*/results.json", f"{tmp_path}/*/args.json").collect()}
    assert rows == {"r1": '{"seed": 3}', "r2": None}


def test_remap_errors_and_fallback(spark):
    source = spark.createDataFrame([(0, 7, "s", "q", ["h"], ["old one", "old two", " old  two "]), (1, 8, "s", "q2", [], [])], "row_index long, hc3_row_id long, source string, question string, human_answers array<string>, chatgpt_answers array<string>")
    samples = spark.createDataFrame([("x", 0, 0, "old one"), ("y", 0, 1, "old two")], "sample_id string, row_index long, answer_order int, text string")
    columns = "position long, domain string, prompt string, text string, label string, sample_id string, parent_sample_id string"
    frame = spark.createDataFrame([(0, "s", "q", " B ", "ai", "n1", "y"), (1, "s", "q", "A", "ai", "n2", "x"), (2, "s", "q", "b ", "ai", "n3", "y"), (3, "s", " q2 ", "C", "AI", "n4", None), (4, "s", "q", "h", "human", "x", None)], columns)
    got = {r.row_index: r.chatgpt_answers for r in P.to_wide(frame, source, samples).collect()}
    assert got == {0: ["A", "B", "b"], 1: ["C"]}
    assert {r.row_index: r.chatgpt_answers for r in P.to_wide(frame.limit(0), source, samples).collect()}[0] == ["old one", "old two", " old  two "]
    with pytest.raises(ValueError, match="match no source row: z / s / nowhere"):
        P.to_wide(spark.createDataFrame([(0, "s", "nowhere", "t", "ai", "z", None)], columns), source, samples).collect()
    with pytest.raises(Exception, match="no record for b"):
        P.lookup_records(spark.createDataFrame([("a",), ("b",)], "sample_id string"), spark.createDataFrame([("a", 1)], "sample_id string, v int")).collect()


def test_selection_summary(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, source string")
    s = P.selection_summary(df, "source", 42, fraction=0.25, before=12, shards=4, shard=2)
    assert s["selection_mode"] == "balanced_source_fraction" and s["tag"] == "frac0p25" and s["shard_tag"] == "shard_02_of_04" and s["sampled_source_rows_by_domain"] == {"a": 2, "b": 1} and s["pre_shard_source_rows"] == 12
    assert P.selection_summary(df, "source", 1)["selection_mode"] == "full_source" and P.sample_tag(5) == "rows5"


def test_running_numbers_over_many_ranges(spark):
    rows = [(g, i * 7 % 500, float(i)) for g in ("a", "b", None) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, v double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(df, ["g"], [F.desc("k")], {"total": F.col("v"), "n": F.lit(1)}, {"next": F.col("k")}).collect()
        flat = numbered(df, [], [F.col("k"), F.col("g").asc_nulls_last()], "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("a", "b", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: -r.k)
        total = 0.0
        for place, r in enumerate(own):
            total += r.v
            assert (r.n, r.total, r.next) == (place + 1, total, own[place + 1].k if place < 499 else None)
    assert [r.n for r in sorted(flat, key=lambda r: (r.k, r.g is None, r.g or ""))] == list(range(1, 1501))


def test_models_are_saved_and_features_cached(spark, tmp_path):
    rows = [(i, f"good fine text number {i % 7}" if i % 2 else f"bad poor words number {i % 5}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, y int")
    model, curve = models.fit_svm(df, df)
    models.save_model(model, f"{tmp_path}/m")
    before = models.predict_svm(df, model, curve, "id").orderBy("id").collect()
    assert models.predict_svm(df, models.load_model(f"{tmp_path}/m"), curve, "id").orderBy("id").collect() == before
    assert sum((r.pred_label == "ai") == (r.id % 2 == 1) for r in before) == 60
    df.write.parquet(f"{tmp_path}/in")
    calls = []

    def make(d):
        calls.append(1)
        return d.select("id", F.length("text").alias("n"))

    for config in ({"k": 1}, {"k": 1}, {"k": 2}):
        assert models.cached_features(spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/cache", config, make).count() == 60
    assert len(calls) == 2
    # a changed filter, and a file that was overwritten in its place, are other inputs
    again = lambda d: models.cached_features(d, f"{tmp_path}/cache", {"k": 1}, make)
    assert again(spark.read.parquet(f"{tmp_path}/in").filter("id < 10")).count() == 10 and again(spark.read.parquet(f"{tmp_path}/in").filter("id < 20")).count() == 20
    assert len(calls) == 4
    name = next(p for p in (tmp_path / "in").iterdir() if p.name.startswith("part-"))
    df.filter("id < 5").coalesce(1).write.parquet(f"{tmp_path}/new")
    name.write_bytes(next(p for p in (tmp_path / "new").iterdir() if p.name.startswith("part-")).read_bytes())
    (name.parent / f".{name.name}.crc").unlink()
    assert again(spark.read.parquet(f"{tmp_path}/in")).count() != 60 and len(calls) == 5
    assert again(df).count() == 60 and again(df).count() == 60 and len(calls) == 7  # rows that no file holds are not cached
    assert not [p for p in (tmp_path / "cache").iterdir() if p.name.startswith("_writing")]


def test_threshold_is_chosen_on_other_rows(spark):
    rows = [(i, float(i % 10), 1.0 + i % 10, 0.1, 0.1 * (i % 3), int(i % 10 > 6)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, doc_perplexity double, sentence_perplexity_mean double, sentence_perplexity_std double, burstiness double, y int")
    model = models.fit_logistic(df.filter("id < 100"))
    threshold = models.choose_threshold(df.filter("id >= 100"), model)
    p = {r.id: r.prob_ai for r in models.predict_logistic(df, model, "id").collect()}
    held = [(p[r[0]], r[5]) for r in rows if r[0] >= 100]

    def judged(t):
        tp, fp, fn = (sum((v >= t) == a and y == b for v, y in held) for a, b in ((True, 1), (True, 0), (False, 1)))
        tn = len(held) - tp - fp - fn
        return (2 * tp / (2 * tp + fp + fn), (tp + tn) / len(held), tp / (tp + fp) if tp + fp else 0, tp / (tp + fn))

    best = max(sorted({0.5, *(v for v, _ in held)}), key=judged)
    assert threshold == pytest.approx(best)
    done = models.predict_logistic(df, model, "id", threshold).collect()
    assert all((r.pred_label == "ai") == (r.prob_ai >= threshold) and r.decision_threshold == threshold and r.burstiness is not None for r in done)
    assert models.choose_threshold(df.filter("y = 1"), model) == 0.5 == models.choose_threshold(df.filter("id < 0"), model)


def test_spans_and_prose_in_linear_time(spark):
    import time

    from sievewright.functions import text as T

    def took(make, n):
        df = spark.createDataFrame([(make(n),)], "text string")
        at = T.span_starts(F.size(T.words(F.col("text"))), 2, 1, 0.3, F.lit("1"))
        done = df.select(F.md5(T.replace_spans(F.col("text"), at, 2, F.transform(at, lambda _: F.lit("x")))["text"]), F.md5(T.mask_spans(F.col("text"), at, 2)), F.md5(T.markdown_to_prose(F.col("text"))))
        done.collect()
        start = time.time()
        done.collect()
        return time.time() - start

    for make in (lambda n: "word " * n, lambda n: "- item\n# Header\n" * (n // 4)):
        assert took(make, 64_000) < 2.3 * took(make, 32_000) + 0.5


def test_medians(spark):
    import statistics

    from sievewright.operators import metrics as M

    rows = [(i % 3 if i % 7 else None, float(i * 37 % 50)) for i in range(301)] + [(9, None), (8, 2.0), (8, None), (7, 1.0), (7, 4.0)]
    got = {r.g: r.median for r in M.medians(spark.createDataFrame(rows, "g int, v double"), ["g"], "v").collect()}
    want = {}
    for g, v in rows:
        want.setdefault(g, []).extend([] if v is None else [v])
    assert got == {g: statistics.median(v) if v else None for g, v in want.items()}
    frame = spark.createDataFrame([("a", 1, 0.9, 0.2), ("a", 0, 0.1, 0.4), ("b", 1, 0.7, float("nan"))], "d string, y int, score double, decision_threshold double")
    assert {r.d: r.threshold for r in M.median_threshold(frame, ["d"]).collect()} == pytest.approx({"a": 0.3, "b": 0.5})


def test_generators_and_fillers(spark):
    df = texts(spark, ["a b c d e", None]).withColumn("masked", F.when(F.col("id") == 0, "a <extra_id_0> c <extra_id_1> e"))

    def generator():
        calls = iter(range(100))
        return lambda prompts: [p + " x" * (1 if next(calls) < 2 else 60) for p in prompts]

    rows = models.generate(df, "text", generator, prompt_words=2, least_words=55, batch=1).orderBy("id").collect()
    assert rows[0].sampled == "a b" + " x" * 60 and len(rows[1].sampled.split(" ")) >= 55

    def filler():
        tries = iter(range(100))
        return lambda patterns: ["<pad><extra_id_0> B <extra_id_1> D <extra_id_2></s>" if next(tries) else "<extra_id_0> B" for _ in patterns]

    assert models.fill_masks(df.filter("id = 0"), "text", "masked", filler).first().perturbed == "a B c D e"
    assert models.fill_masks(df.filter("id = 0"), "text", "masked", lambda: lambda p: ["nothing"] * len(p), tries=3).first().perturbed == "a b c d e"


def test_targets_names_and_prices():
    assert M.require_targets([0.01, 0.001, 0.01]) == [0.01, 0.001]
    with pytest.raises(ValueError, match="between 0 and 1"):
        M.require_targets([0.0, 1.0])
    assert fresh(["A", "a_"], "a") == "a__" and fresh([], "a") == "a"
    with pytest.raises(ValueError, match="no price"):
        W.with_cost(None, "unknown")


def test_commands(spark, tmp_path):
    rows = [(i, ["finance", "medicine"][i % 2], f"question {i}", f'["human words {i} here", "plain talk {i}"]', f'["machine output {i} there", "robot text {i}"]') for i in range(60)]
    wide = spark.createDataFrame(rows, "hc3_row_id long, source string, question string, human_answers string, chatgpt_answers string")
    io.write_table(wide, f"{tmp_path}/wide.parquet")
    cli.main(["test-set", f"{tmp_path}/wide.parquet", f"{tmp_path}/sets"])
    assert io.read_manifest(spark, f"{tmp_path}/sets/manifest") == {"num_samples": {"wide": 240}}
    assert {r.split for r in spark.read.parquet(f"{tmp_path}/sets/wide/test.parquet").select("split").distinct().collect()} == {"test"}
    for k in (1, 2):
        io.write_table(wide.filter(f"hc3_row_id % 2 = {k - 1} or hc3_row_id < 10"), f"{tmp_path}/shards/shard_{k}_of_2/rows.parquet")
    cli.main(["merge", f"{tmp_path}/shards/*/rows.parquet", f"{tmp_path}/merged.parquet"])
    assert sorted(r.hc3_row_id for r in io.read_table(spark, f"{tmp_path}/merged.parquet").collect()) == list(range(60))
    cli.main(["prepare", f"{tmp_path}/wide.parquet", f"{tmp_path}/set"])
    io.write_table(spark.read.parquet(f"{tmp_path}/set/data"), f"{tmp_path}/samples.parquet")
    cli.main(["train", f"{tmp_path}/samples.parquet", f"{tmp_path}/model"])
    cli.main(["score", f"{tmp_path}/samples.parquet", f"{tmp_path}/scores.parquet", "--model", f"{tmp_path}/model"])
    assert io.count_rows(spark, f"{tmp_path}/scores.parquet") == 240
    cli.main(["evaluate", f"{tmp_path}/scores.parquet", f"{tmp_path}/metrics", "--samples", f"{tmp_path}/samples.parquet"])
    cli.main(["export", f"{tmp_path}/metrics", f"{tmp_path}/shared", "--dataset", "wide"])
    (r,) = E.read_shared(spark, f"{tmp_path}/shared").collect()
    assert json.loads(r.payload)["experiment_name"] == "wide_svm_tfidf" and json.loads(r.payload)["presentation_metrics"]["roc_auc"] > 0.9


def test_accents_of_every_script(spark):
    import unicodedata

    from sievewright.operators import features as X

    said = ["Éå Ñ ÿ", "ἀρχή ΐ", "Ở ệ đ", "ﾊﾟ Ａ　ｂ", "e\u0301a\u0327", "й ё", "İ", "\u00a0x"]
    rows = texts(spark, said).select("text", X.fold(F.col("text")).alias("f")).collect()
    for r in rows:
        assert r.f == "".join(c for c in unicodedata.normalize("NFKD", r.text.lower()) if not unicodedata.combining(c)), r.text
