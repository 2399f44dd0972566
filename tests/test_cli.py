"""The commands end to end on a small table."""

import math

import pytest

from sievewright import cli
from sievewright.sources import io


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    rows = [(i, ["finance", "medicine"][i % 2], f"q{i % 25}", f'["human {i % 30}", "other {i}"]', f'["machine {i}"]') for i in range(60)]
    path = f"{tmp_path_factory.mktemp('cli')}/wide.parquet"
    io.write_table(spark.createDataFrame(rows, "hc3_row_id long, source string, question string, human_answers string, chatgpt_answers string"), path)
    return path


def test_prepare_and_evaluate(spark, wide, tmp_path):
    cli.main(["prepare", wide, f"{tmp_path}/set"])
    df = spark.read.parquet(f"{tmp_path}/set/data")
    assert {r.split for r in df.select("split").distinct().collect()} == {"train", "val", "test"}
    assert df.count() == 30 + 60 + 60 and df.select("sample_id").distinct().count() == df.count()
    assert io.read_manifest(spark, f"{tmp_path}/set/manifest")["config"]["test"] == 0.2
    p = df.selectExpr("sample_id", "'d' as detector_name", "if(label = 'ai', 0.9, 0.1) as prob_ai")
    io.write_table(p, f"{tmp_path}/p.parquet")
    io.write_table(df, f"{tmp_path}/s.parquet")
    cli.main(["evaluate", f"{tmp_path}/p.parquet", f"{tmp_path}/m", "--samples", f"{tmp_path}/s.parquet"])
    rows = spark.read.parquet(f"{tmp_path}/m/metrics_summary.parquet").collect()
    assert len(rows) == 3 and all(r.accuracy == 1 and r.roc_auc == 1 and r["tpr_at_1pct_fpr"] == 1 for r in rows)


def test_sample_shard_estimate(spark, wide, tmp_path):
    cli.main(["sample", wide, f"{tmp_path}/s.parquet", "--fraction", "0.25"])
    assert io.count_rows(spark, f"{tmp_path}/s.parquet") == 15
    cli.main(["shard", wide, f"{tmp_path}/shards", "--shards", "4"])
    assert sorted(r["count"] for r in spark.read.parquet(f"{tmp_path}/shards").groupBy("shard").count().collect()) == [14, 14, 16, 16]
    cli.main(["estimate", wide, f"{tmp_path}/e.parquet", "--depths", "2"])
    (a, b) = io.read_table(spark, f"{tmp_path}/e.parquet").orderBy("depth").collect()
    assert a.requests == 60 and b.total_tokens == 2 * a.total_tokens and a.output_tokens == sum(math.ceil(len(f"machine {i}") / 4) for i in range(60))
    with pytest.raises(ValueError, match="above the budget"):
        cli.main(["estimate", wide, f"{tmp_path}/e2.parquet", "--budget", "0.0000001"])


def test_run_all_detectors(spark, tmp_path):
    rows = [(i, ["finance", "medicine"][i % 2], f"q{i}", f'["people wrote line {i}. It is short, {i * 7 % 13} words"]', f'["the model generated answer {i}. It lists steps {i * 5 % 11}"]') for i in range(50)]
    wide = f"{tmp_path}/wide.parquet"
    io.write_table(spark.createDataFrame(rows, "hc3_row_id long, source string, question string, human_answers string, chatgpt_answers string"), wide)
    cli.main(["run", wide, f"{tmp_path}/run", "--rounds", "2", "--val", "0.2", "--detector", "trees", "--detector", "perplexity"])
    p = io.read_table(spark, f"{tmp_path}/run/predictions.parquet")
    assert {r.detector_name: r["count"] for r in p.groupBy("detector_name").count().collect()} == {"boosted_trees": 100, "perplexity_logistic": 100}
    threshold = io.read_manifest(spark, f"{tmp_path}/run/models/perplexity/threshold")["threshold"]
    assert {r.decision_threshold for r in p.filter("detector_name = 'perplexity_logistic'").select("decision_threshold").distinct().collect()} == {threshold}
    m = {(r.detector_name, r.split): r for r in io.read_table(spark, f"{tmp_path}/run/metrics/metrics_summary.parquet").collect()}
    assert m["boosted_trees", "test"].accuracy == 1 and m["perplexity_logistic", "val"].threshold == pytest.approx(threshold)
    with pytest.raises(FileNotFoundError):
        cli.main(["score", f"{tmp_path}/run/samples.parquet", f"{tmp_path}/x.parquet", "--model", f"{tmp_path}/nothing"])
