"""Command line: ``python -m sievewright.cli COMMAND --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import prepare as P


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sievewright")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, **options) -> argparse.ArgumentParser:
        p = sub.add_parser(name, **options)
        p.add_argument("source")
        p.add_argument("out")
        p.add_argument("--seed", type=int, default=42)
        return p

    p = command("prepare", help="split and check wide question rows")
    p.add_argument("--test", type=float, default=0.2)
    p.add_argument("--val", type=float, default=0.1)
    p.add_argument("--most-per-label", type=int)
    command("sample", help="a proportional sample of wide rows").add_argument("--fraction", type=float, required=True)
    command("shard", help="deal wide rows to shards").add_argument("--shards", type=int, required=True)
    p = command("estimate", help="tokens and cost of rewriting")
    p.add_argument("--model", default="gpt-5.4-mini")
    p.add_argument("--depths", type=int, default=1)
    p.add_argument("--budget", type=float)
    p = command("evaluate", help="metrics of predictions")
    p.add_argument("--samples", required=True)
    p.add_argument("--target-fpr", type=float, action="append")
    command("merge", help="wide rows of all shard folders that match, once each")
    command("test-set", help="every table that matches as a test set").add_argument("--more", action="append", default=[])
    p = command("export", help="shared JSON of an evaluation")
    p.add_argument("--dataset", required=True)
    p.add_argument("--before")
    p = command("train", help="fit and save detectors")
    p.add_argument("--detector", action="append", choices=P.DETECTORS)
    p.add_argument("--rounds", type=int, default=120)
    p = command("run", help="prepare, train, score and evaluate")
    p.add_argument("--test", type=float, default=0.2)
    p.add_argument("--val", type=float, default=0.1)
    p.add_argument("--detector", action="append", choices=P.DETECTORS)
    p.add_argument("--rounds", type=int, default=120)
    p.add_argument("--target-fpr", type=float, action="append")
    command("score", help="score samples by all detectors that are saved").add_argument("--model", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sievewright").getOrCreate()
    if a.command == "prepare":
        P.prepare_command(spark, a.source, a.out, P.PrepareConfig(test=a.test, val=a.val, seed=a.seed, most_per_label=a.most_per_label))
    elif a.command == "sample":
        P.sample_command(spark, a.source, a.out, a.fraction, a.seed)
    elif a.command == "shard":
        P.shard_command(spark, a.source, a.out, a.shards)
    elif a.command == "estimate":
        P.estimate_command(spark, a.source, a.out, a.model, a.depths, a.budget)
    elif a.command == "merge":
        P.merge_command(spark, a.source, a.out)
    elif a.command == "test-set":
        P.test_set_command(spark, [a.source, *a.more], a.out)
    elif a.command == "export":
        P.export_command(spark, a.source, a.dataset, a.out, a.before)
    elif a.command == "train":
        P.train_command(spark, a.source, a.out, tuple(a.detector or ["svm"]), a.rounds)
    elif a.command == "run":
        P.run_command(spark, a.source, a.out, P.PrepareConfig(test=a.test, val=a.val, seed=a.seed), tuple(a.detector or P.DETECTORS), a.rounds, tuple(a.target_fpr or [0.01, 0.001]))
    elif a.command == "score":
        P.score_command(spark, a.model, a.source, a.out)
    else:
        P.evaluate_command(spark, a.source, a.samples, a.out, a.target_fpr or [0.01, 0.001])


if __name__ == "__main__":
    main()
