"""Detectors of stacked TF-IDF weights and of perplexity features, and the scorer protocol."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import clipped_logit, clipped_margin
from ..session import discard, stored
from ..sources.io import exists, read_manifest, write_manifest
from .features import STACKED, stacked_rows, stacked_terms, stacked_tfidf, stacked_vocabulary
from .linear import Linear, fit_squared_hinge, linear_margin
from .metrics import best_f1_threshold
from .trees import Forest, TreeConfig, fit_lists, forest_margin


def balanced(df: DataFrame, y: str = "y") -> DataFrame:
    """Adds ``weight``: all rows by classes times own rows."""
    sizes = df.groupBy(y).agg(F.count(F.lit(1)).alias("_own"))
    total = sizes.agg(F.sum("_own").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(sizes.join(F.broadcast(total))), y).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_own"))).drop("_own", "_all", "_k")


@dataclass
class TextModel:
    """A fitted model of stacked TF-IDF weights, and what the weights were fitted to: the vocabulary and the number of documents."""

    vocabulary: DataFrame
    documents: int
    fitted: Forest | Linear

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``margin``."""
        rows = with_weights(df, self.vocabulary, self.documents)
        if isinstance(self.fitted, Forest):
            return forest_margin(rows, self.fitted, F.col("places"), F.col("weights")).drop("places", "weights")
        return linear_margin(rows, self.fitted).drop("places", "weights")

    def save(self, path: str) -> None:
        spark = self.vocabulary.sparkSession
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        write_manifest(spark, {"documents": self.documents}, f"{path}/features")
        if isinstance(self.fitted, Forest):
            write_manifest(spark, {"forest": self.fitted.to_dict()}, f"{path}/model")
        else:
            write_manifest(spark, {"linear": {"weights": self.fitted.weights.tolist(), "constant": self.fitted.constant}}, f"{path}/model")

    @classmethod
    def load(cls, path: str) -> TextModel:
        spark = SparkSession.getActiveSession()
        model = read_manifest(spark, f"{path}/model")
        fitted = Forest.from_dict(model["forest"]) if "forest" in model else Linear(np.array(model["linear"]["weights"]), model["linear"]["constant"])
        return cls(spark.read.parquet(f"{path}/vocabulary"), fitted=fitted, **read_manifest(spark, f"{path}/features"))


def text_weights(df: DataFrame, key: str, vocab: DataFrame | None = None, documents: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """``key, place, weight`` of the stacked TF-IDF blocks of ``text``, the vocabulary and the number of documents; both are fitted to ``df`` where they are not given."""
    lists = stacked_terms(df.select(key, "text"), key, "text")
    if vocab is None:
        vocab, documents = stacked_vocabulary(lists, key), df.count()
    return stacked_tfidf(lists, vocab, documents, key).select(key, "place", "weight"), vocab, documents


def with_weights(df: DataFrame, vocab: DataFrame, documents: int) -> DataFrame:
    """``df`` with ``places``, ascending, and their ``weights``; a text without known terms has empty ones."""
    return stacked_rows(stored(df, "rows"), "text", vocab, documents)


def fit_svm(df: DataFrame, calibration: DataFrame, y: str = "y") -> tuple[TextModel, PipelineModel]:
    """A balanced linear SVM (squared hinge) on stacked TF-IDF weights, and a logistic curve fitted to its margins on other rows."""
    rows = stored(df.select("text", F.col(y).alias("y")), "rows")
    terms = stacked_terms(rows.withColumn("id", F.monotonically_increasing_id()).select("id", "text"), "id", "text")
    vocab, documents = stacked_vocabulary(terms, "id"), rows.count()
    training = with_weights(balanced(rows, "y"), vocab, documents)
    model = TextModel(vocab, documents, fit_squared_hinge(training.select("y", "weight", "places", "weights"), STACKED))
    margins = stored(model.transform(calibration.select("text", y)).select("margin", y), "margins")
    curve = Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="m"), LogisticRegression(featuresCol="m", labelCol=y, rawPredictionCol="r", probabilityCol="p", predictionCol="d")]).fit(margins)
    return model, curve


def predict_svm(df: DataFrame, model: TextModel, curve: PipelineModel, key: str) -> DataFrame:
    done = curve.transform(model.transform(df))
    return predictions(done.withColumn("prob_ai", vector_to_array("p")[1]), key, "svm_tfidf", "margin")


def fit_trees(df: DataFrame, y: str = "y", config: TreeConfig = TreeConfig()) -> TextModel:
    """Boosted trees on all places of the stacked TF-IDF weights; rows marked ``validation``, where there are any, tell when to stop, and are not learned from.

    The vocabulary is that of the training rows.
    """
    marked = F.coalesce("validation", F.lit(False)) if "validation" in df.columns else F.lit(False)
    rows = stored(df.select(F.monotonically_increasing_id().alias("id"), "text", F.col(y).alias("y"), marked.alias("validation")), "rows")
    training = rows.filter("not validation")
    vocab, documents = stacked_vocabulary(stacked_terms(training.select("id", "text"), "id", "text"), "id"), training.count()
    lists = stored(stacked_rows(rows, "text", vocab, documents).select("id", "y", "validation", "places", "weights"), "lists")
    forest = fit_lists(lists, STACKED, config)
    discard(rows, lists)
    return TextModel(vocab, documents, forest)


def predict_trees(df: DataFrame, model: TextModel, key: str) -> DataFrame:
    done = model.transform(df).withColumn("prob_ai", 1 / (1 + F.exp(-F.col("margin"))))
    return predictions(done, key, "boosted_trees", logit=clipped_margin)


def save_model(model: PipelineModel | TextModel, path: str) -> None:
    """The fitted stages with their parameters, of text models the vocabulary too, replacing what is there."""
    if isinstance(model, TextModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | TextModel:
    return TextModel.load(path) if exists(SparkSession.getActiveSession(), f"{path}/vocabulary") else PipelineModel.load(path)


#: Plan leaves whose content the names, sizes and times of their files tell.
FILE_LEAVES = ("LogicalRelation", "DataSourceV2Relation", "DataSourceV2ScanRelation")


def fingerprint(df: DataFrame, config: dict) -> str | None:
    """A digest of ``config``, of the plan with its literals, and of the state (path, size, time of change) of every file that it reads; null if it reads anything but files."""
    import hashlib
    import json

    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    if any(leaves.apply(i).getClass().getSimpleName() not in FILE_LEAVES for i in range(leaves.size())):
        return None
    wide, before = "spark.sql.debug.maxToStringFields", spark.conf.get("spark.sql.debug.maxToStringFields", None)
    spark.conf.set(wide, str(2**31 - 1))
    try:
        text = plan.canonicalized().toString()
    finally:
        spark.conf.set(wide, before) if before else spark.conf.unset(wide)
    names = df.inputFiles()
    states: list = []
    if names:
        files = spark.read.format("binaryFile").load(names).select("path", "length", "modificationTime")
        row = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), *[F.bit_xor(F.xxhash64(F.lit(k), "path", "length", "modificationTime")).alias(f"h{k}") for k in (0, 1)]).head()
        states = [row.n, row.bytes, row.h0, row.h1]
    state = json.dumps({"config": config, "files": states, "plan": text, "schema": df.schema.simpleString()}, sort_keys=True, default=str)
    return hashlib.sha256(state.encode()).hexdigest()[:32]


def cached_features(df: DataFrame, folder: str, config: dict, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make(df)``, written once under the fingerprint of ``config``, the plan and its files, and read again by later calls with the same.

    The table appears as a whole, by a rename; of two writers the first one's stays. A plan that reads anything but files is not cached.
    """
    import uuid

    spark = df.sparkSession
    name = fingerprint(df, config)
    if name is None:
        return make(df)
    path, own = f"{folder}/features-{name}", f"{folder}/_writing-{uuid.uuid4().hex}"
    if not exists(spark, path):
        make(df).write.parquet(own)
        jvm = spark.sparkContext._jvm
        source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (own, path))
        fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # a rename to a folder that is there would move into it
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
    return spark.read.parquet(path)


FEATURES = ["doc_perplexity", "sentence_perplexity_mean", "sentence_perplexity_std", "burstiness"]


def perplexity_matrix(df: DataFrame) -> DataFrame:
    """Logarithms of the perplexities, the others as they are."""
    return df.select("*", *[F.log1p(c).alias(f"x_{c}") for c in FEATURES[:2]], *[F.col(c).alias(f"x_{c}") for c in FEATURES[2:]])


def fit_logistic(df: DataFrame, y: str = "y") -> PipelineModel:
    """Standardised perplexity features to a balanced logistic regression."""
    stages = [VectorAssembler(inputCols=[f"x_{c}" for c in FEATURES], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=y, weightCol="weight", regParam=1e-3)]
    return Pipeline(stages=stages).fit(stored(balanced(perplexity_matrix(df), y).select(*[f"x_{c}" for c in FEATURES], y, "weight"), "training"))


def _logistic_probability(df: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(perplexity_matrix(df)).withColumn("prob_ai", vector_to_array("probability")[1])


def choose_threshold(df: DataFrame, model: PipelineModel, y: str = "y") -> float:
    """The probability that gives the best f1 on rows that the model has not learned from; 0.5 where these have one class or none."""
    found = best_f1_threshold(_logistic_probability(df, model).select(F.col("prob_ai").alias("score"), F.col(y).alias("y")), []).head()
    return 0.5 if found is None or found.threshold is None else found.threshold


def predict_logistic(df: DataFrame, model: PipelineModel, key: str, threshold: float = 0.5) -> DataFrame:
    done = _logistic_probability(df, model)
    out = predictions(done, key, "perplexity_logistic", threshold=threshold, keep=FEATURES)
    return out.withColumn("decision_threshold", F.lit(threshold))


def predictions(df: DataFrame, key: str, detector: str, score: str | None = None, threshold: float = 0.5, logit: Callable[[Column], Column] = clipped_logit, keep: list[str] | None = None) -> DataFrame:
    s = F.col(score) if score else logit(F.col("prob_ai"))
    return df.select(key, F.lit(detector).alias("detector_name"), s.alias("score"), "prob_ai", F.when(F.col("prob_ai") >= threshold, "ai").otherwise("human").alias("pred_label"), *(keep or []))


def score_texts(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[float]]], batch: int = 16, name: str = "score") -> DataFrame:
    """Adds a score by a scorer that ``load`` makes once a task; texts are scored in batches of similar length."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches: Iterator) -> Iterator:
        scorer = load()
        for pdf in batches:
            order = pdf[text].fillna("").str.len().sort_values(kind="stable").index
            values = {}
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                values |= dict(zip(part, scorer(pdf.loc[part, text].fillna("").tolist()), strict=True))
            yield pdf.assign(**{name: [values[i] for i in pdf.index]})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))


def generate(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[str]]], prompt_words: int = 30, least_words: int = 55, tries: int = 10, batch: int = 16, name: str = "sampled") -> DataFrame:
    """Adds a machine text begun by the first words of ``text``, by a generator that ``load`` makes once a task.

    A batch is generated again, ``tries`` times at most, until its shortest text has ``least_words`` words; the last try stays.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches: Iterator) -> Iterator:
        generator = load()
        for pdf in batches:
            prompts = pdf[text].fillna("").map(lambda t: " ".join(t.split(" ")[:prompt_words])).tolist()
            out: list[str] = []
            for at in range(0, len(prompts), batch):
                part: list[str] = []
                for _ in range(tries):
                    part = generator(prompts[at : at + batch])
                    if min((len(t.split(" ")) for t in part), default=least_words) >= least_words:
                        break
                out += part
            yield pdf.assign(**{name: out})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(name, StringType())]))


def fill_masks(df: DataFrame, text: str, masked: str, load: Callable[[], Callable[[list[str]], list[str]]], tries: int = 20, name: str = "perturbed") -> DataFrame:
    """Adds ``masked`` with its masks filled by a filler that ``load`` makes once a task.

    Answers that fill too few masks are asked for again, ``tries`` times at most; a text that is still not filled stays as ``text`` has it.
    """
    import re

    from pyspark.sql.types import StringType, StructField, StructType

    from ..functions.text import MASK

    mark = re.compile(MASK)

    def filled(pattern: str, answer: str) -> str | None:
        pieces = mark.split(pattern)
        fills = [x.strip() for x in mark.split(answer.replace("<pad>", "").replace("</s>", "").strip())[1:-1]]
        if len(fills) < len(pieces) - 1:
            return None
        return "".join(p + f for p, f in zip(pieces, [*fills, ""], strict=False))

    def run(batches: Iterator) -> Iterator:
        filler = load()
        for pdf in batches:
            patterns, out = pdf[masked].fillna("").tolist(), pdf[text].tolist()
            left = list(range(len(patterns)))
            for _ in range(tries):
                if not left:
                    break
                answers = filler([patterns[k] for k in left])
                again = []
                for k, answer in zip(left, answers, strict=True):
                    if (done := filled(patterns[k], answer)) is None:
                        again.append(k)
                    else:
                        out[k] = done
                left = again
            yield pdf.assign(**{name: out})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(name, StringType())]))
