"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's features are counts over the whole text: hashed words, pairs of words and byte 4-grams (``BLOCKS``, letters A-Z lowered),
trigrams of character classes with runs collapsed (the shape of the writing), and a few ratios of repetition and
length. Counts are damped by a logarithm, weighted by inverse document frequency, scaled to length 1 in each block and projected on the leading
singular vectors of the labelled sample (truncated SVD by subspace iteration). The labelled latent vectors are broadcast, every document's cosine
to each of them is computed in blocks, and the labels of the ``NEIGHBOURS`` nearest vote with their similarity.

A vector of the sample that carries the document's own id does not vote, so a document's own label is never an input of its score.

Bounds: the sample holds at most ``PER_CLASS`` labelled rows of each label, chosen by a hash of the id, one text for each id, so that model and
neighbours are at most ``2 * PER_CLASS`` vectors of ``RANK`` numbers for any input, and voting costs the same for every document.
Documents are scored in the scan; nothing is shuffled but labels and the sample.

Inputs of a score are the text alone. Rows are held out of learning where crc32 of the id as text is divisible by ``FOLDS``.

Defined cases: null text is empty; texts of any length are read whole; a document whose features vanish, or with no
similar neighbour, gets the share of label 1 in the sample; ties: all vectors as similar as the ``NEIGHBOURS``-th vote; labels that are null or neither
0 nor 1 are ignored, an id with several labels counts once with the smallest, one with several texts is learned from the smallest; if no label is
left every score is 0.5; repeated rows are scored each; rows with a null id are scored, and are not held out;
an empty table gives an empty result; extra columns of any name are kept, those named ``score``, ``predicted`` or ``held_out`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .memory import frugal, give_back

FOLDS = 5
PER_CLASS = 512
RANK = 64
NEIGHBOURS = 24
KEEP = 0.3
#: How strongly a neighbour's weight falls with its distance.
SHARPNESS = 12.0

#: Character classes, in order: letters and bytes beyond ASCII, capitals, digits, blanks, line ends, then punctuation.
GROUPS = [b"", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"|", b"!?", b"#$%&*@^~", b"<>{}[]()=/\\_+", b"-:;'\"`"]
K = len(GROUPS)
#: Buckets of words, pairs of words, byte 4-grams and class trigrams, and their weights.
BLOCKS = {"words": (2048, 0.6), "pairs": (1024, 0.3), "grams": (2048, 0.6), "shape": (K**3, 1.0)}
RATIOS, RATIO_WEIGHT = 7, 0.15
COUNTS = sum(n for n, _ in BLOCKS.values())
WIDTH = COUNTS + RATIOS

U = np.uint64


def _class_table() -> bytes:
    table = bytearray(256)
    for i, group in enumerate(GROUPS):
        for c in group:
            table[c] = i
    return bytes(table)


CLASSES = _class_table()
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Odd multipliers for the places of a byte in a word; further bytes share the last one.
PLACES = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(32)], U)


def _scrambled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(31))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


def _bucketed(h: np.ndarray, n: int) -> np.ndarray:
    return np.bincount((_scrambled(h) % U(n)).astype(np.int64), minlength=n)


def features(texts: list[str | None]) -> np.ndarray:
    """A row of ``WIDTH`` numbers for each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        data = (text or "").encode()
        if not data:
            continue  # nothing to judge: such a row has no latent vector
        counts = {}
        low = np.frombuffer(data.lower(), np.uint8)
        blank = BLANK[low]
        begins = ~blank
        begins[1:] &= blank[:-1]
        first = np.flatnonzero(begins)
        with np.errstate(over="ignore"):
            if len(first):
                place = np.arange(len(low)) - first[np.maximum(np.cumsum(begins) - 1, 0)]
                value = np.where(blank, U(0), (low.astype(U) + U(1)) * PLACES[np.clip(place, 0, 31)])
                word = _scrambled(np.add.reduceat(value, first))
                counts["words"] = _bucketed(word, BLOCKS["words"][0])
                if len(word) > 1:
                    counts["pairs"] = _bucketed(word[:-1] * U(3) + word[1:], BLOCKS["pairs"][0])
            if len(low) > 3:
                w = low.astype(U)
                counts["grams"] = _bucketed(w[:-3] | w[1:-2] << U(8) | w[2:-1] << U(16) | w[3:] << U(24), BLOCKS["grams"][0])
        c = np.frombuffer(data.translate(CLASSES), np.uint8)
        c = c[np.concatenate([[True], c[1:] != c[:-1]])].astype(np.int32)
        if len(c) > 2:
            counts["shape"] = np.bincount((c[:-2] * K + c[1:-1]) * K + c[2:], minlength=K**3)
        at = 0
        for name, (n, _) in BLOCKS.items():
            if name in counts:
                row[at : at + n] = counts[name]
            at += n
        words = data.split()
        lines = data.split(b"\n")
        n = max(1, len(words))
        row[COUNTS:] = (
            sum(a == b for a, b in zip(words, words[1:])) / n,  # noqa: B905
            len(set(words)) / n,
            len(set(lines)) / len(lines),
            np.log1p(n) / 10,
            min(1.0, len(data) / n / 20),
            sum(w.isupper() for w in words) / n,
            len(c) / len(data),
        )
    return out


def damped(x: np.ndarray) -> np.ndarray:
    """Counts by their logarithm; ratios as they are."""
    return np.hstack([np.log1p(x[:, :COUNTS]), x[:, COUNTS:]])


def leading_vectors(w: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of ``w`` as columns, by subspace iteration."""
    rank = min(rank, *w.shape)
    q = np.linalg.qr(w.T @ np.random.default_rng(5).standard_normal((len(w), min(rank + 16, len(w)))).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(w.T @ (w @ q))[0]
    _, _, turn = np.linalg.svd(w @ q, full_matrices=False)
    return (q @ turn.T)[:, :rank].astype(np.float32)


class Model:
    """Projection, labelled latent vectors and the ids that they carry; ``vectors`` is None without labels."""

    #: ``x`` are features of the sample with damped counts.
    def __init__(self, x: np.ndarray, labels: np.ndarray, ids: list | None = None, rank: int = RANK) -> None:
        self.prior, self.vectors = 0.5, None
        self.own: dict = {i: k for k, i in enumerate(ids or [])}
        if not len(x):
            return
        self.prior = float(labels.mean())
        self.idf = (np.log((1 + len(x)) / (1 + (x[:, :COUNTS] > 0).sum(0))) + 1).astype(np.float32)
        self.mean, self.std = x[:, COUNTS:].mean(0), x[:, COUNTS:].std(0) + 1e-3
        w = self.weigh(x, in_place=True)  # ``x`` is not used any more
        self.basis = leading_vectors(w, rank)
        self.vectors = self._unit(w @ self.basis)
        self.labels = labels.astype(np.float64)

    @staticmethod
    def _unit(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def weigh(self, x: np.ndarray, in_place: bool = False) -> np.ndarray:
        some = x.any(1)[:, None]
        out = x if in_place else np.empty_like(x)
        at = 0
        for n, weight in BLOCKS.values():
            out[:, at : at + n] = self._unit(x[:, at : at + n] * self.idf[at : at + n]) * weight
            at += n
        out[:, COUNTS:] = np.clip((x[:, COUNTS:] - self.mean) / self.std, -5, 5) * RATIO_WEIGHT * some
        return out

    def latent(self, x: np.ndarray) -> np.ndarray:
        return self._unit(self.weigh(damped(x)) @ self.basis)

    def score(self, x: np.ndarray, ids: list | None = None, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Votes for the documents with features ``x``; the vector that carries a document's own id does not vote."""
        if self.vectors is None:
            return np.full(len(x), self.prior)
        cosine = self.latent(x) @ self.vectors.T
        for k, i in enumerate(ids or []):
            if i is not None and i in self.own:
                cosine[k, self.own[i]] = -2
        least = -np.partition(-cosine, min(neighbours, cosine.shape[1]) - 1, axis=1)[:, [min(neighbours, cosine.shape[1]) - 1]]
        weight = np.where((cosine >= least) & (cosine > 0), np.exp(SHARPNESS * (cosine.astype(np.float64) - 1)), 0)
        total = weight.sum(1)
        return np.clip(np.where(total > 0, weight @ self.labels / np.maximum(total, 1e-300), self.prior), 0.0, 1.0)


def held_out(key: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learn from the labelled rows that are not held out."""
    usable = labels.select(F.col(key), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    usable = usable.groupBy(key).agg(F.min("y").alias("y"))
    order = [F.xxhash64(F.col(key), F.lit(7)), F.col(key)]
    sample = None
    for y in (0, 1):
        part = usable.filter(F.col("y") == y).orderBy(*order).limit(per_class)
        sample = part if sample is None else sample.unionByName(part)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([r.tobytes() for r in damped(x).astype(np.float16)], pa.binary())], names=["id", "y", "x"])

    # at most 2 * per_class ids are broadcast; an id that repeats gives one text, so as many feature rows come to the driver
    sample = sample.select(F.col(key).alias("id"), "y")
    chosen = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    chosen = chosen.groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")
    kind = docs.schema[key].dataType.simpleString()
    rows = sorted(chosen.mapInArrow(run, f"id {kind}, y int, x binary").collect(), key=lambda r: r["id"])
    x = np.empty((len(rows), WIDTH), np.float32)
    for k, r in enumerate(rows):
        x[k] = np.frombuffer(r["x"], np.float16)
    labels, ids = np.array([r["y"] for r in rows], np.float32), [r["id"] for r in rows]
    del rows
    model = Model(x, labels, ids)
    del x
    give_back()
    return model


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: float = KEEP, block: int = 256) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("held_out", "score", "predicted")
    place, names = docs.columns.index(text), docs.columns.index(key)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts, scores = b.column(place), np.zeros(b.num_rows)
            for at in range(0, b.num_rows, block):
                scores[at : at + block] = m.score(features(texts.slice(at, block).to_pylist()), b.column(names).slice(at, block).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], names=[*b.schema.names, "score"])

    scored = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
    return scored.select("*", held_out(F.col(key)).alias("held_out"), (F.col("score") >= keep).cast("int").alias("predicted"))
