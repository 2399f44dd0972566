"""Scores of all rows under the Kneser-Ney models of the same rows (see ``language``), in two shuffles of packed numbers.

Each gram lies in the bucket of its context's last word ``v``: what follows ``v``, after which ``u``, is counted and scored in one task, beside the rows that it is summed for. What that task cannot know
is how many words each ``w`` follows. This is counted in the bucket of ``w`` from the distinct pairs of each piece of rows, and goes from there to the buckets of the ``v`` before it.
A task reads its pieces twice, from memory or a file of its own; it holds the bucket's distinct grams. All grams of one ``v`` are in one task.
"""

from __future__ import annotations

import math
import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .cutting import pieces
from .features import over_cores

#: Tokens of a piece of rows, and of a bucket on average; bytes of pieces that a task holds in memory.
PIECE, BUCKET, HELD = 1_000_000, 4_000_000, 1 << 28
#: Grams that are scored at once, and that wait before equal ones are counted.
SCORED, WAITING = 1_000_000, 8_000_000


def _hashed(words: np.ndarray, buckets: int) -> np.ndarray:
    return (words.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _counted(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of the rows of ``n`` over each."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return code[starts], np.add.reduceat(n[order], starts, axis=0) if len(code) else n


@dataclass
class Piece:
    """The tokens of some rows: distinct ``words``, the number ``at`` of each token's word, its row and its place there."""

    words: np.ndarray
    at: np.ndarray
    row: np.ndarray
    place: np.ndarray
    key: np.ndarray
    model: np.ndarray

    @classmethod
    def all(cls, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Piece]:
        for batch in (piece for whole in batches for piece in pieces(whole, ["t"], most)):
            size = np.diff(batch["t"].offsets.to_numpy())
            words, at = np.unique(batch["t"].flatten().to_numpy(), return_inverse=True)
            place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            yield cls(words, at, np.repeat(np.arange(len(size)), size), place, batch["k"].to_numpy(), batch["m"].to_numpy().astype(np.int64))


def _binary(rows: list[tuple], names: str) -> pa.RecordBatch:
    """Rows of a bucket and bytes."""
    kinds = [pa.int32(), *[pa.binary()] * (len(names.split()) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names.split())


def _schema(names: str) -> str:
    return ", ".join(f"{n} {'binary' if i else 'int'}" for i, n in enumerate(names.split()))


PAIRS, ANSWERS, GRAMS = "bucket v w m first", "bucket words one two", "bucket words one two key grams row seen m"


def _cut(order: np.ndarray, ends: np.ndarray, *columns: np.ndarray) -> Iterator[list[np.ndarray]]:
    ordered = [c[order] for c in columns]
    for i, j in zip(ends[:-1], ends[1:], strict=True):
        yield [c[i:j] for c in ordered]


def _before(ids: DataFrame, buckets: int) -> DataFrame:
    """``bucket, words, one, two``: for each bucket of ``v`` the words after its words, and how many words each follows in either model; in bucket -1 how many words have such numbers."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in Piece.all(batches, PIECE):
            later = np.flatnonzero(p.place > 0)
            code = np.unique(((p.at[later] << 32) | p.at[later - 1]) << 1 | p.model[p.row[later]])
            w, v, m = code >> 33, (code >> 1) & 0xFFFFFFFF, (code & 1).astype(np.uint8)
            of = _hashed(p.words, buckets)
            first = np.unique(p.at[p.place == 0])
            ends = lambda b: np.searchsorted(np.sort(b), np.arange(buckets + 1))
            own = _cut(np.argsort(of[w], kind="stable"), ends(of[w]), p.words[v], p.words[w], m)
            begun = _cut(np.argsort(of[first], kind="stable"), ends(of[first]), p.words[first])
            yield _binary([(b, *[c.tobytes() for c in (*x, *y)]) for b, (x, y) in enumerate(zip(own, begun, strict=True))], PAIRS)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.frombuffer(b[name][i].as_buffer(), kind) for name, kind in (("v", np.int64), ("w", np.int64), ("m", np.uint8), ("first", np.int64))] for b in batches for i in range(b.num_rows)]
        if not parts:
            return
        v, w, m, first = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        words, at = np.unique(np.concatenate([w, first]), return_inverse=True)
        before, v = np.unique(v, return_inverse=True)
        code = np.unique((at[: len(w)] * max(len(before), 1) + v) * 2 + m)
        w, v, m = code // 2 // max(len(before), 1), code // 2 % max(len(before), 1), code % 2
        one, two = (np.bincount(w[m == k], minlength=len(words)).astype(np.int64) for k in (0, 1))
        wanted = np.unique(_hashed(before, buckets)[v] * len(words) + w)
        to, w = wanted // len(words), wanted % len(words)
        rows = [(b, *[c.tobytes() for c in x]) for b, x in enumerate(_cut(np.arange(len(w)), np.searchsorted(to, np.arange(buckets + 1)), words[w], one[w], two[w])) if len(x[0])]
        both, n = np.unique(np.stack([one, two]), axis=1, return_counts=True)
        rows.append((-1, n.astype(np.int64).tobytes(), both[0].tobytes(), both[1].tobytes()))
        yield _binary(rows, ANSWERS)

    dealt = ids.mapInArrow(pairs, _schema(PAIRS)).repartitionById(buckets, F.col("bucket"))
    return stored(dealt.mapInArrow(answers, _schema(ANSWERS)), "answers")


@dataclass
class Ends:
    """What all words tell: of each model the sum of numbers and the even share, and sums over the vocabulary with the place of unknown words."""

    total: tuple[float, float]
    even: tuple[float, float]
    all_a: float
    all_x: float


def _ends(answers: DataFrame, discount: float, same: bool) -> Ends:
    """``same``: all rows are of the first model, and the second is the same."""
    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b[name][i].as_buffer(), np.int64)) for name in ("words", "one", "two")], names=["n", "one", "two"])

    rows = answers.filter("bucket < 0").mapInArrow(plain, "n long, one long, two long").groupBy("one", "two").agg(F.sum("n").alias("n"))
    c = ("one", "one" if same else "two")
    found = rows.agg(F.sum("n").alias("size"), *[F.sum(F.col("n") * F.col(k)).alias(k) for k in ("one", "two")], *[F.sum(F.when(F.col(k) > 0, F.col("n"))).alias(f"{k}_types") for k in ("one", "two")]).head()
    total = [float(found[k] or 1) for k in c]
    size = (found["size"] or 0) + 1
    even = [discount * (found[f"{k}_types"] or 0) / found[k] / size if found[k] else 1.0 / size for k in c]
    a, b = (F.greatest(F.col(k) - discount, F.lit(0.0)) / F.lit(t) + F.lit(e) for k, t, e in zip(c, total, even, strict=True))
    sums = rows.agg(F.sum(F.col("n") * a), F.sum(F.col("n") * a * F.log(b))).head()
    return Ends(tuple(total), tuple(even), (sums[0] or 0.0) + even[0], (sums[1] or 0.0) + even[0] * math.log(even[1]))


def _grams(ids: DataFrame, buckets: int, order: int, max_length: int, stride: int) -> DataFrame:
    """For each piece and bucket its words and, by ``v``, the grams with the row that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in Piece.all(batches, PIECE):
            later = np.flatnonzero(p.place > 0)
            v, w, i = p.at[later - 1], p.at[later], p.place[later]
            u = np.where(i > 1, p.at[np.maximum(later - 2, 0)], -1)
            s = min(stride, max_length)
            begin = np.maximum(-(-(i - (max_length - 1)) // s), 0) * s
            seen = np.minimum(i - begin, 2).astype(np.uint8)
            of = _hashed(p.words, buckets)
            by = np.argsort(of[v] * len(p.words) + v, kind="stable")
            ends = np.searchsorted(of[v][by], np.arange(buckets + 1))
            rows = []
            for b, (u, v, w, row, seen) in enumerate(_cut(by, ends, u, v, w, p.row[later], seen)):
                grams = np.stack([v, w, u] if order == 3 else [v, w])
                used = np.zeros(len(p.words) + 1, bool)
                used[grams] = True  # -1 is the place after all words
                number = np.cumsum(used) - 1
                number[-1] = -1
                rows.append((b, p.words[used[:-1]].tobytes(), None, None, p.key.tobytes(), number[grams].astype(np.int32).tobytes(), row.astype(np.int32).tobytes(), seen.tobytes(), p.model.astype(np.uint8).tobytes()))
            yield _binary(rows, GRAMS)

    return ids.mapInArrow(run, _schema(GRAMS))


def _shares(c: np.ndarray, group: np.ndarray, groups: int, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each gram what its discounted count gives, and of each context, by ``group``, its back-off weight; 1 for one without a count."""
    total, types = np.bincount(group, c, groups), np.bincount(group, c > 0, groups)
    safe = np.where(total > 0, total, 1.0)
    return np.maximum(c - discount, 0) / safe[group], np.where(total > 0, discount * types / safe, 1.0)


class Bucket:
    """The grams of one bucket: counted at first, then scored."""

    def __init__(self, order: int, ends: Ends, discount: float, same: bool, held: int, at_once: int, waiting: int) -> None:
        self.order, self.ends, self.discount, self.same, self.at_once, self.waiting = order, ends, discount, same, at_once, waiting
        self.file = tempfile.SpooledTemporaryFile(held)
        self.answers: list[tuple] = []
        self.tables: list[np.ndarray] = []

    def read(self, batches: Iterator[pa.RecordBatch]) -> None:
        for b in batches:
            for i in range(b.num_rows):
                plain = [b[name][i].as_py() for name in GRAMS.split()[1:]]
                if plain[1] is not None:
                    self.answers.append(tuple(np.frombuffer(x, np.int64) for x in plain[:3]))
                elif plain[4]:
                    pickle.dump(plain, self.file)
                    self.tables.append(np.frombuffer(plain[0], np.int64))
                    if sum(map(len, self.tables)) > self.waiting:
                        self.tables = [np.unique(np.concatenate(self.tables))]

    def pieces(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Key, code, counting model and ``seen`` of the grams, some pieces at a time."""
        self.file.seek(0)
        held, n = [], 0
        while True:
            try:
                words, _, _, key, grams, row, seen, m = pickle.load(self.file)
            except EOFError:
                break
            key, row, m = np.frombuffer(key, np.int64), np.frombuffer(row, np.int32), np.frombuffer(m, np.uint8)
            number = np.append(np.searchsorted(self.words, np.frombuffer(words, np.int64)), -1)  # the last one is that of no word
            grams = number[np.frombuffer(grams, np.int32).reshape(-1, len(row))]
            v = self.rank[grams[0]]
            code = (v * (self.size + 1) + grams[2] + 1) * self.size + grams[1] if self.order == 3 else v * self.size + grams[1]
            held.append((key[row], code, m[row], np.frombuffer(seen, np.uint8)))
            n += len(row)
            if n >= self.at_once:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def count(self, buckets: int, number: int) -> None:
        self.words = np.unique(np.concatenate(self.tables))
        self.size = len(self.words)
        own = _hashed(self.words, buckets) == number
        self.rank = np.cumsum(own) - 1
        if int(own.sum()) * (self.size + 1) * self.size >= 1 << 63 and self.order == 3:
            raise OverflowError(f"{self.size} words in a bucket: more shuffle partitions are needed")
        parts, waiting = [], 0
        for _, code, m, _ in self.pieces():
            parts.append(_counted(code, np.stack([m == 0, m == 1], axis=1).astype(np.int64)))
            waiting += len(parts[-1][0])
            if waiting > self.waiting:
                parts = [_counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                waiting = 0
        self.code, c = _counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        c = np.stack([c.sum(axis=1)] * 2, axis=1) if self.same else c
        words, *numbers = (np.concatenate(x) for x in zip(*self.answers, strict=True))
        at = np.searchsorted(self.words, words)
        p1 = []
        for k, n in enumerate((numbers[0] + numbers[1],) * 2 if self.same else numbers):
            p1.append(np.full(self.size, self.ends.even[k]))
            p1[k][at] += np.maximum(n - self.discount, 0) / self.ends.total[k]
        (self._three if self.order == 3 else self._two)(c, *p1)

    def _three(self, c: np.ndarray, p1: np.ndarray, _: np.ndarray) -> None:
        context, w = self.code // self.size, self.code % self.size
        v, u = context // (self.size + 1), context % (self.size + 1)
        pairs, at, n = np.unique(v * self.size + w, return_inverse=True, return_counts=True)
        share, back = _shares(n.astype(np.float64), pairs // self.size, int(self.rank[-1]) + 1, self.discount)
        lower = (share + back[pairs // self.size] * p1[pairs % self.size])[at]
        group = np.cumsum(np.append(True, context[1:] != context[:-1])[: len(context)]) - 1
        share, back = _shares(c[:, 0].astype(np.float64), group, int(group[-1]) + 1, self.discount)
        # the beginning of a row is no context of its own
        self.logs = np.log(lower), np.log(np.where(u > 0, share + back[group] * lower, lower))

    def _two(self, c: np.ndarray, a1: np.ndarray, b1: np.ndarray) -> None:
        v, w = self.code // self.size, self.code % self.size
        contexts = int(self.rank[-1]) + 1
        (sa, ka), (sb, kb) = (_shares(c[:, k].astype(np.float64), v, contexts, self.discount) for k in (0, 1))
        pa_, pb = sa + ka[v] * a1[w], sb + kb[v] * b1[w]
        sums = [np.bincount(v, x, contexts) for x in (pa_ * np.log(pb), a1[w], a1[w] * np.log(b1[w]))]
        self.logs = (np.log(pb),) * 2
        self.ce = -(sums[0] + ka * (np.log(kb) * (self.ends.all_a - sums[1]) + (self.ends.all_x - sums[2])))

    def scores(self) -> Iterator[pa.RecordBatch]:
        """``k, n, lp, ce``: sums over the scored grams of some rows."""
        for key, code, _, seen in self.pieces():
            hit = seen > 0
            key, row = np.unique(key[hit], return_inverse=True)
            at = np.searchsorted(self.code, code[hit])
            lp = np.where(seen[hit] == 2, self.logs[1][at], self.logs[0][at])
            ce = self.ce[self.code[at] // self.size] if self.order == 2 else np.zeros(len(at))
            sums = [np.bincount(row, x, len(key)) for x in (lp, ce)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(row, minlength=len(key)).astype(np.int64)), *map(pa.array, sums)], names=["k", "n", "lp", "ce"])


def scored(df: DataFrame, key: str, tokens: Column, order: int, max_length: int, stride: int, discount: float, model: Column | None = None) -> DataFrame:
    """``key, tokens, nll, ce`` of rows with scored tokens: their number, mean negative log-probability and, for order 2, mean cross-entropy of what is expected.

    Without ``model`` there is one model of all rows. With it rows where it is 0 make the observer, which expects, and those where it is 1 the performer, whose probabilities count.
    """
    if order not in (2, 3) or (order == 3 and model is not None):
        raise ValueError(f"orders are 2 and 3, not {order}, and two models have order 2")
    rows = over_cores(df).select(key, F.transform(tokens, lambda x: F.xxhash64(x)).alias("t"), (F.lit(0) if model is None else model).cast("int").alias("m"))
    rows = stored(rows.withColumn("k", F.monotonically_increasing_id()), "token-ids")
    ids = rows.filter(F.size("t") > 1).select("k", "t", "m")
    n = ids.agg(F.sum(F.size("t"))).head()[0] or 0
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism, -(-n // BUCKET))
    answers = _before(ids, buckets)
    same = model is None
    ends = _ends(answers, discount, same)
    asked = answers.filter("bucket >= 0").select("bucket", "words", "one", "two", *[F.lit(None).cast("binary").alias(c) for c in GRAMS.split()[4:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bucket(order, ends, discount, same, HELD, SCORED, WAITING)
        with own.file:
            own.read(batches)
            if own.tables:
                own.count(buckets, TaskContext.get().partitionId())
                yield from own.scores()

    dealt = _grams(ids, buckets, order, max_length, stride).unionByName(asked).repartitionById(buckets, F.col("bucket"))
    sums = dealt.mapInArrow(run, "k long, n long, lp double, ce double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("lp").alias("lp"), F.sum("ce").alias("ce"))
    out = sums.join(rows.select("k", key), "k").groupBy(key).agg(F.sum("n").alias("tokens"), (-F.sum("lp") / F.sum("n")).alias("nll"), (F.sum("ce") / F.sum("n")).alias("ce"))
    out = stored(out, "scores")
    discard(rows, answers)
    return out
