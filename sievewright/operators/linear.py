"""A linear classifier by squared hinge loss over sparse rows, fitted by Newton steps that Spark sums.

Minimises ``|w|^2 / 2 + c * sum(weight * max(0, 1 - s * (w x + b))^2)`` with ``s`` 1 or -1; the constant term ``b`` is one more place with the value 1, penalised as the others.
A step solves the Newton equation by conjugate gradients, each of whose products with the Hessian is a pass over the rows, and is
shortened until the loss falls.

Data movement: tasks get the weights (``size + 1`` numbers, bounded by the vocabulary) and give as many sums each: the rows themselves are never shuffled. The
sums of more than ``PARTS`` tasks are added up in the square root of so many tasks, before the driver gets them.
Where tasks can run side by side, they read their rows once, hold them in memory or in a file of their own, and go through all passes in one stage; the first one takes the steps.
"""

from __future__ import annotations

import math
import pickle
import secrets
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import discard, stored
from .features import pieces
from .together import Circle, slots

#: The most steps, products of a step, and halvings of its length; the slope, against the first one, that is flat enough.
STEPS, PRODUCTS, HALVINGS, FLAT = 50, 40, 20, 1e-6
#: Most entries of a block of several rows, and most tasks whose sums go to the driver as they are.
BLOCK, PARTS = 100_000, 32
#: Bytes of rows that a task holds in memory.
HELD = 1 << 28
#: What a block holds: signs, weights and numbers of entries of its rows, places and values of their entries.
PACKED = {"s": np.float64, "weight": np.float64, "size": np.int32, "places": np.int32, "x": np.float64}


@dataclass
class Linear:
    """A weight for each place, and the constant term."""

    weights: np.ndarray
    constant: float
    loss: float = 0.0
    passes: int = 0


def _dots(w: np.ndarray, size: np.ndarray, places: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ``size`` entries each the product with ``w``, and for each entry its row."""
    row = np.repeat(np.arange(len(size)), size)
    return np.bincount(row, x * w[places], len(size)) + w[-1], row


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the number of its entries; for each entry its place and value."""
    return np.diff(batch["places"].offsets.to_numpy()), batch["places"].flatten().to_numpy(), batch["weights"].flatten().to_numpy()


def _packed(rows: DataFrame) -> DataFrame:
    """``rows(s, weight, places, weights)`` as blocks of bytes, one a row: a pass then moves few large values and makes no lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, ["places"], BLOCK)):
            columns = batch["s"].to_numpy(), batch["weight"].to_numpy(), *_entries(batch)
            yield pa.RecordBatch.from_arrays([pa.array([c.astype(t).tobytes()], pa.binary()) for c, t in zip(columns, PACKED.values(), strict=True)], names=[*PACKED])

    return rows.select("s", "weight", "places", "weights").mapInArrow(run, ", ".join(f"{name} binary" for name in PACKED))


def _summed(blocks: DataFrame, parts: int, size: int, of: Callable[..., tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray]:
    """The sum of what ``of`` gives for blocks: a number, a factor for each row, and the row of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for batch in batches:
            for i in range(batch.num_rows):
                s, weight, n, places, x = (np.frombuffer(batch[name][i].as_buffer(), t) for name, t in PACKED.items())
                value, factor, row = of(s, weight, n, places, x)
                total[:size] += np.bincount(places, factor[row] * x, size)
                total[size:] += factor.sum(), value
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for batch in batches:
            for v in batch["v"]:
                total += np.frombuffer(v.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    found = blocks.mapInArrow(run, "v binary")
    if parts > PARTS:
        found = found.repartition(math.isqrt(parts)).mapInArrow(add, "v binary")
    total = np.zeros(size + 2)
    for v in found.toArrow()["v"]:
        total += np.frombuffer(v.as_buffer())
    return float(total[-1]), total[:-1]


#: The sum over all rows of a number and of what each place gets.
Sum = Callable[[Callable[..., tuple[float, np.ndarray, np.ndarray]]], tuple[float, np.ndarray]]


def _loss(w: np.ndarray, c: float) -> Callable[..., tuple[float, np.ndarray, np.ndarray]]:
    def of(s, weight, *entries):  # noqa: ANN001, ANN002, ANN202
        z, row = _dots(w, *entries)
        short = np.maximum(0.0, 1 - s * z)
        return float((weight * short**2).sum()), -2 * c * weight * s * short, row

    return of


def _curve(w: np.ndarray, v: np.ndarray, c: float) -> Callable[..., tuple[float, np.ndarray, np.ndarray]]:
    def of(s, weight, *entries):  # noqa: ANN001, ANN002, ANN202
        z, row = _dots(w, *entries)
        return 0.0, 2 * c * weight * (s * z < 1) * _dots(v, *entries)[0], row

    return of


class Passes:
    """What a fit asks for: the loss and its slope, and products with the Hessian at the point of the last loss."""

    def __init__(self, total: Sum, c: float) -> None:
        self.total, self.c, self.w = total, c, np.zeros(0)

    def objective(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        self.w = w
        loss, slope = self.total(_loss(w, self.c))
        return w @ w / 2 + self.c * loss, w + slope

    def curved(self, v: np.ndarray) -> np.ndarray:
        return v + self.total(_curve(self.w, v, self.c))[1]


class Held:
    """The rows of a task, in larger blocks: in memory, or in a file beyond ``most`` bytes."""

    def __init__(self, batches: Iterator[pa.RecordBatch], size: int, c: float, most: int) -> None:
        self.size, self.c, self.blocks, self.file = size, c, [], tempfile.TemporaryFile()
        self.most, self.active = most, []
        parts, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                parts.append([np.frombuffer(batch[name][i].as_py(), t) for name, t in PACKED.items()])
                n += len(parts[-1][-1])
                if n >= 10 * BLOCK:
                    self._keep(parts)
                    parts, n = [], 0
        if parts:
            self._keep(parts)

    def _keep(self, parts: list[list[np.ndarray]]) -> None:
        s, weight, count, places, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        full = np.flatnonzero(count)
        block = s, weight, full, (np.cumsum(count) - count)[full], np.repeat(np.arange(len(count), dtype=np.int32), count), places, x
        self.active.append(np.zeros(len(s)))
        self.most -= sum(v.nbytes for v in block)
        if self.most >= 0:
            self.blocks.append(lambda: block)
        else:
            at = self.file.seek(0, 2)
            pickle.dump(block, self.file, 5)
            self.blocks.append(lambda: self.file.seek(at) >= 0 and pickle.load(self.file))

    def sums(self, v: np.ndarray, curved: bool) -> np.ndarray:
        """Of these rows what ``Passes`` needs: for each place and the constant term, and the loss."""
        total, c = np.zeros(self.size + 2), self.c
        for k, block in enumerate(self.blocks):
            s, weight, full, starts, row, places, x = block()
            z = np.full(len(s), v[-1])
            if len(full):
                z[full] += np.add.reduceat(x * v[places], starts)
            if curved:
                factor = self.active[k] * z
            else:
                short = np.maximum(0.0, 1 - s * z)
                self.active[k] = 2 * c * weight * (short > 0)
                factor = -2 * c * weight * s * short
                total[-1] += (weight * short**2).sum()
            total[: self.size] += np.bincount(places, factor[row] * x, self.size)
            total[-2] += factor.sum()
        return total


class Led(Passes):
    """The same, of rows that several tasks hold; the first one leads, the others ``follow``."""

    def __init__(self, circle: Circle, held: Held) -> None:
        self.circle, self.held, self.c = circle, held, held.c

    def _pass(self, v: np.ndarray, curved: bool) -> np.ndarray:
        self.circle.told(bytes([1 + curved]) + v.tobytes())
        return self.circle.total(self.held.sums(v, curved))

    def objective(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        total = self._pass(w, False)
        return w @ w / 2 + self.c * float(total[-1]), w + total[:-1]

    def curved(self, v: np.ndarray) -> np.ndarray:
        return v + self._pass(v, True)[:-1]

    def end(self) -> None:
        self.circle.told(b"\0")

    def follow(self) -> None:
        while (order := self.circle.told(b""))[0]:
            self.circle.total(self.held.sums(np.frombuffer(order, np.float64, offset=1), order[0] == 2))


def _together(blocks: DataFrame, size: int, c: float, tasks: int) -> Linear:
    secret = secrets.token_bytes(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(batches, size, c, HELD)
        with held.file, Circle(secret) as circle:
            led = Led(circle, held)
            if circle.number:
                led.follow()
                return
            found = _minimum(led, size)
            led.end()
            yield pa.RecordBatch.from_pydict({"weights": pa.array([np.append(found.weights, found.constant).tobytes()], pa.binary()), "loss": [found.loss], "passes": pa.array([found.passes], pa.int64())})

    r = blocks.repartition(tasks).mapInArrow(run, "weights binary, loss double, passes long", barrier=True).collect()[0]
    w = np.frombuffer(bytes(r.weights), np.float64)
    return Linear(w[:-1], float(w[-1]), r.loss, r.passes)


def fit_squared_hinge(rows: DataFrame, size: int, c: float = 1.0) -> Linear:
    """For ``rows(y, weight, places, weights)``: ``y`` 1 or 0, places below ``size``, each once a row. ``rows`` are read once: what the passes read is written in blocks."""
    rows = rows.select(F.when(F.col("y") == 1, 1.0).otherwise(-1.0).alias("s"), F.col("weight").cast("double").alias("weight"), "places", "weights")
    written = stored(_packed(rows), "blocks")
    if tasks := slots(rows.sparkSession):
        found = _together(written, size, c, tasks)
        discard(written)
        return found
    blocks = written.persist(StorageLevel.MEMORY_AND_DISK)
    parts = blocks.rdd.getNumPartitions()
    try:
        return _minimum(Passes(lambda of: _summed(blocks, parts, size, of), c), size)
    finally:
        blocks.unpersist()
        discard(written)


def _minimum(rows: Passes, size: int) -> Linear:
    w, passes = np.zeros(size + 1), 1
    loss, slope = rows.objective(w)
    first = np.linalg.norm(slope)
    for _ in range(STEPS):
        norm = np.linalg.norm(slope)
        if norm <= FLAT * first:
            break
        way, rest = np.zeros_like(w), -slope
        step, size2 = rest.copy(), rest @ rest
        # a step need not be exacter than the end asks for
        enough = max(min(0.1, norm / max(first, 1e-300)) * norm, FLAT * first / 2) ** 2
        for _ in range(PRODUCTS):
            if size2 <= enough:
                break
            product, passes = rows.curved(step), passes + 1
            length = size2 / (step @ product)
            way += length * step
            rest -= length * product
            before, size2 = size2, rest @ rest
            step = rest + size2 / before * step
        length, fall = 1.0, slope @ way
        for _ in range(HALVINGS):
            there = w + length * way
            new_loss, new_slope = rows.objective(there)
            passes += 1
            if new_loss <= loss + 1e-4 * length * fall:
                break
            length /= 2
        else:
            break
        w, loss, slope = there, new_loss, new_slope
    return Linear(w[:-1], float(w[-1]), float(loss), passes)


def linear_margin(df: DataFrame, model: Linear, name: str = "margin") -> DataFrame:
    """``df(.., places, weights)`` with the model's margin of each row."""
    w, names = np.append(model.weights, model.constant), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_dots(w, *_entries(batch))[0])], names=[*names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))
