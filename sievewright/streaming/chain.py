"""Rewrite chains with state: each sample is rewritten depth by depth, one call at a time, and checked at one depth.

``run_stream`` keeps a sample's texts and failed attempts in Spark's state store and goes on by processing-time timers, one call for each sample and
micro-batch: a stream that is stopped between two depths goes on at the next one, and only samples that moved are written. A failed
call sets a timer of 1, 2, 4 ... 30 seconds. ``run_batch`` does the same for a table, from the first depth that an earlier run has not left.
Both give one row for each call, the log that usage is summed from (``usage_of``).

A call carries a ``request_id`` that depends on model, sample, kind and depth alone, so that a service which knows it can answer a call of a task that ran again without a second charge.

Defined cases: null text, question and domain are empty; a sample that comes again is not asked for again; an empty answer counts as a failure; a call that fails
``retries`` times gives a row with status ``failed`` and its sample stops there in a stream, and fails the task in a batch.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rewrite import usage_with_checks

CALL = "sample_id string, call_type string, depth int, text string, request_id string, attempts int, status string, input_tokens long, output_tokens long, total_tokens long"
#: The longest pause, in seconds.
LONGEST = 30.0

#: Takes prompt, kind of call and request id; gives ``text``, ``input_tokens`` and ``output_tokens``.
Client = Callable[[str, str, str], dict[str, Any]]


@dataclass(frozen=True)
class ChainConfig:
    """``load`` makes a client once a worker; ``prompt`` gets the sample's fields and the text to rewrite, ``check`` the text to judge."""

    load: Callable[[], Client]
    depths: int
    prompt: Callable[[dict, str], str]
    check: Callable[[str], str] | None = None
    checked: int | None = None
    model: str = ""
    retries: int = 5

    def next_call(self, done: dict[int, str], checked: bool) -> tuple[str, int] | None:
        """The first depth that is not there; when all are, the check."""
        depth = next((d for d in range(1, self.depths + 1) if d not in done), None)
        if depth is not None:
            return "rewrite", depth
        return ("quality_check", self.checked) if self.check and self.checked and self.checked <= self.depths and not checked else None

    def ask(self, client: Client, sample: str, fields: dict, done: dict[int, str], kind: str, depth: int) -> dict[str, Any]:
        prompt = self.check(done[depth]) if kind == "quality_check" else self.prompt(fields, done.get(depth - 1, fields.get("text") or ""))
        answer = client(prompt, kind, self.request_id(sample, kind, depth))
        if not answer.get("text"):
            raise RuntimeError(f"an empty answer for {sample} at depth {depth}")
        return answer

    def request_id(self, sample: str, kind: str, depth: int) -> str:
        return hashlib.sha1(f"{self.model}||{sample}||{kind}||{depth}".encode()).hexdigest()[:20]

    def row(self, sample: str, kind: str, depth: int, attempts: int, answer: dict[str, Any] | None) -> Row:
        used = [int((answer or {}).get(k) or 0) for k in ("input_tokens", "output_tokens")]
        return Row(
            sample_id=sample, call_type=kind, depth=depth, text=answer and answer["text"], request_id=self.request_id(sample, kind, depth), attempts=attempts, status="done" if answer else "failed",
            input_tokens=used[0], output_tokens=used[1], total_tokens=sum(used),
        )


def pause(attempts: int) -> float:
    """Seconds to wait after so many failed attempts."""
    return min(LONGEST, 2.0 ** (attempts - 1))


_CLIENTS: dict[Any, Client] = {}


def client_of(config: ChainConfig) -> Client:
    """The worker's client, made once."""
    key = getattr(config.load, "__qualname__", ""), config.model
    if key not in _CLIENTS:
        _CLIENTS[key] = config.load()
    return _CLIENTS[key]


class ChainProcessor(StatefulProcessor):
    """State of a sample: its fields, the failed attempts of the next call, whether its check is done, and its texts by depth."""

    def __init__(self, config: ChainConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.texts = handle.getMapState("texts", "depth int", "text string")
        self.work = handle.getValueState("work", "fields string, attempts int, checked boolean, ended boolean")

    def _step(self, sample: str, now: int) -> Iterator[Row]:
        fields, attempts, checked, ended = self.work.get()
        if ended:
            return
        done = {k[0]: v[0] for k, v in self.texts.iterator()}
        kind, depth = self.config.next_call(done, checked)
        try:
            answer = self.config.ask(client_of(self.config), sample, json.loads(fields), done, kind, depth)
        except Exception:
            attempts += 1
            ended = attempts >= self.config.retries
            self.work.update((fields, attempts, checked, ended))
            if ended:
                yield self.config.row(sample, kind, depth, attempts, None)
            else:
                self.handle.registerTimer(now + int(1000 * pause(attempts)))
            return
        if kind == "rewrite":
            self.texts.updateValue((depth,), (answer["text"],))
            done[depth] = answer["text"]
        else:
            checked = True
        ended = self.config.next_call(done, checked) is None
        self.work.update(("{}" if ended else fields, 0, checked, ended))
        if ended:  # that the sample was done stays, its texts are in the log
            self.texts.clear()
        else:
            self.handle.registerTimer(now + 1)
        yield self.config.row(sample, kind, depth, attempts + 1, answer)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        first = min((r.asDict() for r in rows), key=lambda r: json.dumps(r, sort_keys=True, default=str))
        if not self.work.exists():
            self.work.update((json.dumps(first, default=str), 0, False, False))
            yield from self._step(key[0], timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._step(key[0], timerValues.getCurrentProcessingTimeInMs())

    def handleInitialState(self, key: Any, initialState: Any, timerValues: Any) -> None:  # noqa: N802, N803
        """A sample of an earlier run: ``fields`` (JSON), ``texts`` by depth and ``checked``."""
        texts = dict(initialState.texts or {})
        ended = self.config.next_call(texts, bool(initialState.checked)) is None
        self.work.update((initialState.fields, 0, bool(initialState.checked), ended))
        for depth, text in texts.items():
            self.texts.updateValue((depth,), (text,))
        if not ended:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)

    def close(self) -> None:
        pass


#: The state store that transformWithState needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_stream(samples: DataFrame, config: ChainConfig, done: DataFrame | None = None) -> DataFrame:
    """The calls of a stream of ``samples(sample_id, text, ..)``. ``done`` has ``sample_id, fields, texts, checked`` of an earlier run."""
    samples.sparkSession.conf.set(*STATE_STORE)
    start = done.groupBy("sample_id") if done is not None else None
    return samples.groupBy("sample_id").transformWithState(ChainProcessor(config), CALL, "Append", "ProcessingTime", start)


def run_batch(samples: DataFrame, config: ChainConfig, done: DataFrame | None = None) -> DataFrame:
    """The calls that are still to make for a table of ``samples(sample_id, text, ..)``, in order; ``done`` is the log of earlier runs."""
    fields = samples.select("sample_id", F.to_json(F.struct(*samples.columns)).alias("fields")).groupBy("sample_id").agg(F.min("fields").alias("fields"))
    if done is not None:
        ok = done.filter("status = 'done'")
        texts = ok.groupBy("sample_id").agg(
            F.map_from_entries(F.collect_set(F.when(F.col("call_type") == "rewrite", F.struct("depth", "text")))).alias("texts"),  # a row for each depth
            F.max(F.coalesce((F.col("call_type") == "quality_check") & (F.col("depth") == config.checked), F.lit(False))).alias("checked"),
        )
        fields = fields.join(texts, "sample_id", "left")
    else:
        fields = fields.select("*", F.lit(None).cast("map<int,string>").alias("texts"), F.lit(False).alias("checked"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        client = client_of(config)
        for pdf in batches:
            rows = []
            for sample, known, texts, checked in zip(pdf["sample_id"], pdf["fields"], pdf["texts"], pdf["checked"], strict=True):
                texts = dict(texts) if texts is not None else {}
                checked, own = bool(checked) and checked is not None, json.loads(known)
                while call := config.next_call(texts, checked):
                    for attempt in range(1, config.retries + 1):
                        try:
                            answer = config.ask(client, sample, own, texts, *call)
                            break
                        except Exception:
                            if attempt == config.retries:
                                raise
                            time.sleep(pause(attempt))
                    rows.append(config.row(sample, *call, attempt, answer))
                    if call[0] == "rewrite":
                        texts[call[1]] = answer["text"]
                    else:
                        checked = True
            yield pd.DataFrame([r.asDict() for r in rows], columns=[c.split()[0] for c in CALL.split(", ")])

    return fields.mapInPandas(run, CALL)


def usage_of(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Usage of each depth, with and without checks, and run up, from a log of calls; a call that is in it twice counts once."""
    by = by or []
    once = calls.filter("status = 'done'").dropDuplicates(["request_id"])
    return usage_with_checks(once.select(*by, "depth", (F.col("call_type") == "quality_check").alias("quality"), F.lit(1).cast("long").alias("requests"), "input_tokens", "output_tokens", "total_tokens"), by)
