"""Tasks of one stage that run side by side and keep their data between the rounds of an iteration.

They run in Spark's barrier mode, which starts all of them at once and, if one fails, all of them again. They exchange bytes over connections to the first one:
Spark's own exchange takes a second each time. What they exchange must be bounded, or small against the rows.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from multiprocessing.connection import Client, Connection, Listener
from typing import Any

import numpy as np
from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession

#: Most tasks that are run side by side; the first one hears them all.
MOST = 64


def slots(spark: SparkSession) -> int:
    """How many tasks can run side by side now; 0 where that is not known or may change while they run."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    try:
        context = spark.sparkContext._jsc.sc()
        free = context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())
    except Exception:  # no classic session, or another version
        return 0
    return max(0, min(MOST, int(free)))


class Circle:
    """The tasks of a barrier stage. All of them must call the same methods in the same order; a lost one ends the others with an ``EOFError``."""

    def __init__(self, secret: bytes) -> None:
        context = BarrierTaskContext.get()
        hosts = [i.address.rpartition(":")[0] for i in context.getTaskInfos()]
        self.number, self.size = context.partitionId(), len(hosts)
        self.others: list[Connection] = []
        listener = Listener((hosts[0], 0), backlog=MOST, authkey=secret) if self.number == 0 else None
        ports = context.allGather(str(listener.address[1]) if listener else "")
        if listener:
            with listener:
                self.others = [listener.accept() for _ in range(self.size - 1)]
        else:
            self.others = [Client((hosts[0], int(ports[0])), authkey=secret)]

    def __enter__(self) -> Circle:
        return self

    def __exit__(self, *error: object) -> None:
        for c in self.others:
            c.close()

    def _shared(self, own: bytes, merge: Callable[[list[bytes]], bytes]) -> bytes:
        if self.number:
            self.others[0].send_bytes(own)
            return self.others[0].recv_bytes()
        out = merge([own, *[c.recv_bytes() for c in self.others]])
        for c in self.others:
            c.send_bytes(out)
        return out

    def gathered(self, own: bytes) -> list[bytes]:
        """What each task gives, in no certain order."""
        whole, out, at = self._shared(own, lambda parts: b"".join(struct.pack("q", len(p)) + p for p in parts)), [], 0
        while at < len(whole):
            n = struct.unpack_from("q", whole, at)[0]
            out.append(whole[at + 8 : at + 8 + n])
            at += 8 + n
        return out

    def total(self, own: np.ndarray) -> np.ndarray:
        """The sum of what each task gives, the same bytes in all of them."""
        return np.frombuffer(self._shared(own.tobytes(), lambda parts: sum(np.frombuffer(p, own.dtype) for p in parts).tobytes()), own.dtype)

    def told(self, own: bytes) -> bytes:
        """What the first task gives."""
        return self._shared(own if self.number == 0 else b"", lambda parts: parts[0])

    def said(self, of: Callable[[], Any]) -> Any:
        """What the first task finds, in all tasks: floats of different machines may differ in their last bit, and all must decide alike."""
        import json

        return json.loads(self.told(json.dumps(of()).encode() if self.number == 0 else b""))
