"""Running a small state machine per key over a stream, in event-time order.

Rows of a key wait in state until the watermark passes them and are then handed to the
machine sorted by ``(ts, ord)``, so neither file order nor micro-batch borders change
the result. Rows wait in chunks, in a map by chunk number; a list of the chunks' times says
which are due, and only those are read, a few at a time. What waits is bounded by the
watermark delay, and one micro-batch by the limits of its source. A key whose machine remembers
nothing and for which nothing waits leaves the store.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

State = dict[str, Any]
Row = dict[str, Any]


class Machine(Protocol):
    """What one key does with its next row. State must be plain JSON."""

    def step(self, state: State, row: Row) -> list[tuple]:
        """Change ``state`` and return output rows (without the key)."""

    def expire(self, state: State, watermark: int) -> list[tuple]:
        """React to time passing, in microseconds; called when a wake-up is due."""

    def wake_at(self, state: State) -> int | None:
        """Event time in microseconds at which :meth:`expire` is wanted."""


#: Rows of a chunk, and of a frame of output.
CHUNK, OUT = 512, 4096


class OrderedProcessor(StatefulProcessor):
    """Feeds a machine in event-time order; see the module text.

    ``state`` holds the machine's state and the index of the chunks, (first, last, number) each;
    ``waiting`` the chunks' rows.
    """

    def __init__(self, machine: Machine, columns: list[str]):
        self.machine, self.columns = machine, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string, chunks string, next bigint")
        self.waiting = handle.getMapState("waiting", "chunk bigint", "rows string")

    def _store(self, rows: list, chunks: list, number: int) -> int:
        """Put sorted rows into chunks of their own; returns the next free number."""
        for at in range(0, len(rows), CHUNK):
            part = rows[at : at + CHUNK]
            self.waiting.updateValue((number,), (json.dumps(part),))
            chunks.append([part[0][0], part[-1][0], number])
            number += 1
        return number

    def _due(self, chunks: list, limit: int) -> Iterator[list]:
        """Rows up to ``limit`` in order. Takes the chunks that are read out of the list; rows
        of theirs that are not due come as a last list under ``rest``."""
        chunks.sort()
        ready: list = []
        self.rest: list = []
        while ready or (chunks and chunks[0][0] <= limit):
            # whatever may come before the first ready row must be read
            while chunks and chunks[0][0] <= limit and (not ready or chunks[0][0] <= ready[0][0]):
                number = chunks.pop(0)[2]
                rows = json.loads(self.waiting.getValue((number,))[0])
                self.waiting.removeKey((number,))
                self.rest += [r for r in rows if r[0] > limit]
                for r in rows:
                    if r[0] <= limit:
                        heapq.heappush(ready, r)
            yield heapq.heappop(ready)

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=self.columns, dtype=object)

    def _advance(self, key: tuple, fresh: Iterator[list], watermark_ms: int) -> Iterator[pd.DataFrame]:
        limit = watermark_ms * 1000
        kept = self.state.get() if self.state.exists() else None
        state: State = json.loads(kept[0]) if kept else {}
        chunks, number = (json.loads(kept[1]), kept[2]) if kept else ([], 0)
        for rows in fresh:
            number = self._store(sorted(rows), chunks, number)
        out: list[tuple] = []
        for ts, _, body in self._due(chunks, limit):
            wake = self.machine.wake_at(state)
            if wake is not None and wake < ts:
                out += self.machine.expire(state, ts)
            out += self.machine.step(state, {**json.loads(body), "ts": ts})
            if len(out) >= OUT:
                yield self._frame(key, out)
                out = []
        number = self._store(sorted(self.rest), chunks, number)
        first = min((c[0] for c in chunks), default=None)
        wake = self.machine.wake_at(state)
        if wake is not None and wake < limit and (first is None or wake < first):
            out += self.machine.expire(state, limit)
            wake = self.machine.wake_at(state)
        if state or chunks:
            self.state.update((json.dumps(state), json.dumps(chunks), number))
        else:
            self.state.clear()
        for at in {first, wake} - {None}:
            self.handle.registerTimer(at // 1000 + 1)
        yield self._frame(key, out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = (
            [[int(ts), int(order), body] for ts, order, body in zip(pdf["micros"], pdf["tie"], pdf["body"])] for pdf in rows if len(pdf)
        )
        yield from self._advance(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, iter(()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def run_machine(
    events: DataFrame, key: str, machine: Machine, output: str, delay: str = "10 minutes"
) -> DataFrame:
    """Stream of the machine's outputs: ``key`` and the columns of the ``output`` schema.

    ``events`` carry the key, ``ts`` (timestamp), ``ord`` (tie-break) and the columns the
    machine reads. Timestamps reach it, and leave it, as microseconds.
    """
    payload = F.to_json(F.struct(*[c for c in events.columns if c not in (key, "ts", "ord")]), {"ignoreNullFields": "false"})
    ready = events.withWatermark("ts", delay).select(
        key, "ts", F.unix_micros("ts").alias("micros"), F.col("ord").cast("bigint").alias("tie"), payload.alias("body")
    )
    schema = T.StructType([events.schema[key], *T.StructType.fromDDL(output).fields])
    return ready.groupBy(key).transformWithStateInPandas(
        OrderedProcessor(machine, schema.names), schema, "append", "eventTime"
    )
