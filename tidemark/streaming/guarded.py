"""Guarded updates as a stream: the record, the events that wait for their turn, and a timer live in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.guarded import VERDICTS, judged, plain

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECORD = "generation long, reserved long, upto long"
EVENT = "kind string, expected long, amount long"


class Guard(StatefulProcessor):
    """A value: generation, reserved and the last place judged.  A map: place -> event that came too early.

    While something waits, a timer runs; when it fires the gap is given up and judging goes on behind it.
    """

    def __init__(self, cap: int, patience_ms: int, key: str):
        self.cap, self.patience, self.key = cap, patience_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD)
        self.early = handle.getMapState("early", "seq long", EVENT)

    def now(self) -> tuple[int, int, int]:
        return tuple(self.record.get()) if self.record.exists() else (0, 0, 0)

    def advanced(self, k, out: list) -> None:
        """Judges what waits, as far as no place is missing."""
        generation, reserved, upto = self.now()
        while self.early.containsKey((upto + 1,)):
            kind, expected, amount = self.early.getValue((upto + 1,))
            self.early.removeKey((upto + 1,))
            verdict, generation, reserved = judged(generation, reserved, kind, plain(expected), plain(amount), self.cap)
            upto += 1
            out.append((k, upto, verdict, generation, reserved))
        self.record.update((generation, reserved, upto))

    def timed(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if any(True for _ in self.early.keys()):
            self.handle.registerTimer(at + self.patience)

    def frame(self, out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[self.key, "seq", "verdict", "generation", "reserved"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list = []
        for pdf in rows:
            for seq, kind, expected, amount in pdf[["seq", "kind", "expected", "amount"]].itertuples(index=False, name=None):
                generation, reserved, upto = self.now()
                if seq <= upto or self.early.containsKey((int(seq),)):
                    out.append((key[0], int(seq), "repeated", generation, reserved))
                else:
                    self.early.updateValue((int(seq),), (kind, plain(expected), plain(amount)))
                    self.advanced(key[0], out)
        self.timed(timerValues.getCurrentProcessingTimeInMs())
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list = []
        waiting = [k[0] for k in self.early.keys()]
        if waiting:
            generation, reserved, _ = self.now()
            self.record.update((generation, reserved, min(waiting) - 1))
            self.advanced(key[0], out)
        if any(True for _ in self.early.keys()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield self.frame(out)


def guarded(events: DataFrame, cap: int, *, key: str = "key", patience_ms: int = 60_000) -> DataFrame:
    """The verdicts of ``tidemark.operators.guarded``, for a stream of events (key, seq, kind, expected, amount).

    Events wait until every place before theirs was judged, or for ``patience_ms`` at most.  Of the verdict ``repeated`` the
    generation and the reserved amount are those when the event came.  Needs the state store ``STORE``.
    """
    kind = events.schema[key].dataType.simpleString()
    whole = events.where(events[key].isNotNull() & events["seq"].isNotNull())
    return whole.groupBy(key).transformWithStateInPandas(Guard(cap, patience_ms, key), f"{key} {kind}, {VERDICTS}", "Append", "ProcessingTime")
