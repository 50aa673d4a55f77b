"""Guarded updates of a key's record: compare-and-set by generation, and reservations under a cap.

An event has a key, a place ``seq`` in the key's history (1, 2, …), a kind, the generation it expects (null: any) and an
amount.  It is applied, which raises the generation by one, or refused, which changes nothing:

* ``stale``: it expects another generation than the record has;
* ``invalid``: an amount that is null or negative, where its kind needs one;
* ``over the cap``: a reservation that would bring what is reserved above the cap;
* ``over-release``: a release of more than is reserved;
* ``repeated``: its place was taken before.

``folded`` judges whole histories; ``tidemark.streaming.guarded`` judges events as they arrive, in any order, and agrees with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

VERDICTS = "seq long, verdict string, generation long, reserved long"


def judged(generation: int, reserved: int, kind: str | None, expected: int | None, amount: int | None, cap: int) -> tuple[str, int, int]:
    """The verdict on one event, and the record after it."""
    if expected is not None and expected != generation:
        return "stale", generation, reserved
    if kind in ("reserve", "release"):
        if amount is None or amount < 0:
            return "invalid", generation, reserved
        after = reserved + amount if kind == "reserve" else reserved - amount
        if after > cap:
            return "over the cap", generation, reserved
        if after < 0:
            return "over-release", generation, reserved
        reserved = after
    return "applied", generation + 1, reserved


def plain(x) -> int | None:
    return None if pd.isna(x) else int(x)


def folded(events: DataFrame, cap: int, *, key: str = "key") -> DataFrame:
    """``key``, ``seq``, ``verdict``, ``generation``, ``reserved`` for each of ``events`` (key, seq, kind, expected, amount).

    A key's events are sorted in one task, by Spark, which spills, and pass one after the other through a
    fold that holds one record: each step depends on the one before.  Events without key or place are left out; of
    events with one place the least (kind, expected, amount) counts.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seq, generation, reserved = None, None, 0, 0
        for pdf in batches:
            out = []
            for k, s, what, expected, amount in pdf.itertuples(index=False, name=None):
                if k != at:
                    at, seq, generation, reserved = k, None, 0, 0
                if s == seq:
                    verdict = "repeated"
                else:
                    verdict, generation, reserved = judged(generation, reserved, what, plain(expected), plain(amount), cap)
                    seq = s
                out.append((k, s, verdict, generation, reserved))
            yield pd.DataFrame(out, columns=[key, "seq", "verdict", "generation", "reserved"])

    columns = [key, "seq", "kind", "expected", "amount"]
    ordered = events.select(*columns).where(events[key].isNotNull() & events["seq"].isNotNull()).repartition(key).sortWithinPartitions(*columns)
    return ordered.mapInPandas(run, f"{key} {kind}, {VERDICTS}")
