"""Arrivals paired in keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from palimpsest.functions.shipping import ship

ship(__name__)

# What became of an arrival.
PAIRED, NO_BEFORE, NO_AFTER = "paired", "no before", "no after"

# Groups of keys that share a state and a timer.
BUCKETS = 1024

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Timers need the store on disk; the session's own choice comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Pairing(StatefulProcessor):
    """Per bucket of keys the arrivals that wait for their partner, and one
    timer for the first of them to leave."""

    def __init__(self, within_ms: int):
        self._within = within_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "key string, side string, at long, value string")
        self._due = handle.getValueState("due", "due long")

    def _held(self) -> dict[str | None, list[tuple]]:
        """What waits by key, in the order in which it came."""
        held: dict[str | None, list[tuple]] = {}
        for key, side, at, value in self._waiting.get() if self._waiting.exists() else ():
            held.setdefault(key, []).append((side, at, value))
        return held

    def _keep(self, held: dict[str | None, list[tuple]]) -> None:
        rows = [(key, *w) for key, waiting in held.items() for w in waiting]
        if rows:
            self._waiting.put(rows)
        else:
            self._waiting.clear()
        due = min((r[2] for r in rows), default=None)
        if due is not None:
            set_for = self._due.get()[0] if self._due.exists() else None
            # A timer that is set too early finds nothing and sets the next.
            if set_for is None or due + self._within < set_for:
                if set_for is not None:
                    self._handle.deleteTimer(set_for)
                self._handle.registerTimer(due + self._within)
                self._due.update((due + self._within,))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["key", "before_value", "after_value", "outcome"], dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, came, out = self._held(), [], []
        for pdf in rows:
            came += zip(pdf["key"], pdf["side"], pdf["at"].astype("int64").tolist(), pdf["value"], strict=True)
        for name, side, at, value in sorted(came, key=lambda r: (r[2], r[1], r[3] or "")):
            waiting = held.setdefault(name, [])
            nth = next(
                (i for i, w in enumerate(waiting) if w[0] != side and abs(at - w[1]) <= self._within), None
            )
            if nth is None:
                waiting.append((side, at, value))
                continue
            partner = waiting.pop(nth)
            values = (value, partner[2]) if side == "before" else (partner[2], value)
            out.append((name, *values, PAIRED))
        self._keep(held)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        out, left = [], {}
        for name, waiting in self._held().items():
            for w in waiting:
                if w[1] + self._within > limit:
                    left.setdefault(name, []).append(w)
                elif w[0] == "before":
                    out.append((name, w[2], None, NO_AFTER))
                else:
                    out.append((name, None, w[2], NO_BEFORE))
        self._due.clear()
        self._keep(left)
        yield self._frame(out)

    def close(self) -> None:
        pass


def pair_or_expire(
    before: DataFrame, after: DataFrame, key: str, time: str, value: str, within_seconds: int,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``(key, before_value, after_value, outcome)``, values as strings.

    Each arrival is paired with the earliest waiting one of the other side that
    is at most ``within_seconds`` away. One that stays alone is not forgotten
    silently: once the watermark, which trails the slower side by the same time,
    has passed the end of its wait it is emitted with the side that is missing,
    and leaves the state. Run it inside ``keyed_state``.

    Keys are dealt to ``buckets`` by hash, and state and timer are a bucket's,
    so that a call into Python serves many keys. A bucket holds what waits and
    what a batch brings for its keys: a stream with very large batches should
    name more of them, and a restart the same number. A key is of a kind that a
    cast to a string and back leaves as it is.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"),
            F.col(key).cast("string").alias("key"),
            F.col(time).cast("timestamp").alias("_time"),
            F.lit(name).alias("side"),
            F.unix_millis(F.col(time).cast("timestamp")).alias("at"),
            F.col(value).cast("string").alias("value"),
        ).withWatermark("_time", f"{within_seconds} seconds")

    kind = before.schema[key].dataType.simpleString()
    return (
        side(before, "before")
        .unionByName(side(after, "after"))
        .groupBy("bucket")
        .transformWithStateInPandas(
            _Pairing(within_seconds * 1000),
            "key string, before_value string, after_value string, outcome string",
            "Append",
            "EventTime",
        )
        .select(F.col("key").cast(kind).alias(key), "before_value", "after_value", "outcome")
    )
