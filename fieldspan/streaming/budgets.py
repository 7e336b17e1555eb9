"""Streams: incremental extraction, event-time windows, count-based drift and admission by state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(rows: DataFrame, when: str, size: str, late: str, by: str) -> DataFrame:
    """Count and sum of value by window and group; rows later than ``late`` are dropped by the watermark."""
    return rows.withWatermark(when, late).groupBy(F.window(when, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def first_seen(rows: DataFrame, key: str, when: str, late: str) -> DataFrame:
    """Each key's first row within the watermark: repeated documents are answered once."""
    return rows.withWatermark(when, late).dropDuplicatesWithinWatermark([key])


def admitted(rows: DataFrame, by: str, limit: int, seconds: int = 60, idle: int = 3600) -> DataFrame:
    """by, event_id, admitted: at most ``limit`` admitted calls a group in any ``seconds``, in order of ts within a batch.

    State: the times of admitted calls of the last ``seconds``, at most ``limit``; a
    group that nothing came for in ``idle`` seconds is forgotten.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for at, event in zip(rows["at"], rows["event_id"]):
            held = [t for t in held if t > at - seconds * 1_000_000]
            ok = len(held) < limit
            if ok:
                held.append(int(at))
            out.append(ok)
        state.update((held,))
        state.setTimeoutDuration(idle * 1000)
        yield pd.DataFrame({by: key[0], "event_id": rows["event_id"], "admitted": out})

    kind = dict(rows.dtypes)[by]
    shaped = rows.select(by, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return shaped.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, event_id long, admitted boolean", "held array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def drift(rows: DataFrame, by: str, size: int = 200) -> DataFrame:
    """by, n, none_rate, mean of the last ``size`` values of each group, after each batch.

    State: those values, null for none.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("event_id")
        held = (held + [None if pd.isna(v) else float(v) for v in rows["confidence"]])[-size:]
        state.update((held,))
        known = [v for v in held if v is not None]
        yield pd.DataFrame({by: [key[0]], "n": [len(held)], "none_rate": [1 - len(known) / len(held)], "mean_confidence": [sum(known) / len(known) if known else None]})

    kind = dict(rows.dtypes)[by]
    return rows.select(by, "event_id", "confidence").groupBy(by).applyInPandasWithState(step, f"{by} {kind}, n long, none_rate double, mean_confidence double", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def with_snapshot(rows: DataFrame, load: Callable[[], DataFrame], apply: Callable[[DataFrame, DataFrame], DataFrame], sink: Callable[[DataFrame, int], Any], checkpoint: str) -> Any:
    """Starts a stream of which each batch sees the learned state as it was when the batch began."""

    def batch(df: DataFrame, number: int) -> None:
        sink(apply(df, load()), number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
