"""Check-ins per tumbling window with the late ones kept: windowed + late = all.

The windowed count of :func:`frostline.streaming.punches.checkins_per_window` drops what comes after its window was
closed. Here one stateful operator keeps the open windows, packed by block (a hash of the window), closes each with an
event-time timer and hands on every row that comes later than that, with the window it would have been in and how late
it was. Rows carry no event time of their own, so Spark drops none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from frostline.sources.feeds import with_instant
from frostline.sources.shared import let_workers_import
from frostline.streaming.shifts import NEVER

_OPEN = np.dtype([(n, "<i8") for n in ("starts", "checkins", "verified")])
_ROW = "late boolean, starts long, checkins long, verified long, shift_id long, punched_at string, late_us long"


class Windows(StatefulProcessor):
    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("open", "windows binary, timer long")

    def _step(self, frames: list[pd.DataFrame], now: int) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        windows, timer = (np.frombuffer(held[0], _OPEN), held[1]) if held else (np.zeros(0, _OPEN), NEVER)
        if frames:
            rows = pd.concat(frames)
            late = rows["starts"] + self.length <= now
            if late.any():
                missed = rows[late]
                yield pd.DataFrame({
                    "late": True, "starts": missed["starts"], "checkins": 1, "verified": missed["verified"],
                    "shift_id": missed["shift_id"], "punched_at": missed["punched_at"], "late_us": now - missed["at_us"],
                })
            fresh = rows[~late]
            starts = np.concatenate([windows["starts"], fresh["starts"].to_numpy()])
            unique, inverse = np.unique(starts, return_inverse=True)
            merged = np.zeros(len(unique), _OPEN)
            merged["starts"] = unique
            for name, ours in (("checkins", np.ones(len(fresh), np.int64)), ("verified", fresh["verified"].to_numpy())):
                merged[name] = np.bincount(inverse, np.concatenate([windows[name], ours]), len(unique))
            windows = merged
        closed = windows["starts"] + self.length <= now
        if closed.any():
            done = windows[closed]
            yield pd.DataFrame({
                "late": False, "starts": done["starts"], "checkins": done["checkins"], "verified": done["verified"],
                "shift_id": NEVER, "punched_at": None, "late_us": 0,
            })
        windows = windows[~closed]
        if not len(windows):
            self.held.clear()
            return
        due = -(-int(windows["starts"].min() + self.length) // 1000) * 1000
        if due != timer:
            if now < timer != NEVER:
                self.handle.deleteTimer(timer // 1000)
            self.handle.registerTimer(due // 1000)
        self.held.update((windows.tobytes(), due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self._step(list(rows), timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._step([], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def checkins_with_late(
    punches: DataFrame, minutes: int = 15, delay: str = "2 hours", ticks: DataFrame | None = None, blocks: int = 64
) -> DataFrame:
    """Closed windows (``late`` false) with their counts, and late check-ins (``late`` true), one row each, with the
    window they missed and the seconds the clock was past their time. The counts of a window plus its late rows are
    all its check-ins."""
    let_workers_import(punches.sparkSession)
    length = minutes * 60_000_000
    timed = with_instant(punches.where(F.col("punch_type") == "in"), "punched_at").where(F.col("at").isNotNull())
    at, none = F.unix_micros("at"), F.lit(None).cast("timestamp").alias("clock")
    made = timed.select(
        (at - F.pmod(at, F.lit(length))).alias("starts"), at.alias("at_us"), F.when(F.col("gps_verified") == 1, 1).otherwise(0).cast("long").alias("verified"),
        F.coalesce("shift_id", F.lit(NEVER)).alias("shift_id"), "punched_at", none,
    )
    clock = F.col("at").alias("clock")
    rows = made.unionByName(timed.select(clock), allowMissingColumns=True)
    if ticks is not None:
        rows = rows.unionByName(ticks.select(clock), allowMissingColumns=True)
    rows = rows.withWatermark("clock", delay).where(F.col("starts").isNotNull() | F.col("clock").isNull())
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("starts"), F.lit(blocks)))
    told = keyed.groupBy("block").transformWithStateInPandas(
        Windows(length), outputStructType=_ROW, outputMode="Append", timeMode="EventTime"
    )
    return told.select(
        "late", F.timestamp_micros("starts").alias("window_start"), F.timestamp_micros(F.col("starts") + length).alias("window_end"),
        "checkins", "verified", F.when(F.col("shift_id") != NEVER, F.col("shift_id")).alias("shift_id"), "punched_at",
        (F.col("late_us") / 1_000_000).cast("long").alias("late_seconds"),
    )
