"""Streaming forms of the planning operators: events arrive, scenes and gaps go out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def activity(events: DataFrame, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Events and their mean value by kind and window; late events are dropped by watermark."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return counted.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def latest(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events once each, though a source may send one again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def smoothed(events: DataFrame, step: float = 0.30) -> DataFrame:
    """Energy of each user bounded to steps, the last value kept as state across batches."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        for frame in frames:
            rows = frame.sort_values(["ts", "event_id"])
            out = []
            for raw in (rows["value"] / 200.0).clip(0.0, 1.0):
                last = raw if last is None else min(last + step, max(last - step, raw))
                out.append(round(last, 4))
            yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "energy": out})
        if last is not None:
            state.update((last,))

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, energy double", "energy double", "append", GroupStateTimeout.NoTimeout)
