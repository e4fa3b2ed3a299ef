"""Operators that keep state per key between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _expire(state: GroupState, kept: tuple, until_us: int) -> None:
    """Keeps the state until the watermark passes a time; Spark wants that to lie after the watermark."""
    state.update(kept)
    state.setTimeoutTimestamp(max(until_us // 1000, state.getCurrentWatermarkMs()) + 1)


def previous_positions(stream: DataFrame, ttl_s: int = 120, late: str = "10 minutes") -> DataFrame:
    """Each position (vehicle_id, event_id, us, lat, lon) with the one before it of its vehicle, if that is at most
    `ttl_s` old and elsewhere; else nulls. State: the last position, dropped once the stream's watermark (`late`
    behind its newest `ts`) has passed the time at which it can be used.

    Within a micro-batch a vehicle's rows are ordered by time; rows that arrive in a later batch follow in that order,
    and rows later than the watermark are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"], kind="stable")
        out = []
        for r in rows.itertuples():
            use = last is not None and r.us - last[0] <= ttl_s * 1_000_000 and (r.lat != last[1] or r.lon != last[2])
            out.append((key[0], r.event_id, r.us, r.lat, r.lon, *(last[1:] if use else (None, None))))
            last = (r.us, r.lat, r.lon)
        _expire(state, last, last[0] + ttl_s * 1_000_000)
        yield pd.DataFrame(out, columns=["vehicle_id", "event_id", "us", "lat", "lon", "prev_lat", "prev_lon"])

    schema = "vehicle_id bigint, event_id bigint, us bigint, lat double, lon double, prev_lat double, prev_lon double"
    timed = stream.withWatermark("ts", late)
    return timed.groupBy("vehicle_id").applyInPandasWithState(step, schema, "us bigint, lat double, lon double", "append", GroupStateTimeout.EventTimeTimeout)


def suppress_repeats(stream: DataFrame, keys: list[str], hold_s: int, late: str = "10 minutes") -> DataFrame:
    """Signals (keys, event_id, us), each let through unless one of its key was within the last `hold_s` seconds.
    State: the time of the last signal let through."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values(["us", "event_id"], kind="stable").itertuples():
            if last is None or r.us - last >= hold_s * 1_000_000:
                last = r.us
                out.append((*key, r.event_id, r.us))
        _expire(state, (last,), last + hold_s * 1_000_000)
        yield pd.DataFrame(out, columns=[*keys, "event_id", "us"])

    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    timed = stream.withWatermark("ts", late)
    return timed.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, event_id bigint, us bigint", "us bigint", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, width: str, late: str) -> DataFrame:
    """Events per aligned window and kind; rows later than `late` are dropped, and so is the state behind that."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
