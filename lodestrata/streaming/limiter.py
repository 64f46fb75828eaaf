"""Token bucket per key, in event time.

A bucket holds ``capacity`` tokens and refills evenly over ``window`` seconds; an event
takes one token or is rejected with the seconds until one is there. What a
rejected event leaves depends on all before it, so the state is sequential per
key. The batch form sorts by key and time within partitions and carries one
bucket along, so a hot key costs no memory; the stream keeps a bucket per key.

Defined edge cases: null keys share one bucket; null times come first; events of
one instant are taken in the order of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bucket:
    def __init__(self, capacity: float, window: float, level: float | None = None, at: float | None = None):
        self.capacity, self.window = capacity, window
        self.level, self.at = (capacity if level is None else level), at

    def take(self, now: float) -> tuple[bool, float]:
        """Whether the event passes, and the seconds to wait if it does not."""
        if self.at is not None and now > self.at:
            self.level = min(self.capacity, self.level + (now - self.at) / self.window * self.capacity)
        self.at = now if self.at is None else max(self.at, now)
        if self.level >= 1:
            self.level -= 1
            return True, 0.0
        return False, (1 - self.level) / self.capacity * self.window


def limit(events: DataFrame, key: str, time: str, order: str, capacity: int = 60, window: int = 60) -> DataFrame:
    """``order, key, allowed, retry_after`` of every event of a batch."""
    kinds = dict(events.dtypes)
    rows = events.select(order, key, F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    ordered = rows.repartition(key).sortWithinPartitions(key, "us", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, bucket = object(), None
        for pdf in batches:
            out = []
            for one, who, us in zip(pdf[order], pdf[key], pdf.us):
                if bucket is None or not (who == last or (pd.isna(who) and pd.isna(last))):
                    last, bucket = who, Bucket(capacity, window)
                ok, wait = bucket.take(0.0 if pd.isna(us) else us / 1e6)
                out.append((one, who, ok, round(wait, 6)))
            yield pd.DataFrame(out, columns=[order, key, "allowed", "retry_after"])

    return ordered.mapInPandas(run, f"`{order}` {kinds[order]}, `{key}` {kinds[key]}, allowed boolean, retry_after double")


def limit_stream(events: DataFrame, key: str, time: str, order: str, capacity: int = 60, window: int = 60) -> DataFrame:
    """The same for a stream: one bucket of state per key, dropped when event time has passed the instant at which it is full again."""
    kinds = dict(events.dtypes)

    def run(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(capacity, window, *(state.get if state.exists else (None, None)))
        # the events of one key in one micro-batch
        pdf = pd.concat(list(frames)).sort_values(["us", order])
        taken = [bucket.take(us / 1e6) for us in pdf.us]
        state.update((bucket.level, bucket.at))
        state.setTimeoutTimestamp(max(int((bucket.at + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({order: pdf[order], key: pdf[key], "allowed": [t[0] for t in taken], "retry_after": [round(t[1], 6) for t in taken]})

    timed = events.where(F.col(time).isNotNull()).withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", f"{window} seconds")
    rows = timed.select(order, key, "at", F.unix_micros("at").alias("us"))
    return rows.groupBy(key).applyInPandasWithState(run, f"`{order}` {kinds[order]}, `{key}` {kinds[key]}, allowed boolean, retry_after double", "level double, at double", "append", "EventTimeTimeout")
