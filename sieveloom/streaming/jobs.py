"""Streams: polling of jobs, admission of users, throttles and latest results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States in which a job has ended, well or not.
DONE, FAILED = ("completed", "ended"), ("failed", "expired", "canceled")


def job_ends(events: DataFrame) -> DataFrame:
    """Events of jobs (batch_id, ts, status) that end them, with how; the poll interval is the query's trigger."""
    return events.where(F.col("status").isin(*DONE, *FAILED)).withColumn("ok", F.col("status").isin(*DONE))


def admitted(events: DataFrame, allowed: DataFrame, key: str = "user_id") -> DataFrame:
    """Events of allowed users: a stream joined to a static table."""
    return events.join(allowed.select(key).distinct(), key, "left_semi")


def throttled(events: DataFrame, every: float, key: str = "user_id", ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """(key, ts) of events that pass: each key's first, then any that come `every` seconds after the last that passed.

    State is one time per key, and is dropped once the watermark is `every` seconds past it, since the key's next event
    passes then anyway. Event time is used, so that a rerun gives the same result; events later than the watermark are dropped.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed: list = []
        if state.hasTimedOut:
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for t in pd.concat([*frames])[ts].sort_values():
                if last is None or t.timestamp() - last >= every:
                    last = t.timestamp()
                    passed.append(t)
            if last is not None:
                state.update((last,))
                state.setTimeoutTimestamp(max(int((last + every) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]] * len(passed), ts: passed})

    return events.select(key, ts).withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, f"{key} long, {ts} timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def throttled_batch(events: DataFrame, every: float, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The same over a table: one walk over each key's times in order, which holds one time."""
    rows = events.select(F.col(key).cast("long").alias(key), F.col(ts).cast("timestamp").cast("double").alias("t")).where("t is not null")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = last = None
        for batch in batches:
            passed = []
            for k, (who, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if last is None or who != of or t - last >= every:
                    of, last = who, t
                    passed.append(k)
            yield batch.take(pa.array(passed, pa.int64()))

    out = rows.repartition(key).sortWithinPartitions(key, "t").mapInArrow(walk, f"{key} long, t double")
    return out.select(key, F.timestamp_seconds("t").alias(ts))


def latest(events: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The last event of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), ts).alias("e")).select(key, "e.*")
