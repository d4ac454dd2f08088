"""Structured Streaming forms of request control, retention and incremental ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lekhya import fixed_values as fv
from lekhya.operators.requests import bucket_step, epoch_seconds


def rate_limit_stream(events: DataFrame, key: str, event_id: str, ts: str,
                      per_minute: float = fv.RATE_PER_MINUTE, burst: float = fv.RATE_BURST,
                      watermark: str = "10 minutes") -> DataFrame:
    """Token bucket per key with the bucket as streaming state.

    State is dropped once a bucket must be full again, since a new one is full too.
    """
    rate, capacity = per_minute / 60.0, per_minute + burst
    key_type, id_type = [events.schema[c].dataType.simpleString() for c in (key, event_id)]

    def step(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        for rows in batches:  # arrival order, one Arrow batch at a time
            allowed, wait = [], []
            for t in rows["seconds"]:
                tokens, ok, retry = bucket_step(tokens, 0.0 if last is None else t - last, rate,
                                                capacity)
                last = t if last is None else max(last, t)
                allowed.append(ok)
                wait.append(retry)
            yield pd.DataFrame({event_id: rows[event_id], key: group[0], "allowed": allowed,
                                "retry_after": wait})
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int((last + capacity / rate) * 1000),
                                      state.getCurrentWatermarkMs() + 1))

    return (events.withWatermark(ts, watermark)
            .select(event_id, key, ts, epoch_seconds(ts).alias("seconds"))
            .groupBy(key).applyInPandasWithState(
                step, f"{event_id} {id_type}, {key} {key_type}, allowed boolean, retry_after int",
                "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout))


def first_calls_stream(calls: DataFrame, keys: list[str], ts: str,
                       ttl: str = "24 hours") -> DataFrame:
    """Only the first call with each idempotency key within the retention time."""
    return calls.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def unexpired_stream(turns: DataFrame, ts: str, ttl: str) -> DataFrame:
    """Turns that arrive before their retention time is over; late ones are dropped."""
    return turns.withWatermark(ts, ttl).filter(
        F.col(ts) >= F.current_timestamp() - F.expr(f"INTERVAL {ttl}"))


def ingest_stream(items: DataFrame, process, checkpoint: str, once: bool = True):
    """Run an ingestion step per micro-batch; ``process(batch, batch_id)`` appends results.

    The checkpoint remembers which files were taken, so a rerun adds nothing.
    """
    writer = items.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
