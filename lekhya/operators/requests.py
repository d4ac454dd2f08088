"""Request control over event tables: token buckets, idempotent replays, crawl pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lekhya import fixed_values as fv
from lekhya.operators.pointers import first_at_or_after, reached
from lekhya.operators.scale import previous_row, running, scan_in_order, stretches
from lekhya.session import stage


def epoch_seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def bucket_step(tokens: float, idle: float, rate: float, capacity: float,
                cost: float = 1.0) -> tuple[float, bool, int]:
    """One request: (tokens left, allowed, seconds to wait when refused)."""
    tokens = min(capacity, tokens + max(0.0, idle) * rate)
    if tokens >= cost:
        return tokens - cost, True, 0
    return tokens, False, max(1, int((cost - tokens) / rate))


def rate_limit(events: DataFrame, key: str, event_id: str, ts: str,
               per_minute: float = fv.RATE_PER_MINUTE,
               burst: float = fv.RATE_BURST) -> DataFrame:
    """Whether each request passes its key's token bucket.

    A bucket is full again after an idle time of capacity / rate, whatever happened
    before, so keys are cut at such pauses and the pieces run independently.
    """
    rate, capacity = per_minute / 60.0, per_minute + burst
    rows = events.select(event_id, key, epoch_seconds(ts).alias("seconds"))
    cut = stretches(rows, [key], ["seconds", event_id], "seconds", capacity / rate)

    def step(state, t):
        tokens, last = state
        tokens, ok, retry = bucket_step(tokens, 0.0 if last is None else t - last, rate, capacity)
        return (tokens, t), ok, retry

    return scan_in_order(cut, [key, "stretch"], ["seconds", event_id], [event_id, key],
                         ["seconds"], lambda: (capacity, None), step,
                         "allowed boolean, retry_after int")


def idempotent_replays(calls: DataFrame, keys: list[str], call_id: str, ts: str,
                       payload_hash: str, ttl_seconds: int = 86400) -> DataFrame:
    """What each call with an idempotency key gets.

    ``executed`` stores a record that lives for the TTL; within it the same payload
    is ``replayed`` and another payload is a ``conflict``.  ``keys`` must name the
    caller and endpoint too, so that callers do not share records, and ``call_id`` a
    call of a key.  A call without a time stores nothing and is executed.

    Each call points at the first one that would find its record expired.  Calls after an
    idle time of a TTL are executed, and so is every call on the pointers from them; they are
    followed by doubling, so that a key without any pause is spread over all tasks.
    """
    order = ["seconds", call_id]
    rows = calls.select(*keys, call_id, payload_hash, epoch_seconds(ts).alias("seconds"))
    timed = stage(rows.filter("seconds IS NOT NULL"))
    node = F.struct(*keys, *order)
    linked = first_at_or_after(timed, keys, "seconds", call_id, ttl_seconds, "then")
    links = linked.select(node.alias("node"), F.when(F.col("then").isNotNull(), F.struct(
        *keys, *[F.col("then")[c].alias(c) for c in order])).alias("next"))
    before = previous_row(timed, keys, order, ["seconds"], "_before")
    idle = F.col("seconds") >= F.col("_before.seconds") + ttl_seconds
    starts = before.filter(F.coalesce(idle, F.lit(True))).select(node.alias("node"))
    stored = reached(links, starts).withColumn("_stores", F.lit(True))
    marked = (timed.withColumn("node", node).join(stored, "node", "left").drop("node")
              .withColumn("_record", F.when(F.col("_stores"), F.struct(
                  *order, F.col(payload_hash).alias("payload")))))
    known = running(marked, keys, order, "_record", "_live", "max")
    outcome = (F.when(F.col("_stores"), "executed")
               .when(F.col(payload_hash).eqNullSafe(F.col("_live.payload")), "replayed")
               .otherwise("conflict"))
    untimed = rows.filter("seconds IS NULL").select(
        *keys, call_id, F.lit("executed").alias("outcome"))
    return known.select(*keys, call_id, outcome.alias("outcome")).unionByName(untimed)


def crawl_pacing(requests: DataFrame, host: str, request_id: str, ts: str,
                 per_minute: int = 30) -> DataFrame:
    """Seconds each request has to wait so that its host sees at most the permitted rate.

    A request starts at max(its time, previous start + interval), which unrolls to
    i * interval + max over j <= i of (t_j - j * interval): two running folds.
    """
    interval = 60.0 / max(1, per_minute)
    rows = requests.select(host, request_id, epoch_seconds(ts).alias("seconds"),
                           F.lit(1).alias("one"))
    order = ["seconds", request_id]
    numbered = running(rows, [host], order, "one", "i").drop("one")
    shifted = numbered.withColumn("slack", F.col("seconds") - F.col("i") * interval)
    peaks = running(shifted, [host], order, "slack", "peak", "max")
    wait = F.col("peak") + F.col("i") * interval - F.col("seconds")
    return peaks.select(host, request_id, F.round(wait, 6).alias("wait_seconds"))
