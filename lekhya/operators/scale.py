"""Shared building blocks that stay safe when one key holds much of the data.

* a side is broadcast only after its size was checked, otherwise the hot side is salted;
* order-dependent work (running totals, previous row, exact percentiles) is cut into
  range segments of similar size, so a hot key is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lekhya.session import stage

BROADCAST_ROWS = 100_000
SALTS = 64


def either(conditions: list[Column]) -> Column:
    """Disjunction of a list of predicates; NULL counts as false."""
    return F.coalesce(reduce(lambda a, b: a | b, conditions), F.lit(False))


def join_small(left: DataFrame, small: DataFrame, on: list[str], row_id: str,
               how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large, possibly skewed side to a side expected to be small.

    The small side is staged and its rows are counted.  Within the bound it is
    broadcast and the large side does not move; otherwise it is replicated over
    salts and the large side is spread by ``row_id``.
    """
    small = stage(small)
    if small.count() <= max_rows:
        return left.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS)).cast("int"))
    return spread.join(salted, [*on, "_salt"], how).drop("_salt")


def top_k(df: DataFrame, k: int, keys: list[str], order: list[Column],
          rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key.

    ``row_number() <= k`` lets the planner keep only k rows per key in every map
    task before the shuffle (window group limit), so a hot key moves k rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, by mergeable aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def earliest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def segmented(df: DataFrame, keys: list[str], order: list[str],
              segments: int | None = None) -> DataFrame:
    """Range-partition by (keys, order) into segments of similar size and stage them.

    ``_segment`` numbers follow the order.  (keys, order) should be unique so that
    even a key with a third of all rows is cut evenly.
    """
    n = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order)
    return stage(ranged.withColumn("_segment", F.spark_partition_id()))


def _carried(tails: DataFrame, keys: list[str]) -> DataFrame:
    """What the previous segment hands over: at most one row per segment."""
    w = Window.orderBy("_segment")
    return tails.select("_segment", F.lag(F.struct(*keys)).over(w).alias("_from"),
                        F.lag("_value").over(w).alias("_carry"))


def _attach_carry(seg: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    same = F.col("_from").eqNullSafe(F.struct(*keys))
    return (seg.join(F.broadcast(carried), "_segment", "left")
               .withColumn("_carry", F.when(same, F.col("_carry"))).drop("_from"))


def running(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
            how: str = "sum") -> DataFrame:
    """Inclusive running ``sum``, ``max`` or ``min`` of ``value`` per key, exact for hot keys."""
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    seg = segmented(df, keys, order)
    per_segment = seg.groupBy("_segment", *keys).agg(fold(value).alias("_fold"))
    tails = (per_segment.groupBy("_segment")
             .agg(F.max_by(F.struct(*keys, "_fold"), F.struct(*keys)).alias("_t"))
             .select("_segment", "_t.*"))
    # at most one row per segment
    totals = tails.withColumn("_value", fold("_fold").over(
        Window.partitionBy(*keys).orderBy("_segment")))
    w = Window.partitionBy("_segment", *keys).orderBy(*order)
    local, carry = fold(value).over(w), F.col("_carry")
    joined = local + F.coalesce(carry, F.lit(0)) if how == "sum" \
        else {"max": F.greatest, "min": F.least}[how](local, carry)
    return (_attach_carry(seg, _carried(totals, keys), keys)
            .withColumn(out, joined).drop("_carry", "_segment"))


def previous_row(df: DataFrame, keys: list[str], order: list[str], columns: list[str],
                 out: str) -> DataFrame:
    """A struct of ``columns`` of the preceding row of the same key, exact for hot keys."""
    seg = segmented(df, keys, order)
    tails = (seg.groupBy("_segment")
             .agg(F.max_by(F.struct(*keys, F.struct(*columns).alias("_value")),
                           F.struct(*keys, *order)).alias("_t"))
             .select("_segment", "_t.*"))
    w = Window.partitionBy("_segment", *keys).orderBy(*order)
    return (_attach_carry(seg, _carried(tails, keys), keys)
            .withColumn(out, F.coalesce(F.lag(F.struct(*columns)).over(w), F.when(
                F.row_number().over(w) == 1, F.col("_carry"))))
            .drop("_carry", "_segment"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str,
                      percents: list[float]) -> DataFrame:
    """Nearest-rank percentiles per key without gathering a key in one task.

    Equal values are counted first, then ranked by a segmented running count;
    the answer is the smallest value whose count reaches ceil(p/100 * n).
    """
    keys = keys or ["_all"]
    df = df.withColumn("_all", F.lit(0)) if keys == ["_all"] else df
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, keys, [value], "_n", "_cum")
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    picks = []
    for p in percents:
        target = F.greatest(F.ceil(F.lit(p) / 100.0 * F.col("_total")), F.lit(1))
        picks.append(F.min(F.when(F.col("_cum") >= target, F.col(value))).alias(f"p{p:g}"))
    joined = join_small(ranked, totals, keys, value, "inner")
    return joined.groupBy(*keys).agg(*picks).drop("_all")


def stretches(df: DataFrame, keys: list[str], order: list[str], seconds: str,
              gap: float) -> DataFrame:
    """Number the stretches of each key that are separated by ``gap`` idle seconds or more.

    Recurrences that forget everything after such a gap can treat stretches as
    independent groups.  ``seconds`` is a numeric time column.
    """
    rows = previous_row(df, keys, order, [seconds], "_before")
    opens = F.coalesce(F.col(seconds) - F.col(f"_before.{seconds}") >= gap, F.lit(True))
    marked = rows.withColumn("_opens", opens.cast("long")).drop("_before")
    return running(marked, keys, order, "_opens", "stretch").drop("_opens")


def scan_in_order(df: DataFrame, keys: list[str], order: list[str], carry: list[str],
                  inputs: list[str], start, step, outputs: str) -> DataFrame:
    """Run a sequential recurrence over each group in order.

    ``step(state, *inputs)`` returns (state, *outputs) for a row and ``start()`` the
    state before a group's first row.  Groups arrive whole and sorted in one
    partition and are streamed in Arrow batches; nothing but the state is held.
    """
    ordered = (df.repartition(*keys).sortWithinPartitions(*keys, *order)
               .select(*dict.fromkeys([*keys, *carry, *inputs])))
    names = [o.strip().split()[0] for o in outputs.split(",")]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        group, state = None, None
        for pdf in batches:
            rows = []
            for key, values in zip(zip(*[pdf[k] for k in keys]), zip(*[pdf[c] for c in inputs])):
                if key != group:
                    group, state = key, start()
                state, *out = step(state, *values)
                rows.append(out)
            made = pd.DataFrame(rows, columns=names)
            yield pd.concat([pdf[carry].reset_index(drop=True), made], axis=1)

    return ordered.mapInPandas(run, f"{schema}, {outputs}")
