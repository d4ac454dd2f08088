"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

A source's share of the budget is proportional to its weight, but at most ``max_epochs``
times its own size.  What the clamped sources leave is shared again by weight until no
source is above its limit.  A target is then met by whole repetitions of all documents and
one fractional repetition: documents in seeded hash order until the target is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lekhya.llm.names import fresh
from lekhya.session import stage

WORD = r"[^\x20\x09-\x0D]+"
EDGE = 4  # hex digits of the hash that make a bucket; half of them make a block of buckets


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_sizes(docs: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """One row per source (null is a source of its own): _source, source_size."""
    return docs.groupBy(F.col(source).alias("_source")).agg(
        F.sum(F.col(size)).cast("long").alias("source_size"))


def cyclic_weights(sizes: DataFrame, cycle: list[int]) -> DataFrame:
    """Weights that repeat over the sources in code point order, null last.

    The order runs over one row per source, not over documents.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(cycle) + 1
    return sizes.withColumn("weight", F.get(F.array(*[F.lit(c) for c in cycle]), at - 1)
                            .cast("double"))


def water_fill(weighted: DataFrame, budget: float, max_epochs: float = 2.0) -> DataFrame:
    """Add ``target`` to (_source, source_size, weight).

    Each round is one aggregate over the sources; sums are decimal, so reruns agree bit for
    bit.  Sources without weight get nothing; if every source is clamped the budget is not
    used up.  A round clamps at least one more source, or it is the last.
    """
    weighted = weighted.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    level, clamped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= F.col("_cap")
        row = weighted.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.sum(F.when(full, F.col("_cap")).cast("decimal(38,6)")).alias("cap"),
            F.sum(F.when(~full, F.col("weight")).cast("decimal(38,9)")).alias("weight")).first()
        if row["n"] == clamped or not row["weight"]:
            break
        clamped = row["n"]
        level = max(0.0, (float(budget) - float(row["cap"] or 0)) / float(row["weight"]))
    share = F.lit(0.0) if level is None else F.col("weight") * F.lit(level)
    return weighted.withColumn("target", F.least(F.col("_cap"), share)).drop("_cap")


def _reached(filled: DataFrame, part: str, quotas: DataFrame) -> DataFrame:
    """Per source the first ``part`` at which the quota is reached, and what came before it.

    ``filled``: _source, part, _filled, at most 256 parts of a source; ``quotas``: _source,
    _quota, _before.  Sources that no part fills up are left out.
    """
    upto = F.sum("_filled").over(Window.partitionBy("_source").orderBy(part))
    mine = quotas.select(F.col("_source").alias("_s"), "_quota", "_before")
    met = (filled.withColumn("_upto", upto)
           .join(mine, F.col("_source").eqNullSafe(F.col("_s")))
           .filter(F.col("_before") + F.col("_upto") >= F.col("_quota")))
    first = F.min(F.struct(part, "_quota", (F.col("_before") + F.col("_upto") - F.col("_filled"))
                           .alias("_before")))
    return met.groupBy("_source").agg(first.alias("_f")).select("_source", "_f.*")


def mix(docs: DataFrame, weights: DataFrame, budget: float, max_epochs: float = 2.0,
        seed: str = "0", key: str = "doc_id", source: str = "source",
        size: str = "size") -> DataFrame:
    """What the mix takes of each document.

    ``weights``: _source, source_size, weight.  Adds source_size, target, whole (repetitions
    of the entire document), extra (words of one more, fractional repetition) and taken
    (words in all) to ``docs``; columns of these names are replaced.  A source's taken sizes
    sum to its rounded target.

    Null size counts as 0 and takes nothing; documents of one key and text are
    interchangeable; an empty table gives an empty result.  A source of any share of the rows
    is only ever pre-aggregated, except for the documents of one hash bucket of 65536.
    """
    docs = docs.drop("source_size", "target", "whole", "extra", "taken")
    docs = (docs.withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long"))
            .withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(
                F.col(key).cast("string"), F.lit("")))))
            .withColumn("_bucket", F.substring("_key", 1, EDGE)))
    targets = (water_fill(weights, budget, max_epochs)
               .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(
                   F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
                   .otherwise(0).cast("long"))
               .withColumn("_quota", F.round("target").cast("long")
                           - F.col("whole") * F.col("source_size")))
    filled = stage(docs.groupBy(F.col(source).alias("_source"), "_bucket")
                   .agg(F.sum(size).alias("_filled"))
                   .withColumn("_block", F.substring("_bucket", 1, EDGE // 2)))
    quotas = targets.select("_source", "_quota", F.lit(0).cast("long").alias("_before"))
    block = _reached(filled.groupBy("_source", "_block").agg(F.sum("_filled").alias("_filled")),
                     "_block", quotas)
    within = filled.join(block.select(F.col("_source").alias("_s"), F.col("_block").alias("_b")),
                         F.col("_source").eqNullSafe(F.col("_s"))
                         & (F.col("_block") == F.col("_b"))).select("_source", "_bucket", "_filled")
    reached = _reached(within, "_bucket", block.drop("_block")).select(
        F.col("_source").alias("_s"), F.struct("_bucket", F.col("_before").alias("before"))
        .alias("_edge"))
    plan = stage(targets.join(reached, F.col("_source").eqNullSafe(F.col("_s")), "left")
                 .drop("_s"))
    each = docs.join(plan.drop("weight"), F.col(source).eqNullSafe(F.col("_source")), "left")
    at_edge = F.coalesce(F.col("_bucket") == F.col("_edge._bucket"), F.lit(False))
    inside = F.coalesce(F.col("_bucket") < F.col("_edge._bucket"), F.lit(False))
    far = each.filter(~at_edge).withColumn("extra", F.when(inside, F.col(size)).otherwise(0))
    earlier = F.coalesce(F.sum(size).over(
        Window.partitionBy("_source").orderBy("_key", key)
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = each.filter(at_edge).withColumn("extra", F.greatest(F.lit(0), F.least(
        F.col(size), F.col("_quota") - F.col("_edge.before") - earlier)))
    return (far.unionByName(near)
            .withColumn("taken", F.col("whole") * F.col(size) + F.col("extra"))
            .drop("_key", "_bucket", "_source", "_quota", "_edge"))


def repeated(mixed: DataFrame, columns: list[str], size: str = "size") -> DataFrame:
    """The mix itself: one row per repetition, every document whole.

    The one document of a source at which its target is reached is repeated once more if at
    least half of it is still missing, so a source's words differ from its target by half a
    document at most.
    """
    once_more = (F.col("extra") > 0) & (2 * F.col("extra") >= F.col(size))
    times = (F.col("whole") + once_more.cast("long")).cast("int")
    (n,) = fresh(mixed, "_times")
    rows = mixed.withColumn(n, times).filter(F.col(n) > 0)
    return rows.select(*columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(n)).drop(n)
