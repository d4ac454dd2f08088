"""Document fingerprints: one-permutation MinHash, in DataFrame operations only.

Every shingle is hashed once; the top bits of the hash name a bin, whose minimum is kept.
An empty bin takes over the value of the first full one in a fixed pseudo-random probing
order of its own (optimal densification).  Only the low bits of each bin are stored, packed
as hex, and likeness is corrected for chance agreement of those bits.

The probing order is evaluated by doubling: in round r an empty bin looks at bin
``ORDERS[r][bin]``, so after r rounds it has tried 2**r bins.  ``probe_orders`` checks that
every bin finds every other one.
"""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window, functions as F

BINS = 256      # a power of two
BITS = 4        # a hex digit per bin
SHINGLE = 5


@lru_cache
def probe_orders(bins: int = BINS, seed: int = 1) -> tuple[tuple[int, ...], ...]:
    """Permutations of the bins, as many as it takes until each bin has tried every other."""
    rng = random.Random(seed)
    orders, tried = [], [{i} for i in range(bins)]
    while any(len(t) < bins for t in tried):
        order = list(range(bins))
        rng.shuffle(order)
        orders.append(tuple(order))
        tried = [tried[i] | tried[order[i]] for i in range(bins)]
    return tuple(orders)


def words_of(text: Column) -> Column:
    """Words between ASCII white space, lower case."""
    spaced = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


def with_fingerprint(df: DataFrame, text: str, out: str, shingle: int = SHINGLE,
                     bins: int = BINS) -> DataFrame:
    """Add the packed fingerprint of a text column.

    Null and empty texts have no shingles and get the fingerprint "".  A text of fewer words
    than a shingle is one shingle.  Equal word sequences have equal fingerprints.
    """
    shift = 64 - (bins - 1).bit_length()
    low = (1 << shift) - 1
    marks = F.array(*[F.lit(((b - bins // 2) << shift) | low) for b in range(bins)])
    bin_of = lambda h: F.shiftright(h, shift)
    df = df.withColumn("_w", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    n = F.size("_w")
    df = df.withColumn("_h", F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(shingle)]))))
    # one mark above any hash per bin: after sorting, the first of each bin is its minimum
    df = df.withColumn("_s", F.sort_array(F.concat("_h", marks)))
    first = F.filter("_s", lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col("_s"), i - 1))))
    df = df.withColumn("_b", F.transform(first, lambda h: F.when(
        h.bitwiseAND(F.lit(low)) == low, F.lit(-1).cast("long")).otherwise(
        h.bitwiseAND(F.lit(low)))))

    empty = F.lit(-1).cast("long")

    def probe(bins_, order):
        return F.when(F.array_contains(bins_, empty), F.transform(order, lambda p, i: F.when(
            F.get(bins_, i) >= 0, F.get(bins_, i)).otherwise(F.get(bins_, p)))).otherwise(bins_)

    orders = F.array(*[F.array(*[F.lit(p) for p in o]) for o in probe_orders(bins)])
    dense = F.when(F.array_contains("_b", empty),
                   F.aggregate(orders, F.col("_b"), probe)).otherwise(F.col("_b"))
    # hashed again with the bin's number, so that a value copied to many bins does not agree or
    # differ by chance in all of them at once
    bits = lambda v, i: F.xxhash64(v, i).bitwiseAND(F.lit((1 << BITS) - 1))
    packed = F.array_join(F.transform(dense, lambda v, i: F.lower(F.hex(bits(v, i)))), "")
    return (df.withColumn("_d", F.when(F.size("_h") == 0, F.lit("")).otherwise(packed))
            .drop("_w", "_h", "_s", "_b").withColumnRenamed("_d", out))


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two fingerprints.

    Agreeing bins minus those that agree by chance.  Two empty texts are alike (1), an empty
    and another text are not (0).
    """
    chance = 1.0 / (1 << BITS)
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y),
                           lambda equal: equal))
    share = (same / F.lit(bins) - chance) / (1 - chance)
    return (F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))))


def with_next(docs: DataFrame, key: str, columns: list[str], prefix: str,
              segments: int | None = None) -> DataFrame:
    """Add ``columns`` of the row that follows in descending order of ``key`` (after the last:
    the first), as ``prefix + column``.

    Rows are cut into segments at quantiles of the key, which are keys of the table; such a
    boundary row also visits the segment above as its guest, so that one shuffle by segment
    is all that moves.  Rows without a key follow the others as a segment of their own; ties
    are ordered by the columns.
    """
    spark = docs.sparkSession
    n = segments or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n + 1)], 10 * n)
                    .alias("c"), F.max(key).alias("m")).first()
    bounds = sorted({*(cuts["c"] or []), *([] if cuts["m"] is None else [cuts["m"]])})
    if not bounds:
        bounds = [0]
    step = max(1, int(len(bounds) ** 0.5))
    lit = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    value = F.coalesce(F.col(key).cast("long"), F.lit(bounds[0]).cast("long"))
    coarse = F.size(F.filter(lit(bounds[step - 1::step]), lambda b: b < value))
    docs = docs.withColumn("_block", coarse)
    fine = F.size(F.filter(F.slice(lit(bounds), F.col("_block") * step + 1, F.lit(step)),
                           lambda b: b < value))
    docs = docs.withColumn("_segment", F.col("_block") * step + fine).drop("_block")
    is_bound = F.get(lit(bounds), F.col("_segment")) == F.col(key)
    homes = F.when(is_bound, F.array(F.col("_segment"), (F.col("_segment") + 1) % len(bounds))) \
        .otherwise(F.array("_segment"))
    if len(bounds) == 1:
        homes = F.when(is_bound, F.array("_segment", "_segment")).otherwise(F.array("_segment"))
    placed = docs.select("*", F.posexplode(homes).alias("_guest", "_home"))
    order = Window.partitionBy("_home").orderBy(
        "_guest", F.col(key).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in columns])
    following = [F.lead(c).over(order).alias(prefix + c) for c in columns]
    return (placed.select("*", *following).filter("_guest = 0")
            .drop("_segment", "_guest", "_home"))


def edited(text: Column, other: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of the other text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(other, F.lit(1), half))
