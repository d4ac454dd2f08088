"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are sorted by size and each enters the bin with the least remaining capacity that
still holds it, found in a balanced tree over remaining capacities.

Groups above a 1/512 of a shard stand alone; the many small ones are first dealt by hash into
bundles, which are packed like groups.  So what is packed is a bounded list at any size of
the table, and a group is never divided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lekhya.session import stage

BUNDLES = 4096     # bundles of small groups
LARGE = 512        # groups above 1/LARGE of a mean shard stand alone: at most shards x LARGE
PARTS = 100_000    # at most so many parts in which the rows of large groups are numbered


class CapacityTree:
    """A balanced (AVL) search tree of (remaining capacity, bin)."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None  # [key, left, right, height]

    @staticmethod
    def _height(n):
        return n[3] if n else 0

    def _fixed(self, n):
        n[3] = 1 + max(self._height(n[1]), self._height(n[2]))
        lean = self._height(n[1]) - self._height(n[2])
        if lean > 1:
            if self._height(n[1][1]) < self._height(n[1][2]):
                n[1] = self._turn(n[1], 2)
            return self._turn(n, 1)
        if lean < -1:
            if self._height(n[2][2]) < self._height(n[2][1]):
                n[2] = self._turn(n[2], 1)
            return self._turn(n, 2)
        return n

    def _turn(self, n, side):
        """Raise the child on ``side`` (1 left, 2 right)."""
        up, other = n[side], 3 - side
        n[side], up[other] = up[other], n
        n[3] = 1 + max(self._height(n[1]), self._height(n[2]))
        up[3] = 1 + max(self._height(up[1]), self._height(up[2]))
        return up

    def add(self, key):
        def into(n):
            if n is None:
                return [key, None, None, 1]
            side = 1 if key < n[0] else 2
            n[side] = into(n[side])
            return self._fixed(n)
        self.root = into(self.root)

    def remove(self, key):
        def out(n, key):
            if key == n[0]:
                if n[1] is None or n[2] is None:
                    return n[1] or n[2]
                least = n[2]
                while least[1]:
                    least = least[1]
                n[0] = least[0]
                n[2] = out(n[2], least[0])
            else:
                side = 1 if key < n[0] else 2
                n[side] = out(n[side], key)
            return self._fixed(n)
        self.root = out(self.root, key)

    def tightest(self, size):
        """The smallest key with at least ``size`` remaining, or None."""
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                n, best = n[1], n[0]
            else:
                n = n[2]
        return best


def best_fit_decreasing(items: list[tuple], capacity: int) -> dict:
    """Bin of each (key, size).  An item larger than ``capacity`` gets a bin of its own."""
    tree, bins, placed = CapacityTree(), 0, {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        found = tree.tightest(size)
        if found:
            tree.remove(found)
            left, at = found
        else:
            left, at, bins = max(capacity, size), bins, bins + 1
        placed[key] = at
        tree.add((left - size, at))
    return placed


def within(items: list[tuple], shards: int) -> dict:
    """Best-fit-decreasing at the least capacity (by bisection) that needs no more bins.

    An item above the mean of what is left gets a bin of its own, so that it does not set the
    capacity of the others.
    """
    placed, rest, total = {}, sorted(items, key=lambda x: (-x[1], x[0])), sum(s for _, s in items)
    while rest and shards > 1 and rest[0][1] * shards > total:
        key, size = rest.pop(0)
        shards, total = shards - 1, total - size
        placed[key] = shards
    low, high, best = -(-total // shards), total, {k: 0 for k, _ in rest}
    while low < high:
        middle = (low + high) // 2
        tried = best_fit_decreasing(rest, middle)
        if max(tried.values(), default=0) < shards:
            best, high = tried, middle
        else:
            low = middle + 1
    return {**placed, **best}


def shard(df: DataFrame, group: Column, size: Column, shards: int | None = None,
          capacity: int | None = None, row_key: str = "doc_id") -> DataFrame:
    """Add shard (from 0), slot (gapless from 0 within the shard) and row_size.

    Either ``shards`` (as equal in size as whole groups allow) or ``capacity`` (as few shards
    as best-fit-decreasing finds) is given.  Rows of equal ``group`` share a shard; null is a
    group as well.  A group above the capacity has a shard of its own.  Repeated rows have a
    slot each; an empty table gives an empty result; columns named shard, slot or row_size
    are replaced.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("either shards or capacity")
    rows = stage(df.drop("shard", "slot", "row_size").withColumn(
        "_group", F.coalesce(group.cast("string"), F.lit("none")))
        .withColumn("row_size", size.cast("long")))
    groups = rows.groupBy("_group").agg(F.sum("row_size").alias("_bytes"),
                                        F.count(F.lit(1)).alias("_rows"))
    total, count = rows.agg(F.sum("row_size"), F.count(F.lit(1))).first()
    total, stride = total or 0, max(1000, count // PARTS)
    bound = max(1, (total // shards if shards else capacity) // LARGE)
    # of a fixed capacity, so many that a bundle stays an item of about 1/LARGE of it
    bundles = BUNDLES if shards else max(BUNDLES, -(-total * LARGE // capacity))
    bundle = F.pmod(F.xxhash64("_group"), F.lit(bundles)).cast("string")
    item = F.when(F.col("_bytes") > bound, F.concat(F.lit("g"), "_group")).otherwise(bundle)
    groups = stage(groups.withColumn("_item", item))
    if shards:  # bounded: shards x LARGE groups and BUNDLES bundles
        items = [tuple(r) for r in groups.groupBy("_item").agg(F.sum("_bytes")).collect()]
        placed = within(items, shards)
        where = df.sparkSession.createDataFrame(
            list(placed.items()), "_item string, shard int")
    else:
        where = _by_capacity(groups, capacity)
    # numbering: every item is cut into parts of some ``stride`` rows, offsets come from counts
    placed_groups = (groups.withColumn("_parts", F.ceil(F.col("_rows") / stride))
                     .join(where, "_item").select("_group", "_parts", "shard"))
    large = F.col("_parts") > 1
    part = F.concat_ws(":", F.when(large, F.col("_group")).otherwise(
        F.pmod(F.xxhash64("_group"), F.lit(BUNDLES)).cast("string")),
        F.when(large, F.pmod(F.xxhash64(row_key, F.lit(7)), F.col("_parts"))).otherwise(0))
    at = stage(rows.join(placed_groups, "_group").withColumn("_part", part)
               .drop("_group", "_parts"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (at.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inner = Window.partitionBy("shard", "_part").orderBy(F.col(row_key))
    return (at.withColumn("_at", F.row_number().over(inner) - 1)
            .join(offsets, ["shard", "_part"])
            .withColumn("slot", (F.col("_before") + F.col("_at")).cast("long"))
            .drop("_part", "_at", "_before"))


def _by_capacity(groups: DataFrame, capacity: int) -> DataFrame:
    """Shards of a fixed capacity.  Items are dealt into regions of some 20,000 that are
    packed on their own, so no task sees more; a region wastes at most one open shard."""
    import pandas as pd

    items = groups.groupBy("_item").agg(F.sum("_bytes").alias("_bytes"))
    regions = max(1, items.count() // 20_000)
    dealt = items.withColumn("_region", F.pmod(F.xxhash64("_item"), F.lit(regions)))

    def pack(pdf):
        placed = best_fit_decreasing(list(zip(pdf["_item"], pdf["_bytes"])), capacity)
        return pd.DataFrame({"_item": list(placed), "_region": int(pdf["_region"].iloc[0]),
                             "_bin": list(placed.values())})

    binned = stage(dealt.groupBy("_region").applyInPandas(
        pack, "_item string, _region long, _bin long"))
    first = Window.orderBy("_region").rowsBetween(Window.unboundedPreceding, -1)
    starts = (binned.groupBy("_region").agg((F.max("_bin") + 1).alias("_n"))
              .withColumn("_from", F.coalesce(F.sum("_n").over(first), F.lit(0))).drop("_n"))
    return binned.join(starts, "_region").select(
        "_item", (F.col("_from") + F.col("_bin")).cast("int").alias("shard"))
