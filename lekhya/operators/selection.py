"""Deep pages of a listing: the range that holds a page is found first, only that is sorted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BOUNDS = 64          # values of a column that cut its rows into ranges
SORTED = 100_000     # rows that are sorted as they are


def _order(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.desc(name) if down else F.asc(name) for name, down in order]


def _bounds(rows: DataFrame, name: str, keys: list[str]) -> list:
    """Values of the rows with the smallest hashes of their keys, in ascending order.

    Every run draws alike.  A value that many rows share is drawn with them.
    """
    drawn = (rows.filter(F.col(name).isNotNull())
             .select(name).orderBy(F.xxhash64(*keys)).limit(BOUNDS))
    return drawn.agg(F.array_sort(F.collect_set(name)).alias("b")).first()["b"]


def _range(value: Column, bounds: list) -> Column:
    """The number of a value's range: 0 for null, 1 below the first bound, then by turns a bound
    itself and what lies between it and the next."""
    at = [F.when(value >= F.lit(b), 1).otherwise(0) + F.when(value > F.lit(b), 1).otherwise(0)
          for b in bounds]
    return F.when(value.isNull(), 0).otherwise(reduce(Column.__add__, at, F.lit(1)))


def _select(rows: DataFrame, order: list[tuple[str, bool]], level: int, skip: int, take: int,
            count: int, sizes: list[int]) -> list[DataFrame]:
    """Parts that hold rows ``skip`` to ``skip + take`` of the order, whole or cut to size.

    Rows are equal in the columns before ``level``.
    """
    take = min(take, count - skip)
    if take <= 0:
        return []
    if skip == 0:
        return [rows if take == count else rows.orderBy(*_order(order)).limit(take)]
    if count <= SORTED or level == len(order):
        sizes.append(count)
        return [rows.orderBy(*_order(order)).offset(skip).limit(take)]
    name, down = order[level]
    bounds = _bounds(rows, name, [c for c, _ in order])
    number = _range(F.col(name), bounds)
    counts = {r["n"]: r["c"] for r in
              rows.groupBy(number.alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    parts, before = [], 0
    for n in sorted(counts, reverse=down):
        first, last = max(skip - before, 0), min(skip + take - before, counts[n])
        if first < last:
            alike = n % 2 == 0    # null or one of the bounds
            parts += _select(rows.filter(number == n), order, level + alike, first, last - first,
                             counts[n], sizes)
        before += counts[n]
    return parts


def deep_page(df: DataFrame, order: list[tuple[str, bool]], limit: int, offset: int = 0,
              total: str | None = None, sizes: list[int] | None = None) -> DataFrame:
    """One page of a listing, however far down, in its order.

    ``order`` names columns and whether each descends, and ends with a unique key; nulls count as
    smallest.  Some values of the leading column cut the rows into ranges, which are counted by
    one aggregate; the range in which the page begins is cut again, values that many rows share
    by the next column, until at most ``SORTED`` rows are left to sort.  Each step reads the
    order's columns of one range and divides it by about ``BOUNDS``; the driver sees one row a
    range.  Rows that are equal in all columns of the order come in any order.  A page beyond the
    end is empty.  ``df`` is read once for each step, so stage what is dear to compute.

    ``total`` names a column for the number of all rows, ``sizes`` receives the numbers of rows
    that were sorted around the page's beginning.
    """
    count = df.count()
    parts = _select(df, order, 0, offset, limit, count, [] if sizes is None else sizes)
    page = reduce(DataFrame.unionByName, parts) if parts else df.filter(F.lit(False))
    page = page.orderBy(*_order(order)).limit(limit)
    return page if total is None else page.withColumn(total, F.lit(count).cast("long"))
