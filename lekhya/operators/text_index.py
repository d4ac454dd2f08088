"""Substring search by trigram postings: groups of rows are ruled out before texts are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lekhya.session import stage

LISTED = 1000    # groups that are named in the filter of a scan, where Parquet can skip by them


@dataclass(frozen=True)
class TextIndex:
    rows: DataFrame        # the indexed rows with ``_group``, stored in its order
    postings: DataFrame    # (trigram, group), each pair once
    column: str


def _trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def build(df: DataFrame, keys: list[str], column: str, rows_per_group: int = 64) -> TextIndex:
    """Store rows in groups of about ``rows_per_group`` with the trigrams of each group.

    Groups are hashes of the keys, so repeated keys share one.  Rows with a null text are stored
    and never found.  ``_group`` must not name a column of the rows.
    """
    groups = max(1, -(-df.count() // rows_per_group))
    numbered = df.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    rows = stage(numbered.repartitionByRange("_group").sortWithinPartitions("_group"))
    pairs = rows.select(F.explode(_trigrams(F.lower(F.col(column)))).alias("trigram"), "_group")
    postings = stage(pairs.distinct().repartitionByRange("trigram")
                     .sortWithinPartitions("trigram", "_group"))
    return TextIndex(rows, postings, column)


def candidates(index: TextIndex, text: str) -> DataFrame:
    """Groups that hold every trigram of ``text``, which has three characters or more."""
    wanted = {text[i:i + 3] for i in range(len(text) - 2)}
    found = index.postings.filter(F.col("trigram").isin(sorted(wanted)))
    return found.groupBy("_group").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") == len(wanted)).select("_group")


def search(index: TextIndex, text: str) -> DataFrame:
    """Rows whose text contains ``text``, taken literally, in upper or lower case.

    The same rows as a scan with ``catalogue.contains_any``.  Up to ``LISTED`` groups are named in
    the scan's filter, beyond that the groups are joined.  Less than three characters are
    searched for by the scan itself, an empty text is in every text that is not null.
    """
    low = text.lower()
    hit = F.contains(F.lower(F.col(index.column)), F.lit(low))
    rows = index.rows
    if len(low) >= 3:
        groups = candidates(index, low)
        few = [r["_group"] for r in groups.limit(LISTED + 1).collect()]
        rows = rows.filter(F.col("_group").isin(few)) if len(few) <= LISTED \
            else rows.join(groups, "_group", "left_semi")
    return rows.filter(hit).drop("_group")
