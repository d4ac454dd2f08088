"""Chains of pointers followed in logarithmically many rounds.

Every node has at most one successor: the next page of a listing, the first call after a
record has expired.  A round joins the pointers with themselves, so that they reach twice as
far, and a chain of n nodes is followed in about log2(n) rounds, each spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lekhya.operators.scale import running
from lekhya.session import stage

HOT_ROWS = 100_000    # pointers to one node that may meet in one task
HOT_NODES = 1_000     # nodes that can have more than their share, and are broadcast


def doubled(links: DataFrame) -> DataFrame:
    """Pointers twice as long; a node drops out where its chain ends before.

    A node that more than ``HOT_ROWS`` and more than one in ``HOT_NODES`` pointers name is
    looked up in a broadcast table, which therefore has fewer than ``HOT_NODES`` rows.
    """
    far = links.select(F.col("node").alias("next"), F.col("next").alias("far"))
    rows = links.count()
    if rows <= HOT_ROWS:
        met = links.join(far, "next")
    else:
        bound = max(HOT_ROWS, rows // HOT_NODES)
        hot = F.broadcast(stage(links.groupBy("next").count().filter(F.col("count") > bound)
                                .select("next")))
        lookup = stage(far.join(hot, "next", "left_semi"))
        met = links.join(F.broadcast(lookup), "next").unionByName(
            links.join(hot, "next", "left_anti").join(far, "next"))
    return stage(met.select("node", F.col("far").alias("next")))


def reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes on the chains that begin at ``starts``, these included, each once; cycles end.

    ``links`` (node, next) name each node once as ``node``; null nodes are on no chain.
    ``starts`` has a column ``node``.  After k rounds the nodes fewer than 2^k steps away are
    known; when a round finds no new one, there is none.
    """
    found = stage(starts.select("node").filter("node IS NOT NULL").distinct())
    links = links.select("node", "next").filter("node IS NOT NULL AND next IS NOT NULL")
    # only nodes that something leads to can lie on a chain
    entered = links.select(F.col("next").alias("node")).unionByName(found).distinct()
    links = stage(links.join(entered, "node", "left_semi"))
    while True:
        step = links.join(found, "node", "left_semi").select(F.col("next").alias("node"))
        new = stage(step.distinct().join(found, "node", "left_anti"))
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        links = doubled(links)


def first_at_or_after(rows: DataFrame, keys: list[str], at: str, row_id: str, delay: float,
                      out: str) -> DataFrame:
    """For each row the first one of its key, in the order of (``at``, ``row_id``), whose time
    is at least ``delay`` later: a struct (at, row_id), null where there is none.

    Rows and questions are sorted together from late to early in range segments, and a running
    minimum of the rows passed answers the questions, so no key is one task.
    """
    here = F.struct(F.col(at), F.col(row_id))
    rows = rows.select(*keys, at, row_id)
    asked = rows.select(*keys, (-(F.col(at) + F.lit(delay))).alias("_late"),
                        F.lit(1).alias("_kind"), F.col(row_id).alias("_id"),
                        here.alias("_asks"), F.lit(None).cast(
                            rows.select(here.alias("h")).schema["h"].dataType).alias("_row"))
    passed = rows.select(*keys, (-F.col(at)).alias("_late"), F.lit(0).alias("_kind"),
                         F.col(row_id).alias("_id"), F.lit(None).cast(
                             asked.schema["_asks"].dataType).alias("_asks"), here.alias("_row"))
    both = running(asked.unionByName(passed), keys, ["_late", "_kind", "_id"], "_row", out, "min")
    return both.filter("_kind = 1").select(*keys, f"_asks.{at}", f"_asks.{row_id}", out)
