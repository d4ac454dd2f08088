"""Prefix trie of conversations by van Emde Boas recursion over the depth.

A sequence of turns is cut at half of its depth range.  Cut prefixes get names, which are the
leaves of an upper trie and the roots of a forest of lower tries; upper and lower parts are
cut again in the same way, all parts of one height in one step, until a part is one turn high.
Naming takes two passes of logarithmically many steps:

* up: aligned blocks of turns get names, a block of twice the length from its halves;
* down: a part of height 2h that begins at a named prefix hands its name to its upper half,
  and to its lower half the name of (prefix, block of the upper half).

So a depth of d takes about log2(d) steps, and no conversation is ever gathered in one row.
Totals of subtrees are then grafted upward, from parts of height 1 to the whole: the totals of
a part's lower tries are added to all nodes of the upper trie above their roots.

Names are SHA-256 digests of what they stand for, so they need no common numbering.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lekhya.operators import scale
from lekhya.session import stage

ROOT = ""           # the name of the empty prefix
IDS_PER_ROW = 4096  # ids of a node's conversations that are joined into one row
SMALL_ROWS = 20_000  # of a table that are written by one task


def _written(df: DataFrame, rows: int) -> DataFrame:
    """Staged in few files where a known bound says that there are few rows."""
    return stage(df.coalesce(1 + rows // SMALL_ROWS)) if rows < 12 * SMALL_ROWS else stage(df)


def _pair(a: Column, b: Column) -> Column:
    """Names have a fixed length (or are empty on the left), so pairs are told apart."""
    return F.sha2(F.concat(a, F.lit("/"), b), 256)


def turn_name(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def sequences(turns: DataFrame, conv: str, order: list[str], role: str, text: str) -> DataFrame:
    """conv, at (from 1), name, size (code points of the text) of every turn, in order.

    Turns are ordered by ``order`` (null first), then role and text; null role or text is
    empty.  Rows without a conversation take no part.  A conversation of any length is cut into
    segments for its numbering.
    """
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = stage(rows.select(
        "conv", *[f"o{i}" for i in range(len(order))], "role",
        F.sha2(F.col("text"), 256).alias("text_hash"), F.substring("text", 1, 256).alias("start"),
        turn_name(F.col("role"), F.col("text")).alias("name"),
        F.length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("one"),
        F.monotonically_increasing_id().alias("row_id")))
    by = [*[f"o{i}" for i in range(len(order))], "role", "start", "text_hash", "row_id"]
    return stage(scale.running(slim, ["conv"], by, "one", "at").select("conv", "at", "name", "size"))


def named_prefixes(seq: DataFrame, depth: int) -> DataFrame:
    """conv, depth, node for every prefix of every conversation of ``seq`` (conv, at, name),
    the empty one included; ``depth``: the greatest at."""
    total = seq.count()
    height = 1
    while height <= depth:
        height *= 2
    # up: blocks[k] holds the names of the full blocks of 2**k turns, by the turns before them
    blocks = [seq.select("conv", (F.col("at") - 1).alias("before"), "name")]
    while 2 ** len(blocks) < height:
        span = 2 ** len(blocks)
        halves = blocks[-1].withColumn("start", F.floor(F.col("before") / span) * span)
        first = F.max(F.when(F.col("before") == F.col("start"), F.col("name")))
        second = F.max(F.when(F.col("before") > F.col("start"), F.col("name")))
        joined = (halves.groupBy("conv", "start").agg(first.alias("a"), second.alias("b"))
                  .filter("b IS NOT NULL")
                  .select("conv", F.col("start").alias("before"),
                          _pair(F.col("a"), F.col("b")).alias("name")))
        blocks.append(_written(joined, total // span))
    # down: a part of twice the span, named by the prefix before it, is cut in half
    parts = seq.select("conv").distinct().select("conv", F.lit(0).cast("long").alias("depth"),
                                                 F.lit(ROOT).alias("node"))
    while blocks:
        span = 2 ** (len(blocks) - 1)
        block = blocks.pop().select("conv", F.col("before").alias("depth"), "name")
        lower = parts.join(block, ["conv", "depth"]).select(
            "conv", (F.col("depth") + span).alias("depth"),
            _pair(F.col("node"), F.col("name")).alias("node"))
        parts = stage(parts.unionByName(lower))
    return parts


def _above(prefixes: DataFrame, cuts: DataFrame, span: int) -> DataFrame:
    """Nodes of the upper halves of parts of height 2 * span, with the totals of the lower
    tries under them.  ``cuts``: conv (one that passes), depth, leaves, saved."""
    upper = prefixes.filter(F.floor(F.col("depth") / span) % 2 == 0).select(
        "conv", "node", ((F.floor(F.col("depth") / span) + 1) * span).alias("cut"))
    roots = cuts.filter((F.floor(F.col("depth") / span) % 2 == 1) & (F.col("depth") % span == 0)) \
        .select("conv", F.col("depth").alias("cut"), "leaves", "saved")
    return (upper.join(roots, ["conv", "cut"]).groupBy("node")
            .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))


def grafted(nodes: DataFrame, prefixes: DataFrame, depth: int) -> DataFrame:
    """``nodes`` (node, depth, conv: one that passes, leaves, saved) with leaves and saved
    summed over subtrees."""
    span = 1
    while span <= depth:
        more = _above(prefixes, nodes, span)
        nodes = stage(nodes.join(more, "node", "left").select(
            *[c for c in nodes.columns if c not in ("leaves", "saved")],
            *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]))
        span *= 2
    return nodes


def ends_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: digest of the comma-joined ids, ascending, of the conversations
    (node, conv) that end at a node.

    Range partitions join up to ``IDS_PER_ROW`` ids of a node into a row; what a node's digest
    then reads in order, as a stream, is a row for so many conversations.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ends.repartitionByRange(n, "node", "conv").sortWithinPartitions("node", "conv")

    def runs(batches):
        node, ids = None, []
        for pdf in batches:
            out = []
            for k, c in zip(pdf["node"], pdf["conv"]):
                if ids and (k != node or len(ids) == IDS_PER_ROW):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = k
                ids.append(c)
            yield pd.DataFrame(out, columns=["node", "first", "ids"])
        if ids:
            yield pd.DataFrame([(node, ids[0], ",".join(map(str, ids)))],
                               columns=["node", "first", "ids"])

    def digests(batches):
        node, state = None, None
        for pdf in batches:
            out = []
            for k, ids in zip(pdf["node"], pdf["ids"]):
                if k != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = k, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])

    rows = ordered.mapInPandas(runs, "node string, first long, ids string")
    return (rows.repartition("node").sortWithinPartitions("node", "first")
            .mapInPandas(digests, "node string, ends_sha256 string"))


def trie(seq: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``seq`` (conv, at from 1, name, size).

    ``convs``: the conversations (conv, distinct), also those without turns, which end at the
    root.  Returns conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs,
    n_children, n_leaves and saved_tokens (of the subtree, a node's (n_convs - 1) times the
    code points of its last text), ends_sha256.  No conversations: no nodes.
    """
    depth = seq.agg(F.max("at")).first()[0] or 0
    prefixes = named_prefixes(seq, depth)
    silent = convs.join(seq.select("conv").distinct(), "conv", "left_anti").select(
        "conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"))
    prefixes = stage(prefixes.unionByName(silent).join(
        seq.select("conv", F.col("at").alias("depth"), "size"), ["conv", "depth"], "left"))
    nodes = stage(prefixes.groupBy("node").agg(
        F.first("depth").alias("depth"), F.min("conv").alias("conv"),
        F.count(F.lit(1)).alias("n_convs"), F.max(F.coalesce("size", F.lit(0))).alias("size")))
    # the parent is the shorter prefix of a conversation that passes
    parents = prefixes.select("conv", (F.col("depth") + 1).alias("depth"),
                              F.col("node").alias("parent"))
    linked = nodes.join(parents, ["conv", "depth"], "left")
    up = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    linked = stage(linked.join(up, "parent", "left"))
    children = linked.filter("parent IS NOT NULL").groupBy("parent").agg(
        F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    linked = stage(linked.join(children, "node", "left").select(
        "node", "depth", "conv", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved")))
    totals = grafted(linked, prefixes, depth)
    last = seq.groupBy("conv").agg(F.max("at").alias("depth"))
    ends = stage(prefixes.join(last, ["conv", "depth"]).select("node", "conv").unionByName(
        silent.select("node", "conv")))
    none = hashlib.sha256().hexdigest()
    return totals.join(ends_digests(ends), "node", "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
