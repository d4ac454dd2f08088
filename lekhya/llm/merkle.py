"""Merkle manifest of a dataset, with proofs by descent of a content-addressed DAG.

Rows are leaves of one tree for each group; the roots of the groups are the leaves of a tree
above them.  A tree joins every FANOUT consecutive nodes into one until one remains.  What is
stored is one record for each inner digest: the digests of its children.  A request for a leaf
descends from the root by the digits (base FANOUT) of its rank; on the way the children that
are not selected are collected, and the collected segments in reverse are its proof.

Requests that share a path descend as one: a level has one row for each node that some request
passes, so all levels of a descent to all leaves together have little more rows than a seventh
of the leaves.  Building a level moves digests only, in blocks of a fixed number of leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lekhya.llm.names import fresh
from lekhya.operators import scale
from lekhya.session import stage

FANOUT = 8                 # digits are written in base 8
LEVELS = 3                 # built from one block
BLOCK = FANOUT ** LEVELS
SMALL = 3                  # levels of a descent with at most FANOUT ** SMALL nodes are broadcast


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def framed(value: Column) -> Column:
    """UTF-8 byte count, colon, value; null: a dash."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value),
                      F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return digest(F.concat(*[framed(v) for v in values]))


def group_key(value: Column) -> Column:
    """A string for every value, null too, in the order of the values' UTF-8, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def _joined(nodes: Column) -> Column:
    """Digests of the runs of FANOUT consecutive digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(
        F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT)), "")))


def _records(parents: str, children: str) -> Column:
    return F.transform(F.col(parents), lambda d, i: F.struct(
        d.alias("digest"), F.slice(F.col(children), i * FANOUT + 1, F.lit(FANOUT))
        .alias("children")))


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves``: tree, rank (gapless from 0 in its tree), digest.

    Returns the records (digest, children), one for each inner digest, and tree, digest, depth
    of every tree's root (depth 0: a lone leaf is its own root).
    """
    spark = leaves.sparkSession
    nodes = leaves.select("tree", "rank", "digest", F.lit(0).alias("depth"))
    most = leaves.agg(F.max("rank")).first()[0] or 0
    parts = []
    while most > 0:
        # a first block that is not full is its whole tree; all others have LEVELS above them
        blocks = nodes.groupBy("tree", F.floor(F.col("rank") / BLOCK).alias("rank")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("run"),
            F.max("depth").alias("depth"))
        size, levels = F.size("run"), F.lit(LEVELS)
        for k in range(LEVELS - 1, -1, -1):
            levels = F.when((F.col("rank") == 0) & (size <= FANOUT ** k), F.lit(k)) \
                .otherwise(levels)
        blocks = blocks.select("tree", "rank", F.col("depth").alias("below"),
                               levels.alias("levels"),
                               F.transform("run", lambda x: x["digest"]).alias("n0"))
        for k in range(LEVELS):
            blocks = blocks.withColumn(f"n{k + 1}", F.when(
                F.col("levels") > k, _joined(F.col(f"n{k}"))).otherwise(F.col(f"n{k}")))
        blocks = stage(blocks)
        made = [F.when(F.col("levels") > k, _records(f"n{k + 1}", f"n{k}")) for k in range(LEVELS)]
        none = F.slice(_records("n1", "n0"), 1, 0)
        parts.append(blocks.select(F.inline(F.concat(*[F.coalesce(m, none) for m in made]))))
        nodes = blocks.select("tree", "rank", F.get(F.col(f"n{LEVELS}"), F.lit(0)).alias("digest"),
                              (F.col("below") + F.col("levels")).alias("depth"))
        most //= BLOCK
    if not parts:
        none = spark.createDataFrame([], "digest string, children array<string>")
        return none, nodes.select("tree", "digest", "depth")
    records = parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    # equal runs of nodes are one record
    return stage(records.dropDuplicates(["digest"])), nodes.select("tree", "digest", "depth")


def digits(rank: Column, depth: Column) -> Column:
    """The rank in base FANOUT, one digit for each level, the highest first."""
    return F.lpad(F.conv(rank.cast("string"), 10, FANOUT), depth, F.lit("0"))


@dataclass(frozen=True)
class Manifest:
    records: DataFrame  # digest, children
    leaves: DataFrame   # columns handed over, digest, subroot, digits: the way from the root
    root: str | None    # None for an empty table


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str) -> Manifest:
    """``rows`` with a digest in column ``leaf``: one tree per value of ``group`` (a string,
    null is a group), leaves ascending by ``order`` (null first) and, where that ties, by
    digest.  Repeated rows are leaves of their own.  Columns named subroot and digits are
    replaced.
    """
    kept = [c for c in rows.columns if c.lower() not in ("subroot", "digits")]
    slim = stage(rows.select(
        F.struct(*[F.col(c) for c in kept]).alias("row"), group_key(F.col(group)).alias("tree"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(leaf).alias("digest"),
        F.monotonically_increasing_id().alias("row_id"), F.lit(1).cast("long").alias("one")))
    by = [*[f"o{i}" for i in range(len(order))], "digest", "row_id"]
    ranked = stage(scale.running(slim, ["tree"], by, "one", "rank")
                   .select("row", "tree", F.col("rank") - 1, "digest").toDF(
                       "row", "tree", "rank", "digest"))
    records, roots = build(ranked)
    roots = stage(roots)
    tops = scale.running(roots.withColumns({"all": F.lit(0), "one": F.lit(1).cast("long")}),
                         ["all"], ["tree"], "one", "place")
    tops = stage(tops.select(F.lit("").alias("tree"), (F.col("place") - 1).alias("rank"), "digest",
                             F.col("tree").alias("below"), F.col("depth").alias("deep")))
    upper, top = build(tops.select("tree", "rank", "digest"))
    found = top.first()
    if found is None:
        empty = rows.select(*[F.col(c) for c in kept], F.lit("").alias("subroot"),
                            F.lit("").alias("digits"))
        return Manifest(records, empty.limit(0), None)
    ways = tops.select(
        F.col("below").alias("tree"), F.col("digest").alias("subroot"), "deep",
        digits(F.col("rank"), F.lit(found["depth"])).alias("above"))
    placed = scale.join_small(ranked, ways, ["tree"], "rank", "inner")
    leaves = stage(placed.select("row.*", "subroot", F.concat(
        "above", digits(F.col("rank"), F.col("deep"))).alias("digits")))
    return Manifest(stage(records.unionByName(upper).dropDuplicates(["digest"])), leaves,
                    found["digest"])


def _split(children: Column, at: Column) -> Column:
    """What stands before and after one child."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), at), "").alias("before"),
                    F.array_join(F.slice(children, at + 2, F.lit(FANOUT)), "").alias("after"))


def prove(m: Manifest, requests: DataFrame) -> DataFrame:
    """Add proof to ``requests``, rows with a column digits as ``m.leaves`` has them: the
    siblings (before, after) level by level, from the leaf to the root.

    A way that the records do not know is an error.  A column proof is replaced.
    """
    requests = requests.drop("proof")
    deepest = requests.agg(F.max(F.length("digits"))).first()[0] or 0
    if m.root is None:
        return requests.withColumn("proof", F.array().cast(
            "array<struct<before:string,after:string>>"))
    spark = requests.sparkSession
    path = "array<struct<before:string,after:string>>"
    front = spark.range(1).select(F.lit("").alias("prefix"), F.lit(m.root).alias("digest"),
                                  F.array().cast(path).alias("path"))
    passed = None  # nodes that requests pass, with what was collected above them
    for level in range(deepest):
        front = F.broadcast(front) if level <= SMALL else front
        met = front.join(m.records, "digest").select("prefix", "path", "children")
        met = stage(met.repartition(1) if level <= SMALL else met)  # few rows, few files
        passed = met if passed is None else passed.unionByName(met)
        if level + 1 == deepest:
            break
        wanted = (requests.filter(F.length("digits") > level + 1)
                  .select(F.substring("digits", 1, level + 1).alias("prefix")).distinct())
        wanted = F.broadcast(wanted) if level + 1 <= SMALL else wanted
        front = met.select("prefix", "path", "children", F.posexplode("children").alias("at", "digest"))
        front = front.select(
            F.concat("prefix", F.col("at").cast("string")).alias("prefix"), "digest",
            F.concat("path", F.array(_split(F.col("children"), F.col("at")))).alias("path"))
        front = front.join(wanted, "prefix", "left_semi")
    if passed is None:
        return requests.withColumn("proof", F.array().cast(path))
    n, (of, above, children) = F.length("digits"), fresh(requests, "_of", "_path", "_children")
    parents = passed.select(F.col("prefix").alias(of), F.col("path").alias(above),
                            F.col("children").alias(children))
    found = requests.join(parents, (n > 0) & (F.substring("digits", F.lit(1), n - 1)
                                              == F.col(of)), "left")
    last = F.substring("digits", n, F.lit(1)).cast("int")
    whole = F.concat(above, F.array(_split(F.col(children), last)))
    known = F.col(children).isNotNull() & (last < F.size(children))
    return found.withColumn("proof", F.when(n == 0, F.array().cast(path))
                            .when(known, F.reverse(whole))
                            .otherwise(F.raise_error(F.concat(
                                F.lit("no record on the way "), "digits")).cast(path))) \
        .select(*requests.columns, "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, from the leaf up and left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))
