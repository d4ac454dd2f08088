"""Stored postings with block maxima, searched by a whole table of questions in one pass.

Rows are numbered into blocks of bounded size.  The index holds, per term and block, the
postings of that block with the largest frequency and the smallest length among them, and per
term and access group the number of rows.  Statistics of a question come from what its
audience may see, by sums over access groups, before any posting is read.

From the maxima follows the most that a block can score for a question.  The most promising
blocks are scored first; the k-th score found there is a floor, and only blocks that can reach
it are read after that.  Scores and order are those of the full evaluation.

Question terms, blocks asked for and access are slim and are brought to the postings as long as
they are few; then only postings of the questions' terms move, once, to where their block is
scored, and of a block no more than the best rows of a question leave the task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lekhya import fixed_values as fv
from lekhya.functions.text import tokens
from lekhya.operators.retrieval import bm25_term
from lekhya.operators.scale import BROADCAST_ROWS, top_k
from lekhya.session import stage

BLOCK = 256      # rows of a block
FIRST = 2        # blocks of a question that set its floor
PLACES = 6       # decimals of a score that count for the order
SLACK = 10.0 ** -PLACES


@dataclass(frozen=True)
class Index:
    rows: DataFrame      # doc, group, block, len
    terms: DataFrame     # term, group, df
    maxima: DataFrame    # term, block, most_tf, least_len
    postings: DataFrame  # term, block, entries: doc, group, tf, len


def build(chunks: DataFrame, doc: str, text: Column, group: Column) -> Index:
    """Index ``text`` of every row under its key ``doc``; ``group`` is what access depends on.

    A null or empty text has no terms but counts for the average length.  Keys are expected to
    be unique; rows without one are left out.
    """
    numbered = chunks.filter(F.col(doc).isNotNull()).select(
        F.col(doc).alias("doc"), F.coalesce(group.cast("string"), F.lit("")).alias("group"),
        F.floor(F.monotonically_increasing_id() / BLOCK).alias("block"),
        tokens(text).alias("toks"))
    # words in order as one text: a fraction of a list of words, and equal ones side by side
    numbered = stage(numbered.select("doc", "group", "block", F.size("toks").alias("len"),
                                     F.array_join(F.array_sort("toks"), " ").alias("words")))
    # dealt out by block once, before words become rows: both groupings below stay in place
    counted = (numbered.repartition("block").filter("len > 0")
               .select("doc", "group", "block", "len",
                       F.explode(F.split("words", " ")).alias("term"))
               .groupBy("term", "block", "doc", "group", "len")
               .agg(F.count(F.lit(1)).cast("int").alias("tf")))
    postings = stage(counted.groupBy("term", "block").agg(
        F.max("tf").alias("most_tf"), F.min("len").alias("least_len"),
        F.collect_list(F.struct("doc", "group", "tf", "len")).alias("entries")))
    return Index(numbered.drop("words"), _by_group(postings),
                 postings.select("term", "block", "most_tf", "least_len"),
                 postings.select("term", "block", "entries"))


def _by_group(postings: DataFrame) -> DataFrame:
    """term, group, df of some postings."""
    return (postings.select("term", F.explode("entries.group").alias("group"))
            .groupBy("term", "group").agg(F.count(F.lit(1)).alias("df")))


def _few(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows``, a staged table, to be brought to all tasks if there are at most ``most``."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _asked_postings(index: Index, asked: DataFrame) -> DataFrame:
    """The postings of terms of ``asked``."""
    return index.postings.join(_few(stage(asked.select("term").distinct())), "term", "left_semi")


def question_terms(questions: DataFrame) -> DataFrame:
    """query_id, audience, term, m (multiplicity) of a question table with a column text."""
    return (questions.select("query_id", "audience", F.explode(tokens(F.col("text"))).alias("term"))
            .groupBy("query_id", "audience", "term").agg(F.count(F.lit(1)).alias("m")))


def granted_beyond(index: Index, audiences: DataFrame, granted: DataFrame) -> DataFrame:
    """audience, doc, len of rows that a grant shows to an audience that does not see their
    group."""
    held = granted.select("audience", "doc").distinct().join(index.rows, "doc")
    return held.join(audiences, ["audience", "group"], "left_anti").select("audience", "doc", "len")


def weighted_terms(index: Index, asked: DataFrame, audiences: DataFrame,
                   beyond: DataFrame) -> DataFrame:
    """``asked`` with n, average (rows and mean length of what the audience sees) and df."""
    sizes = index.rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"))
    seen = audiences.join(sizes, "group").select("audience", "n", "len").unionByName(
        beyond.select("audience", F.lit(1).cast("long").alias("n"), F.col("len").cast("long")))
    totals = seen.groupBy("audience").agg(F.sum("n").alias("n"),
                                          (F.sum("len") / F.sum("n")).alias("average"))
    wanted = stage(asked.select("audience", "term").distinct())
    met = _asked_postings(index, wanted)
    by_group = wanted.join(_by_group(met), "term").join(audiences, ["audience", "group"]).select(
        "audience", "term", "df")
    # the rows that grants add first, then who asks for their terms
    single = (met.select("term", F.explode("entries.doc").alias("doc"))
              .join(_few(beyond.select("audience", "doc")), "doc")
              .join(_few(wanted), ["audience", "term"])
              .select("audience", "term", F.lit(1).cast("long").alias("df")))
    df = by_group.unionByName(single).groupBy("audience", "term").agg(F.sum("df").alias("df"))
    return asked.join(df, ["audience", "term"]).join(totals, "audience")


def block_bounds(index: Index, weighted: DataFrame) -> DataFrame:
    """query_id, block, bound: no row of the block scores more for the question."""
    most = F.col("m") * bm25_term(F.col("most_tf"), F.col("df"), F.col("n"), F.col("least_len"),
                                  F.col("average"))
    return index.maxima.join(_few(weighted), "term").groupBy("query_id", "block").agg(
        F.sum(most).alias("bound"))


def scored(index: Index, blocks: DataFrame, weighted: DataFrame, audiences: DataFrame,
           beyond: DataFrame, apart: bool = False) -> DataFrame:
    """query_id, doc, score of the rows of ``blocks`` (query_id, block) that may be seen.

    All of a block meets in one task; ``apart``: a key may stand in several blocks, so its rows
    are dealt out once more.
    """
    asking = stage(blocks.groupBy("block").agg(F.collect_set("query_id").alias("queries")))
    met = (_asked_postings(index, weighted).join(_few(asking.select("block")), "block", "left_semi")
           .select("term", "block", *[F.col(f"entries.{c}").alias(c)
                                      for c in ("doc", "group", "tf", "len")])
           .repartition("block"))
    # the exchange moves four plain lists; whoever asks for a block's term joins them after it
    questions = _few(stage(weighted.groupBy("term").agg(F.collect_list(F.struct(
        "query_id", "audience", "m", "df", "n", "average")).alias("asked"))))
    wanted = (met.join(questions, "term").join(_few(asking), "block")
              .withColumn("asked", F.filter("asked", lambda a: F.array_contains(
                  F.col("queries"), a["query_id"])))
              .select("block", F.arrays_zip("doc", "group", "tf", "len").alias("entries"),
                      F.inline("asked"))
              .select("block", "query_id", "audience", "m", "df", "n", "average",
                      F.inline("entries")))
    # of a key with several rows one may be seen by its group and by a grant, and counts for both
    seen = (wanted.join(_few(audiences.withColumn("_group", F.lit(1))), ["audience", "group"], "left")
            .join(_few(stage(beyond.select("audience", "doc").distinct()
                             .withColumn("_grant", F.lit(1)))), ["audience", "doc"], "left")
            .withColumn("_times", F.coalesce("_group", F.lit(0)) + F.coalesce("_grant", F.lit(0)))
            .filter("_times > 0"))
    part = F.col("_times") * F.col("m") * bm25_term(
        F.col("tf"), F.col("df"), F.col("n"), F.col("len"), F.col("average"))
    keys = ["query_id", "doc"] if apart else ["query_id", "block", "doc"]
    return (seen.groupBy(*keys).agg(F.round(F.sum(part), PLACES).alias("score"))
            .select("query_id", "doc", "score"))


def search(index: Index, questions: DataFrame, audiences: DataFrame, k: int = 10,
           granted: DataFrame | None = None, first: int = FIRST) -> DataFrame:
    """query_id, rank, doc, score: the ``k`` best rows of every question, ties to smaller keys.

    ``questions``: query_id, audience, text, of any number; ``audiences``: audience, group (the
    groups it sees); ``granted``: audience, doc (rows shown whatever their group).  Questions
    without terms, and those whose audience sees nothing, have no rows.
    """
    audiences = stage(audiences.select("audience", F.coalesce(F.col("group").cast("string"),
                                                              F.lit("")).alias("group")).distinct())
    if granted is None:
        granted = index.rows.limit(0).select(F.lit(None).cast(
            audiences.schema["audience"].dataType).alias("audience"), "doc")
    beyond = stage(granted_beyond(index, audiences, granted))
    # keys are expected to be unique; one that stands in several blocks is scored over all of them
    apart = not (index.rows.groupBy("doc").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
                 .filter("lo <> hi").isEmpty())
    weighted = stage(weighted_terms(index, stage(question_terms(questions)), audiences, beyond))
    bounds = stage(block_bounds(index, weighted))
    start = stage(top_k(bounds, first, ["query_id"], [F.desc("bound"), F.col("block")], "_nth"))
    order = [F.desc("score"), F.col("doc")]

    def best(blocks):
        rows = scored(index, blocks.select("query_id", "block"), weighted, audiences, beyond, apart)
        return stage(top_k(rows, k, ["query_id"], order))

    found = best(start)
    floors = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    more = best(stage(remaining(bounds, start, floors)))
    return top_k(found.unionByName(more).drop("rank"), k, ["query_id"], order).select(
        "query_id", "rank", "doc", "score")


def remaining(bounds: DataFrame, start: DataFrame, floors: DataFrame) -> DataFrame:
    """query_id, block of the blocks not in ``start`` that can still reach a question's floor."""
    return (bounds.join(start.select("query_id", "block"), ["query_id", "block"], "left_anti")
            .join(floors, "query_id", "left")
            .filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))
            .select("query_id", "block"))


def totals(index: Index, questions: DataFrame, audiences: DataFrame,
           granted: DataFrame | None = None) -> DataFrame:
    """query_id, total: rows seen by its audience that hold a term of the question."""
    asked = stage(question_terms(questions))
    group = audiences.select("audience", F.coalesce(F.col("group").cast("string"), F.lit(""))
                             .alias("group")).distinct()
    met = index.postings.join(_few(asked), "term").select("query_id", "audience",
                                                          F.inline("entries"))
    rows = met.join(group, ["audience", "group"], "left_semi").select("query_id", "doc")
    if granted is not None:
        held = granted.select("audience", "doc").distinct()
        rows = rows.unionByName(met.join(held, ["audience", "doc"], "left_semi")
                                .select("query_id", "doc"))
    return rows.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
