"""Retrieval, abstention, grounding and latency metrics as mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lekhya.functions.text import strip, text_or_empty, words
from lekhya.operators.scale import exact_percentiles, top_k


def ndcg(ranking: DataFrame, judgements: DataFrame, k: int = 10) -> DataFrame:
    """nDCG@k per query; the ideal ranking is over all judged items.

    ``ranking``: query_id, item_id, rank (from 1).  ``judgements``: query_id, item_id,
    relevance.  Queries without ranking or without judgements score 0.
    """
    def gain(rel: Column, rank: Column) -> Column:
        return F.when(rel > 0, (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1.0)).otherwise(0.0)

    shown = ranking.filter(F.col("rank") <= k).join(judgements, ["query_id", "item_id"], "left")
    dcg = shown.groupBy("query_id").agg(F.sum(
        gain(F.coalesce("relevance", F.lit(0)), F.col("rank"))).alias("dcg"))
    best = top_k(judgements, k, ["query_id"], [F.desc("relevance"), F.col("item_id")], "_r")
    idcg = best.groupBy("query_id").agg(F.sum(gain(F.col("relevance"), F.col("_r"))).alias("idcg"))
    both = dcg.join(idcg, "query_id", "full")
    score = (F.when(F.col("dcg").isNull() | F.col("idcg").isNull(), 0.0)
             .when(F.col("idcg") == 0, F.when(F.col("dcg") == 0, 1.0).otherwise(0.0))
             .otherwise(F.col("dcg") / F.nullif("idcg", F.lit(0.0))))
    return both.select("query_id", score.alias("ndcg"))


def claim_covered(claim: Column, evidence: Column) -> Column:
    """Half of the claim's words of four or more letters occur in the evidence.

    A claim without such words counts as covered, a blank claim does not.
    """
    terms = F.filter(words(F.lower(claim)), lambda t: F.length(t) >= 4)
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(evidence), t)))
    return F.when(F.length(strip(text_or_empty(claim))) == 0, False).otherwise(
        (F.size(terms) == 0) | (hits * 2 >= F.size(terms)))


def citation_coverage(claims: DataFrame, keys: list[str], evidence: str = "evidence") -> DataFrame:
    """Share of covered claims and its complement per group; no evidence covers nothing."""
    has = F.length(text_or_empty(F.col(evidence))) > 0
    covered = F.when(has, claim_covered(F.col("claim"), F.col(evidence))).otherwise(False)
    share = F.avg(covered.cast("double"))
    return claims.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("claims"), share.alias("coverage"),
        F.round(F.greatest(F.lit(0.0), 1.0 - share), 4).alias("unsupported_rate"))


def _ratio(top: Column, bottom: Column, empty: float) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(empty))


def abstention(df: DataFrame, prediction: str, truth: str, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and accuracy of abstaining, with the confusion counts."""
    p, t = F.col(prediction), F.col(truth)
    counts = df.groupBy(*(keys or [])).agg(
        F.count_if(p & t).alias("true_positives"), F.count_if(p & ~t).alias("false_positives"),
        F.count_if(~p & t).alias("false_negatives"), F.count_if(~p & ~t).alias("true_negatives"))
    tp, fp, fn, tn = [F.col(f"{a}_{b}") for a, b in (
        ("true", "positives"), ("false", "positives"), ("false", "negatives"),
        ("true", "negatives"))]
    precision, recall = _ratio(tp, tp + fp, 1.0), _ratio(tp, tp + fn, 1.0)
    f1 = _ratio(2 * precision * recall, precision + recall, 0.0)
    return counts.select(*(keys or []), F.round(precision, 4).alias("precision"),
                         F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"),
                         F.round(_ratio(tp + tn, tp + fp + fn + tn, 0.0), 4).alias("accuracy"),
                         "true_positives", "false_positives", "false_negatives",
                         "true_negatives")


def latency_percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nearest-rank p50, p90, p95, p99 with mean, extremes and count, to 2 decimals."""
    ranks = exact_percentiles(df, keys, value, [50, 90, 95, 99])
    basic = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"),
                                  F.max(value).alias("max"), F.count(value).alias("count"))
    names = ("p50", "p90", "p95", "p99", "mean", "min", "max")
    return ranks.join(basic, keys).select(
        *keys, *[F.round(n, 2).alias(n) for n in names], "count")


def gate_latency(sorted_values: Column) -> Column:
    """The promotion gate's own p95: element int(0.95 n) of the few probe calls."""
    return F.element_at(F.array_sort(sorted_values),
                        F.floor(F.size(sorted_values) * 0.95).cast("int") + 1)


def correction_rate(corrections: Column, turns: Column) -> Column:
    return F.coalesce(F.round(F.least(F.lit(1.0), corrections / F.nullif(turns, F.lit(0))), 4),
                      F.lit(0.0))


def scorecard(outcomes: DataFrame) -> DataFrame:
    """Accuracy overall, by department and by language in one pass.

    ``outcomes``: department, language, success.  ``level`` tells the rows apart.
    """
    rows = outcomes.groupingSets([[], ["department"], ["language"]], "department", "language").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("total"),
        F.round(F.avg(F.col("success").cast("double")), 4).alias("accuracy"))
    level = (F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "department")
             .otherwise("language"))
    return rows.select(level.alias("level"), F.coalesce("department", "language", F.lit("all"))
                       .alias("value"), "total", "accuracy")


def pilot_gate(outcomes: DataFrame) -> DataFrame:
    """Pilot gates over evaluated questions.

    ``outcomes``: category, refused, leaked, recall_hit, page_hit (NULL when not judged).
    """
    answering = ~F.col("category").isin("no_answer", "acl_denied")
    rates = outcomes.agg(
        F.coalesce(F.avg(F.when(answering, F.col("recall_hit").cast("double"))), F.lit(0.0))
        .alias("recall_at_k"),
        F.coalesce(F.avg(F.when(answering, F.col("page_hit").cast("double"))), F.lit(0.0))
        .alias("page_precision"),
        F.coalesce(F.avg(F.when(F.col("category") == "no_answer",
                                F.col("refused").cast("double"))), F.lit(0.0))
        .alias("refusal_rate"),
        F.count_if((F.col("category") == "acl_denied") & F.col("leaked")).alias("leaks"))
    return rates.withColumn("passed", (F.col("recall_at_k") >= 0.90)
                            & (F.col("page_precision") >= 0.95)
                            & (F.col("refusal_rate") >= 1.0) & (F.col("leaks") == 0))


def promotion_decision(gates: dict[str, Column]) -> Column:
    """(promoted, failed gate names) from named gate results."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name)
                                       for name, ok in gates.items()]))
    return F.struct((F.size(failed) == 0).alias("promoted"), failed.alias("failures"))
