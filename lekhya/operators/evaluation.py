"""Question sets with known answers and their scoring against a search run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lekhya import fixed_values as fv


def gold_questions(records: DataFrame) -> DataFrame:
    """One known-answer question per numbered record and one unanswerable one per department.

    ``records``: document_id, go_number, page_start, department_id, lang.
    """
    numbered = records.filter(F.length("go_number") > 0)
    known = numbered.select(
        F.concat(F.lit("known-"), F.col("document_id").cast("string")).alias("query_id"),
        F.concat(F.lit("What does order no. "), F.col("go_number"), F.lit(" provide?")).alias("text"),
        F.lit("known_answer").alias("category"), "department_id", F.col("lang").alias("language"),
        F.col("document_id").alias("expected_document"), F.col("page_start").alias("expected_page"))
    none = records.select("department_id").distinct().select(
        F.concat(F.lit("none-"), "department_id").alias("query_id"),
        F.concat(F.lit("Metro rail fares under "), "department_id").alias("text"),
        F.lit("no_answer").alias("category"), "department_id", F.lit("en").alias("language"))
    return known.unionByName(none, allowMissingColumns=True)


def evaluate(questions: DataFrame, passages: DataFrame, citations: DataFrame,
             responses: DataFrame) -> DataFrame:
    """Outcome per question, ready for ``metrics.pilot_gate`` and ``metrics.scorecard``.

    Recall looks at every passage of the packet, page precision at the first citation.
    An access question names the document that must not appear.
    """
    found = (questions.select("query_id", "expected_document")
             .join(passages.select("query_id", F.col("document_id").alias("expected_document"))
                   .distinct(), ["query_id", "expected_document"], "left_semi")
             .select("query_id", F.lit(True).alias("_found")))
    first = citations.filter("citation = 1").select("query_id", F.col("page").alias("_page"))
    rows = (questions.join(found, "query_id", "left").join(first, "query_id", "left")
            .join(responses.select("query_id", "is_no_answer", "answer"), "query_id", "left"))
    hit = F.coalesce("_found", F.lit(False))
    refused = F.coalesce("is_no_answer", F.lit(True)) | F.coalesce(
        F.contains("answer", F.lit(fv.REFUSAL)), F.lit(False))
    answering = ~F.col("category").isin("no_answer", "acl_denied")
    success = (F.when(F.col("category") == "no_answer", refused)
               .when(F.col("category") == "acl_denied", ~hit & refused).otherwise(hit))
    return rows.select(
        "query_id", "category", F.col("department_id").alias("department"), "language",
        refused.alias("refused"), (hit & (F.col("category") == "acl_denied")).alias("leaked"),
        F.when(answering, hit).alias("recall_hit"),
        F.when(answering & F.col("_page").isNotNull() & F.col("expected_page").isNotNull(),
               F.col("_page") == F.col("expected_page")).alias("page_hit"),
        success.alias("success"))
