"""Queries over review, retention, feedback and measurement steps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from lekhya import fixed_values as fv
from lekhya.operators import (access, automaton, chunking, memory, metrics, quality,
                              understanding)
from lekhya.plans.corpus import RECORDS_SQL, read, records
from lekhya.plans.registry import query

PURGE_AT = datetime(1996, 1, 1)


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records as pages, versions and documents."""
    r = records(spark, folder)
    pages = r.select("version_id", F.lit(1).alias("page_number"), "review_status")
    return (pages, r.select("version_id", "document_id"),
            r.select("document_id", "title", "lifecycle_status"))


@query("review_queue", f"""WITH {RECORDS_SQL} SELECT document_id, title, review_status FROM records
    WHERE review_status IN ('FLAGGED', 'PENDING')""")
def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    return quality.review_queue(*_parts(spark, folder)).select(
        "document_id", "title", "review_status")


@query("versions_to_chunk", f"""WITH {RECORDS_SQL} SELECT document_id AS version_id FROM records
    WHERE lifecycle_status = 'ACTIVE' AND review_status IN (
      {", ".join(f"'{s}'" for s in fv.APPROVED_REVIEW)})""")
def versions_to_chunk(spark: SparkSession, folder: str) -> DataFrame:
    pages, versions, documents = _parts(spark, folder)
    return chunking.versions_to_chunk(versions, documents, pages).select("version_id")


@query("detect_scan", f"""WITH p AS (SELECT page_id,
      length(regexp_replace(html, '<[^>]*>', '', 'g')) % 100 AS letters, page_id % 3 AS images FROM pages)
    SELECT page_id, letters < {fv.SCAN_TEXT_THRESHOLD} AND images > 0 AS scanned FROM p""")
def detect_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the last two digits of their text length as yield."""
    letters = F.length(F.regexp_replace("html", "<[^>]*>", "")) % 100
    return read(spark, folder, "pages").select(
        "page_id", quality.detect_scan(letters, F.col("page_id") % 3).alias("scanned"))


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("expires_at"))


@query("shortened_sessions", f"""WITH cap AS (SELECT l_orderkey, min(l_shipdate) + INTERVAL {fv.TTL_PII} SECOND AS cap
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
    SELECT o_orderkey AS session_id, least(o_orderdate + INTERVAL 60 DAY, cap) AS expires_at
    FROM orders LEFT JOIN cap ON o_orderkey = l_orderkey""")
def shortened_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as sessions, returned items as turns with personal data."""
    turns = read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").alias("created_at"),
        (F.col("l_returnflag") == "R").alias("has_pii"))
    return memory.shorten_for_personal_data(_sessions(spark, folder), turns)


@query("purge_audit", f"""SELECT 'CHAT_SESSION' AS entity_type, o_orderkey AS entity_id,
    'PURGE_EXPIRED' AS action, 'system' AS actor FROM orders
    WHERE o_orderdate + INTERVAL 60 DAY <= TIMESTAMP '{PURGE_AT}'""")
def purge_audit(spark: SparkSession, folder: str) -> DataFrame:
    return memory.purge_audit(_sessions(spark, folder), PURGE_AT).drop("at")


@query("valid_feedback", """WITH f AS (SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS trace,
      CASE WHEN event_id % 4 > 0 THEN CAST(floor(value) AS BIGINT) % 8 END AS rating FROM events)
    SELECT event_id, rating FROM f WHERE trace <> '' AND (rating IS NULL OR rating BETWEEN 1 AND 5)""")
def valid_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Events as feedback; errors lack a trace and every fourth a rating."""
    feedback = read(spark, folder, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
        .alias("trace_id"),
        F.when(F.col("event_id") % 4 > 0, F.floor("value").cast("long") % 8).alias("rating"))
    return memory.valid_feedback(feedback).select("event_id", "rating")


@query("gate_latency", """SELECT l_orderkey, list_sort(list(l_extendedprice))[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95
    FROM lineitem GROUP BY l_orderkey""")
def gate_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Items of an order as probe calls; their number is bounded."""
    return (read(spark, folder, "lineitem").groupBy("l_orderkey")
            .agg(F.collect_list("l_extendedprice").alias("v"))
            .select("l_orderkey", metrics.gate_latency(F.col("v")).alias("p95")))


_BRIEF = ["human authority required: ", "", "research brief, ", "I hereby order. "]


@query("compliant_briefs", rf"""WITH a AS (SELECT conv_id, turn, CASE turn % 4 {" ".join(
        f"WHEN {i} THEN '{b}'" for i, b in enumerate(_BRIEF))} END || CASE WHEN conv_id % 3 = 0
        THEN 'Hereby granted. ' ELSE '' END || text AS answer FROM conversations)
    SELECT conv_id, turn, ({" OR ".join(f"contains(lower(answer), '{m}')" for m in fv.HIGH_RISK_MARKERS)})
      AND NOT regexp_matches(lower(answer), '{fv.DEFINITIVE_ACTION}') AS compliant FROM a""")
def compliant_briefs(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as answers, some with the notice of a brief, some with a decision in them."""
    opening = F.get(F.array(*[F.lit(b) for b in _BRIEF]), (F.col("turn") % 4).cast("int"))
    decision = F.when(F.col("conv_id") % 3 == 0, "Hereby granted. ").otherwise("")
    answer = F.concat(opening, decision, "text")
    return read(spark, folder, "conversations").select(
        "conv_id", "turn", understanding.is_compliant_brief(answer).alias("compliant"))


@query("role_checks", """SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS allowed FROM customer""")
def role_checks(spark: SparkSession, folder: str) -> DataFrame:
    roles = F.array(F.lower("c_mktsegment"), F.lit("reader"))
    return read(spark, folder, "customer").select(
        "c_custkey", access.has_role(roles, "Building", "machinery").alias("allowed"))


@query("page_reference_quality", """WITH t AS (SELECT conv_id, turn, nfc_normalize(text) AS ref,
      nfc_normalize(CASE WHEN turn % 4 = 0 THEN translate(text, 'ae', 'oi') ELSE text END) AS got
      FROM conversations WHERE role = 'user' AND conv_id % 5 > 0)
    SELECT conv_id AS version_id, turn AS page_number,
      round(levenshtein(ref, got) / length(ref), 6) AS cer,
      round(len(list_filter(list_zip(string_split(ref, ''), string_split(got, '')), lambda p: p[1] = p[2]))
        / greatest(length(ref), length(got)), 6) AS exact_match FROM t""")
def page_reference_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Users' turns as pages with misread vowels; every fifth conversation has no reference."""
    turns = read(spark, folder, "conversations").filter("role = 'user'").select(
        F.col("conv_id").alias("version_id"), F.col("turn").alias("page_number"), "text")
    misread = turns.withColumn("text", F.when(F.col("page_number") % 4 == 0, F.translate(
        "text", "ae", "oi")).otherwise(F.col("text")))
    found = quality.page_reference_quality(misread, turns.filter("version_id % 5 > 0"))
    return found.select("version_id", "page_number", F.round("cer", 6).alias("cer"),
                        F.round("exact_match", 6).alias("exact_match"))


_STAGES = ", ".join(f"'{s}'" for s in fv.AGENT_STATES[:8])


@query("run_audits", f"""WITH s AS (SELECT conv_id, turn, CASE WHEN (conv_id * 7 + turn * 3) % 23 = 0 THEN 'RETRIEVE'
        ELSE list_extract([{_STAGES}], CAST(turn % 8 AS INT) + 1) END AS sign FROM conversations WHERE conv_id IS NOT NULL),
    p AS (SELECT *, coalesce(lag(sign) OVER w, 'NEW') AS state, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    x AS (SELECT *, coalesce(list_position([{_STAGES}], sign) = 1 + CASE state WHEN 'NEW' THEN 0 WHEN 'COMPLETED' THEN 0
        ELSE list_position([{_STAGES}], state) END, false) AS legal FROM p)
    SELECT conv_id, count(*) AS steps, CASE WHEN bool_and(legal) THEN arg_max(sign, r) ELSE 'ILLEGAL' END AS final_state,
      min(turn) FILTER (NOT legal) AS illegal_turn, arg_min(state, r) FILTER (NOT legal) AS illegal_state FROM x GROUP BY conv_id""")
def run_audits(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as the stages of a request; some retrieve where they should not."""
    c = read(spark, folder, "conversations").select("conv_id", "turn")
    stages = F.array(*[F.lit(s) for s in fv.AGENT_STATES[:8]])
    sign = F.when((F.col("conv_id") * 7 + F.col("turn") * 3) % 23 == 0, "RETRIEVE").otherwise(
        F.get(stages, (F.col("turn") % 8).cast("int")))
    audits = automaton.run_audits(c.withColumn("sign", sign), ["conv_id"], ["turn"], "sign",
                                  automaton.orchestration(), "NEW")
    wrong = F.col("first_illegal")
    return audits.select("conv_id", "steps", "final_state", wrong["turn"].alias("illegal_turn"),
                         wrong["state"].alias("illegal_state"))
