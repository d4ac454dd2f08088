"""Extractive answers, refusals, research briefs and the check of every material claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lekhya import fixed_values as fv
from lekhya.functions.regex import java_pattern
from lekhya.functions.text import strip, text_or_empty
from lekhya.operators.evidence import Packet

QUOTED_PASSAGES = 4


def extract_claims(df: DataFrame, text: str = "text") -> DataFrame:
    """Dates, amounts, rule or order numbers and authorities stated in a text, one per row."""
    def row(kind: str):
        return lambda m, i: F.struct(F.lit(kind).alias("claim_type"), i.alias("claim_pos"),
                                     strip(m).alias("claim"))

    found = [F.transform(F.regexp_extract_all(
        text_or_empty(F.col(text)), F.lit(java_pattern(p, True)), F.lit(0)), row(kind))
        for kind, p in fv.CLAIM_PATTERNS]
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.inline(F.concat(*found))).filter(F.length("claim") > 1)


def is_grounded(claim_type: Column, claim: Column, corpus: Column) -> Column:
    """The claim occurs in the corpus, or is numeric and all its digit runs do."""
    digits = F.regexp_extract_all(claim, F.lit(r"\p{Nd}+"), F.lit(0))
    numeric = claim_type.isin(fv.NUMERIC_CLAIMS) & (F.size(digits) > 0) \
        & F.forall(digits, lambda d: F.contains(corpus, d))
    return F.contains(corpus, strip(F.lower(claim))) | numeric


def packet_corpus(packet: Packet) -> DataFrame:
    """Everything a claim may rest on, per question (at most eight passages)."""
    parts = F.struct("position", F.concat(text_or_empty(F.col("content")), F.lit(" "),
                                          text_or_empty(F.col("go_number"))).alias("t"),
                     *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                       for c in ("order_date", "effective_from", "effective_to")])
    rows = packet.passages.groupBy("query_id").agg(
        F.array_sort(F.collect_list(parts)).alias("p"))
    rows = rows.join(packet.summary.select("query_id", "currency_banner"), "query_id")
    columns = [F.array_join(F.col(f"p.{n}"), " ")
               for n in ("t", "order_date", "effective_from", "effective_to")]
    text = F.concat_ws(" ", columns[0], text_or_empty(F.col("currency_banner")), *columns[1:])
    return rows.select("query_id", F.lower(text).alias("corpus"))


def validate(answers: DataFrame, corpora: DataFrame) -> DataFrame:
    """Per question whether every material claim is grounded, and the errors otherwise."""
    claims = extract_claims(answers.select("query_id", "answer"), "answer")
    checked = claims.join(corpora, "query_id").withColumn(
        "ok", is_grounded(F.col("claim_type"), F.col("claim"), F.col("corpus")))
    message = F.concat(F.lit("Material claim ["), F.col("claim_type"), F.lit(": '"),
                       F.col("claim"), F.lit("'] not found in retrieved evidence passages."))
    errors = checked.groupBy("query_id").agg(
        F.bool_and("ok").alias("validation_passed"),
        F.array_sort(F.collect_list(F.when(~F.col("ok"), message))).alias("validation_errors"))
    return answers.join(errors, "query_id", "left").select(
        answers["*"], F.coalesce("validation_passed", F.lit(True)).alias("validation_passed"),
        F.coalesce("validation_errors", F.array().cast("array<string>")).alias(
            "validation_errors"))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def passage_substance(content: Column) -> Column:
    """The passage without letterhead and reference lines, on one line."""
    lines = _lines(content)
    letterhead = java_pattern(fv.LETTERHEAD_LINE, True)
    reference = java_pattern(fv.REFERENCE_LINE, True)
    body = F.filter(lines, lambda x: ~x.rlike(letterhead) & ~x.rlike(reference))
    return F.array_join(F.when(F.size(body) > 0, body).otherwise(lines), " ")


def _joined(parts: DataFrame, text: str, separator: str) -> DataFrame:
    return parts.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", text))), lambda x: x[text]),
        separator).alias(text))


def extractive_answers(packet: Packet) -> DataFrame:
    """Conflict notice, up to four passages with markers, currency footer."""
    named = F.coalesce(F.nullif("go_number", F.lit("")), F.col("title"))
    prefix = (F.when(F.col("is_superseding") | (F.col("currency_status") == "SUPERSEDES"),
                     F.concat(F.lit("Under order "), named, F.lit(" (superseding order): ")))
              .when(F.col("currency_status").isin("AMENDED", "SUPERSEDED"),
                    F.concat(F.lit("Under previous order "), named, F.lit(": ")))
              .otherwise(""))
    parts = packet.passages.filter(F.col("position") <= QUOTED_PASSAGES).select(
        "query_id", "position", F.concat(
            prefix, passage_substance(F.col("content")), F.lit(" ["),
            F.col("position").cast("string"), F.lit("]")).alias("body"))
    body = _joined(parts, "body", "\n\n")
    distinct_notes = (packet.conflicts.groupBy("query_id", "notes")
                      .agg(F.min(F.struct("position", "edge_id")).alias("at"))
                      .select("query_id", F.col("at").alias("position"),
                              F.concat(F.lit("- "), F.col("notes")).alias("notice")))
    notices = _joined(distinct_notes, "notice", "\n")
    footer = F.concat(F.lit("\n*Currency Status: "), F.col("currency_banner"), F.lit("*"))
    rows = (body.join(notices, "query_id", "left").join(packet.summary, "query_id"))
    notice = F.concat(F.lit(fv.CONFLICT_HEADER), F.col("notice"))
    return rows.select("query_id", F.concat_ws("\n\n", notice, "body", footer).alias("answer"))


def research_briefs(packet: Packet, parsed: DataFrame) -> DataFrame:
    """A brief for high-risk questions; the decision stays with a human authority."""
    number = F.when(F.length("go_number") > 0, F.concat(
        F.lit(" (GO: "), F.col("go_number"), F.lit(")"))).otherwise("")
    sentence = F.substring(F.substring_index("content", "\n", 1), 1, 300)
    parts = packet.passages.filter(F.col("position") <= QUOTED_PASSAGES).select(
        "query_id", "position", F.concat(
            F.lit("- **["), F.col("position").cast("string"), F.lit("] "), F.col("title"),
            F.lit("**"), number, F.lit(" [Page "), F.col("page_start").cast("string"),
            F.lit(']:\n  "'), sentence, F.lit('"')).alias("body"))
    rows = (_joined(parts, "body", "\n").join(packet.summary, "query_id")
            .join(parsed.filter("is_high_risk").select("query_id", "clean_query",
                                                       "high_risk_category"), "query_id"))
    category = F.initcap(F.replace(F.coalesce(
        "high_risk_category", F.lit("ADMINISTRATIVE_DECISION")), F.lit("_"), F.lit(" ")))
    status = F.coalesce(F.concat(F.lit("- **Currency Alert:** "), F.col("currency_banner"),
                                 F.lit("\n")), F.lit(fv.BRIEF_CURRENT))
    return rows.select("query_id", F.concat(
        F.lit(fv.BRIEF_HEADER), F.lit("**Query Topic:** "), F.col("clean_query"),
        F.lit("\n**Risk Category:** "), category, F.lit("\n\n"), F.lit(fv.BRIEF_RECORDS),
        F.col("body"), F.lit(fv.BRIEF_STATUS), status, F.lit(fv.BRIEF_FOOTER)).alias("answer"))


def outcome(is_no_answer: Column, is_high_risk: Column, validation_passed: Column) -> Column:
    return (F.when(is_no_answer, "abstained")
             .when(is_high_risk | ~validation_passed, "needs_review").otherwise("answered"))


def respond(parsed: DataFrame, packet: Packet) -> DataFrame:
    """One response per question: answer, brief or refusal, validated, with its outcome."""
    risky = parsed.filter("is_high_risk").select("query_id")
    plain = extractive_answers(packet).join(risky, "query_id", "left_anti")
    checked = validate(plain.unionByName(research_briefs(packet, parsed)),
                       packet_corpus(packet))
    rows = parsed.select("query_id", "clean_query", "is_high_risk").join(
        checked, "query_id", "left")
    missing = F.col("answer").isNull()
    passed = F.coalesce("validation_passed", F.lit(True))
    return rows.select(
        "query_id", "clean_query", F.coalesce("answer", F.lit(fv.REFUSAL)).alias("answer"),
        missing.alias("is_no_answer"), "is_high_risk",
        (F.col("is_high_risk") & ~missing).alias("is_research_brief"),
        passed.alias("validation_passed"),
        F.coalesce("validation_errors", F.array().cast("array<string>")).alias(
            "validation_errors"),
        F.when(missing, F.array(*[F.lit(s) for s in fv.SEARCH_SUGGESTIONS]))
         .otherwise(F.array().cast("array<string>")).alias("search_suggestions"),
        outcome(missing, F.col("is_high_risk"), passed).alias("outcome"))


def request_hash(message: Column, roles: Column, collections: Column) -> Column:
    def part(c: Column) -> Column:
        return F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    return F.sha2(F.concat_ws("|", strip(message), part(roles), part(collections)), 256)


def audit_rows(responses: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Append-only execution audit; the query text is redacted."""
    from lekhya.functions.safety import redact
    state = F.when(F.col("is_no_answer"), "ABSTAINED").otherwise("COMPLETED")
    return responses.join(users, "query_id", "left").select(
        "query_id", "user_id", redact(F.col("clean_query")).alias("query_text"),
        F.lit(1).alias("retrieval_passes"), F.lit(1).alias("answer_passes"), "is_no_answer",
        "is_high_risk", "validation_passed", state.alias("final_state"),
        now.alias("created_at"))


def provenance_rows(responses: DataFrame, packet: Packet, now: Column) -> DataFrame:
    """Append-only provenance: what an answer rested on (at most eight version ids)."""
    versions = packet.passages.groupBy("query_id").agg(F.array_sort(
        F.collect_set(F.col("version_id").cast("string"))).alias("index_version_ids"))
    return responses.join(versions, "query_id", "left").select(
        request_hash(F.col("clean_query"), F.array(), F.array()).alias("request_hash"),
        F.col("query_id").alias("trace_id"),
        F.coalesce("index_version_ids", F.array().cast("array<string>")).alias("index_version_ids"),
        F.col("outcome").alias("status"), now.alias("at"))
