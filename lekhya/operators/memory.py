"""Sessions, retention, grounded summaries, preferences and feedback.

Session content grows without limit for a busy session, so summaries are kept in
long form (one row per item) and every per-session step is a mergeable aggregate.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from lekhya import fixed_values as fv
from lekhya.functions.regex import java_pattern
from lekhya.functions.text import strip, text_or_empty
from lekhya.operators.scale import top_k
from lekhya.operators.understanding import parse_questions

INTENTS, INTENT_LENGTH, CORRECTION_LENGTH = 5, 80, 200


def session_expiry(start: Column, ttl: Column, pii: Column) -> Column:
    """Expiry from the requested lifetime; personal data is capped at one hour."""
    standard = F.when(ttl > 0, ttl).otherwise(fv.TTL_STANDARD)
    capped = F.when(ttl > 0, F.least(ttl, F.lit(fv.TTL_PII))).otherwise(fv.TTL_PII)
    seconds = F.when(F.coalesce(pii, F.lit(False)), capped).otherwise(standard)
    return start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def open_sessions(sessions: DataFrame, user_id: str, now: datetime) -> DataFrame:
    """The caller's own sessions that have not expired."""
    return sessions.filter((F.col("user_id") == user_id) & (F.col("expires_at") > F.lit(now)))


def shorten_for_personal_data(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """A turn with personal data pulls the session's expiry to within an hour of it."""
    cap = turns.filter("has_pii").groupBy("session_id").agg(
        (F.min("created_at") + F.make_dt_interval(secs=F.lit(fv.TTL_PII))).alias("_cap"))
    return sessions.join(cap, "session_id", "left").withColumn(
        "expires_at", F.least("expires_at", "_cap")).drop("_cap")


def split_expired(sessions: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    expired = F.col("expires_at") <= F.lit(now)
    return sessions.filter(expired), sessions.filter(~expired)


def surviving_turns(turns: DataFrame, sessions: DataFrame, now: datetime) -> DataFrame:
    gone, _ = split_expired(sessions, now)
    return turns.join(gone.select("session_id"), "session_id", "left_anti")


def purge_summary(sessions: DataFrame, turns: DataFrame, now: datetime) -> DataFrame:
    """How many sessions and turns a purge removes."""
    gone, _ = split_expired(sessions, now)
    removed = turns.join(gone.select("session_id"), "session_id", "left_semi")
    return gone.agg(F.count(F.lit(1)).alias("sessions_purged")).select(
        "sessions_purged",
        removed.agg(F.count(F.lit(1)).alias("n")).scalar().alias("turns_purged"))


def purge_audit(sessions: DataFrame, now: datetime, actor: str = "system") -> DataFrame:
    """One audit row per purged session, without any content."""
    gone, _ = split_expired(sessions, now)
    return gone.select(F.lit("CHAT_SESSION").alias("entity_type"),
                       F.col("session_id").alias("entity_id"),
                       F.lit("PURGE_EXPIRED").alias("action"), F.lit(actor).alias("actor"),
                       F.lit(now).alias("at"))


def summary_items(turns: DataFrame) -> DataFrame:
    """Grounded session summaries in long form.

    Rows (session_id, item, value, turn): up to five intents (risk categories are
    exempt from the limit), the last value of each filter, distinct citations and
    corrections, and every source turn.  ``turns``: session_id, turn, turn_id, role,
    content, cited_chunk_ids.
    """
    said = parse_questions(turns.filter(F.col("role") == "user"), "content")
    risk = (said.filter("is_high_risk").groupBy("session_id", F.col("high_risk_category").alias("value"))
            .agg(F.min("turn").alias("turn")))
    # the first question of a risk category gives the category; repeats count as plain
    repeated = (said.filter("is_high_risk")
                .join(risk.select("session_id", F.col("value").alias("high_risk_category"),
                                  F.col("turn").alias("_first")),
                      ["session_id", "high_risk_category"])
                .filter(F.col("turn") > F.col("_first")))
    columns = ["session_id", "turn", "clean_query"]
    plain = (said.filter(~F.col("is_high_risk")).select(*columns)
             .unionByName(repeated.select(*columns))
             .withColumn("value", strip(F.substring("clean_query", 1, INTENT_LENGTH)))
             .filter("value <> ''").groupBy("session_id", "value").agg(F.min("turn").alias("turn")))
    # a plain intent is taken only while fewer than five intents are held; risk
    # intents of earlier turns count towards that, later ones do not
    early = top_k(plain, INTENTS, ["session_id"], [F.col("turn")], "_n")
    before = (early.join(risk.select("session_id", F.col("turn").alias("_risk_turn")),
                         "session_id", "left")
              .groupBy("session_id", "value", "turn", "_n")
              .agg(F.count_if(F.col("_risk_turn") < F.col("turn")).alias("_earlier")))
    kept = before.filter(F.col("_n") - 1 + F.col("_earlier") < INTENTS).select(
        "session_id", "value", "turn")
    intents = risk.select("session_id", "value", "turn").unionByName(kept)
    filters = None
    for name in ("department_id", "doc_type", "go_number", "exact_date"):
        last = (said.filter(F.col(name).isNotNull()).groupBy("session_id").agg(
            F.max_by(F.col(name).cast("string"), "turn").alias("value"), F.max("turn").alias("turn"))
            .select("session_id", F.lit(f"filter:{name}").alias("item"), "value", "turn"))
        filters = last if filters is None else filters.unionByName(last)
    snippets = F.array_compact(F.array(*[
        F.nullif(strip(F.regexp_extract("content", java_pattern(p), 0)), F.lit(""))
        for p in fv.CORRECTION_PATTERNS]))
    corrections = (said.select("session_id", "turn", F.explode(snippets).alias("value"))
                   .withColumn("value", F.substring("value", 1, CORRECTION_LENGTH))
                   .groupBy("session_id", "value").agg(F.min("turn").alias("turn")))
    cited = (turns.filter(F.col("role") == "assistant")
             .select("session_id", "turn", F.explode("cited_chunk_ids").alias("value"))
             .filter("value <> ''").groupBy("session_id", "value").agg(F.min("turn").alias("turn")))
    sources = turns.select("session_id", F.col("turn_id").cast("string").alias("value"), "turn")

    def labelled(df: DataFrame, item: str) -> DataFrame:
        return df.select("session_id", F.lit(item).alias("item"), "value", "turn")

    return (labelled(intents, "intent").unionByName(filters)
            .unionByName(labelled(corrections, "correction"))
            .unionByName(labelled(cited, "citation"))
            .unionByName(labelled(sources, "source_turn")))


def valid_preferences(requests: DataFrame) -> DataFrame:
    """Requests with consent and a stated purpose; ``problem`` says why others fail."""
    problem = (F.when(F.length(strip(text_or_empty(F.col("user_id").cast("string")))) == 0,
                      "user_id is required")
               .when(~F.coalesce(F.col("opt_in"), F.lit(False)), "opt-in required")
               .when(F.length(strip(text_or_empty(F.col("purpose")))) < 5, "purpose required"))
    return requests.withColumn("problem", problem)


def current_preferences(events: DataFrame) -> DataFrame:
    """Latest stored preference per user; a deletion removes the user.

    ``events``: user_id, event_id, deleted, opt_in, purpose, data, at.
    """
    checked = valid_preferences(events).filter("deleted OR problem IS NULL")
    last = checked.groupBy("user_id").agg(F.max_by(
        F.struct("deleted", "purpose", "data", "at"), F.struct("at", "event_id")).alias("p"))
    return last.filter("NOT p.deleted").select("user_id", "p.purpose", "p.data", "p.at")


def encrypt(c: Column, key: Column) -> Column:
    """Authenticated encryption of a text column, base64."""
    return F.base64(F.aes_encrypt(c, key, F.lit("GCM")))


def decrypt(c: Column, key: Column) -> Column:
    """Clear text; NULL for anything forged or damaged."""
    return F.try_aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")


def valid_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback fit to append: a trace and, if rated, a rating from 1 to 5."""
    return feedback.filter((F.length(text_or_empty(F.col("trace_id"))) > 0)
                           & F.coalesce(F.col("rating").between(1, 5), F.lit(True)))
