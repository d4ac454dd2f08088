"""Evidence packets: the passages kept for a question and what amends or conflicts with them.

Ranked hits are at most k per question, so they are small enough to broadcast
against chunks, precedent edges and versions; the large tables never shuffle.
Steps that several results share are staged once.
Relations stay in long form, because a much-cited order may have any number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from lekhya import fixed_values as fv
from lekhya.functions.regex import java_pattern
from lekhya.operators.access import User
from lekhya.operators.retrieval import with_grants
from lekhya.operators.scale import earliest_per, either, top_k
from lekhya.session import stage

CHANGING = ["SUPERSEDES", "AMENDS"]
PASSAGE = ["title", "department_id", "doc_type", "page_start", "page_end", "section_heading",
           "content", "go_number", "gazette_number", "order_date", "effective_from",
           "effective_to", "source_url", "sha256", "first_bbox"]


@dataclass(frozen=True)
class Packet:
    passages: DataFrame    # query_id, position, chunk, scores, texts, currency_status, flags
    amendments: DataFrame  # query_id, original and amending document, relation
    conflicts: DataFrame   # query_id, relation and rate conflicts with notes
    notes: DataFrame       # query_id, approved currency notes in order
    summary: DataFrame     # query_id, currency_status, currency_banner


def _with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [F.lit(None).cast("string").alias(n) for n in names if n not in df.columns]
    return df.select("*", *missing)


def select_passages(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits within reach of the best score (or naming the order asked for), at most eight."""
    w = Window.partitionBy("query_id").orderBy("rank")
    best = hits.withColumn("_top", F.first("score").over(w))
    floor = F.greatest(F.lit(fv.PACKET_ABSOLUTE), F.col("_top") * fv.PACKET_RELATIVE)
    kept = top_k(best.filter((F.col("score") >= floor) | F.col("go_match")), fv.PACKET_MAX,
                 ["query_id"], [F.col("rank")], "position").drop("_top", "rank")
    kept = stage(kept)
    # the semi join goes below the making of texts, so they are made for the kept chunks only
    texts = _with_columns(chunks.join(F.broadcast(kept.select("chunk_id")), "chunk_id",
                                      "left_semi"), PASSAGE).select("chunk_id", *PASSAGE)
    return texts.join(F.broadcast(kept), "chunk_id")


def incoming(passages: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that target a passage's document or cite its order number.

    The disjunction is two equi-joins; an edge found both ways counts once.
    """
    keys = passages.select("query_id", "position", F.col("document_id").alias("original_doc"),
                           F.col("go_number").alias("original_go"), "score")
    live = edges.filter(F.col("relation_type").isin(CHANGING))
    by_document = live.join(F.broadcast(keys),
                            F.col("target_document_id") == F.col("original_doc"))
    by_number = live.join(F.broadcast(keys.filter("original_go <> ''")),
                          F.col("cited_order_number") == F.col("original_go"))
    return by_document.unionByName(by_number).dropDuplicates(["query_id", "position", "edge_id"])


def build_packet(hits: DataFrame, chunks: DataFrame,
                 edges: DataFrame | Callable[[DataFrame], DataFrame], versions: DataFrame,
                 users: dict[str, User] | None = None, grants: DataFrame | None = None,
                 now: datetime | None = None) -> Packet:
    """Assemble the packet of every question.

    ``edges``: edge_id, source_version_id, target_document_id, cited_order_number,
    relation_type; or a function that gives at least those edges that leave, target or cite one
    of the passages passed to it.  ``versions``: version_id, document_id, go_number, effective_from,
    lifecycle_status, one row each.  Amending passages obey the access rule of
    the question's user.
    """
    selected = stage(select_passages(hits, chunks))
    if callable(edges):
        edges = edges(selected)
    touching = stage(incoming(selected, edges))
    sources = touching.select(F.col("source_version_id").alias("version_id"))
    changed = touching.join(
        versions.join(sources, "version_id", "left_semi").select(F.col("version_id").alias("source_version_id"),
                        F.col("document_id").alias("amending_doc"),
                        F.col("go_number").alias("amending_go"),
                        F.col("effective_from").alias("amending_from"),
                        F.col("lifecycle_status").alias("amending_status")),
        "source_version_id", "left")
    approved = F.coalesce(F.col("amending_status") == "ACTIVE", F.lit(False))
    dated = F.col("amending_from").isNotNull()
    changed = stage(changed.withColumn("has_approved_rel", approved)
                    .withColumn("has_effective_date", dated)
                    .withColumn("status", F.when(approved & dated, F.col("relation_type"))
                                .otherwise("UNCERTAIN")))

    amendments = earliest_per(changed.select(
        "query_id", "original_doc", "original_go", "amending_doc", "amending_go",
        "relation_type", "has_approved_rel", "has_effective_date", "position", "edge_id"),
        ["query_id", "original_doc", "amending_doc", "relation_type"], ["position", "edge_id"])
    note = F.concat(F.lit("Approved amendment/supersession by GO "),
                    F.coalesce(F.nullif("amending_go", F.lit("")), F.lit("Subsequent Order")),
                    F.lit(" effective "), F.col("amending_from").cast("string"), F.lit("."))
    notes = (changed.filter("status <> 'UNCERTAIN'").withColumn("note", note)
             .groupBy("query_id", "note").agg(F.min(F.struct("position", "edge_id")).alias("at"))
             .select("query_id", "note", "at.position", "at.edge_id"))

    outgoing = stage(edges.filter(F.col("relation_type").isin(CHANGING)).join(
        F.broadcast(selected.select("query_id", "position", "document_id", "version_id",
                                    "go_number")),
        F.col("source_version_id") == F.col("version_id")))
    last_out = outgoing.groupBy("query_id", "position").agg(
        F.max_by("relation_type", "edge_id").alias("outgoing_relation"))
    last_in = changed.groupBy("query_id", "position").agg(
        F.max_by("status", "edge_id").alias("incoming_status"))
    flagged = stage(selected.join(last_in, ["query_id", "position"], "left")
               .join(last_out, ["query_id", "position"], "left")
               .withColumn("currency_status", F.coalesce("incoming_status", F.lit("CURRENT")))
               .withColumn("is_amending", F.coalesce(
                   F.col("outgoing_relation") == "AMENDS", F.lit(False)))
               .withColumn("is_superseding", F.coalesce(
                   F.col("outgoing_relation") == "SUPERSEDES", F.lit(False)))
               .drop("incoming_status", "outgoing_relation"))
    added = _amending_passages(flagged, changed, chunks, users or {}, grants, now)
    passages = stage(flagged.unionByName(added, allowMissingColumns=True))

    rate = rate_conflicts(passages)
    passages = passages.join(rate.select("query_id", F.col("second_position").alias("position"))
                             .distinct().withColumn("has_conflict", F.lit(True)),
                             ["query_id", "position"], "left").fillna({"has_conflict": False})
    conflicts = _relation_conflicts(outgoing).unionByName(
        rate.drop("second_position"), allowMissingColumns=True)
    return Packet(passages, amendments, conflicts, notes,
                  _currency(passages, changed, notes))


def _amending_passages(selected: DataFrame, changed: DataFrame, chunks: DataFrame,
                       users: dict[str, User], grants: DataFrame | None,
                       now: datetime | None) -> DataFrame:
    """First approved chunk of each amending version, while the packet has room."""
    wanted = changed.select("query_id", "position", "edge_id", "score", "relation_type",
                            F.col("source_version_id").alias("version_id"))
    usable = _with_columns(chunks, PASSAGE).filter(
        F.col("review_status").isin(fv.APPROVED_REVIEW))
    # versions named by the edges of at most eight passages, then the access rule
    usable = usable.join(wanted.select("version_id"), "version_id", "left_semi")
    rows, rules = with_grants(usable.select(
        "version_id", "chunk_index", "chunk_id", "document_id", "classification", *PASSAGE)
        .join(wanted, "version_id"), list(set(users.values())) or [User()], grants, now)
    seen = either([rule & (F.col("query_id").isin([q for q, u in users.items() if u == user])
                           if users else F.lit(True)) for user, rule in rules.items()])
    found = earliest_per(rows.filter(seen).select(
        *wanted.columns, "chunk_index", "chunk_id", "document_id", *PASSAGE),
        wanted.columns, ["chunk_index", "chunk_id"])
    fresh = found.join(selected.select("query_id", "chunk_id"), ["query_id", "chunk_id"],
                       "left_anti")
    once = earliest_per(fresh, ["query_id", "chunk_id"], ["position", "edge_id"])
    ordered = top_k(once, fv.PACKET_MAX, ["query_id"], [F.col("position"), F.col("edge_id")],
                    "_n")
    room = selected.groupBy("query_id").agg(F.count(F.lit(1)).alias("_used"))
    return (ordered.join(room, "query_id")
            .withColumn("position", F.col("_used").cast("int") + F.col("_n"))
            .filter(F.col("position") <= fv.PACKET_MAX)
            .withColumn("score", F.col("score") * fv.AMENDING_DISCOUNT)
            .withColumn("currency_status", F.lit("CURRENT"))
            .withColumn("is_amending", F.col("relation_type") == "AMENDS")
            .withColumn("is_superseding", F.col("relation_type") == "SUPERSEDES")
            .drop("_used", "_n", "relation_type", "edge_id", "chunk_index"))


def _relation_conflicts(outgoing: DataFrame) -> DataFrame:
    cited = F.coalesce(F.nullif("cited_order_number", F.lit("")), F.lit("N/A"))
    rows = earliest_per(outgoing.select(
        "query_id", "document_id", "cited_order_number", "relation_type", "go_number",
        "position", "edge_id"),
        ["query_id", "document_id", "cited_order_number", "relation_type"],
        ["position", "edge_id"])
    return rows.select(
        "query_id", F.col("relation_type").alias("conflict_type"), "position", "edge_id",
        F.col("document_id").cast("string").alias("source_doc"),
        F.col("go_number").alias("first_order"),
        F.col("cited_order_number").alias("second_order"),
        F.concat(F.lit("This order "), F.lower("relation_type"), F.lit(" prior order "),
                 cited, F.lit(".")).alias("notes"))


def stated_rates(df: DataFrame, content: str = "content") -> DataFrame:
    """Every dearness-allowance rate stated in a text, in order."""
    pattern = F.lit(java_pattern(fv.DA_RATE, True))
    both = F.zip_with(F.regexp_extract_all(F.col(content), pattern, F.lit(1)),
                      F.regexp_extract_all(F.col(content), pattern, F.lit(2)),
                      lambda a, b: F.when(a != "", a).otherwise(b))
    return df.select("*", F.posexplode(both).alias("at", "rate"))


def rate_conflicts(passages: DataFrame) -> DataFrame:
    """Rates that differ from the first rate of the packet and come from another order."""
    rates = stated_rates(passages.select("query_id", "position", "go_number", "title", "content"))
    base = rates.groupBy("query_id").agg(F.min_by(F.struct(
        F.coalesce(F.nullif("go_number", F.lit("")), F.col("title")).alias("order"), "rate"),
        F.struct("position", "at")).alias("base"))
    named = F.coalesce(F.nullif("go_number", F.lit("")), F.col("title"))
    differing = (rates.join(base, "query_id")
                 .filter((F.col("rate") != F.col("base.rate"))
                         & ~F.col("go_number").eqNullSafe(F.col("base.order"))))
    rows = earliest_per(differing.select(
        "query_id", "position", "at", "go_number", F.col("base.order").alias("first_order"),
        F.col("base.rate").alias("first_rate"), named.alias("second_order"),
        F.col("rate").alias("second_rate")),
        ["query_id", "first_order", "first_rate", "second_order", "second_rate"],
        ["position", "at"])
    text = F.concat(F.lit("Discrepancy detected: "), F.col("first_order"), F.lit(" states "),
                    F.col("first_rate"), F.lit("% while "),
                    F.coalesce("go_number", F.lit("None")), F.lit(" states "),
                    F.col("second_rate"), F.lit("%."))
    return rows.select("query_id", F.lit("RATE_DISCREPANCY").alias("conflict_type"),
                       F.lit(fv.PACKET_MAX + 1).alias("position"),
                       F.col("position").alias("second_position"),
                       F.col("at").cast("long").alias("edge_id"), "first_order", "second_order",
                       F.concat("first_rate", F.lit("%")).alias("first_val"),
                       F.concat("second_rate", F.lit("%")).alias("second_val"),
                       text.alias("notes"))


def _currency(passages: DataFrame, changed: DataFrame, notes: DataFrame) -> DataFrame:
    """Overall currency of each packet and its banner."""
    unverified = changed.groupBy("query_id").agg(
        F.bool_or(F.col("status") == "UNCERTAIN").alias("unverified"))
    joined_notes = notes.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "edge_id", "note"))),
        lambda n: n["note"]), "; ").alias("note_text"))
    packets = passages.groupBy("query_id").agg(
        F.bool_or(F.col("is_amending") | F.col("is_superseding")).alias("changing"))
    rows = (packets.join(unverified, "query_id", "left").join(joined_notes, "query_id", "left"))
    uncertain = F.coalesce("unverified", F.lit(False))
    status = (F.when(uncertain, "UNCERTAIN").when(F.col("note_text").isNotNull(), "AMENDED")
              .when(F.col("changing"), "SUPERSEDING").otherwise("CURRENT"))
    banner = F.when(uncertain, fv.UNCERTAIN_BANNER).otherwise(F.col("note_text"))
    return rows.select("query_id", status.alias("currency_status"),
                       banner.alias("currency_banner"))


def citations(packet: Packet) -> DataFrame:
    """One citation per (document, page, section), in packet order."""
    rows = earliest_per(packet.passages, ["query_id", "document_id", "page_start",
                                          "section_heading"], ["position"])
    rows = rows.join(packet.summary.select("query_id", "currency_banner"), "query_id")
    doubtful = F.col("currency_status").isin("UNCERTAIN", "AMENDED", "SUPERSEDED")
    banner = F.coalesce("currency_banner", F.when(doubtful, fv.UNCERTAIN_BANNER))
    link = F.when(F.length("source_url") > 0, F.concat(
        "source_url", F.lit("#page="), F.col("page_start").cast("string"))).otherwise("")
    return rows.select(
        "query_id", F.row_number().over(
            Window.partitionBy("query_id").orderBy("position")).alias("citation"),
        "chunk_id", "document_id", F.col("title").alias("document_title"),
        F.col("department_id").alias("department"), "go_number", "gazette_number",
        F.coalesce("sha256", F.col("version_id").cast("string")).alias("version_hash"),
        F.col("order_date").cast("string").alias("issue_date"),
        F.col("page_start").alias("page"), F.col("section_heading").alias("section"),
        F.coalesce("source_url", F.lit("")).alias("source_url"), link.alias("pdf_page_link"),
        F.col("first_bbox").alias("bbox"), banner.alias("currency_banner"),
        F.lit(fv.DISCLAIMER).alias("disclaimer"))


def _optional(label: str, c: Column) -> Column:
    return F.when(F.length(c) > 0, F.concat(F.lit(label), c)).otherwise("")


def citation_markdown(c: DataFrame) -> Column:
    """A citation as Markdown, from the columns of :func:`citations`."""
    link = F.when(F.length("pdf_page_link") > 0, F.concat(
        F.lit(" [View Original PDF Page]("), F.col("pdf_page_link"), F.lit(")"))).otherwise("")
    alert = F.when(F.length("currency_banner") > 0, F.concat(
        F.lit("\n   *Currency Alert: "), F.col("currency_banner"), F.lit("*"))).otherwise("")
    digest = F.when(F.length("version_hash") > 0, F.substring("version_hash", 1, 12)) \
              .otherwise("N/A")
    return F.concat(
        F.lit("["), F.col("citation").cast("string"), F.lit("] **"), F.col("document_title"),
        F.lit("** ("), F.col("department"), _optional(", GO: ", F.col("go_number")),
        _optional(", Date: ", F.col("issue_date")), F.lit(", Page "),
        F.col("page").cast("string"), _optional(", Section: ", F.col("section")), F.lit(")"),
        link, F.lit("\n   *Source URL:* "), F.col("source_url"), F.lit(" | *Hash:* `"), digest,
        F.lit("`\n   *Notice:* "), F.col("disclaimer"), alert)
