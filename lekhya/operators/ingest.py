"""From fetched items to versioned, gated records; inventories and source governance."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from lekhya import fixed_values as fv
from lekhya.functions.text import strip, text_or_empty
from lekhya.operators.scale import either, previous_row, running
from lekhya.session import stage

# --- URLs -------------------------------------------------------------------


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and authority, no fragment."""
    u = F.regexp_replace(strip(url), "#.*$", "")
    head = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?]*)?)", 1)
    return F.concat(F.lower(head), F.substr(u, F.length(head) + 1))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_host(url: Column) -> Column:
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#;]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def url_allowed(url: Column, domains: list[str], prefixes: list[str]) -> Column:
    """Web addresses on a permitted host (or its subdomain) below a permitted path.

    File addresses need a local authorisation among the domains.
    """
    hosts = [d.lower().strip() for d in domains if d.strip()]
    paths = [p.strip() for p in prefixes if p.strip()]
    host, path = url_host(url), url_path(url)
    on_host = either([F.lit(False)] + [(host == d) | F.endswith(host, F.lit("." + d))
                                       for d in hosts])
    below = either([F.lit(False)] + [F.startswith(path, F.lit(p)) for p in paths])
    local = bool({"localhost", "local.uk.gov.in", "file", "local"} & set(hosts))
    file_ok = below | F.lit("/" in paths)
    return F.coalesce(F.when(url_scheme(url) == "file", F.lit(local) & file_ok)
                      .when(url_scheme(url).isin("http", "https"), on_host & below),
                      F.lit(False))


# --- content ----------------------------------------------------------------


def _starts(data: Column, *prefixes: bytes) -> Column:
    return either([F.startswith(data, F.lit(p)) for p in prefixes])


def detect_mime(data: Column) -> Column:
    """File type by magic bytes; markup after any white space; text if all of it is UTF-8."""
    body = F.ltrim(F.decode(data, "ISO-8859-1"), F.lit(" \t\n\r\x0b\x0c"))

    def opens(*marks: str) -> Column:
        return either([F.startswith(body, F.lit(m)) for m in marks])

    return (F.when(F.coalesce(F.length(data), F.lit(0)) == 0, "application/x-empty")
             .when(_starts(data, b"%PDF-"), "application/pdf")
             .when(_starts(data, b"\x89PNG\r\n\x1a\n"), "image/png")
             .when(_starts(data, b"\xff\xd8\xff"), "image/jpeg")
             .when(_starts(data, b"PK\x03\x04"), "application/zip")
             .when(opens("<!DOCTYPE", "<html", "<HTML"), "text/html")
             .when(opens("<?xml"), "application/xml")
             .when(opens("{", "["), "application/json")
             .when(F.is_valid_utf8(data.cast("string")), "text/plain")
             .otherwise("application/octet-stream"))


def content_issues(data: Column, declared: Column, mime: Column,
                   max_bytes: int = fv.MAX_CONTENT_BYTES) -> Column:
    """Why content must not be ingested; an empty array means it is safe."""
    size = F.coalesce(F.length(data), F.lit(0))
    wanted = strip(F.substring_index(F.lower(F.coalesce(declared, mime)), ";", 1))
    raw = F.decode(data, "ISO-8859-1")
    issues = [F.when(size == 0, "Zero-byte file content."),
              F.when(size > max_bytes, F.concat(
                  F.lit("File size "), size.cast("string"),
                  F.lit(f" bytes exceeds maximum permitted limit {max_bytes} bytes.")))]
    for magic, label in fv.EXECUTABLE_MAGIC:
        issues.append(F.when(_starts(data, bytes.fromhex(magic)),
                             f"Executable binary content detected ({label}). Ingestion forbidden."))
    for action in fv.PDF_ACTIONS:
        issues.append(F.when((mime == "application/pdf") & raw.rlike(f"/{action}(?![A-Za-z0-9_])"),
                             f"Suspicious executable pattern found in PDF: /{action}"))
    issues.append(F.when(
        (size > 0) & F.contains(wanted, F.lit("pdf")) & (mime != "application/pdf"),
        F.concat(F.lit("Declared MIME type is '"), declared, F.lit("', but actual content is '"),
                 mime, F.lit("'."))))
    return F.array_compact(F.array(*issues))


def effective_status(http_status: Column, url: Column, data: Column) -> Column:
    """The HTTP status with disguised not-found pages turned into 404."""
    text = F.lower(F.decode(data, "ISO-8859-1"))
    missing = F.contains(text, F.lit("<title>404")) | F.contains(text, F.lit("notfound")) | (
        F.endswith(F.lower(url), F.lit(".pdf")) & ~_starts(data, b"%PDF"))
    return F.when((http_status == 200) & missing, 404).otherwise(http_status)


# --- ingestion --------------------------------------------------------------


def gate_items(items: DataFrame, domains: list[str], prefixes: list[str]) -> DataFrame:
    """Add url, sha256, mime, issues and the stage at which an item failed, if any.

    Reads source_id, url, data, http_status, declared_mime.  Failures are rows,
    so one bad item never stops a run.
    """
    url = canonical_url(F.col("url"))
    status = effective_status(F.col("http_status"), F.col("url"), F.col("data"))
    mime = detect_mime(F.col("data"))
    gated = (items.withColumn("url", url).withColumn("http_status", status)
             .withColumn("sha256", F.sha2("data", 256)).withColumn("mime", mime)
             .withColumn("byte_size", F.length("data"))
             .withColumn("issues", content_issues(F.col("data"), F.col("declared_mime"),
                                                  F.col("mime"))))
    failed = (F.when(~url_allowed(F.col("url"), domains, prefixes), "url_guard")
              .when(F.col("data").isNull(), "fetch")
              .when(F.col("http_status") != 200, "http_status"))
    provenance = F.when(F.size("issues") == 0, "VERIFIED").otherwise("FAILED_VALIDATION")
    return gated.withColumn("failed_stage", failed).withColumn("provenance_status", provenance)


def first_copies(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first item of every group of identical copies and how many there were.

    A mergeable aggregate: a content that fills a third of the data is reduced in
    each map task before anything moves.
    """
    rest = [c for c in items.columns if c not in keys]
    out = items.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"),
                                   F.count(F.lit(1)).alias("copies"))
    return out.select(*keys, "_first.*", "copies")


def new_versions(accepted: DataFrame, known: DataFrame) -> DataFrame:
    """Accepted items whose (source, url, content) is not recorded, linked in a chain.

    ``known``: version_id, document_id, source_id, url, sha256, retrieved_at.
    A new version supersedes the preceding version of its URL, in this run or before.
    """
    fresh = first_copies(accepted.join(known.select("source_id", "url", "sha256"),
                                       ["source_id", "url", "sha256"], "left_anti"),
                         ["source_id", "url", "sha256"], ["retrieved_at"])
    version_id = F.sha2(F.concat_ws("|", "source_id", "url", "sha256"), 256)
    fresh = fresh.withColumn("version_id", F.concat(F.lit("ver_"), version_id))
    document_id = F.concat(F.lit("doc_"), F.sha2(F.concat_ws("|", "source_id", "url"), 256))
    fresh = fresh.withColumn("document_id", document_id)
    latest = known.groupBy("source_id", "url").agg(
        F.max_by(F.struct("version_id", "document_id"),
                 F.struct("retrieved_at", "version_id")).alias("_known"))
    chained = previous_row(fresh, ["source_id", "url"], ["retrieved_at", "version_id"],
                           ["version_id"], "_previous")
    linked = chained.join(latest, ["source_id", "url"], "left")
    return (linked.withColumn("document_id", F.coalesce("_known.document_id", "document_id"))
            .withColumn("supersedes_version_id",
                        F.coalesce("_previous.version_id", "_known.version_id"))
            .drop("_previous", "_known", "copies"))


def ingest_run(items: DataFrame, known: DataFrame, domains: list[str],
               prefixes: list[str]) -> tuple[DataFrame, DataFrame]:
    """One run from fetched items to versions: (new versions, job rows).

    ``items`` as for :func:`gate_items`, with retrieved_at; ``known`` as for
    :func:`new_versions`.  Job rows count the items of each source by outcome: a failed stage,
    NEW_VERSION or UNCHANGED.  Both results are staged before either is returned, so a run
    that fails yields nothing, and a second run over its versions adds nothing.
    """
    gated = stage(gate_items(items, domains, prefixes).select(
        "source_id", "url", "sha256", "mime", "byte_size", "provenance_status", "retrieved_at",
        "failed_stage"))
    versions = stage(new_versions(gated.filter("failed_stage IS NULL").drop("failed_stage"), known))
    key = ["source_id", "url", "sha256"]
    made = versions.select(*key, F.lit(True).alias("_made"))
    outcome = F.when(F.col("failed_stage").isNotNull(), F.col("failed_stage")).when(
        F.col("_made"), "NEW_VERSION").otherwise("UNCHANGED")
    jobs = (gated.join(made, key, "left").withColumn("outcome", outcome)
            .groupBy("source_id", "outcome").agg(F.count(F.lit(1)).alias("items")))
    return versions, stage(jobs)


def quarantine_missing(documents: DataFrame, known: DataFrame, seen_urls: DataFrame) -> DataFrame:
    """Active documents none of whose addresses turned up in a complete crawl.

    Only sources that delivered at least one address in the crawl are judged.
    """
    crawled = seen_urls.select("source_id").distinct()
    still = (known.join(seen_urls.select("source_id", "url"), ["source_id", "url"], "left_semi")
             .select("document_id"))
    return (documents.filter(F.col("lifecycle_status") == "ACTIVE")
            .join(crawled, "source_id", "left_semi")
            .join(still, "document_id", "left_anti")
            .withColumn("lifecycle_status", F.lit("QUARANTINED")))


def quarantine_audit(quarantined: DataFrame, sources: DataFrame) -> DataFrame:
    """One content-free notification per quarantined document, with the owner to tell."""
    return quarantined.join(sources.select("source_id", "owner_contact"), "source_id", "left") \
        .select(F.lit("DOCUMENT").alias("entity_type"), F.col("document_id").alias("entity_id"),
                F.lit("QUARANTINE_MISSING").alias("action"), "source_id", "owner_contact")


def immutable_conflicts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys already stored with other content; must be empty before an append."""
    return incoming.join(stored.select("object_key", F.col("sha256").alias("stored_sha256")),
                         "object_key").filter(F.col("sha256") != F.col("stored_sha256"))


def immutable_appends(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Objects not stored yet; writing the same object twice adds nothing."""
    return incoming.join(stored.select("object_key"), "object_key", "left_anti")


# --- vocabularies and sources -------------------------------------------------


def normalise_vocabulary(c: Column, values: list[str]) -> Column:
    """A known value in canonical form, an unknown one as written, nothing as UNKNOWN."""
    trimmed = strip(c)
    folded = F.translate(F.upper(trimmed), " -", "__")
    return (F.when(F.length(text_or_empty(trimmed)) == 0, "UNKNOWN")
             .when(folded.isin(values), folded).otherwise(trimmed))


def source_errors(df: DataFrame) -> Column:
    """Everything wrong with an onboarding sheet (one row per source)."""
    def blank(name: str) -> Column:
        return F.length(strip(text_or_empty(F.col(name)))) == 0

    domains, paths = F.col("permitted_domains"), F.col("permitted_path_prefixes")
    bad_domain = F.get(F.filter(domains, lambda d: (F.length(text_or_empty(d)) == 0)
                                | d.contains("/") | d.contains(":")), F.lit(0))
    bad_path = F.get(F.filter(paths, lambda p: ~F.startswith(p, F.lit("/"))), F.lit(0))
    return F.array_compact(F.array(
        F.when(blank("name"), "Source name is required."),
        F.when(blank("owner_name"), "Departmental owner name is required."),
        F.when(blank("owner_contact"), "Departmental owner contact is required."),
        F.when(blank("written_authority_ref"), "Written authority reference is required."),
        F.when(F.coalesce(F.size(domains), F.lit(0)) <= 0,
               "At least one permitted government domain must be specified."),
        F.when(bad_domain.isNotNull(), F.concat(
            F.lit("Invalid permitted domain: '"), bad_domain,
            F.lit("'. Must be a valid hostname without scheme or path."))),
        F.when(F.coalesce(F.size(paths), F.lit(0)) <= 0,
               "At least one permitted path prefix must be specified."),
        F.when(bad_path.isNotNull(), F.concat(
            F.lit("Permitted path prefix must start with '/': '"), bad_path, F.lit("'"))),
        F.when(F.col("rate_limit_per_minute") <= 0, "rate_limit_per_minute must be positive.")))


def source_states(events: DataFrame) -> DataFrame:
    """Current status per source from its audit events; removal is terminal.

    ``events``: source_id, event_id, action (ONBOARD, APPROVE, PAUSE, REMOVE), at.
    """
    order = F.struct("at", "event_id")
    last = events.groupBy("source_id").agg(
        F.max_by("action", order).alias("action"), F.count(F.lit(1)).alias("events"),
        F.bool_or(F.col("action") == "REMOVE").alias("removed"))
    status = (F.when(F.col("removed"), "REMOVED").when(F.col("action") == "APPROVE", "APPROVED")
              .when(F.col("action") == "PAUSE", "PAUSED").otherwise("PENDING_APPROVAL"))
    return last.select("source_id", status.alias("status"), "events",
                       (status == "APPROVED").alias("may_run"))


def source_history(events: DataFrame) -> DataFrame:
    """Events in order with the action before and whether the step was permitted."""
    rows = previous_row(events, ["source_id"], ["at", "event_id"], ["action"], "_before")
    before = F.col("_before.action")
    return rows.withColumn("previous_action", before).withColumn(
        "permitted", F.coalesce(before != "REMOVE", F.lit(True))).drop("_before")


# --- signed inventories -------------------------------------------------------


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC-SHA256 of a text column, in built-in expressions."""
    raw = key.encode("utf-8")
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in raw))
    outer = F.lit(bytes(b ^ 0x5C for b in raw))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def _json_value(c: Column) -> Column:
    """A JSON scalar, non-ASCII characters escaped with hex digits in lower case."""
    escaped = F.regexp_replace(F.to_json(
        F.array(c.cast("string")), {"writeNonAsciiCharacterAsCodePoint": "true"}), r"^\[|\]$", "")
    # an escaped backslash is a piece of its own, so that a "u" after it stays text
    pieces = F.regexp_extract_all(escaped, F.lit(r"(\\u[0-9A-F]{4}|\\.|[^\\]+)"), 1)
    lowered = F.array_join(F.transform(pieces, lambda p: F.when(
        F.startswith(p, F.lit("\\u")), F.lower(p)).otherwise(p)), "")
    return F.when(c.isNull(), "null").when(
        F.contains(escaped, F.lit("\\u")), lowered).otherwise(escaped)


def canonical_record(fields: dict[str, Column], numeric: tuple[str, ...] = ()) -> Column:
    """One record as compact JSON with sorted keys."""
    parts = [F.concat(F.lit(f'"{name}":'), F.coalesce(
        fields[name].cast("string"), F.lit("null")) if name in numeric
        else _json_value(fields[name])) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


LIMBS = 8


def sign_inventory(records: DataFrame, key: str, group: str = "source_id",
                   record: str = "record") -> DataFrame:
    """A signed inventory per source: record count and a keyed digest of all records.

    Each record is authenticated on its own and the digests are added limb by limb
    modulo 2^32 (an additive multiset hash), so an inventory of any size is a
    mergeable aggregate: no source is sorted, gathered or passed through the driver.
    The signature covers the source, the count and the sums.
    """
    mac = records.select(group, hmac_sha256(F.col(record), key).alias("m"))
    limbs = [F.pmod(F.sum(F.conv(F.substring("m", 8 * i + 1, 8), 16, 10).cast("long")),
                    F.lit(1 << 32)).alias(f"l{i}") for i in range(LIMBS)]
    sums = mac.groupBy(group).agg(F.count(F.lit(1)).alias("total_records"), *limbs)
    digest = F.concat_ws(":", *[F.lpad(F.lower(F.hex(f"l{i}")), 8, "0") for i in range(LIMBS)])
    payload = F.concat_ws("|", F.col(group).cast("string"),
                          F.col("total_records").cast("string"), digest)
    return sums.select(group, "total_records", hmac_sha256(payload, key).alias("signature"))


def verify_inventory(records: DataFrame, inventory: DataFrame, key: str,
                     group: str = "source_id") -> DataFrame:
    """Per source: complete, count agrees, signature agrees."""
    missing = F.greatest(*[F.length(text_or_empty(F.col(c).cast("string"))) == 0
                           for c in ("source_url", "sha256", "retrieved_at")])
    incomplete = records.groupBy(group).agg(F.count_if(missing).alias("incomplete"))
    now = sign_inventory(records, key, group).select(
        group, F.col("total_records").alias("n"), F.col("signature").alias("expected"))
    rows = inventory.join(now, group, "left").join(incomplete, group, "left")
    problem = (F.when(F.length(text_or_empty(F.col("signature"))) == 0,
                      "Manifest is missing cryptographic signature.")
               .when(~F.col("total_records").eqNullSafe(F.coalesce("n", F.lit(0))),
                     "Record count mismatch in manifest.")
               .when(F.col("incomplete") > 0, "Record missing address, hash or timestamp.")
               .when(~F.col("signature").eqNullSafe(F.col("expected")),
                     "Cryptographic signature verification failed (tampered content or invalid key)."))
    return rows.select(group, problem.isNull().alias("valid"), problem.alias("problem"))


def inventory_positions(records: DataFrame, group: str = "source_id") -> DataFrame:
    """Add ``position``: the place of every record in its source's inventory, from 1, in
    canonical order (address, retrieval time, version)."""
    timed = records.withColumn("_time", F.coalesce("retrieved_at", F.lit(""))) \
        .withColumn("_one", F.lit(1).cast("long"))
    return running(timed, [group], ["source_url", "_time", "version_id"], "_one",
                   "position").drop("_time", "_one")
