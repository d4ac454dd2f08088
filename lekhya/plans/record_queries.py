"""Ingestion, inventory, catalogue, request-control, memory and metric queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from lekhya import fixed_values as fv
from lekhya.functions.dates import listing_date
from lekhya.operators import (catalogue, ingest, memory, metrics, requests, selection,
                              text_index, url_rules)
from lekhya.operators.scale import previous_row
from lekhya.plans.corpus import NOW, RECORDS_SQL, read, read_spread, records, turns
from lekhya.plans.registry import query
from lekhya.plans.text_queries import exchanges
from lekhya.sources import listing, robots, saved_listing

DOMAINS, PREFIXES = ["example.com", "blog.tionsh.example.net", "example.org"], ["/en", "/de"]
_HOST = "lower(regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"

# --- addresses and content -------------------------------------------------------


@query("url_canonical", """WITH u AS (SELECT page_id, upper(substr(url, 1, 12)) || substr(url, 13) AS url FROM pages)
    SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) ||
      substr(regexp_replace(url, '#.*$', ''), length(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) + 1) AS url FROM u""")
def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    p = read(spark, folder, "pages")
    shouted = F.concat(F.upper(F.substring("url", 1, 12)), F.expr("substr(url, 13)"))
    return p.select("page_id", ingest.canonical_url(shouted).alias("url"))


@query("url_guard", f"""WITH p AS (SELECT page_id, url AS u FROM pages),
    h AS (SELECT page_id, {_HOST} AS host, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#;]*)', 1) AS path FROM p)
    SELECT page_id, (host IN ('example.com', 'blog.tionsh.example.net', 'example.org') OR host LIKE '%.example.com'
      OR host LIKE '%.blog.tionsh.example.net' OR host LIKE '%.example.org')
      AND (starts_with(path, '/en') OR starts_with(path, '/de')) AS allowed FROM h""")
def url_guard(spark: SparkSession, folder: str) -> DataFrame:
    p = read(spark, folder, "pages")
    return p.select("page_id", ingest.url_allowed(F.col("url"), DOMAINS, PREFIXES).alias("allowed"))


@query("url_rule_table", f"""WITH p AS (SELECT page_id, url AS u FROM pages),
    h AS (SELECT page_id, {_HOST} AS host, regexp_extract(u, '^[a-z]+://[^/?#]*([^?#;]*)', 1) AS path FROM p),
    r AS (SELECT DISTINCT host, substr(path, 1, 4) AS prefix, length(host) % 2 = 0 AS allow FROM h
      UNION SELECT DISTINCT regexp_extract(host, '[^.]+[.][^.]+$') AS host, '/' AS prefix, ends_with(host, '.com') AS allow FROM h
      UNION SELECT host, path AS prefix, min(page_id) % 3 = 0 AS allow FROM h WHERE path LIKE '%/' OR path LIKE '%.html' GROUP BY ALL),
    m AS (SELECT h.page_id, arg_max(r, length(r.host) * 100000 + length(r.prefix)) AS r FROM h
      JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.prefix) GROUP BY h.page_id)
    SELECT page_id, coalesce(m.r.allow, false) AS allowed, m.r.host AS rule_host, m.r.prefix AS rule_prefix FROM h LEFT JOIN m USING (page_id)""")
def url_rule_table(spark: SparkSession, folder: str) -> DataFrame:
    """Rules for hosts and languages, for whole domains, and for single pages of some forms."""
    p = read(spark, folder, "pages").select("page_id", "url")
    host, path = ingest.url_host(F.col("url")), ingest.url_path(F.col("url"))
    h = p.select("page_id", host.alias("host"), path.alias("path"))
    rules = h.select("host", F.substring("path", 1, 4).alias("prefix"),
                     (F.length("host") % 2 == 0).alias("allow")).distinct()
    rules = rules.union(h.select(F.regexp_extract("host", "[^.]+[.][^.]+$", 0), F.lit("/"),
                                 F.endswith("host", F.lit(".com"))).distinct())
    single = h.filter("path LIKE '%/' OR path LIKE '%.html'").groupBy("host", "path").agg(
        F.min("page_id").alias("first"))
    rules = rules.union(single.select("host", "path", F.col("first") % 3 == 0))
    return url_rules.decide(p, rules).select(
        "page_id", "allowed", F.col("rule.host").alias("rule_host"),
        F.col("rule.prefix").alias("rule_prefix"))


_ROBOTS = {"blog.tionsh.example.net": "User-agent: *\nDisallow: /fr\nDisallow: /en/9"}


@query("robots_rules", f"""WITH p AS (SELECT page_id, url AS u FROM pages)
    SELECT page_id, NOT ({_HOST} = 'blog.tionsh.example.net' AND (starts_with(regexp_extract(u, '^[a-z]+://[^/?#]*(.*)', 1), '/fr')
      OR starts_with(regexp_extract(u, '^[a-z]+://[^/?#]*(.*)', 1), '/en/9'))) AS may_fetch FROM p""")
def robots_rules(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "pages").select(
        "page_id", robots.can_fetch(F.col("url"), _ROBOTS).alias("may_fetch"))


def fetched(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and documents as fetched items; some documents are dressed as other formats."""
    p = read_spread(spark, folder, "pages", "page_id").select(
        F.lit("portal").alias("source_id"), F.col("page_id").alias("item_id"), "url",
        F.encode("html", "UTF-8").alias("data"), F.lit(200).alias("http_status"),
        F.lit("text/html").alias("declared_mime"))
    d = read_spread(spark, folder, "documents", "doc_id")
    head = (F.when(F.col("lang") == "fr", "%PDF-1.7 /OpenAction ").when(F.col("lang") == "de", "MZ")
            .when(F.col("lang") == "es", '{"text": ').otherwise(""))
    files = d.select(
        "source", F.col("doc_id").alias("item_id"),
        F.concat(F.lit("https://files.example.org/en/"), "source", F.lit("/"),
                 F.col("doc_id").cast("string"), F.lit(".pdf")).alias("url"),
        F.encode(F.concat(head, F.col("text")), "UTF-8").alias("data"),
        F.when(F.col("n_chars") < 100, 404).otherwise(200).alias("http_status"),
        F.lit("application/pdf; q=1").alias("declared_mime")).withColumnRenamed("source", "source_id")
    return p.unionByName(files)


_FETCHED_SQL = """fetched AS (
  SELECT 'portal' AS source_id, page_id AS item_id, html AS t, 200 AS st, 'text/html' AS declared,
    url AS u FROM pages
  UNION ALL SELECT source, doc_id, CASE lang WHEN 'fr' THEN '%PDF-1.7 /OpenAction ' WHEN 'de' THEN 'MZ'
    WHEN 'es' THEN '{"text": ' ELSE '' END || text, CASE WHEN n_chars < 100 THEN 404 ELSE 200 END,
    'application/pdf; q=1', 'https://files.example.org/en/' || source || '/' || doc_id || '.pdf' FROM documents),
  sniffed AS (SELECT *, ltrim(t, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS b FROM fetched),
  typed AS (SELECT *, CASE WHEN t = '' THEN 'application/x-empty' WHEN starts_with(t, '%PDF-') THEN 'application/pdf'
    WHEN starts_with(t, 'PK' || chr(3) || chr(4)) THEN 'application/zip'
    WHEN starts_with(b, '<!DOCTYPE') OR starts_with(b, '<html') OR starts_with(b, '<HTML') THEN 'text/html'
    WHEN starts_with(b, '<?xml') THEN 'application/xml' WHEN starts_with(b, '{') OR starts_with(b, '[') THEN 'application/json'
    ELSE 'text/plain' END AS mime FROM sniffed)"""


def _sniff(df: DataFrame) -> DataFrame:
    return df.withColumn("mime", ingest.detect_mime(F.col("data")))


@query("mime_sniff", f"WITH {_FETCHED_SQL} SELECT source_id, mime, count(*) AS items FROM typed GROUP BY ALL")
def mime_sniff(spark: SparkSession, folder: str) -> DataFrame:
    return _sniff(fetched(spark, folder)).groupBy("source_id", "mime").agg(
        F.count(F.lit(1)).alias("items"))


@query("content_issues", f"""WITH {_FETCHED_SQL}, i AS (SELECT source_id, unnest(list_filter([
      CASE WHEN t = '' THEN 'Zero-byte file content.' END,
      CASE WHEN starts_with(t, 'MZ') THEN 'Executable binary content detected (DOS/Windows Executable (PE)). Ingestion forbidden.' END,
      CASE WHEN mime = 'application/pdf' AND regexp_matches(t, '/Launch([^A-Za-z0-9_]|$)') THEN 'Suspicious executable pattern found in PDF: /Launch' END,
      CASE WHEN mime = 'application/pdf' AND regexp_matches(t, '/OpenAction([^A-Za-z0-9_]|$)') THEN 'Suspicious executable pattern found in PDF: /OpenAction' END,
      CASE WHEN t <> '' AND contains(declared, 'pdf') AND mime <> 'application/pdf' THEN 'Declared type differs' END],
      lambda x: x IS NOT NULL)) AS issue FROM typed)
    SELECT source_id, issue, count(*) AS items FROM i GROUP BY ALL""")
def content_issues(spark: SparkSession, folder: str) -> DataFrame:
    items = _sniff(fetched(spark, folder))
    issue = F.explode(ingest.content_issues(F.col("data"), F.col("declared_mime"), F.col("mime")))
    rows = items.select("source_id", issue.alias("issue"))
    short = F.when(F.startswith("issue", F.lit("Declared")), "Declared type differs") \
             .otherwise(F.col("issue"))
    return rows.groupBy("source_id", short.alias("issue")).agg(F.count(F.lit(1)).alias("items"))


@query("ingest_gate", f"""WITH {_FETCHED_SQL}, s AS (SELECT source_id, {_HOST} AS host, u,
      regexp_extract(u, '^[a-z]+://[^/?#]*([^?#;]*)', 1) AS path,
      CASE WHEN st = 200 AND (contains(lower(t), '<title>404') OR contains(lower(t), 'notfound')
        OR (lower(regexp_replace(u, '#.*$', '')) LIKE '%.pdf' AND NOT starts_with(t, '%PDF'))) THEN 404 ELSE st END AS st FROM typed)
    SELECT source_id, CASE WHEN NOT ((host IN ('example.com', 'blog.tionsh.example.net', 'example.org') OR host LIKE '%.example.com'
      OR host LIKE '%.blog.tionsh.example.net' OR host LIKE '%.example.org') AND (starts_with(path, '/en') OR starts_with(path, '/de')))
      THEN 'url_guard' WHEN st <> 200 THEN 'http_status' ELSE 'accepted' END AS stage, count(*) AS items FROM s GROUP BY ALL""")
def ingest_gate(spark: SparkSession, folder: str) -> DataFrame:
    gated = ingest.gate_items(fetched(spark, folder), DOMAINS, PREFIXES)
    stage_name = F.coalesce("failed_stage", F.lit("accepted"))
    return gated.groupBy("source_id", stage_name.alias("stage")).agg(F.count(F.lit(1)).alias("items"))


@query("ingest_run", f"""WITH {_FETCHED_SQL}, s AS (SELECT source_id, item_id, {_HOST} AS host, u,
      regexp_extract(u, '^[a-z]+://[^/?#]*([^?#;]*)', 1) AS path,
      CASE WHEN st = 200 AND (contains(lower(t), '<title>404') OR contains(lower(t), 'notfound')
        OR (lower(regexp_replace(u, '#.*$', '')) LIKE '%.pdf' AND NOT starts_with(t, '%PDF'))) THEN 404 ELSE st END AS st FROM typed)
    SELECT source_id, CASE WHEN NOT ((host IN ('example.com', 'blog.tionsh.example.net', 'example.org') OR host LIKE '%.example.com'
      OR host LIKE '%.blog.tionsh.example.net' OR host LIKE '%.example.org') AND (starts_with(path, '/en') OR starts_with(path, '/de')))
      THEN 'url_guard' WHEN st <> 200 THEN 'http_status' WHEN item_id % 2 = 0 THEN 'UNCHANGED' ELSE 'NEW_VERSION' END AS outcome,
      count(*) AS items FROM s GROUP BY ALL""")
def ingest_run(spark: SparkSession, folder: str) -> DataFrame:
    """A first run takes every second item, a second run all of them."""
    items = fetched(spark, folder).withColumn("retrieved_at", F.lit(datetime(2024, 1, 1)) + F.expr(
        "make_dt_interval(0, 0, 0, item_id % 2)"))
    none = spark.createDataFrame([], "version_id string, document_id string, source_id string, "
                                     "url string, sha256 string, retrieved_at timestamp")
    known, _ = ingest.ingest_run(items.filter("item_id % 2 = 0"), none, DOMAINS, PREFIXES)
    return ingest.ingest_run(items, known, DOMAINS, PREFIXES)[1]


@query("html_links")
def html_links(spark: SparkSession, folder: str) -> DataFrame:
    portal = listing.Portal(tuple(DOMAINS), ("/",), "GO", "FINANCE_TREASURY", "Government Order",
                            cues=("/",))
    found = listing.discover(read_spread(spark, folder, "pages", "page_id"), portal)
    return found.select("page_id", "at", "source_url", "title", "doc_type")


@query("connector_pages", r"""SELECT page_id, url, len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) AS links,
      regexp_extract(html, '(?i)<a\s[^>]*href="([^"]*)"', 1) AS first_link FROM pages""")
def connector_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The given pages by the connector's own reader."""
    saved_listing.register(spark)
    pages = spark.read.format("saved_listing").load(f"{folder}/pages.parquet")
    return pages.select(
        "page_id", "url", F.size("links").cast("long").alias("links"),
        F.coalesce(F.get("links", F.lit(0))["href"], F.lit("")).alias("first_link"))


@query("followed_pages", """WITH RECURSIVE e AS (SELECT page_id AS a, CASE WHEN page_id % 97 = 96 THEN page_id - 20 ELSE page_id + 1 END AS b
      FROM pages WHERE page_id % 41 <> 40),
    r AS (SELECT page_id AS a FROM pages WHERE page_id % 60 = 0
      UNION SELECT e.b FROM r JOIN e ON e.a = r.a)
    SELECT 'https://example.com/list/' || a AS url FROM r""")
def followed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The saved pages as listings: each names the next one, some lead back, some end."""
    p = read_spread(spark, folder, "pages", "page_id")
    address, n = F.lit("https://example.com/list/"), F.col("page_id")
    then = F.when(n % 97 == 96, n - 20).otherwise(n + 1)
    link = F.when(n % 41 != 40, F.concat(F.lit("<a href='../list/"), then, F.lit("'>Next</a>")))
    listings = p.select(n, F.concat(address, n).alias("url"), F.concat(
        F.coalesce(link, F.lit("")), F.regexp_replace("html", "(?i)next|»", "")).alias("html"))
    start = listings.filter("page_id % 60 = 0").select("url")
    return listing.follow_pages(listings.select("url", "html"), start, DOMAINS, ["/list"])


@query("listing_dates", """SELECT o_orderkey, CASE WHEN o_custkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS listed FROM orders""")
def listing_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates as portals print them: day first, year first, or not a date at all."""
    o = read(spark, folder, "orders")
    form = F.col("o_custkey") % 3
    text = (F.when(form == 0, F.concat(F.lit("Issued: "), F.date_format("o_orderdate", "d.M.yyyy")))
             .when(form == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise("31/02/2020"))
    return o.select("o_orderkey", listing_date(text).alias("listed"))


# --- versions ---------------------------------------------------------------------


@query("exact_duplicates", """SELECT source, sha256(text) AS sha256, min(doc_id) AS first_doc, count(*) AS copies
    FROM documents GROUP BY source, sha256(text)""")
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents").select(
        "source", "doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    return ingest.first_copies(d, ["source", "sha256"], ["doc_id"]).select(
        "source", "sha256", F.col("doc_id").alias("first_doc"), "copies")


@query("version_chain", """SELECT event_id AS version_id, user_id, lag(event_id) OVER (PARTITION BY user_id, event_type
      ORDER BY ts, event_id) AS supersedes FROM events""")
def version_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Events as versions of the address their user and type stand for."""
    e = read(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    chained = previous_row(e, ["user_id", "event_type"], ["ts", "event_id"], ["event_id"], "before")
    return chained.select(F.col("event_id").alias("version_id"), "user_id",
                          F.col("before.event_id").alias("supersedes"))


@query("incremental_ingest", """WITH items AS (SELECT 'src' || user_id AS source_id, event_type AS url,
      sha256(CAST(CAST(floor(value / 10) AS INT) AS VARCHAR)) AS sha, ts FROM events),
    known AS (SELECT * FROM items WHERE ts < TIMESTAMP '2024-01-10'),
    fresh AS (SELECT source_id, url, sha, min(ts) AS ts FROM items i WHERE ts >= TIMESTAMP '2024-01-10'
      AND NOT EXISTS (SELECT 1 FROM known k WHERE k.source_id = i.source_id AND k.url = i.url AND k.sha = i.sha)
      GROUP BY source_id, url, sha)
    SELECT f.source_id, count(*) AS versions, count(*) FILTER (WHERE
      row_in_url > 1 OR EXISTS (SELECT 1 FROM known k WHERE k.source_id = f.source_id AND k.url = f.url)) AS superseding
    FROM (SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY ts) AS row_in_url FROM fresh) f GROUP BY f.source_id""")
def incremental_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Events as crawl results: a first crawl is known, a second adds what changed."""
    e = read(spark, folder, "events")
    items = e.select(
        F.concat(F.lit("src"), F.col("user_id").cast("string")).alias("source_id"),
        F.col("event_type").alias("url"),
        F.sha2(F.floor(F.col("value") / 10).cast("int").cast("string"), 256).alias("sha256"),
        F.col("ts").alias("retrieved_at"))
    cut = F.lit(datetime(2024, 1, 10))
    known = items.filter(F.col("retrieved_at") < cut).withColumn(
        "version_id", F.concat_ws("|", "source_id", "url", "sha256")).withColumn(
        "document_id", F.concat_ws("|", "source_id", "url"))
    new = ingest.new_versions(items.filter(F.col("retrieved_at") >= cut), known)
    return new.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("versions"),
        F.count_if(F.col("supersedes_version_id").isNotNull()).alias("superseding"))


@query("delta_quarantine", """WITH a AS (SELECT DISTINCT l_suppkey AS source_id, l_partkey AS url FROM lineitem
      WHERE l_shipdate < TIMESTAMP '1998-01-01'),
    b AS (SELECT DISTINCT l_suppkey AS source_id, l_partkey AS url FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
    SELECT source_id, count(*) AS quarantined FROM a WHERE source_id IN (SELECT source_id FROM b)
      AND NOT EXISTS (SELECT 1 FROM b WHERE b.source_id = a.source_id AND b.url = a.url) GROUP BY source_id""")
def delta_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Parts a supplier shipped before a date are its documents; later ones a crawl."""
    li = read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("url"), "l_shipdate")
    cut = F.lit(datetime(1998, 1, 1))
    known = li.filter(F.col("l_shipdate") < cut).select("source_id", "url").distinct().withColumn(
        "document_id", F.concat_ws("|", F.col("source_id").cast("string"), F.col("url").cast("string")))
    seen = li.filter(F.col("l_shipdate") >= cut).select("source_id", "url").distinct()
    docs = known.select("document_id", "source_id", F.lit("ACTIVE").alias("lifecycle_status"))
    gone = ingest.quarantine_missing(docs, known, seen)
    audit = ingest.quarantine_audit(gone, read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("owner_contact")))
    return audit.groupBy("source_id").agg(F.count(F.lit(1)).alias("quarantined"))


@query("immutable_store", """WITH k AS (SELECT sha256(text) AS sha, source || '/' || lang AS key, min(doc_id) AS id FROM documents GROUP BY ALL),
    s AS (SELECT source || '/' || lang AS key, min_by(sha256(text), doc_id) AS sha FROM documents GROUP BY ALL)
    SELECT k.key AS object_key, count(*) FILTER (WHERE k.sha <> s.sha) AS conflicts, count(*) FILTER (WHERE k.sha = s.sha) AS unchanged
    FROM k JOIN s USING (key) GROUP BY k.key""")
def immutable_store(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct texts offered under the key of the first text of their source and language."""
    d = read(spark, folder, "documents").select(
        F.concat("source", F.lit("/"), "lang").alias("object_key"), "doc_id",
        F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))
    offered = d.select("object_key", "sha256").distinct()
    stored = ingest.first_copies(d, ["object_key"], ["doc_id"]).select("object_key", "sha256")
    clash = ingest.immutable_conflicts(offered, stored).groupBy("object_key").agg(
        F.count(F.lit(1)).alias("conflicts"))
    same = offered.join(stored, ["object_key", "sha256"], "left_semi").groupBy("object_key").agg(
        F.count(F.lit(1)).alias("unchanged"))
    return same.join(clash, "object_key", "left").select(
        "object_key", F.coalesce("conflicts", F.lit(0)).alias("conflicts"), "unchanged")


# --- inventories and sources -------------------------------------------------------

KEY = "inventory-key"
_RECORD = ("document_id", "title", "doc_type", "department_id", "source_url", "go_number")


def inventory_records(spark: SparkSession, folder: str) -> DataFrame:
    r = records(spark, folder)
    rows = r.withColumn("sha256", F.sha2(F.encode("content", "UTF-8"), 256)).withColumn(
        "retrieved_at", F.col("order_date").cast("string"))
    fields = {n: F.col(n) for n in (*_RECORD, "sha256", "retrieved_at")}
    return rows.select("source_id", "sha256", "source_url", "retrieved_at", F.col("document_id")
                       .alias("version_id"), ingest.canonical_record(fields, ("document_id",)).alias("record"))


def _blob(data: bytes) -> str:
    return "'" + "".join(f"\\x{b:02X}" for b in data) + "'::BLOB"


def hmac_sql(message: str) -> str:
    raw = KEY.encode().ljust(64, b"\0")
    inner, outer = _blob(bytes(b ^ 0x36 for b in raw)), _blob(bytes(b ^ 0x5C for b in raw))
    return f"sha256({outer} || unhex(sha256({inner} || encode({message}))))"


def _limb(i: int) -> str:
    return f"lpad(to_hex(CAST(sum(CAST('0x' || substr(m, {8 * i + 1}, 8) AS BIGINT)) % 4294967296 AS BIGINT)), 8, '0')"


def _ascii(text: str) -> str:
    """A JSON string with characters beyond ASCII as code points."""
    return (f"list_aggregate(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 "
            "THEN c ELSE '\\u' || printf('%04x', unicode(c)) END), 'string_agg', '')")


@query("signed_inventory", f"""WITH {RECORDS_SQL}, j AS (SELECT source_id, concat(
      '{{"department_id":', to_json(department_id), ',"doc_type":', to_json(doc_type), ',"document_id":', document_id,
      ',"go_number":', to_json(go_number), ',"retrieved_at":', to_json(CAST(order_date AS VARCHAR)),
      ',"sha256":', to_json(sha256(content)), ',"source_url":', to_json(source_url), ',"title":', {_ascii('to_json(title)')}, '}}') AS record FROM records),
    m AS (SELECT source_id, {hmac_sql('record')} AS m FROM j),
    s AS (SELECT source_id, count(*) AS total_records, lower(concat_ws(':', {", ".join(_limb(i) for i in range(8))})) AS digest
      FROM m GROUP BY source_id)
    SELECT source_id, total_records, {hmac_sql("concat_ws('|', source_id, total_records, digest)")} AS signature FROM s""")
def signed_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.sign_inventory(inventory_records(spark, folder), KEY)


@query("inventory_verification", """SELECT source AS source_id, source <> 'src3' AS valid FROM documents GROUP BY source""")
def inventory_verification(spark: SparkSession, folder: str) -> DataFrame:
    """Every source verifies but one, whose records were edited after signing."""
    rows = inventory_records(spark, folder)
    inventory = ingest.sign_inventory(rows, KEY)
    edited = rows.withColumn("record", F.when(F.col("source_id") == "src3", F.concat(
        "record", F.lit(" "))).otherwise(F.col("record")))
    return ingest.verify_inventory(edited, inventory, KEY).select("source_id", "valid")


@query("inventory_order", f"""WITH {RECORDS_SQL} SELECT source_id, source_url, document_id AS version_id,
    row_number() OVER (PARTITION BY source_id ORDER BY source_url, CAST(order_date AS VARCHAR), document_id) AS position FROM records""")
def inventory_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.inventory_positions(inventory_records(spark, folder))
    return rows.select("source_id", "source_url", "version_id", "position")


@query("source_validation", """WITH s AS (SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN '' ELSE s_name END AS contact,
      CASE s_nationkey % 3 WHEN 0 THEN 'https://' || s_suppkey ELSE s_suppkey || '.example.org' END AS domain,
      CASE WHEN s_nationkey % 5 = 0 THEN 'orders' ELSE '/orders' END AS path FROM supplier)
    SELECT s_suppkey AS source_id, CAST((contact = '')::INT + contains(domain, '/')::INT + (NOT starts_with(path, '/'))::INT AS INT) AS errors FROM s""")
def source_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as onboarding sheets with the slips a form would have."""
    s = read(spark, folder, "supplier")
    key = F.col("s_suppkey").cast("string")
    sheet = s.select(
        F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"),
        F.col("s_name").alias("owner_name"), F.when(F.col("s_acctbal") < 0, "").otherwise(
            F.col("s_name")).alias("owner_contact"), F.lit("ref").alias("written_authority_ref"),
        F.array(F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("https://"), key)).otherwise(
            F.concat(key, F.lit(".example.org")))).alias("permitted_domains"),
        F.array(F.when(F.col("s_nationkey") % 5 == 0, "orders").otherwise("/orders"))
        .alias("permitted_path_prefixes"), F.lit(30).alias("rate_limit_per_minute"))
    return sheet.select("source_id", F.size(ingest.source_errors(sheet)).alias("errors"))


_ACTION = "CASE event_type WHEN 'signup' THEN 'ONBOARD' WHEN 'purchase' THEN 'APPROVE' WHEN 'error' THEN 'PAUSE' ELSE 'APPROVE' END"


def source_events(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    kind = F.col("event_type")
    action = F.when(kind == "signup", "ONBOARD").when(kind == "error", "PAUSE").otherwise("APPROVE")
    action = F.when(F.col("value") > 150, "REMOVE").otherwise(action)
    return e.select(F.col("user_id").alias("source_id"), "event_id", action.alias("action"),
                    F.col("ts").alias("at"))


_EVENTS_SQL = f"ev AS (SELECT user_id, event_id, ts, CASE WHEN value > 150 THEN 'REMOVE' ELSE {_ACTION} END AS a FROM events)"


@query("source_lifecycle", f"""WITH {_EVENTS_SQL}, l AS (SELECT user_id, arg_max(a, (ts, event_id)) AS a, count(*) AS n,
      bool_or(a = 'REMOVE') AS removed FROM ev GROUP BY user_id)
    SELECT user_id AS source_id, CASE WHEN removed THEN 'REMOVED' WHEN a = 'APPROVE' THEN 'APPROVED' WHEN a = 'PAUSE' THEN 'PAUSED'
      ELSE 'PENDING_APPROVAL' END AS status, n AS events, NOT removed AND a = 'APPROVE' AS may_run FROM l""")
def source_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.source_states(source_events(spark, folder))


@query("source_history", f"""WITH {_EVENTS_SQL}, h AS (SELECT *, lag(a) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ev)
    SELECT coalesce(p, 'none') AS previous_action, a AS action, coalesce(p <> 'REMOVE', true) AS permitted, count(*) AS steps FROM h GROUP BY ALL""")
def source_history(spark: SparkSession, folder: str) -> DataFrame:
    h = ingest.source_history(source_events(spark, folder))
    return h.groupBy(F.coalesce("previous_action", F.lit("none")).alias("previous_action"),
                     "action", "permitted").agg(F.count(F.lit(1)).alias("steps"))


@query("vocabulary_normalise", """SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'UNKNOWN' WHEN o_orderpriority = '1-URGENT' THEN 'RTI_MANUAL'
      ELSE o_orderpriority END AS doc_type, count(*) AS orders FROM orders GROUP BY ALL""")
def vocabulary_normalise(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders")
    raw = (F.when(F.col("o_orderpriority") == "1-URGENT", " rti-manual ")
            .when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.concat(
                F.col("o_orderpriority"), F.lit(" "))))
    return o.groupBy(ingest.normalise_vocabulary(raw, fv.DOC_TYPES).alias("doc_type")).agg(
        F.count(F.lit(1)).alias("orders"))


# --- request control ---------------------------------------------------------------


@query("rate_limit", """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    b AS (SELECT event_id, user_id, t, r, 3.0::DOUBLE AS before, true AS allowed, 2.0::DOUBLE AS tokens FROM e WHERE r = 1
      UNION ALL
      SELECT e.event_id, e.user_id, e.t, e.r, least(3.0, b.tokens + (e.t - b.t) / 36000),
        least(3.0, b.tokens + (e.t - b.t) / 36000) >= 1.0,
        least(3.0, b.tokens + (e.t - b.t) / 36000) - CASE WHEN least(3.0, b.tokens + (e.t - b.t) / 36000) >= 1.0 THEN 1 ELSE 0 END
      FROM b JOIN e ON e.user_id = b.user_id AND e.r = b.r + 1)
    SELECT event_id, user_id, allowed FROM b""")
def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    """One request per ten hours with a bucket of three, so that some events are refused."""
    per_minute = 60.0 / 36000
    limited = requests.rate_limit(read(spark, folder, "events"), "user_id", "event_id", "ts",
                                  per_minute, 3.0 - per_minute)
    return limited.select("event_id", "user_id", "allowed")


@query("idempotent_replays", """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t, CAST(floor(value / 20) AS INT) AS h,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
    b AS (SELECT event_id, user_id, event_type, t, r, t + 86400 AS expires, h AS stored, 'executed' AS outcome FROM e WHERE r = 1
      UNION ALL
      SELECT e.event_id, e.user_id, e.event_type, e.t, e.r, CASE WHEN e.t >= b.expires THEN e.t + 86400 ELSE b.expires END,
        CASE WHEN e.t >= b.expires THEN e.h ELSE b.stored END,
        CASE WHEN e.t >= b.expires THEN 'executed' WHEN e.h = b.stored THEN 'replayed' ELSE 'conflict' END
      FROM b JOIN e ON e.user_id = b.user_id AND e.event_type = b.event_type AND e.r = b.r + 1)
    SELECT event_id, outcome FROM b""")
def idempotent_replays(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").withColumn(
        "payload", F.floor(F.col("value") / 20).cast("int").cast("string"))
    out = requests.idempotent_replays(e, ["user_id", "event_type"], "event_id", "ts", "payload")
    return out.select("event_id", "outcome")


@query("crawl_pacing", """WITH e AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS t,
      row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)
    SELECT event_id, round(max(t - i * 60.0) OVER (PARTITION BY event_type ORDER BY i) + i * 60.0 - t, 3) AS wait_seconds FROM e""")
def crawl_pacing(spark: SparkSession, folder: str) -> DataFrame:
    """Event types as hosts, at one request per minute each."""
    e = read(spark, folder, "events")
    out = requests.crawl_pacing(e, "event_type", "event_id", "ts", 1)
    return out.select("event_id", F.round("wait_seconds", 3).alias("wait_seconds"))


# --- catalogue ---------------------------------------------------------------------


@query("latest_versions", """SELECT o_custkey AS document_id, max(o_orderkey) AS version_id, max(o_orderdate) AS retrieved_at
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
    WHERE r = 1 GROUP BY o_custkey""")
def latest_versions(spark: SparkSession, folder: str) -> DataFrame:
    v = read(spark, folder, "orders").select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_id"),
        F.col("o_orderdate").alias("retrieved_at"))
    return catalogue.latest_versions(v)


@query("parent_counts", """SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def parent_counts(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    c = read(spark, folder, "customer").select("c_custkey")
    return catalogue.with_child_count(c, o, "c_custkey", "orders")


@query("session_turn_counts", """SELECT u.user_id AS session_id, count(c.turn) AS turns FROM (SELECT DISTINCT user_id FROM events) u
    LEFT JOIN conversations c ON c.conv_id = u.user_id GROUP BY u.user_id""")
def session_turn_counts(spark: SparkSession, folder: str) -> DataFrame:
    sessions = read(spark, folder, "events").select(F.col("user_id").alias("session_id")).distinct()
    return catalogue.with_child_count(sessions, turns(spark, folder), "session_id", "turns")


@query("documents_page", f"""WITH {RECORDS_SQL}
    SELECT document_id, title, department_id, order_date, source_id FROM records
    WHERE classification IN ('PUBLIC', 'INTERNAL') AND (contains(lower(title), 'the') OR contains(lower(go_number), 'the'))
    ORDER BY order_date DESC, document_id LIMIT 20 OFFSET 20""")
def documents_page(spark: SparkSession, folder: str) -> DataFrame:
    from lekhya.operators.access import clearance_allows
    r = records(spark, folder).filter(clearance_allows(F.col("classification"), "INTERNAL")
                                      & catalogue.contains_any("The", ["title", "go_number"]))
    return catalogue.page(r.select("document_id", "title", "department_id", "order_date", "source_id"),
                          [F.desc("order_date"), F.col("document_id")], 20, 20)


@query("title_search", f"""WITH {RECORDS_SQL} SELECT document_id, title FROM records WHERE contains(lower(title), 're ha')""")
def title_search(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that contain a piece of text, found by trigrams."""
    titles = records(spark, folder).select("document_id", "title")
    return text_index.search(text_index.build(titles, ["document_id"], "title"), "Re Ha")


@query("audit_page", """SELECT event_id, ts, user_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total
    FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 50""")
def audit_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of the errors, with how many there are."""
    e = read(spark, folder, "events").filter("event_type = 'error'").select("event_id", "ts", "user_id")
    return catalogue.page(e, [F.desc("ts"), F.col("event_id")], 50, 50, total="total")


@query("audit_recent", """SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50""")
def audit_recent(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    return catalogue.page(e, [F.desc("ts"), F.col("event_id")], 50)


@query("deep_audit_page", """SELECT event_id, value, user_id, (SELECT count(*) FROM events) AS total FROM events
    QUALIFY row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) BETWEEN 5001 AND 5100""")
def deep_audit_page(spark: SparkSession, folder: str) -> DataFrame:
    """Events by value, a page from the middle of them."""
    e = read(spark, folder, "events").select("event_id", "value", "user_id")
    return selection.deep_page(e, [("value", True), ("event_id", False)], 100, 5000, "total")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in _TABLES))
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.table_counts({t: read(spark, folder, t) for t in _TABLES})


@query("orphan_check", """SELECT 'orders.customer' AS relation, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'labels.documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'events.conversations', count(*) FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations)""")
def orphan_check(spark: SparkSession, folder: str) -> DataFrame:
    def t(name: str, column: str, key: str) -> DataFrame:
        return read(spark, folder, name).select(F.col(column).alias(key))

    return (catalogue.orphans(t("orders", "o_custkey", "k"), t("customer", "c_custkey", "k"), "k", "orders.customer")
            .unionByName(catalogue.orphans(t("labels", "doc_id", "k"), t("documents", "doc_id", "k"), "k", "labels.documents"))
            .unionByName(catalogue.orphans(t("events", "user_id", "k"), t("conversations", "conv_id", "k"), "k", "events.conversations")))


@query("block_resolution", """SELECT l_linenumber AS page_number, count(*) AS blocks, count(o_orderkey) AS resolved, count(c_custkey) AS documents
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY l_linenumber""")
def block_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as blocks of orders, orders as pages of customers."""
    li, o, c = [read(spark, folder, n) for n in ("lineitem", "orders", "customer")]
    blocks = li.select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber")
                                   .cast("string")).alias("block_id"),
                       F.col("l_orderkey").alias("page_id"), F.col("l_linenumber"))
    pages = o.select(F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("version_id"),
                     F.lit(1).alias("page_number"))
    versions = c.select(F.col("c_custkey").alias("version_id"), F.col("c_custkey").alias("document_id"),
                        F.col("c_name").alias("source_url"))
    found = catalogue.resolve_blocks(blocks, pages, versions)
    number = F.element_at(F.split("block_id", ":"), 2).cast("int")
    return found.groupBy(number.alias("page_number")).agg(
        F.count(F.lit(1)).alias("blocks"), F.count("version_id").alias("resolved"),
        F.count("document_id").alias("documents"))


@query("unprocessed_versions", """SELECT doc_id AS version_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unprocessed_versions(spark: SparkSession, folder: str) -> DataFrame:
    v = read(spark, folder, "documents").select(F.col("doc_id").alias("version_id"))
    p = read(spark, folder, "labels").select(F.col("doc_id").alias("version_id"))
    return catalogue.versions_without_pages(v, p)


@query("cache_evictions", """WITH f AS (SELECT doc_id, n_chars, doc_id AS m, sum(CASE WHEN lang = 'en' THEN n_chars END) OVER (ORDER BY doc_id) AS freed,
      lang, sum(n_chars) OVER () - 2000000 AS excess FROM documents)
    SELECT 'tmp/' || doc_id AS path, n_chars AS size FROM f WHERE lang = 'en' AND freed - n_chars < excess""")
def cache_evictions(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents")
    prefix = F.when(F.col("lang") == "en", "tmp/").otherwise("keep/")
    files = d.select(F.concat(prefix, F.col("doc_id").cast("string")).alias("path"),
                     F.col("n_chars").alias("size"), F.col("doc_id").alias("modified"))
    return catalogue.evictions(files, 2_000_000).select("path", "size")


# --- memory ------------------------------------------------------------------------


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Signups open sessions; a signup after an error counts as one with personal data."""
    e = read(spark, folder, "events").filter("event_type = 'signup'")
    return e.select(F.col("event_id").alias("session_id"), F.col("user_id"),
                    memory.session_expiry(F.col("ts"), F.round(F.col("value") * 5000).cast("long"),
                                          F.col("user_id") % 7 == 0).alias("expires_at"))


_SESSIONS_SQL = """s AS (SELECT event_id AS session_id, user_id, ts + to_seconds(CASE
      WHEN user_id % 7 = 0 THEN CASE WHEN CAST(round(value * 5000) AS BIGINT) > 0 THEN least(CAST(round(value * 5000) AS BIGINT), 3600) ELSE 3600 END
      ELSE CASE WHEN CAST(round(value * 5000) AS BIGINT) > 0 THEN CAST(round(value * 5000) AS BIGINT) ELSE 86400 END END) AS expires_at
    FROM events WHERE event_type = 'signup')"""


@query("session_expiry", f"WITH {_SESSIONS_SQL} SELECT session_id, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at FROM s")
def session_expiry(spark: SparkSession, folder: str) -> DataFrame:
    s = event_sessions(spark, folder)
    return s.select("session_id", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@query("ttl_purge", f"""WITH {_SESSIONS_SQL} SELECT count(*) AS sessions_purged,
      (SELECT count(*) FROM events e WHERE e.user_id IN (SELECT user_id FROM s WHERE expires_at <= TIMESTAMP '2024-01-20')) AS turns_purged
    FROM s WHERE expires_at <= TIMESTAMP '2024-01-20'""")
def ttl_purge(spark: SparkSession, folder: str) -> DataFrame:
    s = event_sessions(spark, folder).select("session_id", F.col("user_id").alias("owner"), "expires_at")
    gone, _ = memory.split_expired(s, NOW)
    t = read(spark, folder, "events").select("user_id")
    removed = t.join(gone.select(F.col("owner").alias("user_id")), "user_id", "left_semi")
    return gone.agg(F.count(F.lit(1)).alias("sessions_purged")).select(
        "sessions_purged", removed.agg(F.count(F.lit(1)).alias("n")).scalar().alias("turns_purged"))


@query("open_sessions", f"""WITH {_SESSIONS_SQL} SELECT session_id FROM s WHERE user_id = 7 AND expires_at > TIMESTAMP '2024-01-02'
    UNION ALL SELECT session_id FROM s WHERE user_id = 8 AND expires_at > TIMESTAMP '2024-01-02'""")
def open_sessions(spark: SparkSession, folder: str) -> DataFrame:
    s = event_sessions(spark, folder)
    at = datetime(2024, 1, 2)
    return memory.open_sessions(s, 7, at).unionByName(memory.open_sessions(s, 8, at)).select("session_id")


@query("session_summary", """WITH t AS (SELECT conv_id AS session_id, turn, conv_id || ':' || turn AS turn_id, role,
      regexp_replace(regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g'), '[\\s]+', ' ', 'g') AS q FROM conversations),
    p AS (SELECT session_id, trim(substr(q, 1, 80)) AS value, min(turn) AS turn FROM t WHERE role = 'user' AND q <> '' GROUP BY ALL),
    i AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS r FROM p)
    SELECT session_id, 'intent' AS item, value, turn FROM i WHERE r <= 5
    UNION ALL SELECT session_id, 'source_turn', turn_id, turn FROM t""")
def session_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = turns(spark, folder).withColumn("cited_chunk_ids", F.array().cast("array<string>"))
    return memory.summary_items(t).filter(F.col("item").isin("intent", "source_turn"))


@query("current_preferences", """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS deleted, event_type <> 'view' AS opt_in,
      CASE WHEN event_type = 'click' THEN 'abc' ELSE 'display of ' || event_type END AS purpose, ts FROM events),
    k AS (SELECT * FROM e WHERE deleted OR (opt_in AND length(purpose) >= 5))
    SELECT user_id, purpose FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND NOT deleted""")
def current_preferences(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    kind = F.col("event_type")
    rows = e.select("user_id", "event_id", (kind == "error").alias("deleted"), (kind != "view").alias("opt_in"),
                    F.when(kind == "click", "abc").otherwise(F.concat(F.lit("display of "), kind)).alias("purpose"),
                    F.col("props").alias("data"), F.col("ts").alias("at"))
    return memory.current_preferences(rows).select("user_id", "purpose")


@query("field_encryption", "SELECT conv_id, turn, length(text) AS size, true AS intact FROM conversations")
def field_encryption(spark: SparkSession, folder: str) -> DataFrame:
    c = read(spark, folder, "conversations")
    key = F.lit("0123456789abcdef0123456789abcdef")
    back = memory.decrypt(memory.encrypt(F.col("text"), key), key)
    return c.select("conv_id", "turn", F.length(back).cast("long").alias("size"),
                    (back == F.col("text")).alias("intact"))


# --- metrics -----------------------------------------------------------------------


@query("ndcg_at_10", """WITH j AS (SELECT d.source AS query_id, d.doc_id, l.quality + l.toxic AS rel FROM labels l JOIN documents d USING (doc_id)),
    r AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
    a AS (SELECT r.query_id, sum(CASE WHEN rel > 0 THEN (power(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM r LEFT JOIN j USING (query_id, doc_id) WHERE rank <= 10 GROUP BY ALL),
    o AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM j),
    b AS (SELECT query_id, sum(CASE WHEN rel > 0 THEN (power(2, rel) - 1) / log2(r + 1) ELSE 0 END) AS idcg FROM o WHERE r <= 10 GROUP BY ALL)
    SELECT query_id, round(CASE WHEN dcg IS NULL OR idcg IS NULL THEN 0 WHEN idcg = 0 THEN CASE WHEN dcg = 0 THEN 1 ELSE 0 END ELSE dcg / idcg END, 6) AS ndcg
    FROM a FULL JOIN b USING (query_id)""")
def ndcg_at_10(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's documents by length as a ranking, judged by the labels."""
    from lekhya.operators.scale import top_k
    d = read(spark, folder, "documents").select(F.col("source").alias("query_id"),
                                                F.col("doc_id").alias("item_id"), "n_chars")
    ranking = top_k(d, 10, ["query_id"], [F.desc("n_chars"), F.col("item_id")])
    j = read(spark, folder, "labels").select(F.col("doc_id").alias("item_id"),
                                             (F.col("quality") + F.col("toxic")).alias("relevance"))
    judged = j.join(d.select("query_id", "item_id"), "item_id")
    out = metrics.ndcg(ranking.select("query_id", "item_id", "rank"), judged)
    return out.select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("abstention_metrics", """WITH p AS (SELECT d.lang, n_chars < 800 AS p, quality = 0 AS t FROM documents d JOIN labels USING (doc_id)),
    c AS (SELECT lang, count(*) FILTER (WHERE p AND t) AS tp, count(*) FILTER (WHERE p AND NOT t) AS fp,
      count(*) FILTER (WHERE NOT p AND t) AS fn, count(*) FILTER (WHERE NOT p AND NOT t) AS tn FROM p GROUP BY lang),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS re FROM c)
    SELECT lang, round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1,
      round((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives FROM r""")
def abstention_metrics(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id")
    rows = d.select("lang", (F.col("n_chars") < 800).alias("p"), (F.col("quality") == 0).alias("t"))
    return metrics.abstention(rows, "p", "t", ["lang"])


@query("scorecard_grouping_sets", """WITH o AS (SELECT source AS department, lang AS language, quality = 1 AS ok FROM documents JOIN labels USING (doc_id))
    SELECT CASE grouping_id(department, language) WHEN 3 THEN 'overall' WHEN 1 THEN 'department' ELSE 'language' END AS level,
      coalesce(department, language, 'all') AS value, count(*) AS total, round(avg(ok::INT), 4) AS accuracy
    FROM o GROUP BY GROUPING SETS ((), (department), (language))""")
def scorecard_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id")
    return metrics.scorecard(d.select(F.col("source").alias("department"), F.col("lang").alias("language"),
                                      (F.col("quality") == 1).alias("success")))


@query("pilot_gate", """WITH o AS (SELECT CASE lang WHEN 'es' THEN 'no_answer' WHEN 'de' THEN 'acl_denied' ELSE 'known' END AS c,
      quality = 0 AS refused, toxic = 1 AS leaked, quality = 1 AS hit,
      CASE WHEN n_chars % 5 > 0 THEN n_chars % 40 > 1 END AS page FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT coalesce(avg(hit::INT) FILTER (WHERE c = 'known'), 0) AS a, coalesce(avg(page::INT) FILTER (WHERE c = 'known'), 0) AS b,
      coalesce(avg(refused::INT) FILTER (WHERE c = 'no_answer'), 0) AS d, count(*) FILTER (WHERE c = 'acl_denied' AND leaked) AS leaks FROM o)
    SELECT round(a, 6) AS recall_at_k, round(b, 6) AS page_precision, round(d, 6) AS refusal_rate, leaks,
      a >= 0.9 AND b >= 0.95 AND d >= 1 AND leaks = 0 AS passed FROM r""")
def pilot_gate(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id")
    category = F.when(F.col("lang") == "es", "no_answer").when(F.col("lang") == "de", "acl_denied").otherwise("known")
    page = F.when(F.col("n_chars") % 5 > 0, F.col("n_chars") % 40 > 1)    # some are not judged
    rows = d.select(category.alias("category"), (F.col("quality") == 0).alias("refused"),
                    (F.col("toxic") == 1).alias("leaked"), (F.col("quality") == 1).alias("recall_hit"),
                    page.alias("page_hit"))
    return metrics.pilot_gate(rows).select(
        F.round("recall_at_k", 6).alias("recall_at_k"),
        F.round("page_precision", 6).alias("page_precision"), F.round("refusal_rate", 6).alias("refusal_rate"),
        "leaks", "passed")


@query("latency_percentiles", """SELECT event_type, round(quantile_disc(value, 0.5), 2) AS p50, round(quantile_disc(value, 0.9), 2) AS p90,
      round(quantile_disc(value, 0.95), 2) AS p95, round(quantile_disc(value, 0.99), 2) AS p99, round(avg(value), 2) AS mean,
      round(min(value), 2) AS min, round(max(value), 2) AS max, count(value) AS count FROM events GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.latency_percentiles(read(spark, folder, "events"), ["event_type"], "value")


@query("citation_coverage", r"""WITH x AS (SELECT a.conv_id, a.turn, a.text AS asked, b.text AS reply FROM conversations a JOIN conversations b
      ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
    c AS (SELECT conv_id, turn, unnest(string_split(asked, '.')) AS claim, lower(reply) AS e FROM x),
    w AS (SELECT conv_id, turn, claim, e, list_filter(regexp_extract_all(lower(claim), '\S+'), lambda t: length(t) >= 4) AS ts FROM c),
    k AS (SELECT conv_id, turn, CASE WHEN trim(claim, ' ' || chr(10)) = '' OR e = '' THEN false ELSE len(ts) = 0
      OR 2 * len(list_filter(ts, lambda t: contains(e, t))) >= len(ts) END AS ok FROM w)
    SELECT conv_id, turn, count(*) AS claims, round(avg(ok::INT), 6) AS coverage, round(greatest(0.0, 1.0 - avg(ok::INT)), 4) AS unsupported_rate FROM k GROUP BY ALL""")
def citation_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of each question as claims, the reply as evidence."""
    x = exchanges(spark, folder).select("conv_id", "turn", F.explode(F.split("asked", "\\.")).alias("claim"),
                                        F.col("reply").alias("evidence"))
    out = metrics.citation_coverage(x, ["conv_id", "turn"])
    return out.withColumn("coverage", F.round("coverage", 6))


@query("correction_rate", """SELECT event_type, round(least(1.0, count(*) FILTER (WHERE value > 100) / count(*)), 4) AS rate FROM events GROUP BY event_type""")
def correction_rate(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events").groupBy("event_type").agg(
        F.count_if(F.col("value") > 100).alias("c"), F.count(F.lit(1)).alias("n"))
    return e.select("event_type", metrics.correction_rate(F.col("c"), F.col("n")).alias("rate"))


@query("promotion_gates", """WITH g AS (SELECT source, avg(quality) AS q, avg(toxic) AS t, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT source, q >= 0.5 AND t <= 0.1 AND n >= 10 AS promoted, concat_ws(',', CASE WHEN NOT q >= 0.5 THEN 'recall' END,
      CASE WHEN NOT t <= 0.1 THEN 'leaks' END, CASE WHEN NOT n >= 10 THEN 'size' END) AS failures FROM g""")
def promotion_gates(spark: SparkSession, folder: str) -> DataFrame:
    d = read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id")
    g = d.groupBy("source").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    decision = metrics.promotion_decision({"recall": F.col("q") >= 0.5, "leaks": F.col("t") <= 0.1, "size": F.col("n") >= 10})
    return g.select("source", decision.alias("d")).select(
        "source", "d.promoted", F.array_join("d.failures", ",").alias("failures"))
