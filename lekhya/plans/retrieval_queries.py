"""Search, access and question-understanding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lekhya import fixed_values as fv
from lekhya.functions import vectors
from lekhya.functions.text import expand_tokens, tokens
from lekhya.operators import access, answers, catalogue, evidence, precedents, retrieval
from lekhya.operators import understanding
from lekhya.operators.access import User
from lekhya.operators.retrieval import Question
from lekhya.operators.scale import join_small, top_k
from lekhya.plans.corpus import (GRANTS_SQL, NOTICES_SQL, NOW, RECORDS_SQL, SEVEN, grants,
                                 notice_chunks, order_notices, read, read_spread,
                                 records)
from lekhya.plans.registry import query
from lekhya.session import stage

OFFICER = User("user7", ("OFFICER",), "FINANCE_TREASURY", "RESTRICTED")
TERMS = ["reat", "heble", "nicht", "pour", "heble"]

_TOKENS = ("list_filter(regexp_extract_all(lower({}), '[A-Za-z0-9ऀ-ॿ]+'), "
           "lambda x: length(x) > 1 OR regexp_matches(x, '^[ऀ-ॿ]'))")


def bm25_sql(source: str, id_col: str, text: str, terms: list[str], k: int) -> str:
    weights = ", ".join(f"('{t}', {terms.count(t)})" for t in dict.fromkeys(terms))
    return f""", toks AS (
      SELECT {id_col} AS id, {_TOKENS.format(text)} AS t FROM {source}),
    stats AS (SELECT count(*) AS n, avg(len(t)) AS average FROM toks),
    q(term, m) AS (VALUES {weights}),
    tf AS (SELECT id, len(t) AS dl, term, m, len(list_filter(t, lambda x: x = term)) AS tf
           FROM toks, q WHERE list_contains(t, term)),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
    SELECT id AS {id_col}, round(sum(m * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
             / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(average, 1.0)))), 6) AS score
    FROM tf JOIN df USING (term), stats GROUP BY id
    ORDER BY score DESC, id LIMIT {k}"""


@query("bm25_topk", "WITH src AS (SELECT * FROM documents)"
       + bm25_sql("src", "doc_id", "text", TERMS, 10))
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = retrieval.keyword_search(read_spread(spark, folder, "documents", "doc_id"), TERMS, 10)
    return hits.select("doc_id", F.round("score", 6).alias("score"))


_OFFICER_SEES = """(classification = 'PUBLIC'
    OR (classification IN ('INTERNAL', 'RESTRICTED') AND department_id = 'FINANCE_TREASURY')
    OR document_id IN (SELECT document_id FROM grants WHERE subject_id IN ('user7', 'OFFICER')
        AND action IN ('READ', 'ADMIN') AND expires_at > TIMESTAMP '2024-01-20'))"""


@query("bm25_acl_topk", f"WITH {RECORDS_SQL}, {GRANTS_SQL}, src AS (SELECT * FROM records "
       f"WHERE {_OFFICER_SEES})" + bm25_sql("src", "document_id", "content", TERMS, 10))
def bm25_acl_topk(spark: SparkSession, folder: str) -> DataFrame:
    seen = access.filter_visible(records(spark, folder), OFFICER, grants(spark, folder), NOW)
    hits = retrieval.keyword_search(seen, TERMS, 10, "document_id", "content")
    return hits.select("document_id", F.round("score", 6).alias("score"))


@query("acl_visible_counts", f"""WITH {RECORDS_SQL}, {GRANTS_SQL}
    SELECT classification, department_id, count(*) AS visible FROM records
    WHERE {_OFFICER_SEES} GROUP BY ALL""")
def acl_visible_counts(spark: SparkSession, folder: str) -> DataFrame:
    seen = access.filter_visible(records(spark, folder), OFFICER, grants(spark, folder), NOW)
    return seen.groupBy("classification", "department_id").agg(
        F.count(F.lit(1)).alias("visible"))


@query("clearance_listing", f"""WITH {RECORDS_SQL}
    SELECT department_id, count(*) AS documents FROM records
    WHERE classification IN ('PUBLIC', 'INTERNAL') GROUP BY department_id""")
def clearance_listing(spark: SparkSession, folder: str) -> DataFrame:
    listed = records(spark, folder).filter(
        access.clearance_allows(F.col("classification"), "INTERNAL"))
    return listed.groupBy("department_id").agg(F.count(F.lit(1)).alias("documents"))


@query("page_stealth_access", f"""WITH {RECORDS_SQL}, {GRANTS_SQL}, held AS (
      SELECT DISTINCT document_id FROM grants WHERE subject_id IN ('user7', 'OFFICER')
        AND action IN ('READ', 'ADMIN') AND expires_at > TIMESTAMP '2024-01-20')
    SELECT r.document_id, r.classification FROM records r LEFT JOIN held h USING (document_id)
    WHERE classification = 'PUBLIC' OR ((classification IN ('INTERNAL', 'RESTRICTED')
        OR h.document_id IS NOT NULL) AND department_id = 'FINANCE_TREASURY')""")
def page_stealth_access(spark: SparkSession, folder: str) -> DataFrame:
    held = access.document_grants(grants(spark, folder), OFFICER, NOW).withColumn(
        "held", F.lit(True))
    rows = records(spark, folder).join(held, "document_id", "left")
    ok = access.page_accessible(OFFICER, F.col("classification"), F.col("department_id"),
                                F.coalesce("held", F.lit(False)))
    return rows.filter(ok).select("document_id", "classification")


@query("searchable_gate", f"""WITH {RECORDS_SQL}
    SELECT lifecycle_status, provenance_status, review_status, count(*) AS chunks,
      count(*) FILTER (WHERE lifecycle_status = 'ACTIVE' AND review_status <> 'FLAGGED') AS approved
    FROM records GROUP BY ALL""")
def searchable_gate(spark: SparkSession, folder: str) -> DataFrame:
    r = records(spark, folder).filter(
        access.searchable(F.col("lifecycle_status"), F.col("provenance_status")))
    ok = access.approved(F.col("review_status"), F.col("lifecycle_status"))
    return r.groupBy("lifecycle_status", "provenance_status", "review_status").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(ok).alias("approved"))


@query("accessible_departments", f"""WITH {RECORDS_SQL}, src AS (
      SELECT DISTINCT source_id, department_id, classification FROM records)
    SELECT department_id, count(*) AS collections FROM src
    WHERE classification = 'PUBLIC' OR (classification IN ('INTERNAL', 'RESTRICTED')
      AND department_id = 'FINANCE_TREASURY') GROUP BY department_id""")
def accessible_departments(spark: SparkSession, folder: str) -> DataFrame:
    sources = records(spark, folder).select(
        "source_id", "department_id", F.col("classification").alias("access_classification"),
        F.lit("APPROVED").alias("status")).distinct()
    return access.accessible_departments(sources, OFFICER)


@query("soft_filter", f"""WITH {RECORDS_SQL}, a AS (
      SELECT * FROM records WHERE lang = 'it' OR NOT EXISTS (SELECT 1 FROM records WHERE lang = 'it')),
    b AS (SELECT * FROM a WHERE order_date BETWEEN DATE '2016-01-01' AND DATE '2017-12-31'
      OR NOT EXISTS (SELECT 1 FROM a WHERE order_date BETWEEN DATE '2016-01-01' AND DATE '2017-12-31'))
    SELECT lang, doc_type, count(*) AS n FROM b GROUP BY ALL""")
def soft_filter(spark: SparkSession, folder: str) -> DataFrame:
    between = F.col("order_date").between(F.lit("2016-01-01").cast("date"),
                                          F.lit("2017-12-31").cast("date"))
    kept = catalogue.soft_filter(records(spark, folder), [F.col("lang") == "it", between])
    return kept.groupBy("lang", "doc_type").agg(F.count(F.lit(1)).alias("n"))


# --- hybrid search -------------------------------------------------------------

QUESTIONS = [
    Question("q1", "reat heble notification 2019", User()),
    Question("q2", "nicht keit rules in 2020", OFFICER),
    Question("q3", "pour dans audit inspection", User("a", ("ADMIN",))),
    Question("q4", "helicopter allowance", User()),
]


def _round_hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "document_id", F.round("score", 4).alias("score"),
                       F.round("bm25_score", 4).alias("bm25_score"),
                       F.round("vector_score", 4).alias("vector_score"), "go_match")


@query("hybrid_search")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return _round_hits(retrieval.search_all(
        records(spark, folder), QUESTIONS, k=10, grants=grants(spark, folder), now=NOW))


@query("search_page")
def search_page(spark: SparkSession, folder: str) -> DataFrame:
    return _round_hits(retrieval.search_page(records(spark, folder), QUESTIONS[:1], 5, 5))


@query("hashed_embedding_votes", f"""WITH t AS (SELECT doc_id, lower(text) AS s, text FROM documents),
    dictionary(term, expansion) AS (VALUES {", ".join(
        f"('{t}', '{e}')" for t, x in fv.BILINGUAL_TERMS.items() for e in x)}),
    w0 AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS w FROM t),
    w AS (SELECT * FROM w0 UNION ALL SELECT doc_id, expansion FROM w0 JOIN dictionary ON w = term),
    wh AS (SELECT doc_id, md5(w) AS h FROM w),
    g AS (SELECT doc_id, unnest(list_transform(generate_series(1, length(s) - 2),
            lambda i: substr(s, CAST(i AS INT), 3))) AS gram FROM t WHERE length(s) >= 3),
    gc AS (SELECT gram, count(*) AS n, doc_id FROM g GROUP BY gram, doc_id),
    gh AS (SELECT doc_id, n, CAST('0x' || substr(sha256(gram), 1, 8) AS BIGINT) AS h FROM gc),
    votes AS (
      SELECT doc_id, CAST('0x' || substr(h, 31, 2) AS INT) % 128 AS dim,
        CASE WHEN CAST('0x' || substr(h, 30, 1) AS INT) % 2 = 0 THEN 1 ELSE -1 END AS word,
        0 AS gram FROM wh
      UNION ALL
      SELECT doc_id, CAST(h % 128 AS INT), 0, n * CASE WHEN (h // 16) % 2 = 0 THEN 1 ELSE -1 END
      FROM gh)
    SELECT doc_id, dim, CAST(sum(word) AS BIGINT) AS word_votes, CAST(sum(gram) AS BIGINT) AS ngram_votes
    FROM votes GROUP BY doc_id, dim HAVING sum(word) <> 0 OR sum(gram) <> 0""")
def hashed_embedding_votes(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_spread(spark, folder, "documents", "doc_id").select(
        "doc_id", vectors.embedding_votes("text").alias("v"))
    both = F.arrays_zip(F.col("v.words"), F.col("v.ngrams"))
    rows = docs.select("doc_id", F.posexplode(both).alias("dim", "x"))
    return rows.select("doc_id", "dim", F.col("x.words").cast("long").alias("word_votes"),
                       F.col("x.ngrams").cast("long").alias("ngram_votes")).filter(
        "word_votes <> 0 OR ngram_votes <> 0")


@query("cosine_topk", """WITH d AS (
      SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM d GROUP BY label, i),
    s AS (SELECT d.label, vec_id, sum(CAST(x AS DOUBLE) * m) AS dp, sqrt(sum(CAST(x AS DOUBLE) * x)) AS nx,
            sqrt(sum(m * m)) AS nm FROM d JOIN c ON d.label = c.label AND d.i = c.i GROUP BY ALL),
    r AS (SELECT label, vec_id, round(greatest(0.0, least(1.0, dp / (nx * nm))), 6) AS similarity FROM s)
    SELECT label, vec_id, similarity FROM r
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) <= 10""")
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors closest to the mean vector of their own label."""
    e = read(spark, folder, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    means = parts.groupBy("label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("mean"))
    scored = join_small(e, means, ["label"], "vec_id", "inner", 10_000).select("label", "vec_id", F.round(
        vectors.cosine(F.col("embedding").cast("array<double>"), F.col("mean")), 6)
        .alias("similarity"))
    return top_k(scored, 10, ["label"], [F.desc("similarity"), F.col("vec_id")]).drop("rank")


@query("rerank_boost", f"""WITH {RECORDS_SQL}
    SELECT document_id, round(
      CASE WHEN contains(lower(content), 'order pour 2019') THEN 0.25 ELSE 0 END
      + CASE WHEN list_has_any({_TOKENS.format("section_heading || ' ' || title")},
          ['order', 'pour', '2019']) THEN 0.15 ELSE 0 END
      + CASE WHEN contains('order pour 2019', lower(go_number)) THEN 0.30 ELSE 0 END
      + CASE WHEN contains('order pour 2019', CAST(year(order_date) AS VARCHAR)) THEN 0.10 ELSE 0 END, 4)
      AS boost FROM records""")
def rerank_boost(spark: SparkSession, folder: str) -> DataFrame:
    asked = retrieval.ParsedQuestion("q", "order pour 2019", User(), False)
    return records(spark, folder).select(
        "document_id", F.round(retrieval.rerank_boost(asked), 4).alias("boost"))


# --- questions -------------------------------------------------------------------


def order_questions(spark: SparkSession, folder: str) -> DataFrame:
    """A question about every order: by number, by date, by year, or high-risk."""
    o = read_spread(spark, folder, "orders", "o_orderkey")
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    form = F.col("o_custkey") % 5
    text = (F.when(form == 0, F.concat(F.lit("What does order no. "), key.cast("string"),
                                       F.lit("/FIN/A of the finance department say?")))
             .when(form == 1, F.concat(F.lit("Which circular was issued on "),
                                       F.date_format(day, "dd/MM/yyyy"), F.lit(" by the audit directorate")))
             .when(form == 2, F.concat(F.lit("Show rules  issued in "), F.year(day).cast("string")))
             .when(form == 3, F.concat(F.lit("Am I eligible under FIN/"), key.cast("string"),
                                       F.lit(" dated "), F.date_format(day, "d MMMM yyyy"), F.lit("?")))
             .otherwise(F.concat(F.lit("Leave policy of Punjab for "), F.year(day).cast("string"),
                                 F.lit("-"), F.substring((F.year(day) + 1).cast("string"), 3, 2))))
    return o.select(F.col("o_orderkey").alias("query_id"), text.alias("text"))


QUESTIONS_SQL = """questions AS (
  SELECT o_orderkey AS query_id, o_orderdate AS d, o_custkey % 5 AS form,
    CASE o_custkey % 5
      WHEN 0 THEN concat('What does order no. ', o_orderkey, '/FIN/A of the finance department say?')
      WHEN 1 THEN concat('Which circular was issued on ', strftime(o_orderdate, '%d/%m/%Y'), ' by the audit directorate')
      WHEN 2 THEN concat('Show rules  issued in ', year(o_orderdate))
      WHEN 3 THEN concat('Am I eligible under FIN/', o_orderkey, ' dated ', day(o_orderdate), ' ', strftime(o_orderdate, '%B'), ' ', year(o_orderdate), '?')
      ELSE concat('Leave policy of Punjab for ', year(o_orderdate), '-', substr(CAST(year(o_orderdate) + 1 AS VARCHAR), 3, 2)) END AS text
  FROM orders)"""

_Q = r"regexp_extract(text, '{}', {}, 'i')"


@query("parse_questions", rf"""WITH {QUESTIONS_SQL}, p AS (SELECT query_id, text,
      regexp_replace(text, '(?:order|go)\s*(?:no\.?|number)|which\s+(?:order|go|rules?)', '', 'gi') AS typed,
      regexp_extract(text, '(?:GO|G\.O\.|order\s+no\.?|order\s+number|notification\s+no\.?|notification\s+number|notification)\s*[:\-]?\s*([0-9A-Za-z()/\-._]{{3,60}})', 1, 'i') AS pre,
      regexp_extract(text, '\b((?:UK|GO|FIN|RD|AUD|BOR)/[A-Za-z0-9/\-._]{{3,40}})\b', 1, 'i') AS bare,
      regexp_extract(text, '\b(\d{{1,2}})[.\-/](\d{{1,2}})[.\-/](\d{{4}})\b', 0) AS num,
      regexp_extract(text, '\b\d{{1,2}}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{{4}}\b', 0) AS eng,
      regexp_extract(text, '\b(\d{{4}})\s*[\-/]\s*(\d{{2,4}})\b', 1) AS y1,
      regexp_extract(text, '\b(\d{{4}})\s*[\-/]\s*(\d{{2,4}})\b', 2) AS y2,
      regexp_extract(text, '(?:year|in)\s*(\d{{4}})\b', 1, 'i') AS yr FROM questions),
    e AS (SELECT *, CAST(coalesce(try_strptime(num, '%d/%m/%Y'), try_strptime(eng, '%-d %B %Y'),
        try_strptime(eng, '%d %B %Y')) AS DATE) AS exact_date,
      TRY_CAST(y1 AS INT) AS a, TRY_CAST(y2 AS INT) AS b, TRY_CAST(yr AS INT) AS c FROM p),
    f AS (SELECT *, CASE WHEN b > 1000 THEN b ELSE (a // 100) * 100 + b END = a + 1 AS fy FROM e)
    SELECT query_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean_query,
      CASE WHEN regexp_matches(text, '\b(?:am\s+i\s+eligible)\b', 'i') THEN 'ELIGIBILITY' END AS high_risk_category,
      CASE WHEN regexp_matches(text, 'finance\s+department', 'i') THEN 'FINANCE_TREASURY'
           WHEN regexp_matches(text, 'audit\s+directorate', 'i') THEN 'AUDIT_DIRECTORATE' END AS department_id,
      CASE WHEN regexp_matches(typed, '\b(?:government\s+order|g\.?o\.?)\b', 'i') THEN 'GO'
           WHEN regexp_matches(typed, '\bact\b', 'i') THEN 'ACT'
           WHEN regexp_matches(typed, '\b(?:rules|regulations)\b', 'i') THEN 'RULES'
           WHEN regexp_matches(typed, '\b(?:circular|office\s+memorandum|om)\b', 'i') THEN 'CIRCULAR' END AS doc_type,
      CASE WHEN regexp_matches(CASE WHEN pre <> '' THEN pre ELSE bare END, '[0-9]')
           THEN trim(CASE WHEN pre <> '' THEN pre ELSE bare END, ',.;:') END AS go_number,
      exact_date,
      CASE WHEN exact_date IS NULL THEN CASE WHEN coalesce(fy, false) THEN make_date(a, 4, 1)
           WHEN c BETWEEN 1950 AND 2050 THEN make_date(c, 1, 1) END END AS date_from,
      CASE WHEN exact_date IS NULL THEN CASE WHEN coalesce(fy, false) THEN make_date(a + 1, 3, 31)
           WHEN c BETWEEN 1950 AND 2050 THEN make_date(c, 12, 31) END END AS date_to,
      regexp_matches(text, '\bpunjab\b', 'i') AS is_out_of_jurisdiction
    FROM f""")
def parse_questions(spark: SparkSession, folder: str) -> DataFrame:
    parsed = understanding.parse_questions(order_questions(spark, folder))
    return parsed.select("query_id", "clean_query", "high_risk_category", "department_id",
                         "doc_type", "go_number", "exact_date", "date_from", "date_to",
                         "is_out_of_jurisdiction")


@query("refusal_categories", rf"""WITH {QUESTIONS_SQL}
    SELECT CASE WHEN contains(lower(text), 'punjab') THEN 'OUT_OF_JURISDICTION'
      WHEN contains(lower(text), '999999') THEN 'NON_EXISTENT_RECORD'
      WHEN regexp_matches(text, '\b20[3-9]\d\b') THEN 'FUTURE_SPECULATION'
      ELSE 'NONE' END AS category, count(*) AS questions FROM questions GROUP BY ALL""")
def refusal_categories(spark: SparkSession, folder: str) -> DataFrame:
    q = order_questions(spark, folder)
    category = F.coalesce(understanding.refusal_category(F.col("text")), F.lit("NONE"))
    return q.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("questions"))


@query("refusal_verification", rf"""WITH {QUESTIONS_SQL}, a AS (
      SELECT query_id, form, CASE WHEN contains(lower(text), 'punjab')
        THEN '{fv.REFUSAL} {fv.REFUSAL_RULES[0][3]}'
        WHEN contains(text, '999999') THEN '{fv.REFUSAL} {fv.REFUSAL_RULES[1][3]}'
        WHEN regexp_matches(text, '\b20[3-9]\d\b') THEN '{fv.REFUSAL} {fv.REFUSAL_RULES[2][3]}' ELSE '{fv.REFUSAL} {fv.ZERO_EVIDENCE_HINT}' END AS answer
      FROM questions)
    SELECT form, count(*) AS answers, count(*) FILTER (WHERE contains(lower(answer), 'i could not establish this')) AS abstained,
      max(len(string_split(answer, ' '))) AS longest FROM a GROUP BY form""")
def refusal_verification(spark: SparkSession, folder: str) -> DataFrame:
    o = read(spark, folder, "orders").select(F.col("o_orderkey").alias("query_id"),
                                             (F.col("o_custkey") % 5).alias("form"))
    q = order_questions(spark, folder).join(o, "query_id")
    category = F.coalesce(understanding.refusal_category(F.col("text")), F.lit("ZERO_EVIDENCE"))
    answer = understanding.cap_tokens(understanding.refusal_text(category), 512)
    rows = q.select("form", answer.alias("answer"))
    return rows.groupBy("form").agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if(understanding.is_abstention(F.col("answer"))).alias("abstained"),
        F.max(F.size(F.split("answer", " "))).cast("long").alias("longest"))


@query("query_expansion", f"""WITH dictionary(term, expansion) AS (VALUES {", ".join(
        f"('{t}', '{e}')" for t, x in fv.BILINGUAL_TERMS.items() for e in x)}), {QUESTIONS_SQL},
    w AS (SELECT query_id, unnest({_TOKENS.format('text')}) AS term FROM questions),
    x AS (SELECT query_id, term FROM w UNION ALL
          SELECT query_id, expansion FROM w JOIN dictionary USING (term))
    SELECT term, count(*) AS uses FROM x GROUP BY term""")
def query_expansion(spark: SparkSession, folder: str) -> DataFrame:
    q = order_questions(spark, folder)
    return (q.select(F.explode(expand_tokens(tokens(F.col("text")))).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("uses")))


# --- evidence and answers ----------------------------------------------------------

ORDER_QUESTIONS = [
    Question("sanction", "sanction under priority urgent", User()),
    Question("amended", "What does order no. 118/FIN/A say about allowance", OFFICER),
    Question("risky", "Am I eligible for sanction under schedule heads of account", User()),
    Question("refused", "metro rail sanction", User()),
]


def notice_edges(spark: SparkSession, folder: str, around: DataFrame | None = None) -> DataFrame:
    """Precedent edges read out of the notices and resolved to their targets.

    With passages ``around``: at least all edges that leave, target or cite one of them.
    """
    n = order_notices(spark, folder)
    texts, holders = n, n.select("notice_id", "number")
    if around is not None:
        texts = precedents.texts_around(n, "notice_id", holders, around)
    refs = precedents.extract_precedents(texts, "notice_id").withColumnRenamed(
        "notice_id", "source_document_id")
    if around is not None:
        refs = stage(refs)
        holders = holders.join(refs.select(F.col("cited_order_number").alias("number")),
                               "number", "left_semi")
    versions = holders.select(F.col("number").alias("go_number"),
                              F.col("notice_id").alias("document_id"))
    attributes = versions.withColumnRenamed("go_number", "order_number")
    resolved = precedents.resolve_targets(refs, versions, attributes)
    # 4 bits for the family and 20 for the place of the citation in its text
    edge = F.col("source_document_id") * (1 << 24) + F.col("family") * (1 << 20) + F.col("at")
    return resolved.select(edge.alias("edge_id"), "source_document_id",
                           F.col("source_document_id").alias("source_version_id"),
                           "target_document_id", "cited_order_number", "relation_type")


def staged_edges(spark: SparkSession, folder: str) -> DataFrame:
    return stage(notice_edges(spark, folder))


def notice_packet(spark: SparkSession, folder: str) -> tuple[DataFrame, evidence.Packet]:
    chunks = notice_chunks(spark, folder)
    hits = retrieval.search_all(chunks, ORDER_QUESTIONS, k=10)
    versions = chunks.select("version_id", "document_id", "go_number", "effective_from",
                             "lifecycle_status")
    users = {q.query_id: q.user for q in ORDER_QUESTIONS}
    packet = evidence.build_packet(
        hits, chunks, lambda passages: stage(notice_edges(spark, folder, passages)), versions,
        users)
    asked = spark.createDataFrame([(q.query_id, q.text) for q in ORDER_QUESTIONS],
                                  "query_id string, text string")
    return understanding.parse_questions(asked), packet


@query("evidence_packet")
def evidence_packet(spark: SparkSession, folder: str) -> DataFrame:
    _, packet = notice_packet(spark, folder)
    return packet.passages.select(
        "query_id", "position", "document_id", F.round("score", 4).alias("score"), "go_number",
        "currency_status", "is_amending", "is_superseding", "has_conflict")


@query("evidence_conflicts")
def evidence_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    _, packet = notice_packet(spark, folder)
    return packet.conflicts.select("query_id", "conflict_type", "first_order", "second_order",
                                   "notes")


@query("cited_answers")
def cited_answers(spark: SparkSession, folder: str) -> DataFrame:
    parsed, packet = notice_packet(spark, folder)
    return answers.respond(parsed, packet).select(
        "query_id", "answer", "outcome", "is_no_answer", "is_research_brief", "validation_passed")


@query("citations")
def citations(spark: SparkSession, folder: str) -> DataFrame:
    _, packet = notice_packet(spark, folder)
    rows = evidence.citations(packet)
    return rows.select("query_id", "citation", "document_id",
                       evidence.citation_markdown(rows).alias("markdown"))


@query("claim_extraction", rf"""WITH {NOTICES_SQL},
    c AS (
      SELECT notice_id, 'DATE' AS claim_type, unnest(regexp_extract_all(text, '\b(?:\d{{1,2}}[.\-/]\d{{1,2}}[.\-/]\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})\b')) AS claim FROM notices
      UNION ALL SELECT notice_id, 'MONEY_AMOUNT', unnest(regexp_extract_all(text, '(?i)(?:(?:Rs\.?|INR)\s*[\d,]+(?:\.\d+)?|\b\d+(?:\.\d+)?%)')) FROM notices
      UNION ALL SELECT notice_id, 'RULE_OR_GO_NUMBER', unnest(regexp_extract_all(text, '(?i)(?:Rule\s+\d+[A-Za-z()]*|Section\s+\d+[A-Za-z()]*|(?:UK|GO|FIN|RD|AUD|BOR)/[A-Za-z0-9/\-._]{{3,30}}|\b\d+/\S+/\d{{4}}\b)')) FROM notices
      UNION ALL SELECT notice_id, 'AUTHORITY', unnest(regexp_extract_all(text, '(?i)\b(?:Governor|Additional Chief Secretary|Departmental Secretary|Head of Department|District Magistrate)\b')) FROM notices)
    SELECT notice_id, claim_type, trim(claim) AS claim, count(*) AS times FROM c GROUP BY ALL""")
def claim_extraction(spark: SparkSession, folder: str) -> DataFrame:
    claims = answers.extract_claims(order_notices(spark, folder).select("notice_id", "text"))
    return claims.groupBy("notice_id", "claim_type", "claim").agg(F.count(F.lit(1)).alias("times"))


@query("claim_grounding", rf"""WITH {NOTICES_SQL},
    c AS (SELECT notice_id, number, order_date, unnest(regexp_extract_all(text, '\b\d{{1,2}}/\d{{1,2}}/\d{{4}}\b')) AS claim FROM notices),
    k AS (SELECT notice_id, claim, lower(number || ' ' || CAST(order_date AS VARCHAR)) AS corpus FROM c)
    SELECT count(*) AS claims, count(*) FILTER (WHERE contains(corpus, claim) OR
      len(list_filter(regexp_extract_all(claim, '\d+'), lambda d: NOT contains(corpus, d))) = 0) AS grounded
    FROM k""")
def claim_grounding(spark: SparkSession, folder: str) -> DataFrame:
    """Dates of each notice against the number and date recorded for it."""
    n = order_notices(spark, folder)
    claims = answers.extract_claims(n.select("number", "order_date", "text")).filter(
        "claim_type = 'DATE'")
    corpus = F.lower(F.concat_ws(" ", "number", F.col("order_date").cast("string")))
    ok = answers.is_grounded(F.col("claim_type"), F.col("claim"), corpus)
    return claims.agg(F.count(F.lit(1)).alias("claims"), F.count_if(ok).alias("grounded"))


@query("da_rates", rf"""WITH {NOTICES_SQL}
    SELECT department_id, regexp_extract(text, '(?i)(\d+(?:\.\d+)?)\s*%\s*da', 1) AS rate,
      count(*) AS notices FROM notices GROUP BY ALL""")
def da_rates(spark: SparkSession, folder: str) -> DataFrame:
    rates = evidence.stated_rates(order_notices(spark, folder), "text")
    return rates.groupBy("department_id", "rate").agg(F.count(F.lit(1)).alias("notices"))


@query("request_hashes", """SELECT conv_id, turn, sha256(concat_ws('|',
      regexp_replace(text, '^\\s+|\\s+$', '', 'g'), role, lang_list)) AS request_hash
    FROM (SELECT *, 'a,b' AS lang_list FROM conversations)""")
def request_hashes(spark: SparkSession, folder: str) -> DataFrame:
    c = read(spark, folder, "conversations")
    return c.select("conv_id", "turn", answers.request_hash(
        F.col("text"), F.array("role"), F.array(F.lit("b"), F.lit("a"))).alias("request_hash"))


@query("precedent_extraction", f"""WITH {NOTICES_SQL}
    SELECT notice_id, CASE o_orderstatus WHEN 'F' THEN 'SUPERSEDES' WHEN 'O' THEN 'IN_CONTINUATION_OF'
      ELSE 'AMENDS' END AS relation_type, cited AS cited_order_number, cited_day AS cited_date
    FROM notices""")
def precedent_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = precedents.extract_precedents(order_notices(spark, folder), "notice_id")
    return found.select("notice_id", "relation_type", "cited_order_number", "cited_date")


@query("precedent_targets", f"""WITH {NOTICES_SQL}
    SELECT a.notice_id, b.notice_id AS target_document_id FROM notices a
    LEFT JOIN notices b ON a.cited = b.number AND a.notice_id <> b.notice_id""")
def precedent_targets(spark: SparkSession, folder: str) -> DataFrame:
    return notice_edges(spark, folder).select(
        F.col("source_document_id").alias("notice_id"), "target_document_id")


@query("precedent_neighbours", f"""WITH {NOTICES_SQL},
    e AS (SELECT a.notice_id AS s, b.notice_id AS t, a.cited FROM notices a LEFT JOIN notices b
      ON a.cited = b.number AND a.notice_id <> b.notice_id),
    i AS (SELECT t AS d, s AS e FROM e WHERE t IS NOT NULL
          UNION SELECT n.notice_id, s FROM e JOIN notices n ON e.cited = n.number)
    SELECT document_id, direction, count(*) AS edges FROM (
      SELECT s AS document_id, 'outgoing' AS direction FROM e
      UNION ALL SELECT d, 'incoming' FROM i) GROUP BY ALL""")
def precedent_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    n = order_notices(spark, folder)
    around = precedents.neighbourhood(staged_edges(spark, folder), n.select(
        F.col("notice_id").alias("document_id"), F.col("number").alias("go_number")))
    return around.groupBy("document_id", "direction").agg(F.count(F.lit(1)).alias("edges"))
