"""Record tables derived from the given tables, in Spark and in SQL.

The given tables hold prose and orders, not government records, so each role
(chunk, version, order notice, session) is a projection of a given table.  The
``*_SQL`` strings state the same projections for the SQL check.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lekhya import fixed_values as fv

NOW = datetime(2024, 1, 20)
TASK_ROWS = 50_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_spread(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table for per-row text work, over all cores even if it is one small file.

    Tasks get at most about TASK_ROWS rows, so the longest one does not grow with the table.
    Splits may hold no row group or a large one; a table whose splits are even and small
    enough is read as it is and nothing moves.
    """
    df = read(spark, folder, name)
    held = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(
        F.count(F.lit(1)).alias("n")).collect()]  # a number a split, from the footers
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(held) // TASK_ROWS))
    return df.repartition(tasks, key) if max(held, default=0) * tasks > 2 * sum(held) else df


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def sql_pick(values: list[str], index: str) -> str:
    return "(CASE " + " ".join(f"WHEN {index} = {i} THEN '{v}'" for i, v in enumerate(values)) \
        + " END)"


SEVEN = fv.DEPARTMENTS[:7]
_N = "CAST(substr(source, 4) AS INT)"


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as one-chunk records; review state from the labels."""
    docs = read_spread(spark, folder, "documents", "doc_id")
    labels = read(spark, folder, "labels").select("doc_id", "quality", "toxic")
    n = F.substring("source", 4, 10).cast("int")
    d = docs.join(labels, "doc_id", "left").withColumn("n", n)
    issued = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("n_chars") % 3650).cast("int"))
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"),
        F.col("doc_id").alias("version_id"), F.lit(0).alias("chunk_index"),
        F.col("source").alias("source_id"), "lang", "n_chars", "quality", "toxic",
        F.col("text").alias("content"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.split_part("text", F.lit("\n"), F.lit(2)).alias("section_heading"),
        F.split_part("text", F.lit("\n"), F.lit(3)).alias("subject"),
        F.concat(F.lit("GO/"), (F.lit(2015) + F.col("n") % 10).cast("string"), F.lit("/"),
                 F.col("doc_id").cast("string")).alias("go_number"),
        pick(SEVEN, F.col("n") % 7).alias("department_id"),
        F.when(F.col("n") < 12, "PUBLIC").when(F.col("n") < 16, "INTERNAL")
         .when(F.col("n") < 19, "RESTRICTED").otherwise("CONFIDENTIAL").alias("classification"),
        F.when(F.col("lang") == "en", "GO").when(F.col("lang") == "fr", "RULES")
         .when(F.col("lang") == "de", "CIRCULAR").otherwise("NOTIFICATION").alias("doc_type"),
        F.when(F.col("lang") == "es", "SUPERSEDED").otherwise("ACTIVE").alias("lifecycle_status"),
        F.when(F.col("toxic") == 1, "FLAGGED").when(F.col("quality") == 1, "REVIEWED")
         .otherwise("AUTO_APPROVED").alias("review_status"),
        F.when(F.col("quality") == 0, "UNVERIFIED").otherwise("VERIFIED").alias("provenance_status"),
        issued.alias("order_date"), F.date_add(issued, 30).alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/records/"),
                 F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_url"),
        (F.lit(1) + F.floor(F.col("n_chars") / 3000)).cast("int").alias("page_start"))


RECORDS_SQL = f"""records AS (
  SELECT d.doc_id AS chunk_id, d.doc_id AS document_id, d.source AS source_id, d.lang, d.n_chars,
         l.quality, l.toxic, d.text AS content, split_part(d.text, chr(10), 1) AS title,
         split_part(d.text, chr(10), 2) AS section_heading, split_part(d.text, chr(10), 3) AS subject,
         'GO/' || (2015 + {_N} % 10) || '/' || d.doc_id AS go_number,
         {sql_pick(SEVEN, f'({_N} % 7)')} AS department_id,
         CASE WHEN {_N} < 12 THEN 'PUBLIC' WHEN {_N} < 16 THEN 'INTERNAL'
              WHEN {_N} < 19 THEN 'RESTRICTED' ELSE 'CONFIDENTIAL' END AS classification,
         CASE d.lang WHEN 'en' THEN 'GO' WHEN 'fr' THEN 'RULES' WHEN 'de' THEN 'CIRCULAR'
              ELSE 'NOTIFICATION' END AS doc_type,
         CASE d.lang WHEN 'es' THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS lifecycle_status,
         CASE WHEN l.toxic = 1 THEN 'FLAGGED' WHEN l.quality = 1 THEN 'REVIEWED'
              ELSE 'AUTO_APPROVED' END AS review_status,
         CASE WHEN l.quality = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS provenance_status,
         DATE '2015-01-01' + CAST(d.n_chars % 3650 AS INT) AS order_date,
         DATE '2015-01-01' + CAST(d.n_chars % 3650 AS INT) + 30 AS effective_from,
         'https://' || d.source || '.example.org/records/' || d.doc_id || '.pdf' AS source_url,
         CAST(1 + floor(d.n_chars / 3000) AS INT) AS page_start
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def grants(spark: SparkSession, folder: str) -> DataFrame:
    """Access grants taken from usage: users who bought or signed up hold one.

    An event's user may read the record with the event's number; every third
    record names a class as well and every fourth has already run out.
    """
    e = read(spark, folder, "events")
    subject = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    return e.filter(F.col("event_type").isin("purchase", "signup")).select(
        subject.alias("subject_id"), F.col("event_id").alias("document_id"),
        F.when(F.col("event_id") % 3 == 0, "INTERNAL").alias("classification"),
        F.when(F.col("event_type") == "purchase", "READ").otherwise("EXPORT").alias("action"),
        F.when(F.col("event_id") % 4 == 0, F.col("ts")).otherwise(
            F.col("ts") + F.expr("INTERVAL 365 DAYS")).alias("expires_at"))


GRANTS_SQL = """grants AS (
  SELECT 'user' || user_id AS subject_id, event_id AS document_id,
         CASE event_type WHEN 'purchase' THEN 'READ' ELSE 'EXPORT' END AS action,
         CASE WHEN event_id % 4 = 0 THEN ts ELSE ts + INTERVAL 365 DAY END AS expires_at
  FROM events WHERE event_type IN ('purchase', 'signup'))"""


def notice_number(k: Column) -> Column:
    return F.concat(k.cast("string"), F.lit("/FIN/A"))


def order_notices(spark: SparkSession, folder: str) -> DataFrame:
    """A government order written from every row of ``orders``.

    Status F supersedes, O continues and P amends the order some places before it.
    """
    o = read_spread(spark, folder, "orders", "o_orderkey")
    cited = F.greatest(F.col("o_orderkey") - 1 - F.col("o_custkey") % 5, F.lit(0))
    number, old = notice_number(F.col("o_orderkey")), notice_number(cited)
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    old_day = F.date_format(F.date_sub("o_orderdate", 30), "dd/MM/yyyy")
    money = F.format_string("%.2f", "o_totalprice")
    share = (F.lit(10) + F.col("o_custkey") % 40).cast("string")
    body = (F.when(F.col("o_orderstatus") == "F", F.concat(
                F.lit("In supersession of Government Order No. "), old, F.lit(" dated "), old_day,
                F.lit(", a sum of Rs. "), money, F.lit(" is sanctioned from "), day, F.lit(".")))
             .when(F.col("o_orderstatus") == "O", F.concat(
                F.lit("In continuation of Government Order No. "), old, F.lit(" dated "), old_day,
                F.lit(", a sum of Rs. "), money, F.lit(" is continued from "), day, F.lit(".")))
             .otherwise(F.concat(
                F.lit("Order No. "), old, F.lit(" dated "), old_day,
                F.lit(" is hereby amended to allow Rs. "), money, F.lit("."))))
    paragraphs = [
        F.concat(F.lit("GOVERNMENT OF EXAMPLE\nOrder No: "), number, F.lit("\nDated: "), day),
        F.concat(F.lit("Subject: Sanction of Rs. "), money, F.lit(" under Rule "),
                 (F.col("o_custkey") % 90).cast("string"), F.lit(" for "), F.col("o_orderpriority"),
                 F.lit("\nSir,")),
        body,
        F.concat(F.lit("Provided that dearness allowance is paid at "), share, F.lit("% DA.")),
        F.lit("Schedule A: heads of account\nPage 1 of 2\nDepartmental Secretary to note."),
        F.concat(F.lit("(A. K. Officer "), F.lit("Name)\nPrincipal Secretary")),
    ]
    return o.select(
        F.col("o_orderkey").alias("notice_id"), number.alias("number"),
        F.col("o_orderdate").cast("date").alias("order_date"), "o_orderstatus",
        F.col("o_custkey").alias("authority"), pick(SEVEN, F.col("o_custkey") % 7)
        .alias("department_id"), F.concat_ws("\n\n", *paragraphs).alias("text"))


NOTICES_SQL = f"""notices AS (
  SELECT o_orderkey AS notice_id, o_orderkey || '/FIN/A' AS number,
         CAST(o_orderdate AS DATE) AS order_date, o_orderstatus, o_custkey AS authority,
         {sql_pick(SEVEN, '(o_custkey % 7)')} AS department_id,
         greatest(o_orderkey - 1 - o_custkey % 5, 0) || '/FIN/A' AS cited,
         CAST(o_orderdate AS DATE) - 30 AS cited_day,
         concat('GOVERNMENT OF EXAMPLE', chr(10), 'Order No: ', o_orderkey, '/FIN/A', chr(10),
                'Dated: ', strftime(o_orderdate, '%d/%m/%Y'), chr(10), chr(10),
                'Subject: Sanction of Rs. ', printf('%.2f', o_totalprice), ' under Rule ',
                o_custkey % 90, ' for ', o_orderpriority, chr(10), 'Sir,', chr(10), chr(10),
                CASE o_orderstatus
                 WHEN 'F' THEN concat('In supersession of Government Order No. ',
                   greatest(o_orderkey - 1 - o_custkey % 5, 0), '/FIN/A dated ',
                   strftime(o_orderdate - INTERVAL 30 DAY, '%d/%m/%Y'), ', a sum of Rs. ',
                   printf('%.2f', o_totalprice), ' is sanctioned from ',
                   strftime(o_orderdate, '%d/%m/%Y'), '.')
                 WHEN 'O' THEN concat('In continuation of Government Order No. ',
                   greatest(o_orderkey - 1 - o_custkey % 5, 0), '/FIN/A dated ',
                   strftime(o_orderdate - INTERVAL 30 DAY, '%d/%m/%Y'), ', a sum of Rs. ',
                   printf('%.2f', o_totalprice), ' is continued from ',
                   strftime(o_orderdate, '%d/%m/%Y'), '.')
                 ELSE concat('Order No. ', greatest(o_orderkey - 1 - o_custkey % 5, 0),
                   '/FIN/A dated ', strftime(o_orderdate - INTERVAL 30 DAY, '%d/%m/%Y'),
                   ' is hereby amended to allow Rs. ', printf('%.2f', o_totalprice), '.') END,
                chr(10), chr(10), 'Provided that dearness allowance is paid at ',
                10 + o_custkey % 40, '% DA.', chr(10), chr(10),
                'Schedule A: heads of account', chr(10), 'Page 1 of 2', chr(10),
                'Departmental Secretary to note.', chr(10), chr(10),
                '(A. K. Officer Name)', chr(10), 'Principal Secretary') AS text
  FROM orders)"""


def notice_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Order notices as retrieval chunks; open orders of urgent priority are internal."""
    n = order_notices(spark, folder)
    return n.select(
        F.col("notice_id").alias("chunk_id"), F.col("notice_id").alias("document_id"),
        F.col("notice_id").alias("version_id"), F.lit(0).alias("chunk_index"),
        F.col("text").alias("content"), F.concat(F.lit("Order "), "number").alias("title"),
        F.lit("Sanction").alias("section_heading"), F.lit("").alias("subject"),
        F.col("number").alias("go_number"), "department_id",
        F.when(F.col("o_orderstatus") == "P", "INTERNAL").otherwise("PUBLIC").alias("classification"),
        F.lit("GO").alias("doc_type"), F.lit("ACTIVE").alias("lifecycle_status"),
        F.lit("AUTO_APPROVED").alias("review_status"), "order_date",
        F.when(F.col("o_orderstatus") != "F", F.col("order_date")).alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"),
        F.concat(F.lit("https://orders.example.org/"), F.col("notice_id").cast("string"),
                 F.lit(".pdf")).alias("source_url"), F.lit(1).alias("page_start"),
        F.lit(1).alias("page_end"))


def turns(spark: SparkSession, folder: str) -> DataFrame:
    c = read_spread(spark, folder, "conversations", "conv_id")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn"),
                    F.concat_ws(":", F.col("conv_id").cast("string"),
                                F.col("turn").cast("string")).alias("turn_id"),
                    "role", F.col("text").alias("content"))
