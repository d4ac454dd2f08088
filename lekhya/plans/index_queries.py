"""Search of a question table over stored postings, and its totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lekhya.operators import access, postings
from lekhya.operators.access import User
from lekhya.plans.corpus import GRANTS_SQL, NOW, RECORDS_SQL, grants, read, records
from lekhya.plans.registry import query
from lekhya.plans.retrieval_queries import _OFFICER_SEES, _TOKENS, OFFICER

USERS = [User(), OFFICER, User("user3", ("CLERK",), "AUDIT_DIRECTORATE", "INTERNAL"),
         User("root", ("ADMIN",), None, "ADMIN")]


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """A question per benchmark item, put by the users in turn."""
    return read(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), (F.col("item_id") % len(USERS)).alias("audience"),
        "text")


def indexed(spark: SparkSession, folder: str) -> tuple[postings.Index, DataFrame, DataFrame]:
    """The index of all records, what each user's groups are and what grants add."""
    table = records(spark, folder)
    both = F.concat_ws("|", "classification", "department_id")
    index = postings.build(table, "document_id", F.col("content"), both)
    groups = index.rows.select("group").distinct().select("group", F.split("group", "\\|").alias("g"))
    seen = [groups.filter(access.visible(u, F.col("g")[0], F.col("g")[1])).select(
        F.lit(i).cast("long").alias("audience"), "group") for i, u in enumerate(USERS)]
    held = [access.document_grants(grants(spark, folder), u, NOW).select(
        F.lit(i).cast("long").alias("audience"), F.col("document_id").alias("doc"))
        for i, u in enumerate(USERS)]
    return (index, reduce(DataFrame.unionByName, seen), reduce(DataFrame.unionByName, held))


def _held(subjects: list[str]) -> str:
    names = ", ".join(f"'{s}'" for s in subjects)
    return (f"document_id IN (SELECT document_id FROM grants WHERE subject_id IN ({names}) "
            "AND action IN ('READ', 'ADMIN') AND expires_at > TIMESTAMP '2024-01-20')")


MATCHES_SQL = f"""{RECORDS_SQL}, {GRANTS_SQL},
    t AS (SELECT document_id AS doc, {_TOKENS.format('content')} AS toks FROM records),
    q AS (SELECT item_id AS query_id, item_id % 4 AS audience,
                 unnest({_TOKENS.format('text')}) AS term FROM benchmark),
    qt AS (SELECT query_id, audience, term, count(*) AS m FROM q GROUP BY ALL),
    seen AS (SELECT audience, document_id AS doc FROM records, range(4) AS a(audience)
             WHERE CASE audience
               WHEN 0 THEN classification = 'PUBLIC' OR {_held(USERS[0].subjects)}
               WHEN 1 THEN {_OFFICER_SEES}
               WHEN 2 THEN classification = 'PUBLIC' OR {_held(USERS[2].subjects)}
                 OR classification = 'INTERNAL' AND department_id = 'AUDIT_DIRECTORATE'
               ELSE true END),
    tf AS (SELECT doc, dl, term, count(*) AS tf
           FROM (SELECT doc, len(toks) AS dl, unnest(toks) AS term FROM t)
           WHERE term IN (SELECT term FROM qt) GROUP BY ALL)"""


@query("question_table_search", f"""WITH {MATCHES_SQL},
    stats AS (SELECT audience, count(*) AS n, avg(len(toks)) AS average
              FROM seen JOIN t USING (doc) GROUP BY audience),
    df AS (SELECT audience, term, count(*) AS df FROM tf JOIN seen USING (doc) GROUP BY ALL),
    s AS (SELECT query_id, doc, round(sum(m * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
                 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(average, 1.0)))), 6) AS score
          FROM qt JOIN tf USING (term) JOIN seen USING (audience, doc) JOIN df USING (audience, term)
          JOIN stats USING (audience) GROUP BY query_id, doc),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s)
    SELECT query_id, CAST(rank AS INT) AS rank, doc AS document_id, score FROM r WHERE rank <= 10""")
def question_table_search(spark: SparkSession, folder: str) -> DataFrame:
    index, audiences, held = indexed(spark, folder)
    hits = postings.search(index, asked(spark, folder), audiences, 10, held)
    return hits.select("query_id", "rank", F.col("doc").alias("document_id"), "score")


@query("question_table_totals", f"""WITH {MATCHES_SQL}
    SELECT query_id, count(DISTINCT doc) AS total
    FROM qt JOIN tf USING (term) JOIN seen USING (audience, doc) GROUP BY query_id""")
def question_table_totals(spark: SparkSession, folder: str) -> DataFrame:
    index, audiences, held = indexed(spark, folder)
    return postings.totals(index, asked(spark, folder), audiences, held)
