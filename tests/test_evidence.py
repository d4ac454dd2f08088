"""Evidence packets, answers and the streaming forms."""

from datetime import date, datetime

from pyspark.sql import functions as F

from lekhya import fixed_values as fv
from lekhya.operators import answers, evidence, understanding
from lekhya.operators.access import User
from lekhya.streaming import requests as streams

HIT = ("query_id string, rank int, chunk_id string, document_id string, version_id string, score double, bm25_score double, "
       "vector_score double, go_match boolean")
CHUNK = ("chunk_id string, document_id string, version_id string, chunk_index int, content string, title string, section_heading string, "
         "go_number string, department_id string, doc_type string, classification string, review_status string, order_date date, "
         "effective_from date, effective_to date, source_url string, page_start int, page_end int")


def chunk(name, content, go, classification="PUBLIC", effective=None):
    return (name, f"d{name}", f"v{name}", 0, content, f"Title {name}", "Sec", go, "FIN", "GO", classification, "REVIEWED", date(2020, 1, 2),
            effective, None, f"https://x/{name}.pdf", 3, 3)


def packet(spark, user=User()):
    chunks = spark.createDataFrame([
        chunk("a", "GOVERNMENT OF X\nDA rate is 38% DA from Rule 4", "1/2020"), chunk("b", "Now 42% DA applies", "2/2021", effective=date(2021, 4, 1)),
        chunk("c", "secret amendment", "3/2022", "CONFIDENTIAL", date(2022, 1, 1)), chunk("e", "weak", "9/2020")], CHUNK)
    hits = spark.createDataFrame([("q", 1, "a", "da", "va", .9, 1., 1., False), ("q", 2, "e", "de", "ve", .2, 1., 1., False)], HIT)
    edges = spark.createDataFrame([(1, "vb", "da", "1/2020", "AMENDS"), (2, "vc", None, "1/2020", "AMENDS"), (3, "va", None, "0/2019", "SUPERSEDES"),
                                   (4, "vb", None, "1/2020", "REFERS_TO")],
                                  "edge_id int, source_version_id string, target_document_id string, cited_order_number string, relation_type string")
    versions = chunks.select("version_id", "document_id", "go_number", "effective_from", F.lit("ACTIVE").alias("lifecycle_status"))
    return evidence.build_packet(hits, chunks, edges, versions, {"q": user})


def test_packet_and_answer(spark):
    p = packet(spark)
    rows = p.passages.orderBy("position").collect()
    # the weak hit is dropped, the public amendment is added, the confidential one is not
    assert [(r["chunk_id"], r["currency_status"], r["has_conflict"]) for r in rows] == [("a", "AMENDS", False), ("b", "CURRENT", True)]
    assert abs(rows[1]["score"] - .9 * .95) < 1e-9 and rows[0]["is_superseding"] and rows[1]["is_amending"]
    assert {(r["amending_doc"], r["relation_type"]) for r in p.amendments.collect()} == {("db", "AMENDS"), ("dc", "AMENDS")}
    kinds = {r["conflict_type"]: r["notes"] for r in p.conflicts.collect()}
    assert kinds["SUPERSEDES"] == "This order supersedes prior order 0/2019."
    assert kinds["RATE_DISCREPANCY"] == "Discrepancy detected: 1/2020 states 38% while 2/2021 states 42%."
    s = p.summary.first()
    assert s["currency_status"] == "AMENDED" and s["currency_banner"] == (
        "Approved amendment/supersession by GO 2/2021 effective 2021-04-01.; Approved amendment/supersession by GO 3/2022 effective 2022-01-01.")
    asked = understanding.parse_questions(spark.createDataFrame([("q", "da rate"), ("none", "other"), ("r", "am i eligible")], "query_id string, text string"))
    got = {r["query_id"]: r for r in answers.respond(asked, p).collect()}
    assert got["q"]["outcome"] == "answered" and got["q"]["validation_passed"]
    assert "Under order 1/2020 (superseding order): DA rate is 38% DA from Rule 4 [1]" in got["q"]["answer"]
    assert got["none"]["answer"] == fv.REFUSAL and got["none"]["outcome"] == "abstained" and len(got["none"]["search_suggestions"]) == 4
    cites = evidence.citations(p).orderBy("citation").collect()
    assert [(c["citation"], c["pdf_page_link"]) for c in cites] == [(1, "https://x/a.pdf#page=3"), (2, "https://x/b.pdf#page=3")]


def test_confidential_amendment_needs_an_admin(spark):
    rows = packet(spark, User("x", ("ADMIN",))).passages.orderBy("position").collect()
    assert [r["chunk_id"] for r in rows] == ["a", "b", "c"]


def test_unsupported_claim_is_reported(spark):
    a = spark.createDataFrame([("q", "Pay Rs. 77 by Governor")], "query_id string, answer string")
    c = spark.createDataFrame([("q", "pay rs. 50")], "query_id string, corpus string")
    r = answers.validate(a, c).first()
    assert not r["validation_passed"] and len(r["validation_errors"]) == 2


def test_streams(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(i, "u", base.replace(second=i // 20, microsecond=(i % 20) * 1000), f"k{i % 3}") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, user string, ts timestamp, key string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(stream, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option(
            "checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    limited = run(streams.rate_limit_stream(source, "user", "id", "ts"), "limited")
    assert len(limited) == 100 and 70 <= sum(r["allowed"] for r in limited) <= 75
    assert len(run(streams.first_calls_stream(source, ["key"], "ts"), "firsts")) == 3


def test_gold_questions_are_scored(spark):
    from lekhya.operators import evaluation, metrics, retrieval
    from lekhya.operators.retrieval import Question
    p = packet(spark)
    records = p.passages.select("document_id", "go_number", "page_start", "department_id", F.lit("en").alias("lang"))
    gold = evaluation.gold_questions(records)
    assert gold.count() == 3
    mine = gold.filter("query_id = 'known-da'").withColumn("query_id", F.lit("q")).unionByName(gold.filter("category = 'no_answer'"))
    asked = understanding.parse_questions(mine.select("query_id", "text"))
    out = evaluation.evaluate(mine, p.passages, evidence.citations(p), answers.respond(asked, p))
    got = metrics.pilot_gate(out).first()
    assert (got["recall_at_k"], got["page_precision"], got["refusal_rate"], got["leaks"], got["passed"]) == (1., 1., 1., 0, True)
    assert {(r["level"], r["accuracy"]) for r in metrics.scorecard(out).collect()} == {("overall", 1.), ("department", 1.), ("language", 1.)}
    assert all(q.refused for q in retrieval.parse(spark, [Question("x", "Metro rail fares under FIN")]))
    rows = answers.provenance_rows(answers.respond(asked, p), p, F.current_timestamp()).collect()
    assert {r["trace_id"]: r["index_version_ids"] for r in rows}["q"] == ["va", "vb"]


def test_tables_and_cited_source(spark, tmp_path):
    from lekhya import schemas
    from lekhya.operators import catalogue
    schemas.append_table(spark.createDataFrame([("t", 5)], "trace_id string, rating long"), str(tmp_path), "feedback_records")
    row = schemas.read_table(spark, str(tmp_path), "feedback_records").first()
    assert (row["trace_id"], row["rating"], row["comment"]) == ("t", 5, None)
    assert all(spark.createDataFrame([], ddl).columns for ddl in schemas.TABLES.values())
    blocks = spark.range(30).select(F.lit("v").alias("version_id"), F.lit(1).alias("page_number"), F.col("id").alias("reading_order"), F.col("id").alias("block_id"))
    cited = spark.createDataFrame([("v", 1)], "version_id string, page_number int")
    assert catalogue.open_cited_source(blocks, cited).count() == 20
    assert len(spark.range(1).select(catalogue.config_hash({"b": "1", "a": "2"})).first()[0]) == 64
