"""What moves when an index or chunks are made."""

from pyspark.sql import functions as F

from lekhya.operators import chunking, postings


def test_words_of_an_index_are_not_dealt_out_again(spark, monkeypatch):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(postings, "stage", kept)
    df = spark.createDataFrame([(i, "aa bb aa", "g") for i in range(600)], "d int, t string, g string")
    index = postings.build(df, "d", F.col("t"), F.col("g"))
    assert plans[1].count("Exchange") == 1  # by block, for both groupings
    entries = index.postings.select("term", "block", F.inline("entries"))
    assert entries.count() == 1200 and {r["tf"] for r in entries.filter("term = 'aa'").collect()} == {2}


def test_scored_rows_are_not_dealt_out_by_question(spark):
    df = spark.createDataFrame([(i, "aa bb aa", "g") for i in range(900)], "d int, t string, g string")
    index = postings.build(df, "d", F.col("t"), F.col("g"))
    asked = spark.createDataFrame([(q, 0, "aa bb") for q in range(5)],
                                  "query_id int, audience int, text string")
    see = spark.createDataFrame([(0, "g")], "audience int, group string")
    beyond = postings.granted_beyond(index, see, see.select("audience", F.lit(0).alias("doc")))
    weighted = postings.weighted_terms(index, postings.question_terms(asked), see, beyond)
    blocks = asked.select("query_id").crossJoin(index.rows.select("block").distinct())
    rows = postings.scored(index, blocks, weighted, see, beyond)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "hashpartitioning(query_id" not in plan
    assert rows.count() == 5 * 900


def test_a_key_in_several_blocks_is_scored_over_all_of_them(spark):
    rows = [(i, "cc dd") for i in range(300)] + [(300, "aa bb")] * 2
    df = spark.createDataFrame(rows, "d int, t string").coalesce(1).sortWithinPartitions("d")
    twice = df.unionByName(df.filter("d = 300"))  # another partition, so another block
    index = postings.build(twice, "d", F.col("t"), F.lit("g"))
    asked = spark.createDataFrame([(1, 0, "aa")], "query_id int, audience int, text string")
    see = spark.createDataFrame([(0, "g")], "audience int, group string")
    hits = postings.search(index, asked, see, 10, first=9).collect()
    assert [(r.rank, r.doc) for r in hits] == [(1, 300)] and hits[0].score > 0


def test_pages_and_sections_are_not_broadcast(spark):
    rows = [("v", p, o, f"text {p} {o}", "PARAGRAPH", f"{p}:{o}") for p in range(1, 4) for o in range(3)]
    blocks = spark.createDataFrame(
        rows, "version_id string, page_number int, reading_order int, text string, "
        "block_type string, block_id string").withColumn("bbox", F.lit(None).cast("array<double>"))
    chunks = chunking.chunk_blocks(blocks)
    for df in (chunking._sections(blocks), chunks):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sum(r["units"] for r in chunks.collect()) == 9
