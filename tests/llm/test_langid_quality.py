import numpy as np
import pytest
from pyspark.sql import functions as F

from lekhya.llm import langid, quality
from lekhya.llm.sampling import bounded_sample

SF = "/root/testdata/sf0.1"


def test_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.filter("doc_id % 2 = 0"), "doc_id", sample=1500)
    found = langid.identify(docs.filter("doc_id % 2 = 1"), model, F.col("text"))
    right = found.agg(F.avg((F.col("language") == F.col("lang")).cast("int")),
                      F.avg(F.col("identified").cast("int"))).first()
    assert right[0] >= 0.97 and right[1] >= 0.99


def test_evidence_is_fused(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, "doc_id", sample=1500)
    texts = {r.lang: r.text for r in docs.filter("n_chars > 900").groupBy("lang").agg(
        F.min("text").alias("text")).collect()}
    rows = [(i, texts["fr"], "fr", f"h{i % 4}", "fr", 1.0) for i in range(60)]
    rows += [(100 + i, texts["de"], "de", "g", "de", 1.0) for i in range(60)]
    # words that say little; declaration, host and suffix decide
    rows += [(200, "x 7", "FR-ca", None, None, 1.0), (201, "x 7", None, "h1", "fr", 1.0),
             (202, "x 7", None, "new", "de", 1.0), (203, None, "fr", "h1", "fr", 1.0),
             (204, " \n", None, None, None, 1.0), (205, texts["de"] * 40, "klingon", "h1", "fr", 1.0)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, "
                                     "suffix string, confidence double")
    got = {r.id: r for r in langid.identify(df, model, F.col("text"), F.col("declared"),
                                            F.col("host"), F.col("suffix")).collect()}
    assert all(got[i].language == "fr" for i in range(60))
    assert (got[200].language, got[201].language, got[202].language) == ("fr", "fr", "de")
    assert not got[203].identified and got[203].language is None and not got[204].identified
    assert got[205].text_language == "de" and got[205].language == "de"
    assert langid.identify(df.limit(0), model, F.col("text")).count() == 0


def test_rare_languages_are_fitted(spark):
    words = {"aa": "kala mata pono", "bb": "the which there", "cc": "zwyx qvrr hjkk"}
    rows = [(i, f"{words[k]} {i} {words[k]}", k) for i in range(6000) for k in [["aa", "bb"][i % 2]]]
    rows += [(7000 + i, f"{words['cc']} {words['cc']} {i}", "cc") for i in range(3)]
    rows += [(None, f"unkeyed {i % 2} furlongs", "dd") for i in range(900)]  # one key, two texts
    rows += [(8000, "no label", " "), (8001, " ", "ee"), (8002, None, "ff")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, "doc_id", sample=40)
    assert model.languages == ("aa", "bb", "cc", "dd")
    drawn = {r["language"]: r["count"] for r in langid.language_sample(
        df, "doc_id", "text", "lang", 40).groupBy("language").count().collect()}
    assert drawn["cc"] == 3 and drawn["dd"] == 2
    assert 15 < drawn["aa"] < 80 and 15 < drawn["bb"] < 80
    few = df.filter("lang = 'cc'").unionByName(df.filter("lang = 'bb' AND doc_id < 600"))
    found = langid.identify(few, model, F.col("text"), F.col("lang")).collect()
    assert all(r.language == r.lang and r.identified for r in found)


def test_held_out_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"), sample=6000)
    scored = (quality.classify(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id")
              .select("quality", "good", "content_score").collect())
    kept = np.mean([r.good for r in scored if r.quality == 1])
    gone = np.mean([not r.good for r in scored if r.quality == 0])
    assert kept >= 0.98 and gone >= 0.9


def test_labels_are_kept_in_a_large_table(spark):
    docs = spark.range(20_000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 10 = 0 THEN concat('%$# @@ ', id, ' ##') ELSE "
        "concat('plain words of a text ', id) END AS text", "'s' AS source", "'en' AS lang",
        "30L AS n_chars")
    labels = spark.range(0, 20_000, 100).selectExpr("id + (id div 100) % 2 AS doc_id") \
        .selectExpr("doc_id", "int(doc_id % 10 <> 0) AS quality")
    model = quality.fit(docs, labels, sample=400)  # labels fall on 1 of 100 documents
    assert model.labelled == (100, 100)
    right = quality.classify(docs, model).agg(F.avg(F.expr("int(good = (doc_id % 10 <> 0))")))
    assert right.first()[0] == 1
    most, sizes = quality.drawn(docs, docs.selectExpr("doc_id", "int(doc_id % 10 <> 0) AS quality"),
                                "doc_id", 400)
    assert sizes == {0: 2000, 1: 18_000}
    assert all(50 < r["count"] <= 200 for r in most.groupBy("label").count().collect())


def test_a_class_without_labels_is_an_error(spark, tmp_path):
    from lekhya.llm.queries import judged

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.createDataFrame([(r.doc_id, 1) for r in docs.limit(50).collect()],
                          "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.raises(ValueError, match="0 and 50"):
        judged(spark, docs, str(tmp_path))
    assert judged(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_classes_count_by_their_share():
    rng = np.random.default_rng(5)
    y = np.arange(4000) % 2
    content = (y + rng.normal(0, 1, 4000))[:, None]
    model = quality.co_train(content, content, y, share=0.9)
    p = model.scores(content, content)[:, 2]
    assert abs(0.1 * p[y == 0].mean() + 0.9 * p[y == 1].mean() - 0.9) < 0.02


def test_views_teach_each_other():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 3000)
    content = np.stack([y + rng.normal(0, .5, 3000), rng.normal(size=3000)], 1)
    meta = np.stack([y + rng.normal(0, .7, 3000), rng.normal(size=3000)], 1)
    label = np.where(np.arange(3000) < 60, y, -1)
    model = quality.co_train(content, meta, label)
    p = model.scores(content, meta)
    right = ((p >= .5) == y[:, None])[60:].mean(0)
    assert right[2] > max(right[0], right[1]) - 0.01 and right[2] > 0.88
    assert abs(p[:, 2].mean() - y.mean()) < 0.1


def test_quality_of_unusual_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, good string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "a " * 300_000, "en", "s", 9, "x"),
            (3, "a " * 300_000, "en", "s", 9, "x"), (4, "Good text.", "en", "s", 10, "x")]
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(4, 1, 0), (2, 0, 0), (3, None, 0), (3, 5, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.classify(df, quality.fit(df, labels)).collect()
    assert len(got) == 5 and all(0 <= r.quality_score <= 1 for r in got)
    none = quality.fit(df, labels.limit(0))
    assert quality.classify(df.limit(0), none).count() == 0
    assert len({round(r.quality_score, 6) for r in quality.classify(df, none).collect()}) == 1


def test_sample_is_bounded_and_stable(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    a = {r.k for r in bounded_sample(df, "k", 500).collect()}
    assert 350 < len(a) < 650 and a == {r.k for r in bounded_sample(df.repartition(9), "k", 500).collect()}
    assert bounded_sample(df, "k", 30_000).count() == 20_000
