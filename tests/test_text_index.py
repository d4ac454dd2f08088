"""Searches by trigrams against a scan."""

import random

from lekhya.operators import catalogue, text_index


def test_search_equals_the_scan(spark, monkeypatch):
    rng = random.Random(8)
    words = ["Pay", "order", "über", "वेतन", "50%", "a_b", "REVISION", "aaa", "x"]
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choices(words, k=rng.randrange(5))))
            for i in range(400)] + [(9, "Needle in one row"), (9, "needle again"), (9, "needle again")]
    df = spark.createDataFrame(rows, "id int, title string")
    index = text_index.build(df, ["id"], "title", 8)

    def same(text):
        got = sorted(map(str, text_index.search(index, text).collect()))
        assert got == sorted(map(str, df.filter(catalogue.contains_any(text, ["title"])).collect()))
        return len(got)

    counts = {t: same(t) for t in ["needle", "PAY ORDER", "वेतन", "Über", "aaaa", "50%", "a_b x", "x", ""]}
    assert counts["needle"] == 3 and counts["aaaa"] == 0 and min(counts["वेतन"], counts["x"]) > 50
    # one group of some fifty is read
    assert text_index.candidates(index, "needle").count() == 1
    assert index.rows.select("_group").distinct().count() > 40
    monkeypatch.setattr(text_index, "LISTED", 3)
    assert same("pay") == len([t for _, t in rows if t and "pay" in t.lower()])


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, title string")
    assert text_index.search(text_index.build(df, ["id"], "title"), "pay").count() == 0
