"""A packet reads only the texts that can touch its passages, and loses no edge by it."""

from lekhya.operators import precedents
from lekhya.plans import retrieval_queries


def notices(spark):
    body = "In supersession of Government Order No. {} dated 01/02/2019, paid."
    return spark.createDataFrame(
        [(1, "1/FIN/A", body.format("9/FIN/A")), (2, "2/FIN/A", body.format("1/FIN/A")),
         (3, "3/FIN/A", body.format("21/FIN/A")), (4, "4/F.N/A", body.format("4/FxN/A")),
         (5, "5/FIN/A", None), (6, None, body.format("4/F.N/A")), (1, "1b/FIN/A", "none"),
         (7, "7/FIN/A", body.format("1b/FIN/A")), (8, "8/FIN/A", body.format("5/FIN/A"))],
        "notice_id long, number string, text string")


def passages(spark):
    return spark.createDataFrame(
        [("q", 1, 1, 1, "1/FIN/A"), ("r", 1, 4, 4, "4/F.N/A"), ("s", 1, 6, 6, None)],
        "query_id string, position int, document_id long, version_id long, go_number string")


def test_texts_around_passages(spark):
    n = notices(spark)
    found = precedents.texts_around(n, "notice_id", n, passages(spark)).collect()
    # 21/FIN/A holds 1/FIN/A, so 3 is read as well; a dot stands for itself
    assert sorted(r["notice_id"] for r in found if r["text"]) == [1, 1, 2, 3, 4, 6, 7]
    assert len(found) == 9
    none = precedents.texts_around(n, "notice_id", n, passages(spark).limit(0)).collect()
    assert len(none) == 9 and not any(r["text"] for r in none)


def test_edges_around_passages_are_those_of_all_edges(spark, monkeypatch):
    n = notices(spark)
    monkeypatch.setattr(retrieval_queries, "order_notices", lambda *_: n)
    some = retrieval_queries.notice_edges(spark, "", passages(spark)).collect()
    every = retrieval_queries.notice_edges(spark, "").collect()
    assert set(some) < set(every)
    for e in set(every) - set(some):
        assert e["source_version_id"] not in (1, 4, 6)
        assert e["target_document_id"] not in (1, 4, 6)
        assert e["cited_order_number"] not in ("1/FIN/A", "4/F.N/A")
