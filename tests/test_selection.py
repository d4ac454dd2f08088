"""Deep pages against a plain sort."""

import random

import pytest

from lekhya.operators import selection


def plain(rows, order):
    for at, down in reversed(order):
        rows = sorted(rows, key=lambda r: (r[at] is not None, r[at] or 0), reverse=down)
    return rows


@pytest.mark.parametrize("first_down,last_down", [(False, False), (True, False), (True, True)])
def test_deep_pages(spark, monkeypatch, first_down, last_down):
    monkeypatch.setattr(selection, "SORTED", 50)
    monkeypatch.setattr(selection, "BOUNDS", 8)
    rng = random.Random(4)
    # a third of the rows share a value, some have none, and ids come in no order
    rows = [(rng.choice([7, None, rng.randrange(40)]) if i % 3 else 7, i * 31 % 997)
            for i in range(997)]
    df = spark.createDataFrame(rows, "v int, id int").repartition(4)
    order = [("v", first_down), ("id", last_down)]
    want = plain(rows, [(0, first_down), (1, last_down)])
    for offset, limit in [(0, 5), (1, 3), (333, 20), (600, 150), (990, 50), (997, 5)]:
        sizes = []
        got = selection.deep_page(df, order, limit, offset, "total", sizes).collect()
        assert [tuple(r[:2]) for r in got] == want[offset:offset + limit]
        assert {r["total"] for r in got} <= {997} and all(s <= 50 for s in sizes)


def test_texts_equal_rows_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(selection, "SORTED", 3)
    df = spark.createDataFrame([("a",)] * 9 + [("é",), ("z",), (None,)], "t string")
    got = [r[0] for r in selection.deep_page(df, [("t", False)], 4, 8).collect()]
    assert got == ["a", "a", "z", "é"]
    assert selection.deep_page(df.limit(0), [("t", True)], 4, 0).collect() == []
