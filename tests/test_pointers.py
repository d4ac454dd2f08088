"""Pointer doubling: chains, cycles, hot targets, replay windows without a pause, pagination."""

import random

import pytest
from pyspark.sql import functions as F

from lekhya.operators import pointers, requests
from lekhya.sources import listing


def walk(links, starts):
    seen = set()
    for node in starts:
        while node is not None and node not in seen:
            seen.add(node)
            node = links.get(node)
    return seen


@pytest.mark.parametrize("hot", [False, True])
def test_reached_equals_a_walk(spark, monkeypatch, hot):
    if hot:  # every node that ten pointers name is looked up in the broadcast table
        monkeypatch.setattr(pointers, "HOT_ROWS", 10)
        monkeypatch.setattr(pointers, "HOT_NODES", 40)
    rng = random.Random(3)
    links = {i: i + 1 for i in range(120)} | {120: 90}
    links |= {i: rng.choice([5, 7, rng.randrange(400)]) for i in range(200, 400)}
    starts = [0, 210, 211, 399, 777]
    df = spark.createDataFrame([*links.items(), (500, None), (None, 3)], "node int, next int")
    got = pointers.reached(df, spark.createDataFrame([(s,) for s in [*starts, None]], "node int"))
    assert sorted(r["node"] for r in got.collect()) == sorted(walk(links, starts))


def test_reached_of_nothing(spark):
    none = spark.createDataFrame([], "node int, next int")
    assert pointers.reached(none, none.select("node")).count() == 0
    assert pointers.reached(none, spark.createDataFrame([(1,)], "node int")).count() == 1


def test_a_long_chain_takes_logarithmically_many_rounds(spark, monkeypatch):
    rounds, once = [], pointers.doubled
    monkeypatch.setattr(pointers, "doubled", lambda links: rounds.append(1) or once(links))
    links = spark.range(9_999).select(F.col("id").alias("node"), (F.col("id") + 1).alias("next"))
    got = pointers.reached(links, spark.range(1).select(F.col("id").alias("node")))
    assert got.count() == 10_000 and len(rounds) == 14


def test_replays_of_one_key_without_a_pause(spark):
    rng = random.Random(8)
    times = sorted(rng.choice([1_700_000_000 + i // 3, 1_700_000_000 + i // 2]) for i in range(900))
    calls = [(i, "hot" if i % 4 else None, t, rng.choice(["a", "b", None])) for i, t in enumerate(times)]
    df = spark.createDataFrame([*calls, (9000, "hot", None, "a")], "id int, k string, t long, h string")
    got = requests.idempotent_replays(df.withColumn("ts", F.timestamp_seconds("t")), ["k"], "id",
                                      "ts", "h", 7)
    want, state = {9000: "executed"}, {}
    for i, k, t, h in calls:
        if k not in state or t >= state[k][0] + 7:
            state[k] = (t, h)
            want[i] = "executed"
        else:
            want[i] = "replayed" if state[k][1] == h else "conflict"
    rows = got.collect()
    assert len(rows) == 901 and {r["id"]: r["outcome"] for r in rows} == want


def test_pages_with_several_next_links_are_all_followed(spark):
    def page(i, to):
        return f"https://gov.in/docs/{i}", f"<a href='{to}'>Next</a>"
    pages = [page(i, i + 1) for i in range(20)] + [page(3, 50), page(50, 51), page(51, 3), page(7, 5),
                                                   page(9, "https://evil.org/docs/1")]
    got = listing.follow_pages(spark.createDataFrame(pages, "url string, html string"),
                               spark.createDataFrame([("https://gov.in/docs/2",)], "url string"),
                               ["gov.in"], ["/docs"])
    assert sorted(int(r["url"].split("/")[-1]) for r in got.collect()) == [*range(2, 21), 50, 51]
