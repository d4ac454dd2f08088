import random

from pyspark.sql import functions as F

from lekhya.llm import mixing


def levels(sizes, weights, budget, epochs):
    """Targets by bisection on the common level."""
    low, high = 0.0, max(epochs * s / w for s, w in zip(sizes, weights)) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(
            min(epochs * s, w * mid) for s, w in zip(sizes, weights)) < budget else (low, mid)
    return [min(epochs * s, w * low) for s, w in zip(sizes, weights)]


def test_targets_and_taken(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "b", "c", None, "d", "e" * (i % 40 == 0) or "a"]),
             " ".join("w" * rng.randrange(1, 90)), rng.randrange(1, 90), 1.5) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size long, target double")
    sizes = mixing.source_sizes(df)
    total = sizes.agg(F.sum("source_size")).first()[0]
    weights = mixing.cyclic_weights(sizes, [3, 1, 2])
    got = mixing.mix(df, weights, 1.5 * total).collect()
    assert len(got) == 900
    per = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        size, target, taken = per.get(r.source, (r.source_size, r.target, 0))
        per[r.source] = (r.source_size, r.target, taken + r.taken)
    names = sorted((k for k in per if k), key=str) + [None]
    want = levels([per[k][0] for k in names], [[3, 1, 2][i % 3] for i in range(len(names))],
                  1.5 * total, 2.0)
    for name, target in zip(names, want):
        assert abs(per[name][1] - target) < 1e-3
        assert per[name][2] == int(per[name][1] + 0.5)
    again = mixing.mix(df.repartition(7), weights, 1.5 * total)
    assert {r.doc_id: r.taken for r in again.collect()} == {r.doc_id: r.taken for r in got}


def test_repetitions(spark):
    df = spark.createDataFrame(
        [(1, " one\ttwo  three four", "en", "s", 20)] * 2 + [(2, None, "en", "s", None),
                                                            (3, "x y", "en", None, 3)],
        "doc_id long, text string, lang string, source string, n_chars long") \
        .withColumn("size", mixing.word_count(F.col("text")))
    weights = spark.createDataFrame([("s", 8, 1.0), (None, 2, 0.0)],
                                    "_source string, source_size long, weight double")
    mixed = mixing.mix(df, weights, 11.0)
    rows = mixing.repeated(mixed, ["doc_id", "text", "lang", "source", "n_chars"]).collect()
    # 11 of 4 + 4 + 0 words: two repetitions are due in part, and half a document decides
    assert sum(len((r.text or "").split()) for r in rows) == 12
    assert {(r.doc_id, r.text, r.n_chars) for r in rows} == {
        (1, " one\ttwo  three four", 20), (2, None, None)}
    empty = mixing.mix(df.limit(0), weights.limit(0), 0.0)
    assert empty.count() == 0


def test_all_sources_clamped(spark):
    weights = spark.createDataFrame([("a", 5, 1.0), ("b", 7, 2.0)],
                                    "_source string, source_size long, weight double")
    got = {r["_source"]: r.target for r in mixing.water_fill(weights, 1000.0).collect()}
    assert got == {"a": 10.0, "b": 14.0}


def test_documents_stay_whole(spark):
    text = " ".join(["w"] * 100)
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string") \
        .withColumn("size", mixing.word_count(F.col("text")))
    weights = spark.createDataFrame([("s", 100, 1.0)],
                                    "_source string, source_size long, weight double")
    for budget, times in ((40.0, 0), (60.0, 1), (140.0, 1), (160.0, 2)):
        got = mixing.repeated(mixing.mix(df, weights, budget), ["doc_id", "text"]).collect()
        assert [r.text for r in got] == [text] * times
