import random

import numpy as np
from pyspark.sql import functions as F

from lekhya.llm import ann, fingerprint
from tests.llm import brute


def exact(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v)
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 50 == 0:
            scored = sorted((-float(v @ u / np.sqrt(v @ v) / np.sqrt(u @ u)), i)
                            for i, u in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_exhaustive_on_small_tables(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(150 * 50, rows[7][1])]
    rows += [(9001, None), (9002, [0.0] * 8), (9003, [1.0] * 7 + [None]), (9050, [float("nan")] * 8),
             (9100, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows],
                               "vec_id long, embedding array<float>, rank int, score double")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in ann.search(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = exact(rows)
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == [1, 2, 3, 4, 5]
        assert np.allclose([x[2] for x in found], [s for _, s in want[q]], atol=1e-12)
        if q == 7500:
            assert [x[1] for x in found] == [7, 1000, 1001, 1002, 1003]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id in (0, 1, 2)")
    assert ann.search(few, few.filter("vec_id = 0")).count() == 2


def test_recall_when_cells_are_left_out(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = exact(rows)
    got = {}
    for r in ann.search(vectors, vectors.filter("vec_id % 50 = 0"), least=10, chunk=700).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    share = np.mean([len(got[q] & {i for i, _ in hits}) / len(hits) for q, hits in want.items()])
    assert share >= 0.9


def test_cells_come_in_order_of_summed_distance():
    rng = np.random.default_rng(2)
    d1, d2, counts = rng.random(9), rng.random(7), rng.integers(0, 5, (9, 7))
    cells = ann.visits(d1, d2, counts, 10 ** 9)
    sums = [d1[i] + d2[j] for i, j in cells]
    assert sums == sorted(sums) and len(set(cells)) == 63
    part = ann.visits(d1, d2, counts, 20)
    assert part == cells[:len(part)]
    assert sum(counts[c] for c in part[:-1]) < 20 <= sum(counts[c] for c in part)


def test_likeness_is_near_the_true_similarity(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows, true = [], {}
    for i in range(150):
        a = [rng.choice(words) for _ in range(rng.choice([3, 8, 20, 60, 300, 1500]))]
        b = list(a)
        for _ in range(rng.randrange(0, 1 + len(a) // 5)):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((i, " ".join(a), "\n ".join(b)))
        x, y = brute.shingle_set(rows[-1][1], 5), brute.shingle_set(rows[-1][2], 5)
        true[i] = len(x & y) / len(x | y)
    df = spark.createDataFrame(rows, "id long, a string, b string")
    for c in "ab":
        df = fingerprint.with_fingerprint(df, c, "f" + c)
    got = {r.id: r for r in df.select("*", fingerprint.likeness(F.col("fa"), F.col("fb"))
                                      .alias("near")).collect()}
    errors = np.array([got[i].near - true[i] for i in true])
    assert abs(errors.mean()) < 0.015 and np.abs(errors).max() < 0.2
    assert all(len(r.fa) == fingerprint.BINS for r in got.values())
    assert all(got[i].near == 1.0 for i in true if rows[i][1].split() == rows[i][2].split())


def test_empty_texts_and_probing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "one")], "id long, t string")
    got = {r.id: r.f for r in fingerprint.with_fingerprint(df, "t", "f").collect()}
    assert got[1] == got[2] == got[3] == "" and len(got[4]) == fingerprint.BINS
    assert fingerprint.with_fingerprint(df.limit(0), "t", "f").count() == 0
    for order in fingerprint.probe_orders():
        assert sorted(order) == list(range(fingerprint.BINS))


def test_next_in_descending_order(spark):
    rng = random.Random(6)
    ids = rng.sample(range(-500, 10 ** 12), 300) + [5, 6, 7]
    rows = [(i, f"t{i}", "x") for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string, next_x string").repartition(5)
    order = sorted(ids, reverse=True)
    want = {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}
    for segments in (1, 3, 40, None):
        got = fingerprint.with_next(df, "doc_id", ["text"], "next_", segments)
        assert {r.doc_id: r.next_text for r in got.collect()} == want
        assert got.count() == len(ids)
    one = fingerprint.with_next(df.filter("doc_id = 5"), "doc_id", ["text"], "next_")
    assert [r.next_text for r in one.collect()] == ["t5"]
    assert fingerprint.with_next(df.limit(0), "doc_id", ["text"], "next_").count() == 0


def test_edited_text(spark):
    rows = [("abcdé", "xy\U0001f600zw"), ("ab", ""), ("", "q"), ("abcd", "z"), ("a", "b")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r.e for r in df.select(fingerprint.edited(F.col("a"), F.col("b")).alias("e")).collect()]
    assert got == ["abcxy", "a", "", "abz", "a"]
