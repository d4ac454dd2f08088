"""Search over stored postings against plain evaluation."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lekhya.operators import postings


def words(text):
    return [t for t in re.findall(r"[a-z0-9]+", (text or "").lower()) if len(t) > 1]


def plain(docs, questions, sees, held, k):
    """docs: {doc: (group, text)}; questions: {id: (audience, text)}"""
    out = {}
    for q, (a, text) in questions.items():
        seen = {d: Counter(words(t)) for d, (g, t) in docs.items() if (a, g) in sees or (a, d) in held}
        if not seen:
            continue
        average = sum(sum(c.values()) for c in seen.values()) / len(seen)
        rows = []
        for d, c in seen.items():
            score, dl = 0.0, sum(c.values())
            for term, m in Counter(words(text)).items():
                if term in c:
                    df = sum(term in o for o in seen.values())
                    score += m * math.log(1 + (len(seen) - df + 0.5) / (df + 0.5)) * c[term] * 2.5 / (
                        c[term] + 1.5 * (0.25 + 0.75 * dl / max(average, 1.0)))
            if any(term in c for term in words(text)):
                rows.append((-round(score, 6), d))
        out[q] = [(d, -s) for s, d in sorted(rows)[:k]]
    return out


def test_against_plain_evaluation(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = {d: (rng.choice(["a", "b", "", "c"]), " ".join(
        rng.choice(vocabulary[:rng.choice([3, 60])]) for _ in range(rng.randrange(0, 30))))
        for d in range(700)}
    docs[700], docs[701] = ("a", None), ("b", "w1 " * 4000)
    questions = {q: (q % 4, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 6))))
                 for q in range(70)}
    sees = {(0, "a"), (1, "a"), (1, ""), (2, "b")}
    held = {(0, d) for d in range(0, 700, 9)} | {(3, 5), (3, 701), (1, 9999)}
    df = spark.createDataFrame([(d, g or None, t) for d, (g, t) in docs.items()] + [(None, "a", "w1")],
                               "doc long, g string, text string").repartition(3)
    asked = spark.createDataFrame([(q, a, t) for q, (a, t) in questions.items()] + [(999, 1, None)],
                                  "query_id long, audience int, text string")
    see = spark.createDataFrame([(a, g or None) for a, g in sees] * 2, "audience int, group string")
    hold = spark.createDataFrame(list(held) * 2, "audience int, doc long")
    index = postings.build(df, "doc", F.col("text"), F.col("g"))
    want = plain(docs, questions, sees, held, 5)
    for first in (1, 3):
        got = {}
        for r in postings.search(index, asked, see, 5, hold, first).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append((r.doc, r.score))
        assert set(got) == {q for q, hits in want.items() if hits}
        for q, hits in got.items():
            assert [d for d, _ in hits] == [d for d, _ in want[q]]
            assert all(abs(s - w) < 2e-6 for (_, s), (_, w) in zip(hits, want[q]))
    everything = plain(docs, questions, sees, held, 10 ** 6)
    totals = {r.query_id: r.total for r in postings.totals(index, asked, see, hold).collect()}
    assert totals == {q: len(h) for q, h in everything.items() if h}
    assert postings.search(index, asked.limit(0), see).count() == 0
    assert postings.search(index, asked, see.limit(0)).count() == 0


def test_blocks_are_skipped(spark):
    """Rare words in one block lift the floor above what all other blocks can reach."""
    rows = spark.range(0, 5000, 1, 2).select(
        F.col("id").alias("doc"), F.when(F.col("id") < 20, "rare rare common")
        .otherwise("common filler words").alias("text"))
    index = postings.build(rows, "doc", F.col("text"), F.lit("g"))
    asked = spark.createDataFrame([(1, 0, "rare common")], "query_id int, audience int, text string")
    see = spark.createDataFrame([(0, "g")], "audience int, group string")
    beyond = postings.granted_beyond(index, see, see.select("audience", F.lit(0).alias("doc")))
    weighted = postings.weighted_terms(index, postings.question_terms(asked), see, beyond)
    bounds = postings.block_bounds(index, weighted)
    assert bounds.count() >= 20
    hits = postings.search(index, asked, see, 10).orderBy("rank").collect()
    assert [r.doc for r in hits] == list(range(10))
    start = bounds.orderBy(F.desc("bound")).limit(1)
    floors = spark.createDataFrame([(1, hits[-1].score)], "query_id int, floor double")
    assert postings.remaining(bounds, start, floors).count() == 0
