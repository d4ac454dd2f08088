"""One edit distance per pair, in a band where texts are near."""

import random

import pytest
from pyspark.sql import functions as F

from lekhya.functions import compare


def edits_by_rule(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def changed(rng, text, rate, alphabet):
    out = []
    for c in text:
        kind = rng.random() / rate
        out += [c] if kind >= 1 else [rng.choice(alphabet)] if kind < .4 else [] if kind < .7 else [
            c, rng.choice(alphabet)]
    return "".join(out)


@pytest.mark.parametrize("rate", [.01, .05, .2, .9])
def test_edits_against_the_table(monkeypatch, rate):
    rng = random.Random(rate)
    monkeypatch.setattr(compare, "BLOCK", 50)
    monkeypatch.setattr(compare, "SHORT", 60)
    for size in [0, 1, 2, 5, 20, 64, 65, 130, 400, 700]:
        for alphabet in ("ab", "abcdefghij \U0001f600\u0928"):
            a = "".join(rng.choice(alphabet) for _ in range(size))
            b = changed(rng, a, rate, alphabet)
            for x, y in ((a, b), (b, a), (a, b[::-1]), ("xy" + a, b), (a + b, b)):
                assert compare.py_edits(x, y) == edits_by_rule(x, y)
    for most in (0, 1, 3, 10, 200):
        a = "".join(rng.choice("abc") for _ in range(90))
        b = changed(rng, a, rate, "abc")
        long, short = sorted((a, b), key=len, reverse=True)
        want = edits_by_rule(a, b)
        if most >= len(long) - len(short):
            got, _ = compare._banded(compare._points(long), compare._points(short), most)
            assert got == want if want <= most else got > most


def test_long_texts_take_seconds():
    import time

    rng = random.Random(5)
    a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(60_000))
    b = changed(rng, a, .05, "abcdefghijklmnop ")
    words = [str(rng.randrange(9000)) for _ in range(9000)]
    begun = time.time()
    assert 2000 < compare.py_edits(a, b) < 4000
    assert 0 < compare.py_word_edits(words, words[100:] + words[:100]) <= 200
    assert time.time() - begun < 20  # 3.6 thousand million cells of a table took longer


def test_one_distance_serves_both_error_rates(spark):
    long = "abcdefghij" * 300
    pairs = [("abc", "abd"), (" abc ", "abc"), ("", ""), ("", "x"), (None, None), ("é a", "é b"),
             (long, long.replace("e", "c")), (long, long[::-1])]
    df = spark.createDataFrame(pairs, "a string, b string")
    ref, hyp = F.col("a"), F.col("b")
    plain = df.select(compare.cer(ref, hyp), compare.cer_rounded(ref, hyp), compare.wer(ref, hyp))
    got = compare.with_error_rates(df, "a", "b").select("cer", "cer_rounded", "wer")
    assert got.collect() == plain.collect()
    bands = df.select((compare.edit_distance(ref, hyp)).alias("x"), F.levenshtein(ref, hyp).alias("y"))
    assert all(r["x"] == r["y"] for r in bands.collect())


def test_one_pass_serves_error_rate_and_exact_match(spark):
    long = "abcdefghij" * 300
    pairs = [("abc", "abd"), (" abc ", "abc"), ("", ""), ("", "x"), ("x", None), (None, None),
             ("e\u0301 a", "\u00e9 b"), (long, long.replace("e", "c")), (long, long[5:])]
    df = spark.createDataFrame(pairs, "a string, b string")
    plain = df.select(compare.cer(F.col("a"), F.col("b")), compare.exact_match(F.col("a"), F.col("b")))
    got = compare.with_reading_rates(df, "a", "b").select("cer", "exact_match")
    assert got.collect() == plain.collect()
