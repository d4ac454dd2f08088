import math
import random
import re
import zlib
from collections import Counter

from lekhya.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if often[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def ngrams(text):
    h = [zlib.crc32(w.encode()) for w in WORD.findall(text or "")]
    return [[x % rules.BINS for x in h],
            [(x * rules.FACTOR + y) % 2 ** 32 % rules.BINS for x, y in zip(h, h[1:])]]


def scores(docs, trusted):
    raw, target = [Counter(), Counter()], [Counter(), Counter()]
    for key, text in docs:
        for k, found in enumerate(ngrams(text)):
            raw[k].update(found)
            if key in trusted:
                target[k].update(found)
    out = []
    for _, text in docs:
        score = 0.0
        for k, found in enumerate(ngrams(text)):
            share = sum(target[k].values()) / max(1, sum(raw[k].values()))
            if found and share:
                score += sum(math.log((target[k][b] + rules.PRIOR * share)
                                      / (raw[k][b] + rules.PRIOR) / share)
                             for b in found) / len(found)
        out.append(score)
    return out


def test_against_plain_evaluation(spark):
    rng = random.Random(5)
    words = ["the", "of", "é漢", "A.", "b", "c|d", "#x", "\x1c", " ", "$%"]
    docs = [(1, None), (2, ""), (3, " \t\n\x0b\r "), (4, "a " * 5000), (5, "one\ntwo\none\n \n one\none"),
            (6, "a b c d e f a b c d e g"), (6, "other text of one key"), (None, "the of " * 9)]
    for i in range(60):
        n = rng.choice([3, 9, 10, 40, 300])
        docs.append((10 + i, rng.choice([" ", "\n", "\t \r\n"]).join(
            rng.choice(words if i % 3 else words[:3]) for _ in range(n))))
    docs += docs[20:24]
    trusted = {k for k, _ in docs if k and k % 3 == 0}
    # columns whose names clash with what is added
    df = spark.createDataFrame([(k, t, 9, "keep") for k, t in docs],
                               "doc_id long, text string, n_words int, _words string")
    ids = spark.createDataFrame([(k,) for k in trusted] * 2 + [(None,), (999,)], "id long")
    table = rules.ratios(df, ids)
    got = rules.judge(df.coalesce(1), table).collect()
    assert len(got) == len(docs) and {r["_words"] for r in got} == {"keep"}
    for r, (k, t), s in zip(got, docs, scores(docs, trusted)):
        want = base(t)
        assert (r.doc_id, r.text) == (k, t)
        assert tuple(r[c] for c in rules.BASE) == want
        assert abs(r.score - s) < 1e-9 and r.kept == (not want[5] and r.score >= rules.LEAST_SCORE)


def test_keys_are_joined_by_shuffle_beyond_the_bound(spark):
    df = spark.createDataFrame([(i, f"w{i % 4} x y z") for i in range(40)],
                               "doc_id long, text string")
    ids = df.filter("doc_id % 4 = 0").select("doc_id")
    old, want = rules.BROADCAST_IDS, sorted(rules.ratios(df, ids).collect())
    rules.BROADCAST_IDS = 0
    try:
        assert sorted(rules.ratios(df, ids).collect()) == want
    finally:
        rules.BROADCAST_IDS = old


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")],
                               "doc_id long, text string")
    none = df.select("doc_id").limit(0)
    row = rules.judge(df, rules.ratios(df, none)).first()
    assert row.score == 0 and row.kept
    assert rules.judge(df.limit(0), rules.ratios(df.limit(0), none)).count() == 0


def test_planted_kinds(spark):
    """Held-out: clean labelled documents stay, most of those labelled bad go."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = labels.filter("quality = 1 AND toxic = 0")
    half = good.filter("doc_id % 2 = 0").select("doc_id")
    judged = {r.doc_id: r for r in rules.judge(docs, rules.ratios(docs, half)).collect()}
    unseen = [judged[r.doc_id] for r in good.filter("doc_id % 2 = 1").collect()]
    bad = [judged[r.doc_id] for r in labels.filter("quality = 0").collect()]
    assert all(r.kept or r.base_failed for r in unseen)
    assert sum(not r.kept for r in bad) > 0.8 * len(bad)
