import random

import numpy as np
import pytest

from lekhya.llm import ngram_join
from lekhya.llm.components import components
from tests.llm import brute


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, id string")
    return sorted((r.doc_id, r.n_shingles, r.component_id)
                  for r in ngram_join.similar_groups(df, **kw).collect())


def corpus(seed, size=260):
    """Copies, near copies with some edits, shared passages, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = {}
    for i in range(size):
        kind = i % 8
        if kind < 3:  # near copies of one base
            words = list(base)
            for _ in range(rng.randrange(0, 7)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind == 3:
            words = passage + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))]
        elif kind == 4 and i > 8:
            words = texts[rng.randrange(i)].split()
            if words and rng.random() < .6:
                del words[rng.randrange(len(words))]
        elif kind == 5:
            words = [rng.choice("ab") for _ in range(rng.randrange(0, 7))]
        elif kind == 6:  # frequent tokens only, in different mixes
            words = passage[:rng.randrange(20, 60)] + base[:rng.randrange(0, 60)]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 200))]
        texts[i] = rng.choice([" ", "\n", " \t"]).join(words)
    return texts


@pytest.mark.parametrize("seed,words,similar,frequent", [
    (1, 4, (85, 100), 32), (2, 5, (80, 100), 2), (3, 3, (70, 100), 2), (4, 4, (85, 100), 3)])
def test_groups_against_all_pairs(spark, seed, words, similar, frequent):
    texts = corpus(seed)
    want = brute.groups(texts, words, *similar)
    got = run(spark, [(k, t, 1, "x") for k, t in texts.items()], words=words, similar=similar,
              frequent=frequent)
    assert got == sorted((k, n, c) for k, (n, c) in want.items())


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for words, similar in ((4, (85, 100)), (5, (80, 100))):
        want = brute.groups(texts, words, *similar)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in
               ngram_join.similar_groups(docs, words, similar).collect()}
        assert got == want


def test_unusual_rows(spark):
    assert run(spark, []) == []
    rows = [(5, None, 1, "a"), (3, "", 1, "b"), (4, " \n ", 1, "c"), (9, "One two", 1, "d"),
            (8, "one TWO", 1, "e"), (7, "one two three", 1, "f"), (8, "one TWO", 1, "e"),
            (20, "word " * 30_000, 1, "g"), (None, "alone here", 1, "h")]
    assert [r for r in run(spark, rows[:-1])] == sorted([
        (5, 0, 5), (3, 0, 3), (4, 0, 4), (9, 1, 8), (8, 1, 8), (8, 1, 8), (7, 1, 7), (20, 1, 20)])
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, id string")
    found = [r for r in ngram_join.similar_groups(df).collect() if r.doc_id is None]
    assert [(r.n_shingles, r.component_id) for r in found] == [(1, None)]


def test_keep_first(spark):
    df = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (3, "q", "z")],
                               "doc_id long, text string, component_id string")
    assert sorted(r.doc_id for r in ngram_join.keep_first(df).collect()) == [1, 3]


def test_keep_first_of_repeated_rows_null_keys_and_texts(spark):
    near = " ".join(f"n{i}" for i in range(80))
    far = " ".join(f"f{i}" for i in range(80))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]     # repeated rows
    rows += [(None, "a b c d e f"), (None, "only here"), (None, "only here"), (None, "and this")]
    rows += [(None, near + " x"), (None, near)]                            # near, without keys
    rows += [(5, near + " y"), (5, far), (6, far + " z"), (7, "seven")]    # two texts of one key
    rows += [(8, ""), (8, None), (8, " "), (9, ""), (None, None), (None, "")]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)],
                               "doc_id long, text string, n int")
    for parts in (1, 5):
        got = ngram_join.keep_first(df.repartition(parts, "n"))
        assert got.columns == df.columns
        got = [(r.doc_id, (r.text or "").strip()) for r in got.collect()]
        assert sorted(got, key=str) == sorted(
            [(1, "a b c d e f"), (None, "only here"), (None, "and this"), (5, near + " y"),
             (5, far), (7, "seven"), (8, ""), (9, ""), (None, "")], key=str)


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)]
    edges = chain + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in
           components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in top if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 15)
    texts = corpus(9)
    want = brute.groups(texts, 4, 80, 100)
    got = run(spark, [(k, t, 1, "x") for k, t in texts.items()], words=4, similar=(80, 100))
    assert got == sorted((k, n, c) for k, (n, c) in want.items())


def test_groups_over_slices_and_blocks_by_signatures(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SIGS", 60)
    texts = corpus(11)
    met = []
    links = ngram_join._links_between_groups

    def seen(index, sets, rule):
        met.append(index.count())
        return links(index, sets, rule)

    monkeypatch.setattr(ngram_join, "_links_between_groups", seen)
    want = brute.groups(texts, 4, 80, 100)
    got = run(spark, [(k, t, 1, "x") for k, t in texts.items()], words=4, similar=(80, 100))
    assert got == sorted((k, n, c) for k, (n, c) in want.items()) and met[0] > 1


def test_workers_hand_on_what_they_gather_in_slices():
    most = ngram_join.SLICE_ITEMS
    sizes = [most // 50] * 500 + [3 * most] + [0] * 7
    made = list(ngram_join._sliced(((n, n) for n in sizes), list))
    assert [n for rows in made for n in rows] == sizes
    assert all(sum(rows[:-1]) < most for rows in made) and len(made) > 9


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch",
             "spark.sql.execution.arrow.maxBytesPerBatch"]
    before, seen = [spark.conf.get(n) for n in names], []
    for step in ("_sets", "_tokens", "_signatures", "_links_between_groups"):
        def noted(*a, f=getattr(ngram_join, step), **kw):
            seen.append([int(spark.conf.get(n)) for n in names])
            return f(*a, **kw)
        monkeypatch.setattr(ngram_join, step, noted)
    assert len(run(spark, [(k, t, 1, "x") for k, t in corpus(3, 80).items()])) == 80
    assert len(seen) == 4 and all(n <= 1000 and b <= 8 << 20 for n, b in seen)
    assert [spark.conf.get(n) for n in names] == before


@pytest.mark.parametrize("blocks", [1, 2])
def test_links_of_blocks_against_all_pairs(blocks):
    rng, rule, size = random.Random(2), ngram_join.Rule(85, 100), 160
    base = [rng.randrange(1 << 60) for _ in range(150)]
    sets = []
    for _ in range(size):
        s = set(base)
        for _ in range(rng.randrange(0, 16)):
            s.discard(rng.choice(base))
            s.add(rng.randrange(1 << 60))
        sets.append(np.array(sorted(s), np.int64))
    n, ids, block = np.array([len(s) for s in sets]), np.arange(size), np.arange(size) % blocks
    found = ngram_join.block_links(ids, n, ids, block, sets, [np.zeros(len(s), int) for s in sets],
                                   sets, rule)

    def joined(pairs):
        top = list(range(size))
        for a, b in pairs:
            x, y = sorted((top[a], top[b]))
            top = [x if t == y else t for t in top]
        return top

    def alike(a, b):
        both = len(set(sets[a]) & set(sets[b]))
        return both * 100 >= 85 * (n[a] + n[b] - both)

    assert all(alike(a, b) for a, b in found) and len(found) < size
    assert joined(found) == joined([(a, b) for a in range(size) for b in range(a)
                                    if (blocks == 1 or block[a] != block[b]) and alike(a, b)])


def test_several_texts_of_a_key_and_rows_without_one(spark):
    def words(name, n=60):
        return " ".join(f"{name}{i}" for i in range(n))

    a, b = words("a"), words("b")
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (5, words("c")),
            (None, words("c") + " tail"), (None, words("d")), (None, words("d") + " tail"), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in
                  ngram_join.similar_groups(df).collect()), key=str)
    assert got == sorted([(1, 57, 1), (1, 57, 1), (2, 58, 1), (3, 58, 1), (5, 57, 5), (None, 58, 5),
                          (None, 57, None), (None, 58, None), (6, 0, 6)], key=str)
