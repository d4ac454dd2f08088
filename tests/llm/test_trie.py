import hashlib
import random
import zlib
from collections import defaultdict

from lekhya.llm import trie
from lekhya.llm.queries import rebuilt


def plain(convs):
    """{prefix: (conv, depth, parent conv, members, children, leaves, saved, ends)}"""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(cs) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p],
                    leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, rebuild):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at int")
    seq = trie.sequences(df.repartition(5), "conv_id", ["turn"], "role", "text")
    own = defaultdict(list)
    order = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        convs = {c: own.get(c - c % 100, [])[:h[c]] + t[h[c]:] for c, t in own.items()}
        got = trie.trie(*rebuilt(seq))
    else:
        convs, got = own, trie.trie(seq, seq.select("conv").distinct())
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(convs)


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for turn in range(rng.randrange(0, 12)):
            text = rng.choice(["", None, "a", "bé", "b" * 300 + rng.choice("xy")])
            rows.append((c, rng.choice([turn, turn, None, 1]), rng.choice(["user", None, "x"]),
                         text, 0))
    rows += [(None, 0, "user", "nobody", 0)] * 5 + rows[:9]
    check(spark, rows, rebuild=False)
    check(spark, [(None if r[0] is None else r[0] + 95, *r[1:]) for r in rows], rebuild=True)


def test_deep_and_common(spark):
    """One conversation holds a third of the rows, another third is one text; depth 100."""
    deep = [(1, i, "user", f"t{i % 7}", 0) for i in range(100)]
    twin = [(2, i, "user", f"t{i % 7}" if i < 64 else "other", 0) for i in range(80)]
    many = [(100 + c, 0, "user", "hi", 0) for c in range(90)]
    check(spark, deep + twin + many, rebuild=False)


def test_many_ends(spark):
    old, trie.IDS_PER_ROW = trie.IDS_PER_ROW, 4
    try:
        check(spark, [(c, 0, "user", "hi", 0) for c in range(23)], rebuild=False)
    finally:
        trie.IDS_PER_ROW = old


def test_no_turns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    seq = trie.sequences(df, "conv_id", ["turn"], "role", "text")
    assert trie.trie(seq, seq.select("conv").distinct()).count() == 0
    silent = spark.createDataFrame([(4,), (9,)], "conv long")
    (root,) = trie.trie(seq, silent).collect()
    assert (root.conv_id, root.depth, root.n_convs, root.n_leaves, root.ends_sha256) == (
        4, 0, 2, 1, hashlib.sha256(b"4,9").hexdigest())
