import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lekhya.llm import merkle


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def climb(nodes):
    """Root of a list of digests, and the siblings of each leaf, from the leaf up."""
    proofs, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = nodes[at // 8 * 8:at // 8 * 8 + 8]
            proofs[i].append(("".join(run[:at % 8]), "".join(run[at % 8 + 1:])))
            where[i] = at // 8
        nodes = [h("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def plain(groups):
    """groups: {name or None: leaves in order}; {(name, place): (subroot, proof)} and the root."""
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: climb(groups[g]) for g in names}
    root, above = climb([subs[g][0] for g in names])
    return {(g, i): (subs[g][0], p + above[k]) for k, g in enumerate(names)
            for i, p in enumerate(subs[g][1])}, root


def test_sizes_around_powers(spark):
    sizes = {"a": 1, "b": 8, "é": 9, None: 64, "": 65, "z": 513, "Z": 520}
    rows = [(g, i, h(f"{g}{i}"), 5) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "tree string, id long, digest string, subroot int")
    m = merkle.manifest(df.repartition(5), "tree", ["id"], "digest")
    got = merkle.prove(m, m.leaves).withColumn(
        "back", merkle.folded(F.col("digest"), F.col("proof"))).withColumn(
        "sum", merkle.proof_digest(F.col("proof"))).collect()
    want, root = plain({g: [h(f"{g}{i}") for i in range(n)] for g, n in sizes.items()})
    assert m.root == root and len(got) == len(rows)
    for r in got:
        sub, proof = want[r.tree, r.id]
        assert r.subroot == sub and [tuple(s) for s in r.proof] == proof and r.back == root
        assert r.sum == h("".join(a + b for a, b in proof))
    # a few requests only, a false leaf, a way that does not exist
    few = m.leaves.filter("tree = 'z' AND id IN (0, 511, 512)")
    assert {r.id: [tuple(s) for s in r.proof] for r in merkle.prove(m, few).collect()} == {
        i: want["z", i][1] for i in (0, 511, 512)}
    lost = merkle.prove(m, few.withColumn("digits", F.lit("77777")))
    with pytest.raises(Exception, match="no record"):
        lost.collect()


def test_null_and_repeated_rows(spark):
    rows = [(None, "en", "x")] * 2 + [(7, "en", "B")] * 20 + [(7, "en", "A"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn(
        "leaf", merkle.leaf_digest([F.col("doc_id"), F.col("lang"), F.col("text")]))
    m = merkle.manifest(df, "lang", ["doc_id"], "leaf")
    framed = lambda *vs: h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in vs))
    en = [framed(None, "en", "x")] * 2 + sorted([framed("7", "en", "B")] * 20
                                                + [framed("7", "en", "A")])
    want, root = plain({None: [framed("3", None, None)], "en": en})
    got = merkle.prove(m, m.leaves).collect()
    assert m.root == root and len(got) == len(rows)
    assert sorted((r.leaf, str([tuple(s) for s in r.proof])) for r in got) == sorted(
        (leaf, str(want[g, i][1])) for g, leaves in ((None, [framed("3", None, None)]), ("en", en))
        for i, leaf in enumerate(leaves))


def test_one_leaf_and_none(spark):
    df = spark.createDataFrame([("en", 1, "ab")], "lang string, id long, leaf string")
    m = merkle.manifest(df, "lang", ["id"], "leaf")
    assert m.root == "ab" and merkle.prove(m, m.leaves).first().proof == []
    empty = merkle.manifest(df.limit(0), "lang", ["id"], "leaf")
    assert empty.root is None and merkle.prove(empty, empty.leaves).count() == 0


def test_query(spark):
    from lekhya.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_merkle_manifest"](spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        text = docs[r.doc_id].text or ""
        chosen = zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        changed = chosen and any("A" <= c <= "Z" for c in text)
        assert r.verified != changed and (r.folded_root == r.root) == r.verified
