"""Queries without SQL against plain evaluations over the given tables."""

import hashlib

import numpy as np

from lekhya.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_ann_fingerprint import exact

SF = "/root/testdata/sf0.001"


def test_op1(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows)
    got = {}
    for r in QUERIES["op1_multi_index_neighbours"](spark, sf).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want)
    for q, hits in want.items():
        assert [got[q][k + 1][0] for k in range(5)] == [i for i, _ in hits]
        assert np.allclose([got[q][k + 1][1] for k in range(5)], [s for _, s in hits], atol=1e-12)


def test_op6_and_op7(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    said = QUERIES["op6_language_evidence"](spark, SF).collect()
    assert {r.doc_id for r in said} == set(docs) and len(said) == len(docs)
    assert np.mean([r.language == docs[r.doc_id].lang for r in said]) >= 0.97
    scored = QUERIES["op7_co_trained_quality"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in
              spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    right = [r.good == bool(labels[r.doc_id]) for r in scored if r.doc_id in labels]
    assert np.mean(right) >= 0.97


def test_op9(spark):
    docs = sorted(((r.doc_id, r.text or "") for r in
                   spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op9_minhash_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    errors = []
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half, r = len(text) // 2, got[i]
        changed = text[:len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (
            len(text), hashlib.sha256(changed.encode()).hexdigest())
        for near, other in ((r.near_edited, changed), (r.near_next, after)):
            x, y = brute.shingle_set(text.lower(), 5), brute.shingle_set(other.lower(), 5)
            errors.append(near - (len(x & y) / len(x | y) if x | y else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.25
