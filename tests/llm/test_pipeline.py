"""The pipeline against plain evaluations of its stages, each on its own input."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lekhya.session import stage
from tests.llm import brute
from tests.llm.test_packing import sequences

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs, inputs = spark.read.parquet(f"{SF}/documents.parquet"), []
    odd = [(10_001, None, None, None, None), (10_002, "", "en", "new", 0),
           (10_003, "Plain words of one more text.", "en", None, 29)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "quality classifier", "n-gram Jaccard join", "mixing sources",
        "best-fit packing"]
    for _, step in corpus_pipeline.STAGES:
        inputs.append([r.asDict() for r in docs.collect()])
        docs = stage(step(spark, docs, SF))
        if step is not corpus_pipeline.pack:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    first, spoken, good, single, mix = inputs
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = lambda rows: {r["doc_id"] for r in rows}
    assert ids(first) - ids(spoken) == {10_001, 10_002}
    fine = {k for k, q in labels.items() if q == 1}
    assert len(fine & ids(spoken) - ids(good)) <= 0.03 * len(fine)
    assert ids(spoken) - ids(good)
    want = brute.groups({r["doc_id"]: r["text"] for r in good}, 5, 80, 100)
    assert ids(single) == {k for k, (_, c) in want.items() if k == c}
    words = lambda t: len((t or "").split())
    total = sum(words(r["text"]) for r in single)
    per = Counter()
    for r in single:
        per[r["source"]] += words(r["text"])
    names = sorted(k for k in per if k is not None) + [None] * (None in per)
    from tests.llm.test_mixing import levels
    want = levels([per[k] for k in names], [[3, 1, 2][i % 3] for i in range(len(names))],
                  1.5 * total, 2.0)
    taken = Counter()
    for r in mix:
        taken[r["source"]] += words(r["text"])
    for name, target in zip(names, want):
        # documents stay whole, so half a document may be missing or too much
        longest = max(words(r["text"]) for r in single if r["source"] == name)
        assert abs(taken[name] - target) <= 1 + longest / 2
    rows = docs.collect()
    whole = Counter(r.doc_id for r in rows if r.piece == 0)
    assert whole == Counter(r["doc_id"] for r in mix)
    sequences(rows)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert corpus_pipeline.run(spark, SF).filter(F.col("length") > 4096).count() == 0
