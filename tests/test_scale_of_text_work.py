"""Cheaper forms of per-row text work give what the plain forms give, and tasks stay small."""

import re

import pytest
from pyspark.sql import functions as F

from lekhya import fixed_values as fv
from lekhya.functions.regex import java_pattern
from lekhya.functions.text import SPACES, strip
from lekhya.operators.precedents import extract_precedents
from lekhya.plans import corpus


@pytest.mark.parametrize("pattern,begins", [
    (r"\b(?:\d{1,2}/\d|x)", r"(?=[\x{78}\p{Nd}])"), (r"(?:a|b)c|d", r"(?=[\x{61}\x{62}\x{64}])"),
    (r"\s*(?:page)", r"(?=[\x{70}"), (r"a*", ""), (r"a|\w", ""), (r"[^a]", ""), (r".a", "")])
def test_matches_are_looked_for_where_they_can_begin(pattern, begins):
    text = java_pattern(pattern)
    assert text.startswith("(?d)" + begins) and ("(?=[" in text[:8]) == bool(begins)


def test_look_ahead_holds_for_every_alternative(spark):
    texts = ["xa 1/2", "d", "pag", "सचिव", "5 Rule 7(a)", "a-bc", "GO/12/x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in (r"(?:a|b)c|d", r"\b\d+/\d|x", *[p for _, p in fv.CLAIM_PATTERNS]):
        got = df.select("t", F.regexp_extract_all("t", F.lit(java_pattern(p, True)), F.lit(0)))
        for text, found in got.collect():
            assert found == [m.group() for m in re.finditer(p, text, re.IGNORECASE)]


def test_strip_drops_every_space_of_the_class(spark):
    body = "a b c"
    df = spark.createDataFrame([(SPACES + body + SPACES,), (SPACES,), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [body, "", "", None]


def test_cues_are_part_of_every_match(spark):
    assert len(fv.PRECEDENT_CUES) == len(fv.PRECEDENT_FAMILIES)
    for cues, (_, pattern) in zip(fv.PRECEDENT_CUES, fv.PRECEDENT_FAMILIES):
        assert all(c in pattern for c in cues)
    text = "ISSUED IN SUPERSESSION OF ORDER NO. 12/A/2019 dated 01.02.2019; READ WITH THE FIN Rules"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    rows = extract_precedents(df, "id").select("relation_type", "cited_order_number").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(
        [("SUPERSEDES", "12/A/2019"), ("READ_WITH", None)], key=str)


def test_spread_tasks_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    # one row group, whatever the number of splits
    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(corpus, "TASK_ROWS", 250)
    df = corpus.read_spread(spark, str(tmp_path), "orders", "id")
    sizes = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 12 and max(sizes) < 500
