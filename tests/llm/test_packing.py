import random
import zlib
from array import array
from collections import defaultdict

import pytest

from lekhya.llm import packing, sharding
from lekhya.llm.queries import tokenizer_path
from pyspark.sql import functions as F


def sequences(rows, capacity=packing.CAPACITY):
    """Checks that every sequence is gapless and within capacity; returns how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, " \n\t x y Z\x1c "), (-4, "it's <|endoftext|>we'll"),
           (-5, "é ́a ΣΣ İ"), (-6, "x" * 9000), (-7, "a\r\nb" * 3000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows = packing.pack(docs.repartition(40), tokenizer_path()).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        want = [(k, at, len(ids[at:at + 4096]), zlib.crc32(array("I", ids[at:at + 4096]).tobytes()))
                for k, at in enumerate(range(0, len(ids), 4096))]
        assert got[r.doc_id] == want
    total = sum(r.length for r in rows)
    assert sequences(rows) <= total / 4096 * 1.02 + 2


def test_unusual_rows(spark):
    schema = "doc_id long, text string, piece string, length int"
    assert packing.pack(spark.createDataFrame([], schema), tokenizer_path()).count() == 0
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (None, None, None, None)]
    got = packing.pack(spark.createDataFrame(rows, schema), tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 3), (1, 3)]
    assert sequences(got) == 1


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_best_fit_against_a_plain_search(limit):
    rng = random.Random(limit)
    packer, bins, closed, want = packing.BestFit(100, limit), [], [], []
    for i in range(3000):
        size = rng.choice([rng.randrange(1, 101), rng.randrange(1, 30)])
        closed += [[x for x, _ in s] for s in packer.put((i, size), size)]
        fits = [b for b in bins if 100 - sum(s for _, s in b) >= size]
        if fits:
            least = min(100 - sum(s for _, s in b) for b in fits)
            mine = [b for b in fits if 100 - sum(s for _, s in b) == least][-1]
            bins.remove(mine)
        else:
            if len(bins) == limit:
                most = max(sum(s for _, s in b) for b in bins)
                full = [b for b in bins if sum(s for _, s in b) == most][-1]
                bins.remove(full)
                want.append(full)
            mine = []
        mine.append((i, size))
        (want if sum(s for _, s in mine) == 100 else bins).append(mine)
    assert closed == want
    assert sorted(map(str, ([x for x, _ in s] for s in packer.rest()))) == sorted(map(str, bins))


def test_capacity_tree_and_decreasing_fit():
    rng = random.Random(3)
    items = [(f"g{i}", rng.randrange(1, 60)) for i in range(700)]
    placed = sharding.best_fit_decreasing(items, 100)
    left, want = [], {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        fits = [(free, b) for b, free in enumerate(left) if free >= size]
        at = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(100)
        left[at] -= size
        want[key] = at
    assert placed == want
    assert sharding.best_fit_decreasing([("a", 500), ("b", 3)], 100) == {"a": 0, "b": 1}


def test_shards(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i % 500}" if i % 7 else None, 10 + i % 13, "x", 0)
            for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, copy string, size long, shard string, slot int")
    got = sharding.shard(df, F.col("copy"), F.col("size"), shards=8).collect()
    assert len(got) == 6000
    homes, slots, sizes = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        homes[r["copy"]].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(len(v) == 1 for v in homes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    rest = sorted(sizes.values())[:-1]  # the largest shard holds the indivisible third
    assert len(sizes) == 8 and rest[-1] - rest[0] <= max(rest) * .02
    few = sharding.shard(df.filter("copy <> 'same'"), F.col("copy"), F.col("size"), capacity=8000)
    load = [r[1] for r in few.groupBy("shard").agg(F.sum("size")).collect()]
    assert max(load) <= 8000 and len(load) <= sum(load) / 8000 * 1.05 + 1
    assert sharding.shard(df.limit(0), F.col("copy"), F.col("size"), shards=8).count() == 0


def test_given_documents_are_near_equal(spark):
    from lekhya.llm.queries import QUERIES

    got = QUERIES["op3_best_fit_shards"](spark, "/root/testdata/sf0.01")
    sizes = [r[1] for r in got.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= max(sizes) * .01
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
            for r in texts}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.collect()} == want


def test_capacity_holds_for_many_small_groups(spark):
    rows = spark.range(300_000).withColumn("size", F.lit(2))
    got = sharding.shard(rows, F.col("id"), F.col("size"), capacity=128, row_key="id")
    sizes = got.groupBy("shard").agg(F.sum("row_size").alias("n")).agg(
        F.max("n"), F.count(F.lit(1))).first()
    assert sizes[0] <= 128 and sizes[1] < 1.05 * 600_000 / 128
