"""Approximate nearest neighbours with an inverted multi-index.

Unit vectors are cut into halves, and each half is quantised with a codebook of its own, so
K + K centroids name K x K cells.  A query visits cells in ascending order of the summed
distance of its halves to the two centroids, with a heap over the grid, until they hold the
share of all rows that was found necessary when the index was fitted.  What they hold is
ranked by the exact cosine.

Rows are grouped by the first half's centroid, in chunks of bounded size; a query travels
once to each group of which it visits a cell, with the visited second centroids as a mask.
So hot cells are split, and no pair of query and row is ever a row of a table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lekhya.llm.sampling import bounded_sample
from lekhya.session import stage

CENTROIDS = 32
SAMPLE = 20_000       # rows the codebooks are fitted on
TRIALS = 400          # sample rows that act as queries when the share is fitted
RECALL = 0.96         # aimed at on the sample
CHUNK = 20_000        # rows or queries that meet in one task at once


@dataclass(frozen=True)
class Index:
    first: np.ndarray    # K x half
    second: np.ndarray
    share: float         # of all rows, to be visited per query


def _distances(a: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((a ** 2).sum(1)[:, None] - 2 * a @ centroids.T + (centroids ** 2).sum(1))


def _codebook(a: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """K-means from distinct starting rows that are spread over the sample."""
    distinct = np.unique(a, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[np.linspace(0, len(distinct) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(a, centroids).argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, a)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def visits(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, wanted: int) -> list[tuple]:
    """Cells in ascending order of d1[i] + d2[j] until they hold ``wanted`` rows.

    Multi-sequence walk: a cell enters the heap once its left and upper neighbours were
    visited, so the heap stays small.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, order1, order2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    heap, seen, out, held = [(s1[0] + s2[0], 0, 0)], [0] * len(s1), [], 0
    grid = counts.tolist()
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        out.append((order1[i], order2[j]))
        held += grid[order1[i]][order2[j]]
        seen[i] = j + 1
        if j + 1 < len(s2) and (i == 0 or seen[i - 1] > j + 1):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if i + 1 < len(s1) and seen[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
    return out


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite numbers."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (vector.isNotNull() & F.forall(vector, good) & F.exists(vector, lambda x: x != 0))


def unit(a: np.ndarray) -> np.ndarray:
    scaled = a / np.abs(a).max(1)[:, None]
    return scaled / np.sqrt((scaled ** 2).sum(1))[:, None]


def fit(vectors: DataFrame, key: str, vector: str, centroids: int = CENTROIDS,
        sample: int = SAMPLE, trials: int = TRIALS, k: int = 5, recall: float = RECALL) -> Index:
    """Codebooks and the share of rows to visit, from some ``sample`` rows (at most twice as many), chosen by hash.

    The share is the smallest at which ``recall`` of the exact ``k`` nearest of the trial
    rows lie in visited cells.
    """
    rows = bounded_sample(vectors, key, sample).orderBy(F.xxhash64(key), key) \
        .select(vector).toPandas()
    a = unit(np.array(rows[vector].tolist(), dtype=np.float64))
    half = a.shape[1] // 2
    first, second = _codebook(a[:, :half], centroids), _codebook(a[:, half:], centroids)
    i, j = _distances(a[:, :half], first).argmin(1), _distances(a[:, half:], second).argmin(1)
    needed = []
    for q in range(min(trials, len(a))):
        scores = a @ a[q]
        scores[q] = -2
        best = np.argpartition(-scores, min(k, len(a) - 1))[:k]
        cost = (_distances(a[q:q + 1, :half], first)[0][i]
                + _distances(a[q:q + 1, half:], second)[0][j])
        needed += [(cost <= cost[b]).mean() for b in best if b != q]
    share = float(np.quantile(needed, recall)) if needed else 1.0
    return Index(first, second, share)


def _codes(index: Index, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = index.first.shape[1]
    return (_distances(a[:, :half], index.first).argmin(1),
            _distances(a[:, half:], index.second).argmin(1))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id",
           vector: str = "embedding", index: Index | None = None, chunk: int = CHUNK,
           least: int = 4000) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` nearest to each query.

    A row of the query's own key is no candidate.  Score: cosine in double precision of the
    original vectors; ties go to the smaller key.  Vectors that are null, zero, or hold null or
    non-finite components take no part.  At least ``least`` rows are visited per query, so
    small tables are searched exhaustively.  Queries repeated under one key count once;
    repeated rows are candidates each.
    """
    data = vectors.select(F.col(key).cast("long").alias("id"),
                          F.col(vector).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    asked = (queries.select(F.col(key).cast("long").alias("q"),
                            F.col(vector).cast("array<double>").alias("v"))
             .filter(usable(F.col("v"))).dropDuplicates(["q"]))
    result = "query_id long, vec_id long, score double"
    if index is None:
        if data.isEmpty():
            return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, "
                                                         "score double")
        index = fit(data, "id", "v", k=k)
    n1, n2 = len(index.first), len(index.second)

    def coded(batches):
        for pdf in batches:
            if len(pdf):
                a = unit(np.array(pdf["v"].tolist(), dtype=np.float64))
                pdf = pdf.assign(i=np.int32(0), j=np.int32(0))
                i, j = _codes(index, a)
                yield pdf.assign(i=i.astype(np.int32), j=j.astype(np.int32))

    rows = stage(data.mapInPandas(coded, "id long, v array<double>, i int, j int"))
    counts = np.zeros((n1, n2), dtype=np.int64)
    for r in rows.groupBy("i", "j").count().collect():  # at most n1 x n2 cells
        counts[r["i"], r["j"]] = r["count"]
    wanted = max(least, int(np.ceil(index.share * counts.sum())))
    chunks = [max(1, -(-int(c) // chunk)) for c in counts.sum(1)]
    blocks = max(1, -(-asked.count() // chunk))
    half = index.first.shape[1]

    def routed(batches):
        for pdf in batches:
            out = []
            for q, v in zip(pdf["q"], pdf["v"]):
                a = unit(np.array([v], dtype=np.float64))
                masks: dict[int, int] = {}
                for i, j in visits(_distances(a[:, :half], index.first)[0],
                                   _distances(a[:, half:], index.second)[0], counts, wanted):
                    masks[i] = masks.get(i, 0) | 1 << j
                out += [(q, v, i, c, m.to_bytes(-(-n2 // 8), "little"))
                        for i, m in masks.items() for c in range(chunks[i])]
            yield pd.DataFrame(out, columns=["q", "v", "i", "c", "mask"])

    pick = F.get(F.array(*[F.lit(c) for c in chunks]), F.col("i"))
    placed = (rows.withColumn("c", F.pmod(F.xxhash64("id"), pick).cast("int"))
              .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    routes = (asked.mapInPandas(routed, "q long, v array<double>, i int, c int, mask binary")
              .withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")))

    def scored(x, y):
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, j = x["id"].to_numpy(), x["j"].to_numpy()
        raw, asks = (np.array(d["v"].tolist(), dtype=np.float64) for d in (x, y))
        units, asked_units, norms = unit(raw), unit(asks), norm(raw)
        bits = np.unpackbits(np.frombuffer(b"".join(y["mask"]), np.uint8).reshape(len(y), -1),
                             axis=1, bitorder="little").astype(bool)
        out = []
        for at in range(0, len(y), 256):
            near = asked_units[at:at + 256] @ units.T
            near[~bits[at:at + 256][:, j]] = -9
            for s, q, v in zip(near, y["q"].to_numpy()[at:at + 256], asks[at:at + 256]):
                s[ids == q] = -9
                floor = np.partition(s, -k)[-k] if len(s) > k else -2.0
                found = np.flatnonzero(s >= max(floor - 1e-9, -2.0))
                exact = cosine(raw[found], norms[found], v)
                best = np.lexsort((ids[found], -exact))[:k]
                out.append((np.full(len(best), q), ids[found][best], exact[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"),
                                     map(np.concatenate, zip(*out)))))

    on = ["i", "c", "b"]
    hits = placed.groupBy(*on).cogroup(routes.groupBy(*on)).applyInPandas(scored, result)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def norm(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(1))


def cosine(rows: np.ndarray, norms: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row in one order of operations, so that equal rows score equally."""
    return (rows * v).sum(1) / (norms * norm(v[None])[0])
