"""Quality classification by co-training.

Two logistic regressions see different views of a document: the content (which kinds of
characters follow each other, word statistics) and the metadata (source, language, length).
Over some rounds each hands the rows it is surest of, as pseudo-labels, to the other.  Then
both are calibrated on labelled rows that took no part, and their calibrated log-odds are
combined into one score for every document.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lekhya.llm.sampling import bounded_sample
from lekhya.session import stage

SAMPLE = 20_000    # unlabelled documents the models see (at most twice as many)
LABELLED = 4       # a class gives SAMPLE / LABELLED labelled documents, all if it has fewer
ROUNDS = 4
SURE = 0.95        # a pseudo-label's least probability
HANDED = 0.1       # at most this share of the unlabelled rows is handed over a round
KEEP = 0.5

# kinds of bytes: other, space, lower, upper, digit, sentence mark, other mark, non-ASCII
KINDS = np.zeros(256, np.int64)
KINDS[[9, 10, 11, 12, 13, 32]] = 1
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[128:] = 2, 3, 4, 7
KINDS[[ord(c) for c in ".,;:'\"-()?"]] = 5
KINDS[[c for c in range(33, 127) if KINDS[c] == 0]] = 6
CONTENT, META = 64 + 4, 32 + 16 + 16
SLICE = 1 << 20


def content_view(text: str | None) -> np.ndarray:
    """Shares of kind pairs, and word statistics; zeros for a null or empty text."""
    out = np.zeros(CONTENT, np.float32)
    raw = (text or "").encode()
    if not raw:
        return out
    pairs = np.zeros(64, np.int64)
    for at in range(0, len(raw), SLICE):
        kinds = KINDS[np.frombuffer(raw[at:at + SLICE + 1], np.uint8)]
        pairs += np.bincount(kinds[:-1] * 8 + kinds[1:], minlength=64)
    words = raw.split()
    out[:64] = np.sqrt(pairs / max(1, pairs.sum()))
    out[64] = len(set(words)) / max(1, len(words))
    out[65] = min(30, len(raw) / max(1, len(words))) / 10
    out[66] = np.log1p(len(words)) / 10
    lines = raw.split(b"\n")
    out[67] = len(set(lines)) / len(lines)
    return out


def meta_view(source: str | None, lang: str | None, n_chars) -> np.ndarray:
    """Hashed source and language and the order of magnitude of the length."""
    out = np.zeros(META, np.float32)
    out[zlib.crc32((source or "").encode()) % 32] = 1
    out[32 + zlib.crc32((lang or "").encode()) % 16] = 1
    if n_chars is not None and n_chars == n_chars:
        out[48 + min(15, int(np.log2(max(1, n_chars))))] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25,
             count: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method; a row counts ``count`` times."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    count = np.ones(len(x)) if count is None else count
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (count * (p - y)) + penalty * w
        curve = (x * (count * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(curve, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


@dataclass(frozen=True)
class Model:
    content: np.ndarray
    meta: np.ndarray
    calibration: tuple[np.ndarray, np.ndarray]  # scale and shift of each view's log-odds
    combined: np.ndarray                        # of the two calibrated log-odds
    labelled: tuple[int, int] = (0, 0)          # documents labelled 0 and 1 it was fitted on

    def scores(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: content, metadata and combined probability of good quality."""
        z = [odds(c, odds(w, x)[:, None]) for w, x, c in (
            (self.content, content, self.calibration[0]), (self.meta, meta, self.calibration[1]))]
        both = odds(self.combined, np.stack(z, 1))
        return np.stack([sigmoid(z[0]), sigmoid(z[1]), sigmoid(both)], 1)


def co_train(content: np.ndarray, meta: np.ndarray, label: np.ndarray,
             rounds: int = ROUNDS, share: float | None = None) -> Model:
    """``label``: 1, 0, or -1 for unlabelled rows.  Every fourth labelled row calibrates, of
    each class where a class would miss out.  ``share``: of good ones among all labels, if not
    that among these rows; rows of the classes then count as much as makes that share."""
    free = np.flatnonzero(label < 0)
    classes = [np.flatnonzero(label == k) for k in (0, 1)]
    labelled = np.sort(np.concatenate(classes))
    held = train = labelled
    if len(labelled) >= 40 and min(map(len, classes)) != 1:
        held = labelled[::4]
        if any(len(np.intersect1d(c, held)) in (0, len(c)) for c in classes):
            held = np.sort(np.concatenate([c[::4] for c in classes]))
        train = np.setdiff1d(labelled, held)
    found = label[labelled].mean() if len(labelled) else 0.5
    share = found if share is None else share
    count = np.ones(len(label))
    if 0 < found < 1:
        count[classes[0]], count[classes[1]] = (1 - share) / (1 - found), share / found
    views, given = (content, meta), [{}, {}]  # pseudo-labels each view was given
    weights = [None, None]
    for r in range(rounds + 1):
        for v, x in enumerate(views):
            extra = sorted(given[v])
            rows = np.concatenate([train, np.array(extra, dtype=np.int64)])
            y = np.concatenate([label[train], [given[v][i] for i in extra]])
            weights[v] = logistic(x[rows], y, count=count[rows])
        if r == rounds:
            break
        for v, x in enumerate(views):
            p, other = sigmoid(odds(weights[v], x[free])), given[1 - v]
            for value, sure in ((1, p), (0, 1 - p)):
                most = int(len(free) * HANDED * (share if value else 1 - share))
                order = np.argsort(-sure, kind="stable")[:most]
                for i in order[sure[order] >= SURE]:
                    other.setdefault(int(free[i]), value)
    y, n = label[held].astype(np.float64), count[held]
    calibration = tuple(logistic(odds(w, x[held])[:, None], y, ridge=0.01, count=n)
                        for w, x in zip(weights, views))
    z = np.stack([odds(c, odds(w, x[held])[:, None])
                  for w, x, c in zip(weights, views, calibration)], 1)
    return Model(weights[0], weights[1], calibration, logistic(z, y, ridge=0.01, count=n),
                 (len(classes[0]), len(classes[1])))


def drawn(docs: DataFrame, labels: DataFrame, key: str,
          sample: int) -> tuple[DataFrame, dict[int, int]]:
    """id, label (-1: none) of the documents to fit on, and all documents' number by label.

    Every class is drawn on its own by the hash of the key, so the labelled part depends on the
    number of labels and not on that of the documents.
    """
    marks = (labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("q"))
             .filter("q IN (0, 1)").groupBy("_id").agg(F.min("q").alias("q")))
    keys = stage(docs.select(F.col(key).alias("id")).distinct()
                 .join(marks, F.col("id") == F.col("_id"), "left")
                 .select("id", F.coalesce("q", F.lit(-1)).alias("label")))
    sizes = {r["label"]: r["count"] for r in keys.groupBy("label").count().collect()}
    parts = [bounded_sample(keys.filter(F.col("label") == k), "id",
                            sample if k < 0 else max(1, sample // LABELLED)) for k in (-1, 0, 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), sizes


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> Model:
    """Co-train on labelled and unlabelled documents of ``docs`` (key, text, source, lang,
    n_chars), drawn separately; ``labels``: doc_id, quality.

    What is drawn is bounded, so its keys are broadcast and features are fitted on the driver.
    Null labels and labels other than 0 and 1 are none; several labels of a document: the
    smallest; several rows of a document: the one whose hash is smallest.  Without labels of
    both kinds (see ``Model.labelled``) a model tells nothing: without any, every document
    scores the same.
    """
    keys, sizes = drawn(docs, labels, key, sample)
    of = F.struct("text", "source", "lang", "n_chars")
    rows = (docs.select(F.col(key).alias("_key"), of.alias("d"))
            .join(F.broadcast(keys), F.col("_key").eqNullSafe(F.col("id")))
            .groupBy("id", "label").agg(F.min_by("d", F.xxhash64("d")).alias("d")))
    made = (rows.select("id", "label", _views()("d.text", "d.source", "d.lang", "d.n_chars")
                        .alias("v"))
            .select("id", "label", "v.*").orderBy(F.xxhash64("id"), "id").toPandas())
    content = np.array(made["content"].tolist(), np.float32).reshape(-1, CONTENT)
    meta = np.array(made["meta"].tolist(), np.float32).reshape(-1, META)
    bad, good = sizes.get(0, 0), sizes.get(1, 0)
    return co_train(content, meta, made["label"].to_numpy(),
                    share=good / (bad + good) if bad + good else None)


def _views():
    def views(text: pd.Series, source: pd.Series, lang: pd.Series,
              n_chars: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({
            "content": [content_view(t).tolist() for t in text],
            "meta": [meta_view(*m).tolist() for m in zip(source, lang, n_chars)]})

    return F.pandas_udf(views, "content array<float>, meta array<float>")


def classify(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """Add content_score, meta_score, quality_score and good to ``docs``.

    Whole texts are read; null text, source, language or length are values of their own;
    repeated rows score alike; columns of the added names are replaced.
    """
    def score(text: pd.Series, source: pd.Series, lang: pd.Series,
              n_chars: pd.Series) -> pd.DataFrame:
        content = np.array([content_view(t) for t in text]).reshape(-1, CONTENT)
        meta = np.array([meta_view(*m) for m in zip(source, lang, n_chars)]).reshape(-1, META)
        s = model.scores(content, meta)
        return pd.DataFrame({"content_score": s[:, 0], "meta_score": s[:, 1],
                             "quality_score": s[:, 2], "good": s[:, 2] >= keep})

    scored = F.pandas_udf(score, "content_score double, meta_score double, "
                                 "quality_score double, good boolean")
    rest = docs.drop("content_score", "meta_score", "quality_score", "good")
    return rest.withColumn("_v", scored("text", "source", "lang", "n_chars")) \
        .select(*rest.columns, "_v.*")
