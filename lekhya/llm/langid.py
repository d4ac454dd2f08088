"""Language identification by Bayesian evidence fusion.

A text's likelihood per language (naive Bayes over hashed byte trigrams) is combined with
what the markup declares, whose reliability is learnt from how often it agrees with the
texts, and with a prior of the host.  Host priors are counts of text decisions by grouped
aggregation, smoothed towards those of the address suffix, and these towards the whole
collection; a document's own share is taken out of its host's counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lekhya.llm.sampling import SPAN
from lekhya.session import stage

BINS = 1 << 16
SAMPLE = 1000      # texts of each labelled language that its likelihoods are fitted on
EVIDENCE = 60      # a text counts as so many independent trigrams at most
SMOOTHING = 20.0   # documents' worth of the level above in a host's prior
KEEP = 0.5         # least posterior of an identified document
SLICE = 1 << 20    # bytes looked at once


def trigrams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of a text in lower case with single spaces."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, np.uint16)
    b = np.frombuffer(f" {' '.join(words)} ".encode(), np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B)
         + b[2:] * np.uint32(0xC2B2AE35))
    return (h >> np.uint32(16)).astype(np.uint16)


@dataclass(frozen=True)
class Likelihoods:
    languages: tuple[str, ...]
    table: np.ndarray  # BINS x languages, log probabilities

    def of(self, text: str | None) -> np.ndarray | None:
        """Log likelihood per language, or None without any letters to go by."""
        grams = trigrams(text)
        if not len(grams):
            return None
        total = np.zeros(len(self.languages))
        for at in range(0, len(grams), SLICE):
            total += self.table[grams[at:at + SLICE]].sum(0, dtype=np.float64)
        return total / len(grams) * min(len(grams), EVIDENCE)

    def posterior(self, text: str | None) -> np.ndarray | None:
        ll = self.of(text)
        return None if ll is None else softmax(ll)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def language_sample(labelled: DataFrame, key: str, text: str, language: str,
                    sample: int) -> DataFrame:
    """language, text: some ``sample`` texts of every language, all where there are fewer.

    Languages come from all rows, by one aggregate.  A text belongs if the hash of its key and
    text is below its language's threshold, which lets the smallest one in at least.  Rows of
    one key and text are drawn once.
    """
    rows = (labelled.filter(F.col(text).rlike(r"\S") & F.col(language).rlike(r"\S"))
            .select(F.col(language).alias("language"), F.col(text).alias("text"),
                    F.pmod(F.xxhash64(key, text, F.lit(17)), F.lit(SPAN)).alias("_hash")))
    sizes = rows.groupBy("language").agg(
        F.least(F.count(F.lit(1)), F.approx_count_distinct("_hash")).alias("_n"),
        F.min("_hash").alias("_least"))
    edges = sizes.select("language", F.greatest("_least", F.when(
        F.col("_n") <= sample, F.lit(SPAN)).otherwise(
            (F.lit(SPAN) * (F.lit(float(sample)) / F.col("_n"))).cast("long"))).alias("_edge"))
    return (rows.join(F.broadcast(edges), "language").filter("_hash <= _edge")
            .dropDuplicates(["language", "_hash"]).select("language", "text"))


def fit(labelled: DataFrame, key: str, text: str = "text", language: str = "lang",
        sample: int = SAMPLE) -> Likelihoods:
    """Trigram likelihoods of every language that a row with words is labelled with, each from
    some ``sample`` of its texts.  A blank label is none."""
    rows = language_sample(labelled, key, text, language, sample)

    def count(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("language")["text"]:
                counts = np.zeros(BINS, np.int64)
                for t in texts:
                    counts += np.bincount(trigrams(t), minlength=BINS)
                seen = np.flatnonzero(counts)
                yield pd.DataFrame({"language": lang, "bin": seen.astype(np.int32),
                                    "n": counts[seen]})

    parts = (rows.mapInPandas(count, "language string, bin int, n long")
             .groupBy("language", "bin").agg(F.sum("n").alias("n")).toPandas())
    languages = tuple(sorted(parts["language"].unique())) or ("und",)
    table = np.full((BINS, len(languages)), 0.05)
    at = np.searchsorted(languages, parts["language"].to_numpy(str))
    table[parts["bin"].to_numpy(int), at] += parts["n"].to_numpy(float)
    return Likelihoods(languages, np.log(table / table.sum(0)).astype(np.float32))


def identify(docs: DataFrame, model: Likelihoods, text: Column, declared: Column | None = None,
             host: Column | None = None, suffix: Column | None = None, keep: float = KEEP,
             smoothing: float = SMOOTHING) -> DataFrame:
    """Add language, confidence, text_language and identified to ``docs``.

    ``identified`` is false where the best posterior is below ``keep`` or the text has no
    words (language null then).  Null or unknown evidence of any kind says nothing; the
    primary subtag of ``declared`` is compared without case.  Columns of the added names are
    replaced, all others stay; repeated rows are judged alike; an empty table stays empty.
    """
    languages, n = list(model.languages), len(model.languages)
    none = F.lit(None).cast("string")
    tag = F.lower(F.split(F.coalesce(declared if declared is not None else none, F.lit("")),
                          "[-_ ]")[0])
    docs = docs.drop("language", "confidence", "text_language", "identified").withColumns({
        "_text": text, "_declared": F.when(tag.isin(languages), tag).otherwise(""),
        "_host": host if host is not None else none,
        "_suffix": suffix if suffix is not None else none})

    def posteriors(texts: pd.Series) -> pd.Series:
        return pd.Series([model.posterior(t) for t in texts])

    said = F.pandas_udf(posteriors, "array<double>")
    seen = stage(docs.select("_host", "_suffix", "_declared", said("_text").alias("p"))
                 .filter("p IS NOT NULL")
                 .groupBy("_host", "_suffix", "_declared")
                 .agg(*[F.sum(F.get("p", F.lit(k))).alias(f"s{k}") for k in range(n)]))
    sums = [F.sum(f"s{k}").alias(f"s{k}") for k in range(n)]
    total = np.array(seen.agg(*sums).first(), dtype=object)
    total = np.array([float(x or 0) for x in total])
    overall = (total + 1.0 / n) / (total.sum() + 1.0)
    reliable = {"": np.ones(n)}
    agreed = {r["_declared"]: np.array([float(r[f"s{k}"] or 0) for k in range(n)])
              for r in seen.groupBy("_declared").agg(*sums).collect()}  # at most n + 1 rows
    for i, lang in enumerate(languages):
        # P(declared | language), with one document's worth of a declaration that is mostly true
        prior = np.full(n, 0.1)
        prior[i] = 0.9
        reliable[lang] = (agreed.get(lang, np.zeros(n)) + prior) / (total + 1.0)
    own = F.array(*[F.col(f"s{k}") for k in range(n)])
    suffixes = seen.groupBy("_suffix").agg(*sums).select(
        F.col("_suffix").alias("_of"), own.alias("_suffix_sums"))
    hosts = seen.groupBy("_host", "_suffix").agg(*sums).withColumn("_host_sums", own)
    known = stage(hosts.join(suffixes, F.col("_suffix").eqNullSafe(F.col("_of")))
                  .select(F.col("_host").alias("_h"), F.col("_suffix").alias("_s"),
                          "_host_sums", "_suffix_sums"))

    def fuse(texts, declared_, host_sums, suffix_sums):
        out = []
        for t, d, hs, ss in zip(texts, declared_, host_sums, suffix_sums):
            ll = model.of(t)
            if ll is None:
                out.append((None, 0.0, None, False))
                continue
            mine = softmax(ll)
            prior = overall
            for level in (ss, hs):
                if level is not None:
                    others = np.maximum(level - mine, 0.0)
                    prior = (others + smoothing * prior) / (others.sum() + smoothing)
            post = softmax(ll + np.log(prior) + np.log(reliable.get(d, reliable[""])))
            best = int(post.argmax())
            out.append((languages[best], float(post[best]), languages[int(mine.argmax())],
                        bool(post[best] >= keep)))
        return pd.DataFrame(out, columns=["language", "confidence", "text_language",
                                          "identified"])

    def fused(texts: pd.Series, declared_: pd.Series, host_sums: pd.Series,
              suffix_sums: pd.Series) -> pd.DataFrame:
        return fuse(texts, declared_, host_sums, suffix_sums)

    verdict = F.pandas_udf(fused, "language string, confidence double, text_language string, "
                                  "identified boolean")
    joined = docs.join(known, F.col("_host").eqNullSafe(F.col("_h"))
                       & F.col("_suffix").eqNullSafe(F.col("_s")), "left")
    return (joined.withColumn("_v", verdict("_text", "_declared", "_host_sums", "_suffix_sums"))
            .select(*[c for c in docs.columns if c[0] != "_" or c not in (
                "_text", "_declared", "_host", "_suffix")], "_v.*"))
