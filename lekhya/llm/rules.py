"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams.

Word n-grams of the raw corpus (all documents) and of its trusted documents are counted in
hashed bins, a range of bins for each length of n-gram.  A bin's ratio is

    log( (trusted + PRIOR * share) / (raw + PRIOR) / share ),  share = all trusted / all raw

which is the log of its probability among trusted n-grams over that among all, with a prior
that draws bins of little evidence to 0.  A document's score is the sum over the lengths of
the mean ratio of its n-grams; it is kept if the score reaches a fixed threshold and no base
rule fails.  Every count covers all documents and whole texts.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lekhya.llm.names import fresh
from lekhya.session import stage

BINS = 1 << 16           # for each length of n-gram
ORDERS = (1, 2)          # lengths; a bin is linear in the words' hashes, see ``_bins``
FACTOR = 1_000_003
PRIOR = 20.0             # n-grams' worth of the share of all in every bin
LEAST_SCORE = -0.5
LEAST_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20      # of the words may lie in repeated windows
BROADCAST_IDS = 200_000  # trusted ids that are broadcast at most; 8 bytes each

SPACE = r"[\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _windows(hashes: Column, n: int) -> Column:
    """64-bit hashes of the windows of n words, by position."""
    none = F.array().cast("array<bigint>")
    return F.when(F.size(hashes) < n, none).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(hashes) - n),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns ``BASE``; columns of these names are replaced.

    A null or blank text has no words and fails.  n_repeat_words counts the positions covered
    by any window of five words that occurs at least twice in the text, overlaps included;
    windows are compared by 64-bit hashes.
    """
    docs = docs.withColumnRenamed(text, "text") if text.lower() in BASE else docs
    text = "text" if text.lower() in BASE else text
    kept = docs.select(*[c for c in docs.columns if c.lower() not in BASE])
    w, h, win, s, at = fresh(kept, "_words", "_hashes", "_windows", "_sorted", "_at")
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = kept.withColumn(w, words_of(F.col(text)))
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        h: F.transform(w, lambda x: F.xxhash64(x))}).drop(w)
    out = out.withColumn(win, _windows(F.col(h), REPEAT_WINDOW)).drop(h)
    # only a text with equal windows is sorted; then equal ones are neighbours
    pairs = F.transform(F.col(win), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    out = out.withColumn(s, F.when(F.size(F.array_distinct(win)) < F.size(win),
                                   F.sort_array(pairs)).otherwise(F.slice(pairs, 1, 0))).drop(win)
    same = lambda p, i: F.get(F.col(s), i)["x"] == p["x"]
    again = F.filter(s, lambda p, i: F.coalesce(same(p, i + 1), F.lit(False))
                     | (i > 0) & same(p, F.greatest(i - 1, F.lit(0))))
    out = out.withColumn(at, F.sort_array(F.transform(again, lambda p: p["i"]))).drop(s)
    covered = F.aggregate(
        F.transform(at, lambda x, i: F.least(F.lit(REPEAT_WINDOW), F.coalesce(
            F.get(F.col(at), i + 1) - x, F.lit(REPEAT_WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", covered.cast("long")).drop(at)
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))) \
        .select(*kept.columns, *BASE)


def _bins(hashes: Column, order: int, bins: int, first: int) -> Column:
    """Bins of the n-grams of one length, numbered from ``first``."""
    def place(i):
        value = F.get(hashes, i)
        for k in range(1, order):
            value = F.pmod(value * FACTOR + F.get(hashes, i + k), F.lit(1 << 32))
        return (F.pmod(value, F.lit(bins)) + first).cast("int")

    return F.when(F.size(hashes) < order, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(hashes) - order), place))


def ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text",
           bins: int = BINS, orders: tuple[int, ...] = ORDERS,
           prior: float = PRIOR) -> DataFrame:
    """bin, ratio for every bin an n-gram of ``docs`` falls in, bins of the k-th length offset
    by k * ``bins``.

    ``trusted``: its first column holds keys of documents of the target, repeated or null ones
    do no harm.  Rows of one key are trusted alike.  Without any trusted n-gram the ratio of
    every bin is 0.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("id")).filter("id IS NOT NULL") \
        .distinct().withColumn("target", F.lit(1))
    ids = stage(ids)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = (docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(ids, "id", "left")
            .select(F.coalesce("target", F.lit(0)).alias("target"), words_of(F.col("text"))
                    .alias("w"))
            .select("target", F.transform("w", lambda x: F.crc32(x)).alias("h")))
    found = F.concat(*[_bins(F.col("h"), n, bins, k * bins) for k, n in enumerate(orders)])
    counts = stage(rows.select("target", F.explode(found).alias("bin")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target"))
        .withColumn("order", F.floor(F.col("bin") / bins)))
    shares = counts.groupBy("order").agg((F.sum("target") / F.sum("raw")).alias("share"))
    ratio = F.log((F.col("target") + prior * F.col("share")) / (F.col("raw") + prior)
                  / F.col("share"))
    # one row for each length of n-gram
    return stage(counts.join(F.broadcast(shares), "order").select(
        "bin", F.when(F.col("share") > 0, ratio).otherwise(F.lit(0.0)).alias("ratio")))


def with_score(docs: DataFrame, table: DataFrame, text: str = "text", out: str = "score",
               bins: int = BINS, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """Add the sum over the lengths of the mean ratio of a text's n-grams (0 for none).

    The ratios become one array of at most ``bins`` numbers for each length, which a scalar
    subquery hands to the tasks.
    """
    spark = docs.sparkSession
    every = spark.range(bins * len(orders)).select(F.col("id").cast("int").alias("bin"))
    array = every.join(table, "bin", "left").agg(F.sort_array(F.collect_list(F.struct(
        "bin", F.coalesce("ratio", F.lit(0.0)).alias("ratio")))).alias("all")) \
        .select(F.transform("all", lambda x: x["ratio"]).alias("ratios")).scalar()
    kept = docs.select(*[c for c in docs.columns if c.lower() != out.lower() or c == text])
    h, t = fresh(kept, "_hashes", "_ratios")
    hashes = F.transform(words_of(F.col(text)), lambda x: F.crc32(x))
    marked = kept.withColumns({h: hashes, t: array})
    means = []
    for k, n in enumerate(orders):
        many = F.size(h) - (n - 1)
        total = F.aggregate(_bins(F.col(h), n, bins, k * bins), F.lit(0.0),
                            lambda a, b: a + F.get(F.col(t), b))
        means.append(F.when(many > 0, total / many).otherwise(F.lit(0.0)))
    return marked.withColumn(out, sum(means[1:], means[0])).select(*kept.columns, out)


def judge(docs: DataFrame, table: DataFrame, text: str = "text",
          least: float = LEAST_SCORE) -> DataFrame:
    """Add ``BASE``, score and kept: no base rule fails and the score is at least ``least``.

    Every row is judged on its own, so repeated rows agree; an empty table stays empty; columns
    of the added names are replaced.
    """
    scored = with_score(with_base(docs, text), table, text)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
