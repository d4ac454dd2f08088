"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word n-grams ("tokens").  With the tokens of all sets
in one global order, rare first, two sets that share at least o tokens share at least j among
their first n - o + j.  With one class of rare tokens and m classes of frequent ones, and
j = m + 1, they share a rare token or two frequent ones of a class.  So prefixes are extended
by m tokens; rare tokens are indexed alone, frequent ones as pairs within their class, and
what meets is verified exactly.

Steps (each over all that the one before kept):
1. Equal sets become one representative.
2. Tokens of one quarter of the hash space are counted.  A set with more tokens of its own
   among them than a link can leave over has no partner.
3. The rest links to the leader of each of its prefix tokens, the set in whose order the token
   comes first.  This joins groups of near copies without making their pairs.
4. Tokens are counted again by group.  What only one group has cannot make a new link.  The
   rest is indexed with token combinations; sets that these connect meet in blocks of bounded
   size, where pairs of different groups are verified.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lekhya.llm.components import components
from lekhya.llm.workers import release_memory, trimmed, with_small_batches
from lekhya.session import stage

WORDS = 4
SIMILAR = (85, 100)   # numerator, denominator
FREQUENT = 32         # tokens in more sets (or groups) than this are frequent
CLASSES = 4           # of frequent tokens
QUARTER = np.uint64(1) << np.uint64(62)
REMEMBERED = 100_000
BROADCAST_KEYS = 1_000_000
BLOCK_SETS, BLOCK_TOKENS, BLOCK_SIGS = 700, 1_000_000, 1_000_000
SLICE_ITEMS = 200_000  # tokens or signatures that a worker gathers before it hands them on


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def mixed(a: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    a = a ^ (a >> np.uint64(33))
    a = a * np.uint64(0xFF51AFD7ED558CCD)
    a = a ^ (a >> np.uint64(33))
    a = a * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(33))


def shingles(text: bytes | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text.

    A-Z is lower-cased and words end at ASCII white space.  Fewer words than ``words`` are
    one n-gram; no words make an empty set.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = mixed(out + h[k:k + n] + np.uint64(1))
    return np.unique(out)


@dataclass(frozen=True)
class Rule:
    """Jaccard similarity of at least num / den."""
    num: int
    den: int

    @property
    def least(self) -> int:
        """Sets below this size link only with equal ones."""
        return ceil(self.num / (self.den - self.num)) if self.num < self.den else 2 ** 31

    @property
    def classes(self) -> int:
        """A link shares at least ``least`` tokens, so classes + 1 may not exceed that."""
        return max(1, min(CLASSES, self.least - 1))

    def spare(self, n):
        """Tokens of a set of size n that no partner may leave over, at most."""
        return n - (self.num * n + self.den - 1) // self.den

    def spare_sql(self, n: str) -> str:
        return f"({n} - (({self.num} * {n} + {self.den - 1}) div {self.den}))"

    def overlap_sql(self, n: str, m: str) -> str:
        """Least overlap of sets of sizes n and m."""
        both = self.num + self.den
        return f"(({self.num} * ({n} + {m}) + {both - 1}) div {both})"


def _lists(arrays: list[np.ndarray], of):
    """An Arrow list column of ``of`` from one array a row."""
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, of))


def _arrays(column) -> list[np.ndarray]:
    """One array a row of an Arrow list column, without copies."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy()  # not cut to the rows of a slice, as the offsets expect
    return [values[x:y] for x, y in zip(ends[:-1], ends[1:])]


def _sliced(rows, made):
    """``made`` of lists of ``rows`` (size, row) that hold SLICE_ITEMS items or little more."""
    held, items = [], 0
    for size, row in rows:
        held.append(row)
        items += size + 1
        if items >= SLICE_ITEMS:
            yield made(held)
            held, items = [], 0
    if held:
        yield made(held)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, digest of the set, and its tokens within the counted quarter."""
    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    s = shingles(text.as_py(), words, hashes)
                    own = s[:np.searchsorted(s, QUARTER)].copy()  # so that the rest can go
                    yield len(own), (doc_id.as_py(), len(s), hashlib.blake2b(
                        s.tobytes(), digest_size=16).digest(), own.view(np.int64))

        def made(held):
            ids, n, digests, samples = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int32()),
                 pa.array(digests, pa.binary()), _lists(samples, pa.int64())],
                ["doc_id", "n", "digest", "sample"])

        yield from _sliced(rows(), made)

    return docs.mapInArrow(trimmed(run), "doc_id long, n int, digest binary, sample array<long>")


def _tokens(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()

        def rows():
            for batch in batches:
                for doc_id, text in zip(batch["doc_id"], batch["text"]):
                    s = shingles(text.as_py(), words, hashes).view(np.int64)
                    yield len(s), (doc_id.as_py(), s)

        def made(held):
            ids, sets = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(list(map(len, sets)), pa.int32()),
                 _lists(sets, pa.int64())], ["id", "n", "tokens"])

        yield from _sliced(rows(), made)

    return docs.mapInArrow(trimmed(run), "id long, n int, tokens array<long>")


def _with_shared(sets: DataFrame, rows: DataFrame, counts: DataFrame, rule: Rule) -> DataFrame:
    """id, n, group, shared: the tokens in ``counts`` of each set as (groups, token) in order,
    for sets that have enough of them for a partner.  ``rows``: id, token."""
    return (rows.join(counts, "token").groupBy("id")
            .agg(F.sort_array(F.collect_list(F.struct("groups", "token"))).alias("shared"))
            .join(sets.drop("tokens"), "id")
            .filter(f"n - size(shared) <= {rule.spare_sql('n')}"))


def _shared_by_sets(sets: DataFrame, rule: Rule) -> DataFrame:
    """Tokens that other sets have as well; every set is a group of its own."""
    rows = sets.select("id", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    return _with_shared(sets, rows, counts, rule)


def _shared_by_groups(sets: DataFrame, rule: Rule) -> DataFrame:
    """Tokens that other groups have as well; those of one group only go before any counting."""
    rows = sets.select("id", "group", F.explode("tokens").alias("token"))
    several = (rows.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
               .filter("lo <> hi").select("token"))
    kept = stage(rows.join(several, "token", "left_semi"))
    counts = (kept.select("token", "group").distinct().groupBy("token")
              .agg(F.count(F.lit(1)).alias("groups")))
    return _with_shared(sets, kept.select("id", "token"), counts, rule)


def _single_prefixes(counted: DataFrame, rule: Rule) -> DataFrame:
    """token, id, n, pos for the plain prefixes; pos counts from the rarest token."""
    length = F.expr(f"{rule.spare_sql('n')} + 1 - (n - size(shared))")
    return (counted.select("id", "n", F.size("shared").alias("s"),
                           F.posexplode(F.slice("shared", F.lit(1), length)).alias("at", "t"))
            .select(F.col("t.token").alias("token"), "id", "n",
                    (F.col("n") - F.col("s") + F.col("at")).alias("pos")))


def _signatures(counted: DataFrame, rule: Rule, frequent: int) -> DataFrame:
    """id, n, group, sigs, pos: rare tokens alone and pairs of frequent tokens of a class, from
    prefixes extended by the number of classes.  Only the prefixes go to Python, as numbers."""
    classes = np.uint64(rule.classes)
    length = F.expr(f"{rule.spare_sql('n')} + {1 + rule.classes} - (n - size(shared))")
    prefixes = counted.select(
        "id", "n", "group", (F.col("n") - F.size("shared")).alias("own"),
        F.slice("shared", F.lit(1), length).alias("prefix")).select(
        "id", "n", "group", "own", F.col("prefix.groups").alias("count"),
        F.col("prefix.token").alias("token"))

    def signed(own, count, token):
        pos = own + np.arange(len(token))
        rare = count <= frequent
        sigs, at = [token[rare]], [pos[rare]]
        for c in range(int(classes)):
            of = np.flatnonzero(~rare & (mixed(token) % classes == c))
            for k, x in enumerate(of[:-1]):
                sigs.append(mixed(mixed(token[x:x + 1]) + token[of[k + 1:]]))
                # up to classes - 1 common tokens may stand before the pair
                at.append(np.full(len(of) - k - 1, max(0, pos[x] - int(classes) + 1)))
        return np.concatenate(sigs).view(np.int64), np.concatenate(at).astype(np.int32)

    def run(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                for id_, n, group, own, count, token in zip(
                        *[batch[c].to_pylist() for c in ("id", "n", "group", "own")],
                        _arrays(batch["count"]), _arrays(batch["token"])):
                    sigs, pos = signed(own, count, token.view(np.uint64))
                    yield len(sigs), (id_, n, group, sigs, pos)

        def made(held):
            ids, n, groups, sigs, pos = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(groups, pa.int64()),
                 _lists(sigs, pa.int64()), _lists(pos, pa.int32())],
                ["id", "n", "group", "sigs", "pos"])

        yield from _sliced(rows(), made)

    return prefixes.mapInArrow(
        trimmed(run), "id long, n int, group long, sigs array<long>, pos array<int>")


def block_links(ids, n, group, block, sigs, pos, tokens, rule: Rule) -> list[tuple[int, int]]:
    """Links that join different groups among the sets of one or two blocks.

    Two sets are compared if a signature and what sizes and places allow say so, unless they
    are joined already; of two blocks, only across.
    """
    m = len(ids)
    owner = np.repeat(np.arange(m), [len(s) for s in sigs])
    flat, at = np.concatenate(sigs), np.concatenate(pos)
    order = np.argsort(flat, kind="stable")
    flat, owner, at = flat[order], owner[order], at[order]
    ends = np.flatnonzero(np.r_[flat[1:] != flat[:-1], True]) + 1
    maybe = np.zeros((m, m), bool)
    across = block.min() != block.max()
    for start, end in zip(np.r_[0, ends[:-1]], ends):
        who = owner[start:end]
        if end - start < 2 or (group[who] == group[who[0]]).all():
            continue
        size, left = n[who], n[who] - at[start:end]
        need = -(-rule.num * (size[:, None] + size) // (rule.num + rule.den))
        fits = ((np.minimum(left[:, None], left) >= need)
                & (np.minimum(size[:, None], size) * rule.den
                   >= np.maximum(size[:, None], size) * rule.num))
        if across:
            fits &= block[who][:, None] != block[who]
        maybe[np.ix_(who, who)] |= fits
    names, codes = np.unique(np.concatenate(tokens), return_inverse=True)
    bounds = np.r_[0, np.cumsum([len(t) for t in tokens])]
    label, links = np.unique(group, return_inverse=True)[1], []
    held = np.zeros(len(names), bool)
    for x in range(m):
        others = np.flatnonzero(maybe[x] & (label != label[x]))
        others = others[others > x]
        if not len(others):
            continue
        mine = codes[bounds[x]:bounds[x + 1]]
        held[mine] = True
        for y in others:
            if label[y] != label[x]:
                both = int(held[codes[bounds[y]:bounds[y + 1]]].sum())
                if both * rule.den >= (n[x] + n[y] - both) * rule.num:
                    links.append((int(ids[x]), int(ids[y])))
                    label[label == label[y]] = label[x]
        held[mine] = False
    return links


def _links_between_groups(index: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """a, b: enough links to join all groups that any link joins.

    Sets that signatures connect form a cluster.  A cluster is cut into blocks of bounded
    size, and every two of its blocks meet in a task, so no pair is ever a row.
    """
    long = index.select("id", "group", F.explode("sigs").alias("sig"))
    busy = long.groupBy("sig").agg(F.min("group").alias("lo"), F.max("group").alias("hi"),
                                   F.min("id").alias("b")).filter("lo <> hi").select("sig", "b")
    clusters = components(long.select(F.col("id").alias("a"), "sig").join(busy, "sig"))
    members = stage(index.join(clusters.select(F.col("node").alias("id"), F.col("component")
                                               .alias("cluster")), "id"))
    sizes = members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS),
        F.ceil(F.sum(F.size("sigs")) / BLOCK_SIGS)).alias("blocks"))
    placed = (members.join(sizes, "cluster").join(sets.select("id", "tokens"), "id")
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("low", F.least("block", "other"))
              .withColumn("high", F.greatest("block", "other")))

    def verify(pdf):
        arrays = {c: pdf[c].to_numpy() for c in ("id", "n", "group", "block")}
        links = block_links(arrays["id"], arrays["n"].astype(np.int64), arrays["group"],
                            arrays["block"], list(pdf["sigs"]), list(pdf["pos"]),
                            list(pdf["tokens"]), rule)
        if len(pdf) > BLOCK_SETS // 4:  # the worker goes on to other groups, and to other stages
            del pdf, arrays
            release_memory()
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return placed.groupBy("cluster", "low", "high").applyInPandas(verify, "a long, b long")


def _possible(rule: Rule) -> str:
    """What the sizes and places of a first common token allow, for rows x and y."""
    return (f"least(x.n, y.n) * {rule.den} >= greatest(x.n, y.n) * {rule.num} AND "
            f"least(x.n - x.pos, y.n - y.pos) >= {rule.overlap_sql('x.n', 'y.n')}")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("tokens").alias("s"))
    two = sets.select(F.col("id").alias("b"), F.col("tokens").alias("t"))
    met = pairs.join(one, "a").join(two, "b").withColumn(
        "shared", F.size(F.array_intersect("s", "t")).cast("long"))
    union = F.size("s") + F.size("t") - F.col("shared")
    return met.filter(F.col("shared") * rule.den >= union * rule.num).select("a", "b")


def similar_groups(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR,
                   frequent: int = FREQUENT, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    component_id: the smallest key reachable by links, its own included.  Links are exact; no
    frequent token, large group or long text is left out.  A null or blank text has an empty
    set and no links.  Rows of one key count as one document, linked by any of its texts; a
    row without a key is linked like any other, but stands for no document, so its component
    may be null.  All texts and sets are met in here, in batches of a few MB.
    """
    with with_small_batches(docs.sparkSession):
        return _similar_groups(docs, words, similar, frequent, key, text)


def _similar_groups(docs: DataFrame, words: int, similar: tuple[int, int], frequent: int,
                    key: str, text: str) -> DataFrame:
    rule = Rule(*similar)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"),
                       F.col(text).cast("binary").alias("text"))
    rows = stage(_sets(docs, words))
    said = F.xxhash64("digest")
    odd = rows.groupBy("doc_id").agg(F.min(said).alias("lo"), F.max(said).alias("hi"),
                                     F.count(F.lit(1)).alias("n"))
    if not odd.filter("lo <> hi OR doc_id IS NULL").isEmpty():
        return _groups_of_rows(docs, words, similar, frequent)
    classes = stage(rows.filter("n > 0").groupBy("digest")
                    .agg(F.min("doc_id").alias("id"), F.first("n").alias("n"))
                    .filter("id IS NOT NULL"))
    # 2. sets that may have a partner; tokens of equal sets count as shared here
    alone = (rows.filter(f"n >= {rule.least}")
             .select(F.col("doc_id").alias("id"), F.explode("sample").alias("token"))
             .groupBy("token").agg(F.min("id").alias("id"), F.max("id").alias("other"))
             .filter("id = other").groupBy("id").agg(F.count(F.lit(1)).alias("own")))
    open_ = stage(classes.filter(f"n >= {rule.least}").select("id", "n").join(alone, "id", "left")
                  .filter(f"coalesce(own, 0) <= {rule.spare_sql('n')}").select("id", "n"))
    small = open_.count() <= BROADCAST_KEYS  # rows are two numbers, so this bounds the bytes too
    wanted = F.broadcast(open_) if small else open_
    sets = _tokens(docs.join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"),
                   words).join(wanted, ["id", "n"], "left_semi")
    if not odd.filter("n > 1").isEmpty():
        sets = sets.dropDuplicates(["id"])  # repeated rows
    sets = stage(sets)
    # 3. leaders
    shared = stage(_shared_by_sets(sets.withColumn("group", F.col("id")), rule))
    first = stage(_single_prefixes(shared, rule))
    leaders = first.groupBy("token").agg(
        F.min_by(F.struct("id", "n", "pos"), F.struct("pos", "id")).alias("y"))
    pairs = (first.alias("x").join(leaders, "token").filter("x.id <> y.id")
             .filter(_possible(rule))
             .select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))
             .distinct())
    links = stage(_verified(pairs, sets, rule))
    groups = stage(components(links))
    # 4. links between groups
    grouped = (shared.select("id", "n", F.expr("transform(shared, s -> s.token)").alias("tokens"))
               .join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
               .withColumn("group", F.coalesce("component", "id")).drop("component"))
    index = stage(_signatures(_shared_by_groups(grouped, rule), rule, frequent))
    more = _links_between_groups(index, sets, rule)
    groups = stage(components(links.unionByName(more)))
    named = (classes.select("digest", "id")
             .join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
             .select("digest", F.coalesce("component", "id").alias("component_id")))
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "digest") \
        .join(named, "digest", "left")
    return out.select("doc_id", "n_shingles",
                      F.coalesce("component_id", "doc_id").alias("component_id"))


def _groups_of_rows(docs: DataFrame, words: int, similar: tuple[int, int],
                    frequent: int) -> DataFrame:
    """``similar_groups`` where keys are null or have several texts: every row is linked under
    an id of its own, then rows of one key are joined."""
    rows = stage(docs.select("*", F.monotonically_increasing_id().alias("row")))
    found = similar_groups(rows, words, similar, frequent, key="row")
    both = stage(rows.select("row", F.col("doc_id").alias("key")).join(
        found.select(F.col("doc_id").alias("row"), "n_shingles", "component_id"), "row"))
    heads = both.groupBy("component_id").agg(F.min("key").alias("head"))
    both = both.join(heads, "component_id")
    joined = components(both.filter("key <> head").select(F.col("key").alias("a"),
                                                          F.col("head").alias("b")))
    return (both.join(joined, F.coalesce("key", "head") == F.col("node"), "left")
            .select(F.col("key").alias("doc_id"), "n_shingles",
                    F.coalesce("component", "key", "head").alias("component_id")))


def keep_first(docs: DataFrame, words: int = 5, similar: tuple[int, int] = (80, 100),
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: that with the smallest key, null last.

    Every row is a document of its own here, so repeated rows, rows without a key and several
    texts of one key are grouped by what they say.  Texts without words have no near copies;
    of those, one a key stays.
    """
    rows = stage(docs.withColumns({"_row": F.monotonically_increasing_id(),
                                   "_hash": F.xxhash64(text)}))
    groups = similar_groups(rows, words, similar, key="_row", text=text)
    blank = F.col("n_shingles") == 0
    kept = (rows.select("_row", F.col(key).alias("_key"), "_hash")
            .join(groups, F.col("_row") == F.col("doc_id"))
            .groupBy(F.when(~blank, F.col("component_id")).alias("_group"),
                     F.when(blank, F.col("_key")).alias("_own"), blank.alias("_blank"))
            .agg(F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key"), "_hash",
                                "_row")).alias("first"))
            .select(F.col("first._row").alias("_row")))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)
