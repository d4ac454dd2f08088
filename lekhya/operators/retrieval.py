"""Keyword and hybrid ranking of authorised chunks for a batch of questions.

One pass over the chunk text turns every chunk into a slim row: its length, the
frequency of the batch's terms, and per question whether it is a candidate and
which scores do not depend on the corpus.  That table is staged once; corpus
statistics, normalisation and ranking read only it.  Statistics come from each
question's own candidates (after access rules and filters), never from the whole
corpus.  A question batch is a request, so its literals are small by nature;
long batches are cut into slices with :func:`search_all`.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lekhya import fixed_values as fv
from lekhya.functions.text import py_tokens, text_or_empty, tokens
from lekhya.functions.vectors import embed, embedding, similarity_to
from lekhya.operators.access import (User, active_grants, approved, class_grants, searchable,
                                     visible)
from lekhya.operators.scale import either, top_k as keep_top
from lekhya.operators.understanding import parse_questions
from lekhya.session import stage

SLICE = 32
STOP, CATEGORY = set(fv.STOPWORDS), set(fv.CATEGORY_WORDS)
_CANDIDATE, _TYPE, _DATE = 1, 2, 4


@dataclass(frozen=True)
class Question:
    query_id: str
    text: str
    user: User = field(default_factory=User)


@dataclass(frozen=True)
class ParsedQuestion:
    """A question with its filters, tokens and vector, ready to become expressions."""
    query_id: str
    text: str
    user: User
    refused: bool
    department_id: str | None = None
    doc_type: str | None = None
    go_number: str | None = None
    exact_date: date | None = None
    date_from: date | None = None
    date_to: date | None = None

    @property
    def own_tokens(self) -> list[str]:
        return py_tokens(self.text)

    @property
    def weights(self) -> Counter:
        """Query terms with multiplicity: own tokens, then every dictionary expansion."""
        counts = Counter(self.own_tokens)
        for t in self.own_tokens:
            counts.update(fv.BILINGUAL_TERMS.get(t, ()))
        return counts

    @property
    def substantive(self) -> list[str]:
        return [t for t in self.weights if t not in STOP and len(t) > 1]

    @property
    def specifiers(self) -> list[str]:
        return [t for t in self.substantive if t not in CATEGORY]


def parse(spark: SparkSession, questions: list[Question]) -> list[ParsedQuestion]:
    rows = spark.createDataFrame([(i, q.text) for i, q in enumerate(questions)],
                                 "i int, text string")
    out = []
    for r in sorted(parse_questions(rows).collect(), key=lambda r: r["i"]):
        q = questions[r["i"]]
        out.append(ParsedQuestion(
            q.query_id, r["clean_query"], q.user,
            r["is_out_of_jurisdiction"] or r["has_unsupported_topic"],
            r["department_id"], r["doc_type"], r["go_number"], r["exact_date"],
            r["date_from"], r["date_to"]))
    return out


def searchable_text() -> Column:
    """Heading, title, subject, content and number, which all count for term frequency."""
    return F.concat_ws(" ", *[text_or_empty(F.col(c)) for c in (
        "section_heading", "title", "subject", "content", "go_number")])


def with_term_frequencies(df: DataFrame, toks: str, terms: list[str]) -> DataFrame:
    """Add ``len`` and ``tf``: the frequency of each of the given terms that occurs."""
    hits = df.withColumn("_hits", F.filter(toks, lambda t: t.isin(terms)))
    tf = F.map_from_entries(F.transform(F.array_distinct("_hits"), lambda t: F.struct(
        t, F.size(F.filter("_hits", lambda h: h == t)))))
    return hits.withColumn("len", F.size(toks)).withColumn("tf", tf).drop("_hits")


def bm25_term(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    idf = F.ln(1.0 + (n - df + 0.5) / (df + 0.5))
    spread = fv.BM25_K1 * (1.0 - fv.BM25_B + fv.BM25_B * length / F.greatest(average, F.lit(1.0)))
    return idf * tf * (fv.BM25_K1 + 1.0) / F.greatest(tf + spread, F.lit(1e-6))


def _mentions(c: Column, terms: list[str]) -> Column:
    """Whether any term is a substring of the lower-cased text."""
    if not terms:
        return F.lit(False)
    return F.lower(text_or_empty(c)).rlike("|".join(re.escape(t) for t in terms))


def _holds(c: Column, part: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))


def _candidate_code(q: ParsedQuestion, seen: Column) -> Column:
    """0 when not a candidate, else bits for the two soft filters."""
    hard = [seen]
    if q.department_id:
        hard.append(F.col("department_id") == q.department_id)
    if q.go_number:
        like = f"%{q.go_number}%"
        hard.append(either([F.col("go_number").ilike(like), F.col("content").ilike(like)]))
    keep = F.lit(True)
    for h in hard:
        keep = keep & F.coalesce(h, F.lit(False))
    soft_type = F.lit(False)
    if q.doc_type and not q.go_number:
        soft_type = F.coalesce(F.col("doc_type") == q.doc_type, F.lit(False))
    soft_date = F.lit(False)
    if q.exact_date:
        soft_date = either([F.col(c) == F.lit(q.exact_date)
                            for c in ("order_date", "effective_from", "effective_to")])
    elif q.date_from:
        soft_date = either([F.col(c).between(F.lit(q.date_from), F.lit(q.date_to))
                            for c in ("order_date", "effective_from")])
    code = (F.lit(_CANDIDATE) + F.when(soft_type, _TYPE).otherwise(0)
            + F.when(soft_date, _DATE).otherwise(0))
    return F.when(keep, code).otherwise(0).cast("tinyint")


def _number_match(q: ParsedQuestion) -> Column:
    return _holds(F.col("go_number"), q.go_number) if q.go_number else F.lit(False)


def _field_bonus(q: ParsedQuestion) -> Column:
    named = F.when(_number_match(q), 5.0).when(
        _mentions(F.col("go_number"), q.own_tokens), 3.0).otherwise(0.0)
    return (F.when(_mentions(F.col("section_heading"), q.substantive), 2.0).otherwise(0.0)
            + F.when(_mentions(F.col("subject"), q.substantive), 2.0).otherwise(0.0) + named)


def rerank_boost(q: ParsedQuestion) -> Column:
    """Boost for phrase, title, number and year agreement with the question."""
    low = q.text.lower()
    own = set(q.own_tokens)
    expanded = own.union(*[fv.BILINGUAL_TERMS.get(t, ()) for t in own]) if own else set()
    phrase = _holds(F.col("content"), low) if len(q.text) > 5 else F.lit(False)
    title = F.concat_ws(" ", text_or_empty(F.col("section_heading")),
                        text_or_empty(F.col("title")))
    aligned = F.arrays_overlap(tokens(title), F.array(*[F.lit(t) for t in sorted(expanded)])) \
        if expanded else F.lit(False)
    number = (F.col("go_number") != "") & F.contains(F.lit(low), F.lower("go_number"))
    year = F.contains(F.lit(low), F.year("order_date").cast("string"))
    parts = [(phrase, fv.RERANK_PHRASE), (aligned, fv.RERANK_TITLE),
             (number, fv.RERANK_NUMBER), (year, fv.RERANK_YEAR)]
    total = F.lit(0.0)
    for hit, gain in parts:
        total = total + F.when(hit, gain).otherwise(0.0)
    return total


def _size_of_overlap(terms: list[str]) -> Column:
    return F.size(F.filter(F.map_keys("tf"), lambda t: t.isin(terms))) if terms else F.lit(0)


def _survivor(i: int, q: ParsedQuestion) -> Column:
    """Per-question scores of a chunk that passes the grounding gates, else NULL."""
    matched, specific = _size_of_overlap(q.substantive), _size_of_overlap(q.specifiers)
    number, cos = _number_match(q), F.col("cos")[i]
    drop = F.lit(False)
    if q.specifiers:
        drop = drop | (~number & (specific == 0))
    if q.substantive:
        drop = drop | (~number & (matched == 0) & (cos < fv.VECTOR_ADMISSION))
    row = F.struct(F.lit(i).alias("q"), cos.alias("cos"), matched.alias("matched"),
                   number.alias("go_match"), _field_bonus(q).alias("bonus"),
                   rerank_boost(q).alias("boost"))
    return F.when((F.col("codes")[i] > 0) & ~drop, row)


def with_grants(chunks: DataFrame, users: list[User], grants: DataFrame | None,
                 now: datetime | None) -> tuple[DataFrame, dict[User, Column]]:
    """Visibility expression per distinct user of the batch."""
    if grants is None:
        return chunks, {u: visible(u, F.col("classification"), F.col("department_id"))
                        for u in users}
    subjects = sorted({s for u in users for s in u.subjects})
    held = (active_grants(grants, subjects, now).filter("document_id IS NOT NULL")
            .groupBy(F.col("document_id").alias("_doc"))
            .agg(F.collect_set("subject_id").alias("_holders")))
    joined = chunks.join(held, chunks["document_id"] == held["_doc"], "left").drop("_doc")
    rules = {}
    for u in users:
        own = F.coalesce(F.arrays_overlap("_holders", F.array(*[F.lit(s) for s in u.subjects])),
                         F.lit(False))
        rules[u] = visible(u, F.col("classification"), F.col("department_id"),
                           class_grants(grants, u, now), own)
    return joined, rules


def slim_rows(chunks: DataFrame, batch: list[ParsedQuestion], grants: DataFrame | None = None,
              now: datetime | None = None, provenance_gate: bool = True) -> DataFrame:
    """The staged slim table (see the module text).  The only pass over chunk text."""
    admitted = chunks.filter(approved(F.col("review_status"), F.col("lifecycle_status")))
    if provenance_gate and "provenance_status" in chunks.columns:
        admitted = admitted.filter(searchable(F.col("lifecycle_status"),
                                              F.col("provenance_status")))
    joined, rules = with_grants(admitted, list({q.user for q in batch}), grants, now)
    codes = F.array(*[_candidate_code(q, rules[q.user]) for q in batch])
    candidates = joined.withColumn("codes", codes).filter(
        F.exists("codes", lambda c: c > 0))
    stored = F.col("embedding").cast("array<double>") if "embedding" in chunks.columns \
        else F.lit(None).cast("array<double>")
    vectors = similarity_to([embed(q.text) for q in batch])
    terms = sorted({t for q in batch for t in q.weights}) or [""]
    scored = (candidates
              .withColumn("cos", vectors(F.concat_ws(" ", text_or_empty(F.col("subject")),
                                                     text_or_empty(F.col("content"))), stored))
              .withColumn("toks", tokens(searchable_text())))
    scored = with_term_frequencies(scored, "toks", terms)
    survivors = F.array_compact(F.array(*[_survivor(i, q) for i, q in enumerate(batch)]))
    return stage(scored.select("chunk_id", "document_id", "version_id", "len", "tf", "codes",
                               survivors.alias("survivors")))


def _bit(code: Column, mask: int) -> Column:
    return code.bitwiseAND(mask) > 0


def _soft_filters(slim: DataFrame) -> DataFrame:
    """Per question, which soft filters bind: one is applied only if something passes it."""
    long = slim.select(F.posexplode("codes").alias("q", "code")).filter("code > 0")
    both = _bit(F.col("code"), _TYPE) & _bit(F.col("code"), _DATE)
    flags = long.groupBy("q").agg(
        F.bool_or(_bit(F.col("code"), _TYPE)).alias("by_type"),
        F.bool_or(_bit(F.col("code"), _DATE)).alias("any_date"), F.bool_or(both).alias("any_both"))
    return flags.select("q", "by_type", F.when(F.col("by_type"), F.col("any_both"))
                        .otherwise(F.col("any_date")).alias("by_date"))


def _apply_soft(rows: DataFrame, soft: DataFrame) -> DataFrame:
    # one row per question of the batch
    return rows.join(F.broadcast(soft), "q").filter(
        (~F.col("by_type") | _bit(F.col("code"), _TYPE))
        & (~F.col("by_date") | _bit(F.col("code"), _DATE))).drop("by_type", "by_date")


def _statistics(slim: DataFrame, soft: DataFrame) -> DataFrame:
    """Candidate count, average length and document frequencies, one row per question."""
    long = _apply_soft(slim.select("len", "tf", F.posexplode("codes").alias("q", "code"))
                       .filter("code > 0"), soft)
    marks = F.concat(F.array(F.lit("")), F.map_keys("tf"))
    counts = (long.select("q", "len", F.explode(marks).alias("term"))
              .groupBy("q", "term").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("len")))
    entry = F.when(F.col("term") != "", F.struct("term", "n"))
    return counts.groupBy("q").agg(
        F.max(F.when(F.col("term") == "", F.col("n"))).alias("n"),
        F.max(F.when(F.col("term") == "", F.col("len"))).alias("average"),
        F.map_from_entries(F.collect_list(entry)).alias("df"))


def _scored(slim: DataFrame, batch: list[ParsedQuestion]) -> DataFrame:
    soft = stage(_soft_filters(slim))
    weights = F.array(*[F.array(*[F.struct(F.lit(t).alias("term"), F.lit(m).alias("m"))
                                  for t, m in (q.weights or {"": 0}).items()]) for q in batch])
    rows = slim.select("chunk_id", "document_id", "version_id", "len", "tf", "codes",
                       F.inline("survivors"))
    rows = _apply_soft(rows.withColumn("code", F.element_at("codes", F.col("q") + 1)), soft)
    rows = rows.join(F.broadcast(_statistics(slim, soft)), "q")
    total = F.aggregate(
        F.filter(F.element_at(weights, F.col("q") + 1),
                 lambda w: F.map_contains_key(F.col("tf"), w["term"])),
        F.lit(0.0),
        lambda acc, w: acc + w["m"] * bm25_term(
            F.element_at("tf", w["term"]), F.element_at("df", w["term"]), F.col("n"),
            F.col("len"), F.col("average")))
    blank = F.array(*[F.lit(not q.own_tokens) for q in batch])
    empty = (F.col("len") == 0) | F.element_at(blank, F.col("q") + 1)
    return rows.withColumn("bm25", F.when(empty, 0.0).otherwise(total + F.col("bonus")))


def search(chunks: DataFrame, questions: list[Question], k: int = 10, rerank: bool = True,
           grants: DataFrame | None = None, now: datetime | None = None,
           provenance_gate: bool = True) -> DataFrame:
    """Hybrid search: up to ``k`` ranked chunks per question."""
    spark = chunks.sparkSession
    batch = [q for q in parse(spark, questions) if not q.refused]
    schema = ("query_id string, rank int, chunk_id {c}, document_id {d}, version_id {v}, "
              "score double, bm25_score double, vector_score double, go_match boolean").format(
        c=chunks.schema["chunk_id"].dataType.simpleString(),
        d=chunks.schema["document_id"].dataType.simpleString(),
        v=chunks.schema["version_id"].dataType.simpleString())
    if not batch:
        return spark.createDataFrame([], schema)
    slim = slim_rows(chunks, batch, grants, now, provenance_gate)
    # read once for the peaks and once for the ranks
    rows = stage(_scored(slim, batch).select(
        "q", "chunk_id", "document_id", "version_id", "bm25", "cos", "matched", "go_match", "boost"))
    peaks = rows.groupBy("q").agg(F.greatest(F.max("bm25"), F.lit(1.0)).alias("peak"))
    bonus = F.least(F.col("matched") * fv.TERM_BONUS, F.lit(fv.TERM_BONUS_CAP))
    hybrid = F.least(F.lit(1.0), fv.HYBRID_BM25 * F.col("bm25") / F.col("peak")
                     + fv.HYBRID_VECTOR * F.col("cos") + bonus)
    first = stage(keep_top(
        rows.join(F.broadcast(peaks), "q").withColumn("hybrid", hybrid), 2 * k, ["q"],
        [F.desc("hybrid"), F.col("chunk_id")], "rank0"))
    top = first.groupBy("q").agg(F.max("hybrid").alias("top"))
    floor = F.greatest(F.lit(fv.CUTOFF_ABSOLUTE), F.col("top") * fv.CUTOFF_RELATIVE)
    kept = first.join(F.broadcast(top), "q").filter(
        F.col("go_match") | (F.col("hybrid") >= floor))
    score = F.round("hybrid", 4)
    if rerank:
        score = F.least(F.lit(1.0), score + F.col("boost"))
    ranked = keep_top(kept.withColumn("score", score), k, ["q"],
                      [F.desc("score"), F.col("rank0")] if rerank else [F.col("rank0")])
    ids = F.array(*[F.lit(q.query_id) for q in batch])
    return ranked.select(
        F.element_at(ids, F.col("q") + 1).alias("query_id"), "rank", "chunk_id", "document_id",
        "version_id", "score", F.col("bm25").alias("bm25_score"),
        F.col("cos").alias("vector_score"), "go_match")


def with_embeddings(chunks: DataFrame) -> DataFrame:
    """Add the vector of each chunk, to be stored with it; searches then compute none."""
    return chunks.withColumn("embedding", embedding(F.concat_ws(
        " ", text_or_empty(F.col("subject")), text_or_empty(F.col("content")))))


def search_all(chunks: DataFrame, questions: list[Question], **options) -> DataFrame:
    """A batch of any length, one slice at a time; chunks are embedded once for all slices."""
    slices = [questions[i:i + SLICE] for i in range(0, len(questions), SLICE)]
    if len(slices) > 1 and "embedding" not in chunks.columns:
        chunks = stage(with_embeddings(chunks))
    parts = [search(chunks, part, **options) for part in slices]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def search_page(chunks: DataFrame, questions: list[Question], limit: int = 10, offset: int = 0,
                **options) -> DataFrame:
    """A page of ranked evidence; any page can be reached, as depth is limit + offset."""
    found = search(chunks, questions, k=limit + offset, **options)
    return found.filter(F.col("rank").between(offset + 1, offset + limit))


def keyword_search(docs: DataFrame, terms: list[str], k: int = 10, id_col: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Plain BM25 top-k for one list of query terms over already authorised rows."""
    weights = Counter(terms)
    counted = with_term_frequencies(docs.withColumn("toks", tokens(F.col(text))), "toks",
                                    sorted(weights))
    slim = stage(counted.select(id_col, "len", "tf"))
    counts = [F.count_if(F.map_contains_key("tf", t)).alias(f"df{i}")
              for i, t in enumerate(weights)]
    stats = slim.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("len").alias("average"),
                              *counts).alias("s")).scalar()
    score = F.lit(0.0)
    for i, (t, m) in enumerate(weights.items()):
        score = score + F.when(F.map_contains_key("tf", t), m * bm25_term(
            F.element_at("tf", F.lit(t)), F.col("s")[f"df{i}"], F.col("s")["n"], F.col("len"),
            F.col("s")["average"])).otherwise(0.0)
    return (slim.filter(F.size("tf") > 0).withColumn("s", stats)
            .select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k))
