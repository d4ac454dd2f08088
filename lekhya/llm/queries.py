"""The operators of this package over their whole tables, and their SQL where it exists."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from lekhya.llm import (ann, chat, fingerprint, langid, merkle, mixing, ngram_join, packing,
                        quality, rules, sharding, trie, warc)
from lekhya.llm.oracles import MERKLE_SQL, RULES_SQL, TRIE_SQL
from lekhya.session import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_multi_index_neighbours")
def op1(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op3_best_fit_shards")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.md5("text").alias("copy"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    placed = sharding.shard(docs, F.col("copy"), F.col("size"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_warc_normaliser", f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.LEAST} AND first <> page_id THEN 'revisit'
            ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.LEAST} AND first <> page_id THEN first END AS refers_to
FROM f""")
def op4(spark, sf_dir):
    index, folder = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_indexed(index, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


MIX_SEED, MIX_CYCLE, MIX_SHARE, MIX_EPOCHS = "mix", (3, 1, 2), 1.5, 2.0


def mixed(docs: DataFrame) -> DataFrame:
    """Documents with a size column, mixed as the contract of op5 says."""
    sizes = stage(mixing.source_sizes(docs))
    weights = mixing.cyclic_weights(sizes, list(MIX_CYCLE))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    return mixing.mix(docs, stage(weights), MIX_SHARE * total, MIX_EPOCHS, MIX_SEED)


@query("op5_water_filling_mix", f"""
WITH d AS (SELECT doc_id, source,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))
                       AS BIGINT) AS size,
                  md5('{MIX_SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
           FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                  row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth
           FROM d GROUP BY source),
     w AS (SELECT *, CAST(CASE nth % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight,
                  source_size * {MIX_EPOCHS}::DOUBLE AS cap FROM s),
     r AS (SELECT *, {MIX_SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget,
                  coalesce(sum(cap::DECIMAL(38, 6)) OVER earlier, 0)::DOUBLE AS clamped,
                  (sum(weight::DECIMAL(38, 9)) OVER later)::DOUBLE AS free
           FROM w WINDOW earlier AS (ORDER BY cap / weight, nth
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                         later AS (ORDER BY cap / weight, nth
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
     v AS (SELECT *, greatest(0.0::DOUBLE, (budget - clamped) / free) AS level FROM r),
     n AS (SELECT arg_min(level, cap / weight) FILTER (weight * level < cap) AS level FROM v),
     t AS (SELECT v.source, source_size, least(cap, weight * coalesce(n.level, 1e300)) AS target
           FROM v, n),
     q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT)
                          ELSE 0 END AS whole FROM t),
     o AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole,
                  CAST(round(q.target) AS BIGINT) - q.whole * q.source_size AS quota,
                  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
           FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, quota - earlier)) AS BIGINT) AS taken
FROM o""")
def op5(spark, sf_dir):
    docs = stage(table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def identified(docs: DataFrame) -> DataFrame:
    model = langid.fit(docs, "doc_id")
    return langid.identify(docs, model, F.col("text"), declared=F.col("lang"),
                           host=F.col("source"))


@query("op6_language_evidence")
def op6(spark, sf_dir):
    return identified(table(spark, sf_dir, "documents")).select(
        "doc_id", "lang", "language", F.round("confidence", 4).alias("confidence"),
        "text_language", "identified")


@query("language_of_pages")
def pages_language(spark, sf_dir):
    model = langid.fit(table(spark, sf_dir, "documents"), "doc_id")
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style).*?</\1>", " "),
                             r"<[^>]*>", " ")
    found = langid.identify(
        table(spark, sf_dir, "pages"), model, plain,
        declared=F.regexp_extract("html", r"<html[^>]*\slang=\"([^\"]*)\"", 1),
        host=host, suffix=F.regexp_extract(host, r"([^.]*)$", 1))
    return found.select("page_id", "language", F.round("confidence", 4).alias("confidence"),
                        "text_language", "identified")


def judged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their scores; an error where a class has no labelled document to learn
    from, as no score would mean anything then."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not all(model.labelled) and not docs.isEmpty():
        raise ValueError("quality: documents labelled 0 and 1: %d and %d, but both kinds are "
                         "needed" % model.labelled)
    return quality.classify(docs, model)


@query("op7_co_trained_quality")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return judged(spark, docs, sf_dir).select(
        "doc_id", *[F.round(c, 4).alias(c) for c in (
            "content_score", "meta_score", "quality_score")], "good")


_CONTROLS = "|".join(c.replace("[", "\\[").replace("]", "\\]") for c in chat.CONTROLS)
_OK = "</s>[INST] ok [/INST]"


@query("op8_schema_chat", f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_OK}' UNION ALL SELECT -7, 1, 'assistant', '{_OK}'),
     e AS (SELECT *, length(text) + length(text) - length(replace(text, '\\', ''))
                  + len(regexp_extract_all(text, '{_CONTROLS}')) AS escaped,
                  length(role) + length(role) - length(replace(role, '\\', ''))
                  + len(regexp_extract_all(role, '{_CONTROLS}'))
                  + length(role) - length(replace(role, ']', '')) AS name FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
           AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + CASE role WHEN 'user' THEN {len(chat.OPEN_USER + chat.CLOSE_USER)}
                                    WHEN 'assistant' THEN {len(chat.OPEN_ANSWER + chat.END)}
                                    WHEN 'system' THEN {len(chat.OPEN_SYSTEM + chat.CLOSE_SYSTEM)}
                                    ELSE name + {len(chat.OPEN_OTHER + chat.CLOSE_NAME
                                                     + chat.CLOSE_OTHER)} END)
            AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op8(spark, sf_dir):
    whole = {"ignoreNullFields": "false"}
    rows = table(spark, sf_dir, "conversations").select(F.to_json(
        F.struct("conv_id", "turn", "role", "text"), whole).alias("record"))
    extra = F.struct(F.lit(-7).alias("conv_id"), F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(_OK).alias("content"))
        for role in ("user", "assistant")]).alias("messages"))
    records = rows.unionByName(spark.range(1).select(F.to_json(extra).alias("record")))
    read = chat.read_back(chat.formatted(chat.canonical_turns(records)))
    return read.withColumn("conv_id", F.col("conv_id").cast("long"))


@query("op9_minhash_fingerprints")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = fingerprint.with_fingerprint(docs, "text", "fingerprint")
    beside = fingerprint.with_next(marked, "doc_id", ["text", "fingerprint"], "next_")
    changed = beside.withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text"))) \
        .withColumn("n_chars", F.length("text").cast("long")).drop("text", "next_text")
    both = fingerprint.with_fingerprint(changed, "edited", "edited_fingerprint")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        fingerprint.likeness(F.col("fingerprint"), F.col("edited_fingerprint"))
        .alias("near_edited"),
        fingerprint.likeness(F.col("fingerprint"), F.col("next_fingerprint"))
        .alias("near_next"))


@query("op10_ngram_jaccard_groups")
def op10(spark, sf_dir):
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest", MERKLE_SQL)
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    folded = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaf = merkle.leaf_digest([F.col(c) for c in fields])
    tampered = merkle.leaf_digest([F.col(c) for c in fields[:-1]] + [folded])
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"),
                         F.when(chosen, tampered).alias("tampered"))
    made = merkle.manifest(leaves, "lang", ["doc_id"], "leaf")
    proved = merkle.prove(made, made.leaves).withColumns({
        "root": F.lit(made.root).cast("string"), "proof_sha256": merkle.proof_digest(F.col("proof")),
        "folded_root": merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof"))})
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


def rebuilt(seq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences and conversations in which c begins with the first crc32(c) % 6 turns of
    c - c % 100, and goes on with its own after as many."""
    convs = seq.select("conv").distinct().select(
        "conv", (F.crc32(F.col("conv").cast("string")) % 6).alias("h"),
        (F.col("conv") - F.col("conv") % 100).alias("base"))
    donors = seq.filter("conv % 100 = 0 AND at <= 5").select(
        F.col("conv").alias("base"), F.col("at"), "name", "size")
    given = convs.join(donors, "base").filter("at <= h").select("conv", "at", "name", "size")
    many = donors.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    shift = convs.join(many, "base", "left").select(
        "conv", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("given"))
    own = seq.join(shift, "conv").filter("at > h").select(
        "conv", (F.col("at") - F.col("h") + F.col("given")).alias("at"), "name", "size")
    return stage(given.unionByName(own)), convs.select("conv")


@query("op12_conversation_trie", TRIE_SQL)
def op12(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return trie.trie(*rebuilt(trie.sequences(turns, "conv_id", ["turn"], "role", "text")))


@query("op13_quality_rules", RULES_SQL)
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return rules.judge(docs, rules.ratios(docs, trusted)).select("doc_id", *rules.BASE, "kept")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
