"""From documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lekhya.llm.workers import BATCH_BYTES, BATCH_ROWS
from lekhya.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python in small Arrow batches.

    Batches, what is made of them and the buffers on both sides then take a few MB, also after
    several stages in the same workers.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language is not identified go; lang becomes the result.

    So go null and blank texts.  Rows are judged one by one, repeated ones alike.
    """
    from lekhya.llm.queries import identified

    small_batches(spark)
    return (identified(docs).filter("identified").withColumn("lang", F.col("language"))
            .select(*COLUMNS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go.  A score of exactly the threshold stays;
    null fields are values of their own; an empty table stays empty."""
    from lekhya.llm.queries import judged

    small_batches(spark)
    return judged(spark, docs, sf_dir).filter("good").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one row of each group of near copies stays, that of the smallest
    doc_id, null last.  Repeated rows are copies."""
    from lekhya.llm.ngram_join import keep_first

    small_batches(spark)
    return keep_first(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a row per repetition that the mix takes.

    Documents stay whole.  A null source is a source; a document without words is repeated as
    often as whole documents of its source are.
    """
    from lekhya.llm import mixing
    from lekhya.llm.queries import mixed

    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    return mixing.repeated(mixed(sized), list(COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left, repetitions included."""
    from lekhya.llm.packing import pack as packed
    from lekhya.llm.queries import tokenizer_path

    small_batches(spark)
    return packed(docs, tokenizer_path())


STAGES = [("language ID", language), ("quality classifier", quality),
          ("n-gram Jaccard join", near_duplicates), ("mixing sources", mix),
          ("best-fit packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
