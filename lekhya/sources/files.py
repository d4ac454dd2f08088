"""File sources and sinks: batch folders, page engines, OCR tables, tables as CSV."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lekhya.session import stage
from lekhya.operators.ingest import immutable_appends, immutable_conflicts

PAGE_SCHEMA = ("page_number int, raw_text string, image_count int, word_count int, "
               "tables array<struct<table_index:int,headers:array<string>,"
               "rows:array<array<string>>>>")
SIDECAR = ("title string, doc_type string, department_id string, go_number string, "
           "issued_on string, classification string")


def read_batch_folder(spark: SparkSession, path: str) -> DataFrame:
    """PDF files below a folder with the JSON file of the same name, if there is one."""
    def files(pattern: str) -> DataFrame:
        return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                .option("pathGlobFilter", pattern).load(path)
                .withColumn("stem", F.regexp_replace("path", r"\.[A-Za-z]+$", "")))

    meta = files("*.json").select("stem", F.from_json(
        F.col("content").cast("string"), SIDECAR).alias("m")).select("stem", "m.*")
    pdf = files("*.pdf").select("stem", "path", F.col("content").alias("data"),
                                F.col("length").alias("byte_size"), "modificationTime")
    name = F.regexp_extract("stem", r"([^/]+)$", 1)
    return (pdf.join(meta, "stem", "left")
            .withColumn("title", F.coalesce("title", name)).drop("stem"))


def pdf_pages(data: bytes) -> list[dict]:
    """Default page engine; needs an optional PDF library."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("no PDF library installed; pass an engine") from e
    with fitz.open(stream=data, filetype="pdf") as doc:
        return [{"page_number": i + 1, "raw_text": page.get_text("text"),
                 "image_count": len(page.get_images()),
                 "word_count": len(page.get_text("text").split()), "tables": []}
                for i, page in enumerate(doc)]


def read_pages(files: DataFrame, id_col: str, data: str = "data",
               engine: Callable[[bytes], Iterable[dict]] = pdf_pages) -> DataFrame:
    """One row per page of each file, by a page engine that runs inside the tasks."""
    id_type = files.schema[id_col].dataType.simpleString()
    names = ["page_number", "raw_text", "image_count", "word_count", "tables"]

    def run(batches):
        for pdf in batches:
            for key, body in zip(pdf[id_col], pdf[data]):
                pages = pd.DataFrame(list(engine(body)), columns=names)
                pages.insert(0, id_col, key)
                yield pages

    return files.select(id_col, data).mapInPandas(run, f"{id_col} {id_type}, {PAGE_SCHEMA}")


def ocr_blocks(tsv: DataFrame, page_keys: list[str]) -> DataFrame:
    """Text blocks from word rows of an OCR table.

    ``tsv``: page keys, level, block_num, par_num, line_num, word_num, left, top, width,
    height, conf, text.  Words without confidence are dropped; a block's box is its own
    level-2 row, else the envelope of its words.
    """
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    boxes = (tsv.filter("level = 2").groupBy(*page_keys, "block_num")
             .agg(F.max_by(F.array("left", "top", right, bottom), "word_num").alias("own")))
    words = tsv.filter("level = 5 AND conf >= 0 AND trim(text) <> ''").select(
        *page_keys, "block_num", F.struct("par_num", "line_num").alias("line"),
        "word_num", F.trim("text").alias("text"),
        F.least("conf", F.lit(100.0)).alias("conf"), "left", "top",
        right.alias("right"), bottom.alias("bottom"))
    # a line, a block and a page are bounded by the paper they were scanned from
    lines = words.groupBy(*page_keys, "block_num", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", "text"))),
                                 lambda w: w["text"]), " ").alias("text"),
        F.sum("conf").alias("conf"), F.count(F.lit(1)).alias("n"), F.min("left").alias("x0"),
        F.min("top").alias("y0"), F.max("right").alias("x1"), F.max("bottom").alias("y1"))
    blocks = lines.groupBy(*page_keys, "block_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))),
                                 lambda x: x["text"]), "\n").alias("text"),
        F.sum("conf").alias("conf"), F.sum("n").alias("words"),
        F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("envelope"))
    joined = blocks.join(boxes, [*page_keys, "block_num"], "left")
    wide = F.get("own", F.lit(2)) > F.get("own", F.lit(0))
    box = F.when(F.coalesce(wide, F.lit(False)), F.col("own")).otherwise(F.col("envelope"))
    return joined.select(*page_keys, "block_num", "text",
                         F.transform(box, lambda v: F.round(v, 2)).alias("bbox"),
                         F.round(F.col("conf") / (F.col("words") * 100), 4).alias("confidence"),
                         F.col("conf").alias("conf_sum"), "words")


def ocr_pages(blocks: DataFrame, page_keys: list[str]) -> DataFrame:
    """Page text in block order with the word-weighted confidence."""
    return blocks.groupBy(*page_keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_num", "text"))),
                                 lambda b: b["text"]), "\n\n").alias("ocr_text"),
        F.round(F.sum("conf_sum") / (F.sum("words") * 100), 4).alias("confidence"))


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    schema = ("level int, page_num int, block_num int, par_num int, line_num int, word_num int, "
              "left double, top double, width double, height double, conf double, text string")
    return spark.read.csv(path, schema=schema, sep="\t", header=True, quote="")


def write_tables_csv(tables: DataFrame, path: str) -> None:
    """Table rows as CSV files, one folder per version and page."""
    (tables.select("version_id", "page_number", "table_index", F.posexplode("rows")
                   .alias("row_index", "cells"))
     .select("version_id", "page_number", "table_index", "row_index",
             F.to_csv(F.struct(F.to_json("cells").alias("c"))).alias("line"))
     .write.mode("overwrite").partitionBy("version_id", "page_number").csv(path))


def append_objects(incoming: DataFrame, path: str) -> int:
    """Append objects to a write-once store; returns how many were new.

    ``incoming``: object_key, sha256, data.  The same object again is no-op; another
    content under a stored key, several contents under one key of the batch, or a wrong or
    missing checksum stop the append before anything is written.
    """
    spark = incoming.sparkSession
    batch = stage(incoming)
    right = F.sha2("data", 256) == F.lower("sha256")
    if not batch.filter(~F.coalesce(right, F.lit(False))).isEmpty():
        raise ValueError("checksum mismatch")
    try:
        stored = spark.read.parquet(path).select("object_key", "sha256")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], "object_key string, sha256 string")
    keys = batch.groupBy("object_key").agg(F.min(F.lower("sha256")).alias("lo"),
                                           F.max(F.lower("sha256")).alias("hi"))
    if not keys.filter("lo <> hi").isEmpty():
        raise ValueError("one key with several contents in the batch")
    if not immutable_conflicts(batch, stored).isEmpty():
        raise ValueError("stored key with other content")
    fresh = stage(immutable_appends(batch.dropDuplicates(["object_key"]), stored))
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def verify_objects(objects: DataFrame) -> DataFrame:
    """Objects whose content no longer has the recorded hash."""
    return objects.filter(F.sha2("data", 256) != F.lower("sha256"))


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and hash of every file below a folder (backup verification)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"),
                    F.col("modificationTime").alias("modified")))
