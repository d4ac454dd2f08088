"""Session defaults and staging of intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[str, list[str]] = {}  # by application, so that no session drops another's


def get_session(app: str = "lekhya", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow).

    Partition sizing is left to adaptive execution: a generous initial shuffle
    width is coalesced at run time, and skewed join partitions are split.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, a folder of the warehouse, which every executor can reach as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared staging folder and read it back.

    Cuts lineage, survives executor loss, and lets several later branches share
    one pass over the source.  Columnar, so each branch reads only what it needs.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_staged(spark: SparkSession) -> None:
    """Drop the tables this application staged, once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in _STAGED.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
