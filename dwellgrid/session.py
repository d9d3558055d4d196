"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Wall-clock timestamps carry no zone, so the session zone must not shift them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Rows unpack to about ten times what a shuffle moves; a task sorts its share in memory.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "24m",
    # The JVM never compiles longer methods; Spark then goes through the operators one by one, which it does.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Recording a call site for every column costs more than building the plan.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}

CODEC = "zstd"  # of stored tables


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, else a local one in a one-machine session.

    A cluster that names none is an error: its machines do not see each other's local folders.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="dwellgrid-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/dwellgrid/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage where a plan would otherwise be evaluated more than once; survives lost
    executors because the files are on shared storage, and later reads keep column pruning.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, label: str, by: str, buckets: int) -> DataFrame:
    """Like ``materialize``, in buckets of ``by``: windows and joins that keep ``by`` together need no shuffle."""
    spark = df.sparkSession
    name = f"dwellgrid_{label}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", CODEC).option("path", new_folder(spark, label))
    # With a few files open, a task need not put its rows in order of buckets first; with more buckets it still does.
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "4")
    try:
        writer.bucketBy(buckets, by).saveAsTable(name)
    finally:
        spark.conf.set(setting, before)
    return spark.table(name)
