"""A session with the settings the engine is designed for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any scale; a cluster's own settings win over them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def session(app: str = "larder", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's workers, which need not have it; a session does so once."""
    import os
    import shutil
    import tempfile

    if spark.conf.get("larder.shipped", None) is None:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        # the driver's own file: Spark copies it to each executor
        spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/larder", "zip", root, "larder"))
        spark.conf.set("larder.shipped", "yes")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, dealt to all of them; a larger one as it is.

    A small file is one row group and so one task.  Work that costs more than moving the rows is worth the move;
    tables of any size have more partitions than cores and are not touched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """A folder for what an operator or query writes: in the shared folder that the session names, else (local tests only) below /tmp."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or "file:///tmp/larder-shared").rstrip("/") + "/larder"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: it is computed once, its size is known, and its lineage ends."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
