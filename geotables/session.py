"""Spark session helpers.

Jobs read the shared checkpoint folder from the session (``spark.checkpoint.dir``). On a cluster that setting is
required; a local[...] session without it gets a folder of its own, because there is only one machine to share it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(cpus: int | str | None = None, shuffle_partitions: int | None = None,
              app: str = "geotables") -> SparkSession:
    """The session with the settings the plans rely on. Master and memory are the caller's (spark-submit, defaults
    file); ``cpus`` asks for a local session, as tests and the bench do."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cpus is not None:
        builder = builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def storage_root(spark: SparkSession) -> str:
    """Shared folder for written tables and checkpoints: ``spark.checkpoint.dir``, or the checkpoint folder set on
    the context. Without either, a local[...] session gets a fresh folder and any other session an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="geotables-local-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one written table."""
    return f"{storage_root(spark)}/geotables/{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def materialize(df):
    """Cut the lineage of a derived table that several branches of a plan read (a reliable checkpoint in the shared
    folder, never a machine-local one): it is computed once, and the plans reading it stay small."""
    storage_root(df.sparkSession)
    return df.checkpoint(eager=True)


def as_large(df):
    """A side of a join that grows with the input, for a sort-merge join. Spark sizes derived rows by their source, without the
    rows that generators add, and would collect millions of them on the driver as a table to broadcast."""
    return df.hint("merge")
