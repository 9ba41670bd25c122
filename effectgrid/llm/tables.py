"""Intermediate tables in the shared folder, and small helpers on frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="effectgrid-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back.

    This cuts the lineage, survives lost executors, and unlike checkpoint()
    keeps columns that can be pruned. batch_rows bounds the rows that Python gets
    at a time while they are written; the session's setting stays as it was.
    """
    path = f"{shared_folder(df.sparkSession)}/effectgrid-{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    try:
        if batch_rows:
            conf.set(key, str(batch_rows))
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns; whatever else the caller's table carries is left out."""
    return df.select(*(F.col(f"`{c}`") for c in columns))
