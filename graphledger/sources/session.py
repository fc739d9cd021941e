"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def attach(spark: SparkSession) -> SparkSession:
    """Adds the repository to the workers' module path, for sessions that were started without it."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_top(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a session of one machine that names none gets one of its own."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir", None)
    if top is None and context._jsc.sc().getCheckpointDir().isDefined():
        top = context._jsc.sc().getCheckpointDir().get()
    if top is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="graphledger-")
        context.setCheckpointDir(top)
    return top.rstrip("/")


def settled(frame: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: computed once, without its history, and safe when executors are lost."""
    spark = frame.sparkSession
    path = f"{shared_top(spark)}/graphledger-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
