"""Incremental ingestion: new rows of a graph table, each id once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from graphledger.operators.graph import SCHEMAS


def read_stream(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """JSON files as they arrive, with the table's fixed schema."""
    return spark.readStream.schema(SCHEMAS[name]).json(folder)


def evidence_once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Evidence rows, each id once within the delay; later copies of older ids are forgotten with their state."""
    return stream.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["evidence_id"])


def append_to(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a Parquet table and stops; a restart goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
