"""Graph tables in and out: JSON lines with their input order, and Parquet."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphledger.operators.graph import SCHEMAS, Graph, conform, first_wins

KEYS = {"entities": "entity_id", "facts": "fact_id", "support_facts": "fact_id", "evidence": "evidence_id", "coverage": "coverage_id"}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file with a fixed schema, blank lines skipped; ord grows with the place in the input.

    A line that is no object fails the read.
    """
    # Splits are planned by size, so rows are put in order by file and place before they are numbered.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    lines = lines.orderBy("file", "start", "row").withColumn("ord", F.monotonically_increasing_id()).where(F.trim("value") != "")
    bare = ", ".join(p for p in schema.split(", ") if not p.startswith("ord "))
    rows = lines.select(F.from_json("value", bare, {"mode": "FAILFAST"}).alias("r"), "ord").select("r.*", "ord")
    return conform(rows, schema)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table once by id, the first row of an id winning; facts by predicate, so that queries read what they ask for."""
    for name, frame in tables.items():
        rows = first_wins(frame, KEYS[name])
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("predicate") if name == "facts" else writer).parquet(f"{path}/{name}")


def read_jsonl_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_jsonl, or no rows where nothing is at the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return read_jsonl(spark, path, schema)
    return conform(spark.createDataFrame([], schema), schema)


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """write_tables as a whole: readers see all old tables or all new ones; a failed write leaves the old ones.

    The new tables are written beside the old ones, which one rename then replaces.
    """
    path = path.rstrip("/")
    staged, old = (f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("staged", "old"))
    at, new, gone = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, staged, old))
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write_tables(tables, staged)
    except Exception:
        store.delete(new, True)
        raise
    if store.exists(at) and not store.rename(at, gone):
        raise OSError(f"{path} cannot be moved")
    if not store.rename(new, at):
        store.rename(gone, at)
        raise OSError(f"{staged} cannot be moved")
    store.delete(gone, True)


def read_graph(spark: SparkSession, path: str) -> Graph:
    table = lambda name: conform(spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}"), SCHEMAS[name])
    return Graph(table("entities"), table("facts"), table("evidence"), table("coverage"))


def read_manifest(path: str) -> dict:
    """A snapshot's manifest, which must be one JSON object."""
    value = json.loads(Path(path).read_text())
    if not isinstance(value, dict):
        raise ValueError(f"{path} is not a JSON object")
    return value


def fingerprint(repos: DataFrame) -> DataFrame:
    """One digest over all repositories' names and commits, to skip a rebuild that would change nothing."""
    return repos.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("name", "commit_sha")))), 256).alias("fingerprint"))
