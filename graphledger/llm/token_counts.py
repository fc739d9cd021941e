"""Token counts by a digest cache.

A text's count is stored under the digest of its content and of the tokenizer
(the vocabulary file and the way it is used). Counts are joined from the
cache; only distinct texts that it lacks are encoded, once each, and appended.

Rows: a null text counts as empty and has no tokens. A null doc_id stays null.
Repeated rows each get their row. Other columns are ignored. Texts are only
normalised from null to empty, since all else would change what is counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphledger.llm.common import shared_folder, texts
from graphledger.llm.encoders import PieceCounter

CACHE = "digest binary, version string, n_tokens long"
_counters: dict[str, PieceCounter] = {}


def version_of(path: str) -> str:
    """Names the tokenizer: the file's content, and that counts are without begin and end tokens."""
    return hashlib.sha256(Path(path).read_bytes() + b"|plain").hexdigest()


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = PieceCounter(path)
        for batch in batches:
            counts = _counters[path].counts(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["digest", "version", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, cache_path: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    cache_path: a folder in a store that all executors reach; it is read if it
    is there, and what was missing is appended to it. Without it each call
    begins with an empty cache in a new folder, as the registered query does,
    and every distinct text is encoded once.
    """
    spark = docs.sparkSession
    version = version_of(model_path)
    path = cache_path or f"{shared_folder(spark)}/token_counts"
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
    known = spark.read.schema(CACHE).parquet(path).where(F.col("version") == version)
    whole = texts(docs).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = whole.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    # One row of each missing text; the doc_id spreads the copies of a text before texts are moved.
    missing = keys.groupBy("digest").agg(F.min("doc_id").alias("lead")).join(known.select("digest"), "digest", "left_anti")
    m = missing.select(F.col("digest").alias("m_digest"), F.col("lead").alias("m_lead"))
    leads = whole.join(m, (whole.digest == m.m_digest) & F.col("doc_id").eqNullSafe(F.col("m_lead")), "left_semi")
    leads.select("digest", "text").mapInArrow(_encode(model_path, version), CACHE).write.mode("append").parquet(path)
    counted = spark.read.schema(CACHE).parquet(path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    out = keys.join(counted, "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
