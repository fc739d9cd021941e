"""Session settings and small plan pieces that the operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # not glibc
    _libc = None

#: Blocks of documents for each shuffle partition, at least.
BLOCKS_PER_PARTITION = 2
#: Input, as it lies in its files, that a block takes at most on average, and that a bucket of keys may come from.
BLOCK_BYTES, BUCKET_BYTES = 24 << 20, 48 << 20


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(frame: DataFrame) -> int:
    """What the frame is read from, by the planner's figures; sources that tell no size count nothing."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def block_count(docs: DataFrame) -> int:
    """Enough blocks that each fits a task's memory, whatever the number of partitions."""
    return max(width(docs.sparkSession) * BLOCKS_PER_PARTITION, -(-input_bytes(docs) // BLOCK_BYTES))


def bucket_count(docs: DataFrame) -> int:
    """How many buckets keys are dealt into: the partition count, or more where the input asks for them."""
    return max(width(docs.sparkSession), -(-input_bytes(docs) // BUCKET_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


#: Up to so many ids (8 MB) a set of ids goes to every executor; beyond, the texts are shuffled to it.
FEW_IDS = 1 << 20


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The documents, with all their columns, whose doc_id is (left_semi) or is not (left_anti) among ids' doc_id."""
    ids = written(ids.select(F.col("doc_id").alias("_chosen")).distinct())
    key = ids["_chosen"]
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"] == key, how)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's spark.checkpoint.dir; where that is unset, a session of one machine gets a local one."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir", None)
    if top is None:
        top = context._jsc.sc().getCheckpointDir()
        top = top.get() if top.isDefined() else None
    if top is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="graphledger-")
        context.setCheckpointDir(top)
    return f"{top.rstrip('/')}/graphledger-{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there and a lost executor costs a re-read."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    frame.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that `written` made and nothing reads any more."""
    for table in tables:
        if table is not None:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_at)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def lean() -> None:
    """Gives memory that a Python worker no longer uses back to the machine; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)
