"""Token ids as files of canonical Huffman codes.

The file format is a folder with two Parquet tables:

* `code`: the length of each id's code; the canonical codes follow from them.
  Lengths are limited and come from the counts of all ids of all documents.
* `blocks`: stretches of whole documents in ascending doc_id order. A block
  has its shard and number, the index of its first id within the shard, its
  documents and their lengths, its bits, and the bit offset of every 128th id.
  Any block decodes alone, and any checkpoint starts a decoder inside it.

Rows: a null text is empty and has the end id alone. Null doc_ids come last;
repeated doc_ids stand side by side, in the order of a hash of their ids. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphledger.llm import arrays as A
from graphledger.llm import huffman as H
from graphledger.llm import tallies
from graphledger.llm.common import discard, lean, shared_folder, texts, width, written
from graphledger.llm.encoders import WordEncoder

#: A block is closed once it holds this many ids.
BLOCK_IDS = 1 << 17
IDS = "doc_id long, n_tokens long, ids binary"
BLOCKS = "shard int, block int, start long, n_ids long, doc_ids binary, sizes binary, bits binary, marks binary"
_encoders: dict[str, WordEncoder] = {}


def _narrow_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _tokenize(path: str, end_id: int, vocabulary: int):
    kind = _narrow_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            ids = [x.astype(kind).tobytes() + end for x in _encoders[path].ids(batch.column("text"))]
            sizes = pa.array([len(x) // len(end) for x in ids], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), sizes, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])
        lean()

    return run


def _count(vocabulary: int):
    kind, size = _narrow_type(vocabulary), _tally_size(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            joined, _ = A.text_bytes(batch.column("ids"))
            counts += np.bincount(joined.view(kind), minlength=size)
        if counts.any():
            yield tallies.packed(counts)

    return run


def _tally_size(vocabulary: int) -> int:
    return -(-vocabulary // tallies.SLICES) * tallies.SLICES


def _encode(lengths: np.ndarray, vocabulary: int):
    kind = _narrow_type(vocabulary)
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = H.canonical_codes(lengths)
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        held_ids, held = [], []

        def block() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in held], "<i8")
            bits, marks = H.encode(np.concatenate(held), codes, lengths)
            row = (shard, number, start, int(sizes.sum()), np.array(held_ids, "<i8").tobytes(), sizes.tobytes(), bits, marks.tobytes())
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=names)

        total = 0
        for batch in batches:
            for doc_id, packed in zip(A.ids_of(batch.column("doc_id")).tolist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(packed, kind)
                held_ids.append(doc_id), held.append(ids)
                total += len(ids)
                if total >= BLOCK_IDS:
                    yield block()
                    number, start, total, held_ids, held = number + 1, start + total, 0, [], []
        if held:
            yield block()
        lean()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, vocabulary: int) -> None:
    """Encodes every whole text, appends end_id to each document, and writes the folder `path`."""
    spark = docs.sparkSession
    tokens = written(texts(docs).mapInArrow(_tokenize(tokenizer_path, end_id, vocabulary), IDS).withColumn("place", F.xxhash64("ids")))
    counts = tallies.summed(tokens.select("ids").mapInArrow(_count(vocabulary), tallies.SCHEMA), _tally_size(vocabulary))
    lengths = H.code_lengths(counts, max(16, vocabulary.bit_length() + 1))
    # As many rows as the vocabulary at most.
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    # Ranges are drawn from small keys alone; the ids themselves only break ties inside a range.
    order = [F.asc_nulls_last("doc_id"), F.asc("place")]
    dealt = tokens.repartitionByRange(width(spark), *order).sortWithinPartitions(*order, F.asc("ids"))
    dealt.select("doc_id", "ids").mapInArrow(_encode(lengths, vocabulary), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    discard(tokens)


def _decode(lengths: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = H.decode_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], "<i8")
                ids = H.decode(row["bits"], np.frombuffer(row["marks"], "<u4"), row["n_ids"], table)
                start = np.cumsum(sizes) - sizes
                each = [ids[s : s + n].astype("<u4").tobytes() for s, n in zip(start.tolist(), sizes.tolist())]
                columns = [A.ids_back(np.frombuffer(row["doc_ids"], "<i8")), pa.array(start + row["start"]), pa.array(sizes), pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array([row["shard"]] * len(sizes), pa.int32())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").tolist() for x in each], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    return run


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    lengths = np.zeros(1, np.uint8)
    code = spark.read.schema("id int, bits int").parquet(f"{path}/code").collect()  # bounded by the vocabulary
    if code:
        lengths = np.zeros(max(r["id"] for r in code) + 1, np.uint8)
        lengths[[r["id"] for r in code]] = [r["bits"] for r in code]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row for each shard; blocks themselves stay where they are.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.cast("long").alias("first"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int" + (", ids array<long>" if with_ids else "")
    rows = blocks.mapInArrow(_decode(lengths, with_ids), schema).join(shards, "shard")
    return rows.select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_binary(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None, vocabulary: int = 49408) -> DataFrame:
    """Writes the documents' ids as files and returns what the files hold, one row for each document."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens"
    write_tokens(docs, tokenizer_path, end_id, path, vocabulary)
    return read_tokens(spark, path)
