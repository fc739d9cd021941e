"""Documents dealt into blocks, each block's texts packed and compressed together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from graphledger.llm import arrays as A
from graphledger.llm.common import BLOCKS_PER_PARTITION, block_count, lean, texts, width

SCHEMA = "block int, docs int, payload binary"


def _pack(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = A.ids_of(batch.column("doc_id"))
            buf, offsets = A.text_bytes(batch.column("text"))
            size = np.diff(offsets)
            block = (A.mix(ids.astype(np.uint64) ^ (size.astype(np.uint64) << A.U64(40))) % A.U64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            rows = []
            for b, i, j in A.rows_by(block[order]):
                own = order[i:j]
                head = np.stack((ids[own], size[own])).astype("<i8").tobytes()
                body = b"".join(buf[offsets[k] : offsets[k + 1]].tobytes() for k in own)
                rows.append((b, j - i, packer.compress(head + body)))
            columns = list(zip(*rows)) or [()] * 3
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=["block", "docs", "payload"])
        lean()

    return run


def blocked(docs: DataFrame) -> DataFrame:
    """Documents dealt into blocks by id and length. The same exchange serves every pass over them in one plan."""
    blocks = block_count(docs)
    return texts(docs).mapInArrow(_pack(blocks), SCHEMA).repartition(max(width(docs.sparkSession), blocks // BLOCKS_PER_PARTITION), "block")


def opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids, the bytes and the offsets of a block's texts, in an order that every pass sees."""
    lean()  # of the block before
    rows = sorted(zip(table["docs"].to_pylist(), table["payload"].to_pylist()))  # a shuffle may hand them over in any order
    ids, sizes, bodies = [], [], []
    for n, payload in rows:
        raw = zstandard.decompress(payload)
        head = np.frombuffer(raw, "<i8", 2 * n).reshape(2, n)
        ids.append(head[0]), sizes.append(head[1])
        bodies.append(np.frombuffer(raw, np.uint8, offset=16 * n))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint8), np.zeros(1, np.int64)
    return np.concatenate(ids), np.concatenate(bodies), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
