"""Removal of word passages that an earlier document already holds.

Method: fixed-block anchors. A passage of `window` words holds at least one
whole block of `block_words` words that is aligned in the document it came
from, so indexing only the non-overlapping blocks and probing that index with
every rolling window of the same width finds a part of every repeat. Probes
are pre-aggregated in each block of documents, so a passage that a third of
the corpus shares costs one entry for each block of documents, not one for
each document. Runs of hits are then extended to whole passages, which are
settled by 96-bit hashes of all their words.

Rows: a null text is empty; an empty text has no words. A null doc_id is
larger than every id, so such a row loses what others hold and takes nothing
from them. Rows with the same doc_id never remove from each other. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphledger.llm import arrays as A
from graphledger.llm.blocks import blocked, opened
from graphledger.llm.common import bucket_count

Key = tuple[pa.Scalar, ...]
KEY_BITS = 38
PROBE = "bucket int, block int, keys binary"
PASSAGES = "bucket int, block int, first binary, second binary, ids binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long"
WITH_TEXT = RESULT + ", kept_text string"


def _keys(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket and KEY_BITS further bits of each hash."""
    return ((hashes >> A.U64(40)) % A.U64(buckets)).astype(np.int64), hashes & A.U64((1 << KEY_BITS) - 1)


def _joined(hashes: np.ndarray, buckets: int) -> np.ndarray:
    bucket, key = _keys(hashes, buckets)
    return (bucket.astype(np.uint64) << A.U64(KEY_BITS)) | key


class _Words:
    """The words of one run of documents."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.first = A.word_spans(buf, offsets)
        self.buf, self.offsets = buf, offsets

    def hashes(self, which: int) -> np.ndarray:
        return A.span_hashes(self.buf, self.starts, self.ends, which)


def _documents(table: pa.Table):
    ids, buf, offsets = opened(table)
    for i, j in A.runs(offsets):
        yield ids[i:j], _Words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _probe(buckets: int, width: int):
    """All rolling windows of a block of documents, each once: its key, whether documents here share it, whether it is an aligned block."""

    def run(key: Key, table: pa.Table) -> pa.Table:
        found = []
        for _, words in _documents(table):
            at = A.whole_windows(words.first, width)
            if not len(at):
                continue
            hashes = A.rolling(words.hashes(0), width)[at]
            owner = A.owners(words.first, at)
            aligned = (at - words.first[owner]) % width == 0
            order = np.argsort(hashes, kind="stable")
            hashes, owner, aligned = hashes[order], owner[order], aligned[order]
            begin = A.group_starts(hashes)
            many = np.maximum.reduceat(owner, begin) != np.minimum.reduceat(owner, begin)
            flags = many.astype(np.uint64) | (np.logical_or.reduceat(aligned, begin).astype(np.uint64) << A.U64(1))
            found.append((hashes[begin], flags))
        if not found:
            return _table(PROBE_SCHEMA, [])
        hashes, flags = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(hashes, kind="stable")  # the runs of a block together
        hashes, flags = hashes[order], flags[order]
        begin = A.group_starts(hashes)
        again = np.diff(np.append(begin, len(hashes))) > 1
        hashes, flags = hashes[begin], np.bitwise_or.reduceat(flags, begin) | again.astype(np.uint64)
        bucket, low = _keys(hashes, buckets)
        packed = (low << A.U64(2)) | flags
        order = np.argsort(bucket, kind="stable")
        bucket, packed = bucket[order], packed[order]
        block = key[0].as_py()
        return _table(PROBE_SCHEMA, [(b, block, A.narrow(packed[s:e], 5)) for b, s, e in A.rows_by(bucket)])

    return run


def _match(key: Key, table: pa.Table) -> pa.Table:
    """Keys of one bucket that at least two documents hold, told to every block that holds them."""
    blocks, packed = _unpacked(table, "keys", 5)
    low, flags = packed >> A.U64(2), packed & A.U64(3)
    order = np.argsort(low, kind="stable")
    begin = A.group_starts(low[order])
    size = np.diff(np.append(begin, len(low)))
    joint = np.bitwise_or.reduceat(flags[order], begin) if len(begin) else flags[:0]
    shared = (size > 1) | ((joint & A.U64(1)) > 0)
    keep = np.zeros(len(low), bool)
    keep[order] = np.repeat(shared, size)
    anchored = np.zeros(len(low), np.uint64)
    anchored[order] = np.repeat(joint >> A.U64(1), size)
    out = (low[keep] << A.U64(1)) | anchored[keep]
    bucket = key[0].as_py()
    return _table(PROBE_SCHEMA, [(bucket, b, A.narrow(out[s:e], 5)) for b, s, e in A.rows_by(blocks[keep])])


def _extend(buckets: int, width: int, window: int):
    """Passages of `window` words all of whose rolling windows are shared, one of them with an index block."""

    def run(key: Key, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table) or not len(replies):
            return _table(PASSAGE_SCHEMA, [])
        hits, anchors = _hits(replies)
        found = []
        for ids, words in _documents(table):
            at = A.whole_windows(words.first, window)
            if not len(at):
                continue
            one = words.hashes(0)
            probes = _joined(A.rolling(one, width), buckets)
            place = np.minimum(np.searchsorted(hits, probes), len(hits) - 1)
            hit = hits[place] == probes
            anchor = hit & anchors[place]
            inner = window - width + 1
            total = np.concatenate(([0], np.cumsum(hit)))
            lead = np.concatenate(([0], np.cumsum(anchor)))
            at = at[(total[at + inner] - total[at] == inner) & (lead[at + inner] > lead[at])]
            if len(at):
                found.append((A.rolling(one, window)[at], A.rolling(words.hashes(1), window, 1)[at], ids[A.owners(words.first, at)]))
        if not found:
            return _table(PASSAGE_SCHEMA, [])
        first, second, ids = _smallest(*(np.concatenate(x) for x in zip(*found)))
        bucket = (first % A.U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, first, second, ids = bucket[order], first[order], second[order], ids[order]
        block = key[0].as_py()
        return _table(PASSAGE_SCHEMA, [(b, block, first[s:e].tobytes(), A.narrow(second[s:e], 4), _ids_out(ids[s:e])) for b, s, e in A.rows_by(bucket)])

    return run


def _hits(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    bucket = np.repeat(replies["bucket"].to_numpy().astype(np.uint64), [len(x) // 5 for x in replies["keys"].to_pylist()])
    packed = A.widen(b"".join(replies["keys"].to_pylist()), 5)
    hits = (bucket << A.U64(KEY_BITS)) | (packed >> A.U64(1))
    order = np.argsort(hits)
    return hits[order], (packed[order] & A.U64(1)) > 0


def _smallest(first: np.ndarray, second: np.ndarray, ids: np.ndarray):
    """Each passage once, with the smallest id that holds it."""
    second = second & A.U64(0xFFFFFFFF)
    order = np.lexsort((ids, second, first))
    first, second, ids = first[order], second[order], ids[order]
    begin = _pair_starts(first, second)
    return first[begin], second[begin], ids[begin]


def _pair_starts(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]))))


def _ids_out(ids: np.ndarray) -> bytes:
    """Ids as 4 bytes each where they fit, else as 8; the first byte tells."""
    if len(ids) and 0 <= ids.min() and ids.max() < 1 << 32:
        return b"\4" + A.narrow(ids.astype(np.uint64), 4)
    return b"\10" + ids.astype("<i8").tobytes()


def _ids_in(payload: bytes) -> np.ndarray:
    if payload[0] == 4:
        return np.frombuffer(payload, "<u4", offset=1).astype(np.int64)
    return np.frombuffer(payload[1:], "<i8")


def _passages(table: pa.Table):
    first = np.frombuffer(b"".join(table["first"].to_pylist()), "<u8")
    second = A.widen(b"".join(table["second"].to_pylist()), 4)
    each = [_ids_in(x) for x in table["ids"].to_pylist()]
    blocks = np.repeat(table["block"].to_numpy(), [len(x) for x in each])
    return blocks, first, second, np.concatenate(each) if each else np.empty(0, np.int64)


def _settle(key: Key, table: pa.Table) -> pa.Table:
    """The smallest id of every passage, told to the blocks whose own smallest is larger."""
    blocks, first, second, ids = _passages(table)
    order = np.lexsort((ids, second, first))
    begin = _pair_starts(first[order], second[order])
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(ids[order][begin], np.diff(np.append(begin, len(ids))))
    tell = least < ids
    order = np.argsort(blocks[tell], kind="stable")
    blocks, first, second, least = (x[tell][order] for x in (blocks, first, second, least))
    bucket = key[0].as_py()
    return _table(PASSAGE_SCHEMA, [(bucket, b, first[s:e].tobytes(), A.narrow(second[s:e], 4), _ids_out(least[s:e])) for b, s, e in A.rows_by(blocks)])


def _remove(window: int, with_text: bool):
    def run(key: Key, table: pa.Table, replies: pa.Table) -> pa.Table:
        _, far, far_second, far_ids = _passages(replies)
        order = np.argsort(far, kind="stable")
        far, far_second, far_ids = far[order], far_second[order], far_ids[order]
        parts = []  # the passages of the whole block, to find the smallest id in it
        for ids, words in _documents(table):
            at = A.whole_windows(words.first, window)
            parts.append((ids, words, at, A.rolling(words.hashes(0), window)[at], A.rolling(words.hashes(1), window, 1)[at] & A.U64(0xFFFFFFFF)))
        holders = [ids[A.owners(w.first, at)] for ids, w, at, _, _ in parts]
        first = np.concatenate([p[3] for p in parts] or [np.empty(0, np.uint64)])
        second = np.concatenate([p[4] for p in parts] or [np.empty(0, np.uint64)])
        holder = np.concatenate(holders or [np.empty(0, np.int64)])
        order = np.lexsort((holder, second, first)) if _repeats(first) else None
        least = holder.copy()
        if order is not None:
            begin = _pair_starts(first[order], second[order])
            least[order] = np.repeat(holder[order][begin], np.diff(np.append(begin, len(holder))))
        if len(far):
            place = np.searchsorted(far, first)
            for _ in range(_longest_run(far)):  # entries with the same first hash stand side by side
                inside = np.minimum(place, len(far) - 1)
                same = (place < len(far)) & (far[inside] == first) & (far_second[inside] == second)
                least = np.where(same, np.minimum(least, far_ids[inside]), least)
                place = place + 1
        gone = least < holder
        rows, done = [], 0
        for ids, words, at, _, _ in parts:
            mask = A.covered(at[gone[done : done + len(at)]], window, int(words.first[-1]))
            done += len(at)
            for k in range(len(ids)):
                own = mask[words.first[k] : words.first[k + 1]]
                pieces_ = words.buf[words.offsets[k] : words.offsets[k + 1]].tobytes().split()
                removed = int(own.sum())
                kept = b" ".join(compress(pieces_, ~own) if removed else pieces_)
                spans = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if removed else 0
                row = (ids[k], len(own), removed, hashlib.sha256(kept).hexdigest(), spans)
                rows.append(row + (kept.decode(),) if with_text else row)
        return _result(rows, with_text)

    return run


def _repeats(values: np.ndarray) -> bool:
    ordered = np.sort(values)
    return bool((ordered[1:] == ordered[:-1]).any())


def _longest_run(ordered: np.ndarray) -> int:
    begin = A.group_starts(ordered)
    return int(np.diff(np.append(begin, len(ordered))).max()) if len(ordered) else 0


PROBE_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary())])
PASSAGE_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("first", pa.binary()), ("second", pa.binary()), ("ids", pa.binary())])


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _unpacked(table: pa.Table, column: str, size: int):
    """Block and key of every entry, blocks ascending."""
    table = table.take(pa.array(np.argsort(table["block"].to_numpy(), kind="stable")))
    payloads = table[column].to_pylist()
    return np.repeat(table["block"].to_numpy(), [len(x) // size for x in payloads]), A.widen(b"".join(payloads), size)


def _result(rows: list[tuple], with_text: bool) -> pa.Table:
    columns = list(zip(*rows)) or [()] * (6 if with_text else 5)
    arrays = [A.ids_back(np.array(columns[0], np.int64)), *(pa.array(list(columns[k]), t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.int64())))]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_spans"]
    if with_text:
        arrays.append(pa.array(list(columns[5]), pa.string()))
        names.append("kept_text")
    return pa.table(arrays, names=names)


def substring_dedup(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """Removes each word in a run of `window` words that a document with a smaller doc_id holds too.

    Returns one row for each document: doc_id, n_words, n_removed, kept_sha256,
    n_spans (maximal removed runs), and kept_text if asked for. Windows are
    judged on the input, not on what is left of it.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    buckets = bucket_count(docs)
    block_words = (window + 1) // 2
    dealt = blocked(docs)
    replies = dealt.groupBy("block").applyInArrow(_probe(buckets, block_words), PROBE).groupBy("bucket").applyInArrow(_match, PROBE)
    passages = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_extend(buckets, block_words, window), PASSAGES)
    settled = passages.groupBy("bucket").applyInArrow(_settle, PASSAGES)
    return dealt.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(_remove(window, with_text), WITH_TEXT if with_text else RESULT)
