"""Removal of byte strings that an earlier document already holds, by suffix arrays.

Every window of `length` bytes has an anchor: the first of its short grams with
the smallest hash. Windows next to each other mostly share it, so a document
falls into runs of windows. A window reaches beyond its anchor by half of its
other bytes at least on one side, so two equal windows share the anchor with
that much context on that side. A run tells both such contexts, and only those
of its windows go on whose context two documents hold: chance hardly makes two
contexts equal, so what goes on follows what texts really share and not the
size of the corpus. Runs meet by anchor, each distinct run of a block of
documents once, and each bucket of runs gets a suffix array:

* two-stage sorting: suffixes smaller than their successors are sorted
  directly, all others are induced from them by scanning the array's buckets;
* common prefixes of adjacent suffixes show which windows are equal.

Suffixes are ordered by their first bytes up to a multiple of eight beyond
`length`; longer order is never needed. A context that very many documents
hold could gather many runs in one bucket, so its windows are dealt out singly,
by their own hash. Nothing is dropped.

Rows: a null text is empty. A null doc_id is larger than every id. Rows with
the same doc_id never remove from each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from graphledger.llm import arrays as A
from graphledger.llm.blocks import blocked, opened
from graphledger.llm.common import bucket_count

Key = tuple[pa.Scalar, ...]
KEY_BITS = 38
NO_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)
UPPER = np.uint64(0xFFFFFFFF00000000)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Estimated documents behind each count class of a context in one block, and the sum from which it is hot.
CLASS_SIZE = (1, 4, 32, 256)
CLASS_FROM = (1, 2, 8, 64)
HOT = 2048
#: Text of a bucket that one suffix array takes at most, but for what one anchor gathers.
SHARE_BYTES = 1 << 20

KEYS = "bucket int, block int, kind int, keys binary"
KEYS_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, KEYS_SCHEMA)], schema=KEYS_SCHEMA)


def _gram(length: int) -> int:
    return max(4, min(16, length // 3))


def sliding_argmin(hashes: np.ndarray, size: int) -> np.ndarray:
    """Where the smallest of every `size` consecutive hashes stands, by their upper halves, the first of equal ones.

    A hash's upper half and its place (under 2**32: a text is shorter) are one
    number, so each step is one minimum of two arrays.
    """
    out, have = (hashes & UPPER) | np.arange(len(hashes), dtype=np.uint64), 1
    while have * 2 <= size:
        out = np.minimum(out[have:], out[:-have])
        have *= 2
    if size > have:
        out = np.minimum(out[size - have :], out[: have - size])
    return (out & ~UPPER).astype(np.int64)


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket and KEY_BITS further bits of each hash, as one number."""
    return (((hashes >> A.U64(40)) % A.U64(buckets)) << A.U64(KEY_BITS)) | (hashes & A.U64((1 << KEY_BITS) - 1))


class Block:
    """The windows of a block of documents, as runs with one anchor: windows first..last of each, by byte offset.

    Windows up to `mid` are known by the left context of the anchor, later ones
    by the right one; a side without windows has no context. `contexts` are all
    their keys, each once, ascending.
    """

    def __init__(self, table: pa.Table, buckets: int, length: int):
        self.ids, self.buf, self.offsets = opened(table)
        gram = _gram(length)
        left = -(-(length - gram) // 2)
        right = length - gram - left + 1
        parts = []
        for i, j in A.runs(self.offsets):
            base = self.offsets[i]
            buf, offsets = self.buf[base : self.offsets[j]], self.offsets[i : j + 1] - base
            at = A.whole_windows(offsets, length)
            if not len(at):
                continue
            grams = A.rolling(A._byte_table(0)[buf], gram)
            place = sliding_argmin(grams, length - gram + 1)[at]
            begin = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))))
            first, last, place = at[begin], at[np.append(begin[1:], len(at)) - 1], place[begin]
            mid = place - left
            sides = []
            for which, has, start, end in ((0, first <= mid, mid, place + gram), (1, last > mid, place, place + gram + right)):
                key = np.full(len(place), NO_KEY)
                key[has] = _keys(A.span_hashes(buf, start[has], end[has], which), buckets)
                sides.append(key)
            parts.append((first + base, last + base, mid + base, A.mix(grams[place]), A.owners(offsets, first) + i, *sides))
        empty = [(np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, np.int64)) + (np.empty(0, np.uint64),) * 2]
        self.first, self.last, self.mid, self.anchor, self.owner, *self.sides = (np.concatenate(x) for x in zip(*(parts or empty)))
        keys, owner = np.concatenate(self.sides), np.concatenate((self.owner, self.owner))
        real = keys != NO_KEY
        self.held = keys[real], owner[real]
        ordered = np.sort(keys[real])  # np.unique would hash them first
        self.contexts = ordered[A.group_starts(ordered)]


def _probe(buckets: int, length: int):
    """The contexts of a block of documents, with a class for how many documents here hold each."""

    def run(key: Key, table: pa.Table) -> pa.Table:
        block = Block(table, buckets, length)
        keys, owner = block.held
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))) if len(keys) else np.empty(0, bool)
        keys = keys[new]
        begin = A.group_starts(keys)
        count = np.diff(np.append(begin, len(keys)))
        packed = ((keys[begin] & A.U64((1 << KEY_BITS) - 1)) << A.U64(2)) | (np.searchsorted(CLASS_FROM, count, "right") - 1).astype(np.uint64)
        name = key[0].as_py()
        return _rows([(b, name, e - s, A.narrow(packed[s:e], 5)) for b, s, e in A.rows_by((keys[begin] >> A.U64(KEY_BITS)).astype(np.int64))])

    return run


def _match(hot: int):
    """Tells each block which of its contexts in one bucket another document holds too, and which are hot; two bits for each."""

    def run(key: Key, table: pa.Table) -> pa.Table:
        counts = table["kind"].to_numpy().astype(np.int64)
        packed = A.widen(b"".join(table["keys"].to_pylist()), 5)
        low, size = packed >> A.U64(2), np.array(CLASS_SIZE)[(packed & A.U64(3)).astype(np.int64)]
        order = np.argsort(low, kind="stable")
        begin = A.group_starts(low[order])
        total = np.add.reduceat(size[order], begin) if len(begin) else size[:0]
        spread = np.empty(len(low), np.int64)
        spread[order] = np.repeat(total, np.diff(np.append(begin, len(low))))
        ends = np.cumsum(counts)
        bucket = key[0].as_py()
        return _rows([(bucket, b, n, _told(spread[e - n : e] > 1, spread[e - n : e] > hot)) for b, n, e in zip(table["block"].to_pylist(), counts.tolist(), ends.tolist())])

    return run


def _told(shared: np.ndarray, hot: np.ndarray) -> bytes:
    return b"".join(np.packbits(x).tobytes() for x in ((shared, hot) if hot.any() else (shared,)))


def _heard(n: int, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = -(-n // 8)
    raw = np.frombuffer(payload, np.uint8)
    return tuple(np.unpackbits(x, count=n).astype(bool) if len(x) else np.zeros(n, bool) for x in (raw[:size], raw[size:]))


class Strings:
    """The distinct strings that a block of documents sends on, and where each occurs.

    Both the sending and the settling pass build this from the same rows, so a
    string's number means the same in both. told: for each bucket what _match said.
    """

    def __init__(self, table: pa.Table, told: dict[int, bytes], buckets: int, length: int):
        block = Block(table, buckets, length)
        self.ids, self.buf, self.offsets = block.ids, block.buf, block.offsets
        heard = [_heard(e - s, told[b]) for b, s, e in A.rows_by((block.contexts >> A.U64(KEY_BITS)).astype(np.int64))]
        shared, hot = (np.concatenate(x) for x in zip(*heard)) if heard else (np.empty(0, bool),) * 2
        kept, cut = [], []
        for side in block.sides:
            at = np.searchsorted(block.contexts, side)
            real = side != NO_KEY
            at[~real] = 0
            kept.append(real & shared[at] & ~hot[at] if len(shared) else real)
            cut.append(real & hot[at] if len(shared) else real)
        whole_first = np.where(kept[0], block.first, np.maximum(block.first, block.mid + 1))
        whole_last = np.where(kept[1], block.last, np.minimum(block.last, block.mid))
        some = whole_first <= whole_last
        first, last, owner, target = whole_first[some], whole_last[some], block.owner[some], block.anchor[some]
        singles = []
        for which, start, end in ((cut[0], block.first, np.minimum(block.last, block.mid)), (cut[1], np.maximum(block.first, block.mid + 1), block.last)):
            count = end[which] - start[which] + 1
            singles.append((A_range(start[which], count), np.repeat(block.owner[which], count)))
        single, single_owner = (np.concatenate(x) for x in zip(*singles))
        first, last, owner = np.concatenate((first, single)), np.concatenate((last, single)), np.concatenate((owner, single_owner))
        one, two = (A.span_hashes(self.buf, first, last + length, k) for k in (0, 1))
        target = np.concatenate((target, one[len(target) :]))
        self.start, self.windows, self.owner = first, last - first + 1, owner
        holder = self.ids[self.owner]
        order = np.lexsort((self.start, holder, two, one))
        begin = np.flatnonzero(np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))) if len(order) else order
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        lead = order[begin]
        self.least, self.target, self.text_at, self.count = holder[lead], target[lead], self.start[lead], self.windows[lead]


def _send(buckets: int, length: int):
    def run(key: Key, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table) or not len(replies):
            return _rows([])
        known = dict(zip(replies["bucket"].to_pylist(), replies["keys"].to_pylist()))
        s = Strings(table, known, buckets, length)
        bucket = (s.target % A.U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        packer = zstandard.ZstdCompressor(level=1)
        block = key[0].as_py()
        strings = {}
        for b, i, j in A.rows_by(bucket[order]):
            own = order[i:j]
            head = np.stack((own, s.count[own], s.least[own], (s.target[own] // A.U64(buckets) & A.U64(0xFFFF)).astype(np.int64))).astype("<i8").tobytes()
            size = s.count[own] + length - 1
            at = np.repeat(s.text_at[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            strings[b] = (len(own), packer.compress(head + s.buf[at].tobytes()))
        # What the block was told goes along and comes back with the answer, so that it need not be asked for again.
        rows = [(b, block, strings.get(b, (0, b""))[0], _both(known.get(b, b""), strings.get(b, (0, b""))[1])) for b in sorted({*known, *strings})]
        return _rows(rows)

    return run


def _both(anchors: bytes, rest: bytes) -> bytes:
    return len(anchors).to_bytes(8, "little") + anchors + rest


def _parts(payload: bytes) -> tuple[bytes, bytes]:
    end = 8 + int.from_bytes(payload[:8], "little")
    return payload[8:end], payload[end:]


def words_at(text: np.ndarray, size: int) -> np.ndarray:
    """The eight bytes from each of the first `size` places, as numbers that order as the bytes do."""
    out = np.zeros(size, np.uint64)
    for k in range(8):
        out |= text[k : k + size].astype(np.uint64) << A.U64(56 - 8 * k)
    return out


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two-stage suffix sorting of a text that ends in length + 17 zeros, the first of which counts as its last symbol.

    Returns the suffix array, in order of at least the first `length` bytes,
    and the numbers of words_at for all places.
    """
    n = len(text) - length - 16
    words = words_at(text, len(text) - 8)
    here, after = text[:n], text[1 : n + 1]
    differs = np.where(here != after, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(differs[::-1])[::-1]
    smaller = (here[nearest] < after[nearest]) | (here == 0)
    # Stage one: suffixes smaller than their successors, eight bytes at a time, only ties go on.
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(words[direct], kind="stable")]
    group = np.cumsum(np.concatenate(([0], (words[direct][1:] != words[direct][:-1]).astype(np.int64)))) if len(direct) else direct
    for depth in range(8, length, 8):
        size = np.bincount(group) if len(group) else group
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_):
            break
        key = words[direct[open_] + depth]
        order = np.lexsort((key, group[open_]))
        direct[open_] = direct[open_][order]
        key = key[order]
        step = np.zeros(len(group), np.int64)
        step[1:] = group[1:] != group[:-1]
        inside = (open_[1:] == open_[:-1] + 1) & (group[open_[1:]] == group[open_[:-1]]) & (key[1:] != key[:-1])
        step[open_[1:][inside]] = 1
        group = np.cumsum(step)
    # Stage two: scan the buckets upwards; each suffix induces the one before it, if that is the larger.
    head = here[direct]
    bounds = np.searchsorted(head, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        line = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        larger = [line]
        while len(line):
            line = line[line > 0] - 1
            line = line[here[line] == c]
            larger.append(line)
        bucket = np.concatenate((*larger, direct[bounds[c] : bounds[c + 1]]))
        out.append(bucket)
        waiting[c] = []
        before = bucket[bucket > 0] - 1
        symbol = here[before]
        before, symbol = before[symbol > c], symbol[symbol > c]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        for s, i, j in A.rows_by(symbol):
            waiting[s].append(before[i:j])
    return np.concatenate(out), words


def adjacent_prefixes(words: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """How many bytes each suffix shares with the one before it: whole eights, or `length` and more as `length`."""
    shared = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for depth in [*range(0, length - 7, 8), length - 8]:
        live = live[words[order[live] + depth] == words[order[live - 1] + depth]]
        shared[live] = depth + 8
    return shared


def _settle(length: int):
    """A suffix array over one bucket's distinct strings; tells each block which windows have a smaller holder."""

    def run(key: Key, table: pa.Table) -> pa.Table:
        anchors, block, heads, texts = {}, [], [], []
        for b, n, payload in zip(table["block"].to_pylist(), table["kind"].to_pylist(), table["keys"].to_pylist()):
            anchors[b], packed = _parts(payload)
            if n:
                raw = zstandard.decompress(packed)
                block.append(np.full(n, b))
                heads.append(np.frombuffer(raw, "<i8", 4 * n).reshape(4, n))
                texts.append(np.frombuffer(raw, np.uint8, offset=32 * n))
        bucket = key[0].as_py()
        if not block:
            return _rows([(bucket, b, 0, _both(known, b"")) for b, known in anchors.items()])
        block, raw = np.concatenate(block), np.concatenate(texts)
        number, count, holder, target = np.concatenate(heads, axis=1)
        size = count + length - 1
        start = np.cumsum(size) - size
        # Equal windows have equal targets, so a large bucket is worked through in shares of targets.
        share = target % max(1, -(-len(raw) // SHARE_BYTES))
        order = np.argsort(share, kind="stable")
        told = []
        for _, i, j in A.rows_by(share[order]):
            own = order[i:j]
            text = raw[A_range(start[own], size[own])]
            told.extend(_smaller_holders(text, block[own], number[own], count[own], holder[own], length))
        answers = {b: (n, zstandard.compress(x, 1)) for b, n, x in _by_block(told)}
        return _rows([(bucket, b, answers.get(b, (0, b""))[0], _both(known, answers.get(b, (0, b""))[1])) for b, known in anchors.items()])

    return run


def _by_block(told: list[tuple[int, np.ndarray]]):
    blocks = np.array([b for b, _ in told], np.int64)
    for b in np.unique(blocks):
        joined = np.concatenate([x for c, x in told if c == b], axis=1)
        yield int(b), joined.shape[1], joined.astype("<i8").tobytes()


def _smaller_holders(raw: np.ndarray, block: np.ndarray, number: np.ndarray, count: np.ndarray, holder: np.ndarray, length: int):
    """For each block: string, first window, windows and smallest holder, where that is smaller than the string's own."""
    size = count + length - 1
    start = np.cumsum(size) - size
    one, two = (A.span_hashes(raw, start, start + size, k) for k in (0, 1))
    order = np.lexsort((holder, two, one))
    begin = np.flatnonzero(np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))))
    same = np.empty(len(order), np.int64)
    same[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
    lead = order[begin]  # each distinct string once, with its smallest holder
    u_size, u_count, u_holder = size[lead], count[lead], holder[lead]
    u_start = np.cumsum(u_size + 1) - u_size - 1
    text = np.zeros(int(u_size.sum()) + len(lead) + length + 16, np.uint8)
    text[A_range(u_start, u_size)] = raw[A_range(start[lead], u_size)]
    suffixes, words = suffix_order(text, length)
    owner = np.full(len(text), -1, np.int32)
    owner[A_range(u_start, u_count)] = np.repeat(np.arange(len(lead)), u_count)
    suffixes = suffixes[owner[suffixes] >= 0]  # those that a whole window starts
    shared = adjacent_prefixes(words, suffixes, length)
    begin = np.flatnonzero(shared < length)
    least = np.minimum.reduceat(u_holder[owner[suffixes]], begin)
    at = np.empty(len(text), np.int64)
    at[suffixes] = np.repeat(least, np.diff(np.append(begin, len(suffixes))))
    by = np.argsort(block, kind="stable")
    for b, i, j in A.rows_by(block[by]):
        own = by[i:j]
        best, mine = at[A_range(u_start[same[own]], count[own])], np.repeat(holder[own], count[own])
        place = A_range(np.zeros(len(own), np.int64), count[own])
        what = np.repeat(number[own], count[own])
        tell = best < mine
        best, place, what = best[tell], place[tell], what[tell]
        if len(best):
            new = np.flatnonzero(np.concatenate(([True], (what[1:] != what[:-1]) | (best[1:] != best[:-1]) | (place[1:] != place[:-1] + 1))))
            yield b, np.stack((what[new], place[new], np.diff(np.append(new, len(best))), best[new]))


def A_range(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., size[0] of them, then the same for the next."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _remove(buckets: int, length: int, with_kept: bool):
    def run(key: Key, table: pa.Table, replies: pa.Table) -> pa.Table:
        parts = [_parts(x) for x in replies["keys"].to_pylist()]
        s = Strings(table, dict(zip(replies["bucket"].to_pylist(), (x for x, _ in parts))), buckets, length)
        least = np.repeat(s.least, s.count)
        begin = np.cumsum(s.count) - s.count
        for n, (_, payload) in zip(replies["kind"].to_pylist(), parts):
            if n:
                what, place, long, best = np.frombuffer(zstandard.decompress(payload), "<i8").reshape(4, n)
                at = A_range(begin[what] + place, long)
                least[at] = np.minimum(least[at], np.repeat(best, long))
        theirs = least[A_range(begin[s.number], s.windows)]
        gone = A_range(s.start, s.windows)[theirs < np.repeat(s.ids[s.owner], s.windows)]
        mask = A.covered(gone, length, len(s.buf))
        opens = mask.copy()
        opens[1:] &= ~mask[:-1]
        inner = s.offsets[1:-1][s.offsets[1:-1] < len(s.buf)]
        opens[inner] = mask[inner]
        removed, spans = (np.concatenate(([0], np.cumsum(x)))[s.offsets] for x in (mask, opens))
        removed, spans = np.diff(removed), np.diff(spans)
        kept = []
        for k in range(len(s.ids)):
            own = s.buf[s.offsets[k] : s.offsets[k + 1]]
            kept.append((own[~mask[s.offsets[k] : s.offsets[k + 1]]] if removed[k] else own).tobytes())
        columns = [A.ids_back(s.ids), pa.array(np.diff(s.offsets)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_kept:
            columns.append(pa.array(kept, pa.binary()))
            names.append("kept")
        return pa.table(columns, names=names)

    return run


def suffix_dedup(docs: DataFrame, length: int = 50, with_kept: bool = False, hot: int = HOT) -> DataFrame:
    """Removes each byte in a string of `length` bytes that also starts in a document with a smaller doc_id.

    Returns one row for each document: doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256, and the kept bytes if asked for.
    Strings are judged on the input, not on what is left of it; overlaps count.
    hot: from about so many documents on, a context's windows are dealt out singly.
    """
    if length < 16:
        raise ValueError("length must be at least 16 bytes")
    buckets = bucket_count(docs)
    dealt = blocked(docs)
    told = dealt.groupBy("block").applyInArrow(_probe(buckets, length), KEYS).groupBy("bucket").applyInArrow(_match(hot), KEYS)
    strings = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_send(buckets, length), KEYS)
    settled = strings.groupBy("bucket").applyInArrow(_settle(length), KEYS)
    schema = RESULT + (", kept binary" if with_kept else "")
    return dealt.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(_remove(buckets, length, with_kept), schema)
