"""Canonical, length-limited Huffman codes, and blocks of ids that decode on their own."""

from __future__ import annotations

import numpy as np

#: Ids between two bit-offset checkpoints.
STRIDE = 128


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """The lengths of an optimal prefix code with no length over `limit`, by package merging.

    Symbols that never occur get length 0. A single symbol gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("too many symbols for that length limit")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.float64)
    n = len(used)
    # Of each level: which items of the merged list are packages of the level before.
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate((weight, packages))
        is_package = np.concatenate((np.zeros(n, bool), np.ones(len(packages), bool)))
        order = np.argsort(merged, kind="stable")
        merged, is_package = merged[order], is_package[order]
        levels.append(is_package)
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, out = 2 * n - 2, np.zeros(n, np.int64)
    for is_package in reversed(levels):
        inner = int(is_package[:take].sum())
        out[: take - inner] += 1
        take = 2 * inner
    lengths[used] = out
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then of symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for size in np.unique(lengths[order]):
        code <<= int(size) - last
        same = order[lengths[order] == size]
        codes[same] = np.arange(code, code + len(same), dtype=np.uint64)
        code, last = code + len(same), int(size)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for every value of the next `limit` bits."""
    limit = int(lengths.max()) if len(lengths) else 0
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = 1 << (limit - lengths[order].astype(np.int64))
    symbols = np.zeros(1 << limit, np.uint32)
    sizes = np.ones(1 << limit, np.uint8)
    first = (codes[order] << (limit - lengths[order].astype(np.uint64))).astype(np.int64)
    if len(order):
        filled = int(first[-1] + span[-1])
        symbols[:filled] = np.repeat(order, span)
        sizes[:filled] = np.repeat(lengths[order], span)
    return symbols, sizes, limit


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of some ids, and the bit offset of every STRIDE-th."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    offset = end - size
    total = int(end[-1]) if len(ids) else 0
    planes = (int(lengths.max() if len(lengths) else 0) + 14) // 8
    value = codes[ids] << (8 * planes - size - (offset & 7)).astype(np.uint64)
    place = offset >> 3
    out = np.zeros((total + 7) // 8 + planes, np.float64)
    for k in range(planes):  # codes never overlap, so bits add up
        byte = (value >> np.uint64(8 * (planes - 1 - k))) & np.uint64(255)
        part = np.bincount(place, weights=byte.astype(np.float64))
        out[k : k + len(part)] += part
    return out[: (total + 7) // 8].astype(np.uint8).tobytes(), offset[::STRIDE].astype("<u4")


def decode(bits: bytes, marks: np.ndarray, count: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of one block; all stretches between checkpoints advance together, one table look-up each."""
    symbols, sizes, limit = table
    lanes = len(marks)
    out = np.zeros((STRIDE, lanes), np.uint32)
    raw = np.concatenate((np.frombuffer(bits, np.uint8), np.zeros(16, np.uint8)))
    window = np.zeros(len(raw) - 4, np.uint32)
    for k in range(4):
        window |= raw[k : k + len(window)].astype(np.uint32) << np.uint32(24 - 8 * k)
    at = marks.astype(np.int64)
    last = len(window) - 1
    for step in range(STRIDE):
        live = lanes if step < (count - 1) % STRIDE + 1 else lanes - 1
        if live == 0:
            break
        at_ = at[:live]
        value = (window[np.minimum(at_ >> 3, last)] << (at_ & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[step, :live] = symbols[value]
        at[:live] += sizes[value]
    return out.T.reshape(-1)[:count]
