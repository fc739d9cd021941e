"""Array views of text columns: word spans, rolling hashes and compact payloads.

Everything here works on one flat byte buffer holding many texts, so that a
Python worker spends its time in numpy and never loops over words.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: A word is a maximal run of bytes other than space and \t \n \v \f \r.
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
#: A-Z as a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Stands for a null id inside the arrays: larger than every real id.
NO_ID = np.iinfo(np.int64).max
#: Texts are worked on in runs of about this many bytes.
RUN_BYTES = 1 << 20

#: Longer spans are hashed one by one.
LONG_SPAN = 256
#: The first 0 to 8 bytes of a little-endian word.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_BYTE_SEEDS = (0x51A7, 0x9C3B)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that all bits depend on all."""
    x = x ^ (x >> U64(31))
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


@functools.cache
def _byte_table(which: int) -> np.ndarray:
    rng = np.random.default_rng(_BYTE_SEEDS[which])
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


#: Longer tables of powers are made anew each time, so that one very long text does not stay in a worker's memory.
MOST_POWERS = 1 << 21
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        keep = size <= MOST_POWERS
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        have = (out[0], out[1])
        if keep:
            _powers[which] = have
    return have[0][:n], have[1][:n]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more for the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no rows
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES):
    """Splits texts into consecutive runs of about `limit` bytes: (first, last + 1)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def word_spans(buf: np.ndarray, offsets: np.ndarray):
    """Starts and ends of all words, and the index of each text's first word."""
    n = len(buf)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    is_word = WORD_BYTE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1] | edge[1:n]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span: eight bytes at a time, each mixed in before the next, long spans by BLAKE2.

    Nothing here is linear in the bytes, so texts that are related (as the two
    Thue-Morse words, which collide under every polynomial modulo 2**64) are
    no likelier to meet than any others.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) ^ U64(_BASES[which]))
    many = size > LONG_SPAN
    for k in np.flatnonzero(many).tolist():
        digest = hashlib.blake2b(buf[starts[k] : ends[k]], digest_size=8, salt=bytes([which])).digest()
        out[k] = int.from_bytes(digest, "little")
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    live = np.flatnonzero(~many)
    at, left, state = starts[live], size[live], out[live]
    while len(live):
        state = mix((state ^ (eight[at] & _MASKS[np.minimum(left, 8)])) * U64(_BASES[1 - which]))
        done = left <= 8
        out[live[done]] = state[done]
        more = ~done
        live, at, left, state = live[more], at[more] + 8, left[more] - 8, state[more]
    return out


def rolling(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(which, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n])


def whole_windows(first: np.ndarray, width: int) -> np.ndarray:
    """Indices of windows that stay inside their text; first: each text's first element, and the end."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    if total == 0:
        return np.empty(0, np.int64)
    shift = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift


def owners(first: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The text that each element belongs to."""
    return np.searchsorted(first, index, "right") - 1


def covered(first_window: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n elements lie in a window that starts at one of the given places."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first_window, 1)
    np.add.at(edge, np.minimum(first_window + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def narrow(keys: np.ndarray, width: int) -> bytes:
    """64-bit keys as `width` bytes each, low bytes first."""
    return np.ascontiguousarray(keys.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widen(payload: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8")


def group_starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if len(ordered) == 0:
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def rows_by(part: np.ndarray):
    """Yields (value, start, end) for each run of an ascending array."""
    begin = group_starts(part)
    stop = np.append(begin[1:], len(part))
    yield from zip(part[begin].tolist(), begin.tolist(), stop.tolist())
