"""Documents that hold benchmark items, in one piece or reordered, by greedy string tiling.

Items and documents are compared as words: runs of letters, digits and
non-ASCII characters, A-Z in lower case, so punctuation and layout do not
matter. Runs of `min_match` words that both have are the seeds. For each
document and item that share a seed the longest common run of unmarked words
is marked again and again, Karp-Rabin hashes standing for the words, until
none of `min_match` words is left; the marked share of the item's words
decides. Order does not matter, so shuffled passages count in full.

The benchmark is held in parts of bounded size; each part is one pass over
the documents, which are never shuffled.

Rows: a null text has no words. Items with fewer than `min_match` words are
too short to tell and match nothing. Repeated rows each count. Other columns
are ignored. Null ids are carried as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphledger.llm import arrays as A
from graphledger.llm.common import by_ids, texts

#: Bytes of benchmark text in one part.
PART_BYTES = 32 << 20
FLAG_BITS = 20
HITS = "doc_id long, item_id long, item_words long, covered long, coverage double"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin."""
    buf = _FOLD[buf]
    starts, ends, first = A.word_spans(buf, offsets)
    return A.span_hashes(buf, starts, ends), first


def tile(item: np.ndarray, text: np.ndarray, min_match: int) -> np.ndarray:
    """Which words of the item greedy string tiling marks against the text.

    The longest common run of unmarked words is marked first, of equal ones the
    first in the item and then in the text. Lengths are tried from the longest
    possible downwards, which a search over lengths finds; so memory stays in
    proportion to both texts however often their words repeat.
    """
    marked = np.zeros(len(item), bool)
    shared = np.flatnonzero(np.isin(A.rolling(text, min_match), A.rolling(item, min_match)))
    if not len(shared):
        return marked
    # Only what seeds cover of the text can be marked; a gap leaves one word that counts as taken.
    inside = np.flatnonzero(A.covered(shared, min_match, len(text)))
    gaps = np.flatnonzero(inside[1:] != inside[:-1] + 1) + 1
    text, taken = np.insert(text[inside], gaps, 0), np.insert(np.zeros(len(inside), bool), gaps, True)
    size = min(len(item), len(text))
    while size >= min_match:
        size = _most(item, text, marked, taken, min_match, size)
        if size >= min_match:
            _mark(item, text, marked, taken, size)
        size -= 1
    return marked


def _most(item: np.ndarray, text: np.ndarray, marked: np.ndarray, taken: np.ndarray, least: int, most: int) -> int:
    """The length of the longest common unmarked run, up to `most`; less than `least` if there is none. A common run holds common runs of all smaller lengths."""
    low, high = least - 1, most
    step = least
    while low < high:  # lengths are mostly short: double first, then halve
        size = min(high, step) if step else (low + high + 1) // 2
        if len(_places(item, text, marked, taken, size)[0]):
            low = size
            step = 2 * step if step else 0
        else:
            high, step = size - 1, 0
    return low


def _places(item: np.ndarray, text: np.ndarray, marked: np.ndarray, taken: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of unmarked runs of `size` words that the other text has as well, by Karp-Rabin hashes, and the hashes."""
    a, b = A.rolling(item, size), A.rolling(text, size)
    i = np.flatnonzero(~_any(marked, np.arange(len(a)), size))
    j = np.flatnonzero(~_any(taken, np.arange(len(b)), size))
    i = i[np.isin(a[i], b[j])]
    j = j[np.isin(b[j], a[i])]
    return i, j, a[i], b[j]


def _mark(item: np.ndarray, text: np.ndarray, marked: np.ndarray, taken: np.ndarray, size: int) -> None:
    """Marks common runs of `size` words, from the item's first on, each with the text's first free one."""
    i, j, a, b = _places(item, text, marked, taken, size)
    order = np.argsort(b, kind="stable")
    j, b = j[order], b[order]
    begin = np.searchsorted(b, a, "left").tolist()
    end = np.searchsorted(b, a, "right").tolist()
    place = j.tolist()
    tried: dict[int, int] = {}  # places before it are taken for good
    for at, s, e in zip(i.tolist(), begin, end):
        if marked[at : at + size].any():
            continue
        k = tried.get(s, s)
        while k < e and taken[place[k] : place[k] + size].any():
            k += 1
        tried[s] = k
        if k < e and (item[at : at + size] == text[place[k] : place[k] + size]).all():
            marked[at : at + size] = True
            taken[place[k] : place[k] + size] = True


def _any(flags: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[start + size] > total[start]


class Part:
    """Some benchmark items, with their seeds."""

    def __init__(self, items: list[tuple[int | None, bytes]], min_match: int):
        self.ids = [k for k, _ in items]
        raw = [t for _, t in items]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
        self.words, self.first = _words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        at = A.whole_windows(self.first, min_match)
        seeds, owner = A.rolling(self.words, min_match)[at], A.owners(self.first, at)
        order = np.lexsort((owner, seeds))
        self.seeds, self.owner = seeds[order], owner[order]
        self.flags = np.zeros(1 << FLAG_BITS, bool)
        self.flags[(self.seeds >> A.U64(64 - FLAG_BITS)).astype(np.int64)] = True

    def item(self, k: int) -> np.ndarray:
        return self.words[self.first[k] : self.first[k + 1]]


def _match(items: list[tuple[int | None, bytes]], min_match: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Part(items, min_match)
        for batch in batches:
            buf, offsets = A.text_bytes(batch.column("text"))
            ids, found = batch.column("doc_id").to_pylist(), []
            for i, j in A.runs(offsets):
                words, first = _words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = A.whole_windows(first, min_match)
                seeds = A.rolling(words, min_match)[at]
                near = part.flags[(seeds >> A.U64(64 - FLAG_BITS)).astype(np.int64)]
                at, seeds = at[near], seeds[near]
                low, high = np.searchsorted(part.seeds, seeds, "left"), np.searchsorted(part.seeds, seeds, "right")
                count = high - low
                place = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                pairs = np.unique(np.stack((np.repeat(A.owners(first, at), count), part.owner[place])), axis=1)
                for d, k in pairs.T.tolist():
                    item = part.item(k)
                    covered = int(tile(item, words[first[d] : first[d + 1]], min_match).sum())
                    if covered >= threshold * len(item):
                        found.append((ids[i + d], part.ids[k], len(item), covered, covered / len(item)))
            columns = list(zip(*found)) or [()] * 5
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.float64()))], names=["doc_id", "item_id", "item_words", "covered", "coverage"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5) -> DataFrame:
    """One row for each document and benchmark item of which the document covers `threshold` or more.

    Columns: doc_id, item_id, item_words, covered (the item's marked words), coverage.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-total // PART_BYTES)
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts))))
    out = docs.sparkSession.createDataFrame([], HITS)
    for k in range(parts):
        held = [(r["item_id"], r["text"].encode()) for r in items.where(F.col("part") == k).orderBy("item_id", "text").collect()]
        out = out.unionByName(texts(docs).mapInArrow(_match(held, min_match, threshold), HITS))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that cover no item. Rows with a null doc_id stay."""
    return by_ids(docs, contaminated(docs, benchmark, min_match, threshold), "left_anti")
