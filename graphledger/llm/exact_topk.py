"""Exact top-k by inner product over quantised vectors, by MaxScore.

Each component is a term and each vector's value in it a posting. For a query
the terms are ordered by how much they can still add. The essential ones are
traversed for all vectors; the others' bounds together are too small to lift a
vector from below, so they are probed only for vectors that stay competitive,
and fewer with every probe. What a vector can still gain is bounded twice: by
the ranges of the terms left, and by the lengths of what is left of query and
vector. Each task goes through its vectors in slices, the first a small one
that sets the bars, and keeps its best for each query from slice to slice; the
tasks' results are merged.

Queries are held in blocks of bounded size, each block one pass over all rows.

Rows: vectors that are null or empty, or hold null or non-finite components,
take no part; vectors of another length than the query's are none of its
candidates. A query's candidates are all rows with another id. Rows with a null
id take no part. Repeated rows each count. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphledger.llm.common import written

#: Queries in one pass.
QUERY_BLOCK = 8192
#: Terms that are probed together.
PROBE = 8
#: Vectors of a task's first slice, and of each further one.
FIRST_SLICE, SLICE = 256, 1 << 14
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """vec_id and v, the components as floor(scale * x)."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(ok, F.lit(False)))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def _matrices(ids: np.ndarray, lists: pa.Array):
    """Rows by vector length, as (ids, matrix)."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(lists.offsets.to_numpy())
    end = np.cumsum(size)
    for d in np.unique(size).tolist():
        own = np.flatnonzero(size == d)
        yield d, ids[own], flat[(end[own] - d)[:, None] + np.arange(d)]


class Best:
    """The k best of one query so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def bar(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search(query: np.ndarray, own_id: int, matrix: np.ndarray, squares: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best) -> int:
    """MaxScore over the rows of one matrix; low and high bound its columns, squares are the rows' squared lengths.

    Scores are exact. Returns how many postings were looked at.
    """
    most, least = np.maximum(query * low, query * high), np.minimum(query * low, query * high)
    order = np.argsort(least - most, kind="stable")
    ranked = query[order].astype(float)
    rest = np.concatenate((np.cumsum(most[order][::-1].astype(float))[::-1], [0]))  # what terms from each place on can add at most
    length = np.concatenate((np.cumsum((ranked * ranked)[::-1])[::-1], [0]))
    bar = best.bar()
    # Essential: the first terms, until all others together cannot lift a vector that has the least of these to the bar.
    floor = np.concatenate(([0], np.cumsum(least[order].astype(float))))
    slack = 1 + np.abs(ranked) @ np.maximum(np.abs(low), np.abs(high))[order].astype(float) * 2.0**-40  # more than sums of bounds round off
    below = floor + rest + slack < bar
    essential = max(1, int(np.argmax(below))) if below.any() else len(order)
    rows, at = np.arange(len(ids)), essential
    head = matrix[:, order[:at]]
    score, left, seen = head @ query[order[:at]], squares - (head.astype(float) ** 2).sum(axis=1), head.size
    while at < len(order):
        gain = np.minimum(rest[at], np.sqrt(np.maximum(left, 0) * length[at]))
        stay = score + gain + slack >= bar
        rows, score, left = rows[stay], score[stay], left[stay]
        if not len(rows):
            return seen
        terms = order[at : at + PROBE]
        some = matrix[rows[:, None], terms]
        score, left, seen = score + some @ query[terms], left - (some.astype(float) ** 2).sum(axis=1), seen + some.size
        at += PROBE
    stay = (score >= bar) & (ids[rows] != own_id)
    rows, score = rows[stay], score[stay]
    if len(rows) > best.k:
        cut = np.partition(score, len(score) - best.k)[len(score) - best.k]
        rows, score = rows[score >= cut], score[score >= cut]
    if len(rows):
        best.add(score.astype(np.int64), ids[rows])
    return seen


def search_all(held: list[tuple[int, np.ndarray, Best]], ids: np.ndarray, matrix: np.ndarray, fresh: bool) -> int:
    """All queries over vectors of one length, slice by slice; fresh: no bar is set yet. Returns how many postings were looked at."""
    d, seen, at = matrix.shape[1], 0, 0
    peak = max((int(np.abs(v).max()) for _, v, _ in held), default=0)
    # Floats multiply fast and are exact as long as no sum can pass their whole numbers.
    bound = 2 * peak * int(np.abs(matrix).max()) * d
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    queries = [(q, v.astype(kind), best) for q, v, best in held]
    while at < len(ids):
        end = at + (FIRST_SLICE if fresh and at == 0 else SLICE)
        part, own = np.asfortranarray(matrix[at:end].astype(kind)), ids[at:end]
        low, high, squares = part.min(axis=0), part.max(axis=0), (part.astype(float) ** 2).sum(axis=1)
        for q, v, best in queries:
            seen += search(v, q, part, squares, own, low, high, best)
        at = end
    return seen


def _top(queries: list[tuple[int, list[int]]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray, Best]]] = {}
        for q, v in queries:
            held.setdefault(len(v), []).append((q, np.array(v, np.int64), Best(k)))
        met: set[int] = set()
        for batch in batches:
            for d, ids, matrix in _matrices(batch.column("vec_id").to_numpy(), batch.column("v")):
                if d in held:
                    search_all(held[d], ids, matrix, d not in met)
                    met.add(d)
        out = [(q, i, s) for own in held.values() for q, _, best in own for i, s in zip(best.ids.tolist(), best.scores.tolist())]
        columns = list(zip(*out)) or [()] * 3
        yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, every: int, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """For each row whose id is divisible by `every`, the k other rows with the highest inner products.

    Columns: query_id, rank from 1, vec_id, score; ties go to the smaller id.
    """
    rows = quantised(vectors, id_column, vector_column, scale)
    asked = rows.where(F.col("vec_id") % every == 0)
    n = asked.count()
    blocks = -(-n // QUERY_BLOCK)
    found = None
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        queries = [(r["vec_id"], list(r["v"])) for r in mine.collect()]
        if queries:
            part = rows.mapInArrow(_top(queries, k), FOUND)
            part = part if blocks == 1 else written(part)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
