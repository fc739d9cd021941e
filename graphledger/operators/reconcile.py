"""Contract reconciliation: exact keys first, then close matches of what is left."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values that results depend on.
LEAST_LENGTH_RATIO = 0.35
LEAST_SIMILARITY = 0.78


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of both sides: key, status matched, left_only or right_only, and how many rows each side has."""
    l = left.groupBy("key").agg(F.count(F.lit(1)).alias("left_n"))
    r = right.groupBy("key").agg(F.count(F.lit(1)).alias("right_n"))
    rows = l.join(r, "key", "full_outer")
    status = F.when(F.col("left_n").isNull(), "right_only").when(F.col("right_n").isNull(), "left_only").otherwise("matched")
    return rows.select("key", status.alias("status"), F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))


def _segments(key: str) -> F.Column:
    """Parts of a key between slashes, hyphens and underscores, without versions like v1."""
    return F.filter(F.split(key, "[/_-]"), lambda s: (s != "") & ~s.rlike(r"^v\d+$"))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of unmatched keys worth comparing: they share a segment or their first four characters, and lengths are alike.

    All such pairs are compared; there is no cap on how many a key has.
    """
    block = lambda x, k: x.select(F.col("key").alias(k)).distinct().withColumn("block", F.explode(F.array_distinct(F.concat(_segments(k), F.array(F.concat(F.lit("^"), F.substring(k, 1, 4)))))))
    pairs = block(left, "left_key").join(block(right, "right_key"), "block").select("left_key", "right_key").distinct()
    a, b = F.length("left_key"), F.length("right_key")
    return pairs.where(F.least(a, b) / F.greatest(a, b) >= LEAST_LENGTH_RATIO)


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        ratio = [round(SequenceMatcher(None, a, b).ratio(), 3) for a, b in zip(frame["left_key"], frame["right_key"])]
        yield frame.assign(similarity=pd.Series(ratio, index=frame.index, dtype=float))


def scored(pairs: DataFrame) -> DataFrame:
    """Candidate pairs that are similar enough: left_key, right_key, similarity."""
    rows = pairs.mapInPandas(_similar, "left_key string, right_key string, similarity double")
    return rows.where(F.col("similarity") >= LEAST_SIMILARITY)


def possible_matches(left: DataFrame, right: DataFrame) -> list[tuple[str, str, float]]:
    """Each left key, in order, takes the most similar right key still free, of equal ones the last by name; best matches first.

    The pairs are few: both sides are left-overs.
    """
    taken: set[str] = set()
    out = []
    rows = scored(candidates(left, right)).orderBy("left_key", F.desc("similarity"), F.desc("right_key")).toLocalIterator()
    last = None
    for row in rows:
        if row["left_key"] != last and row["right_key"] not in taken:
            last = row["left_key"]
            taken.add(row["right_key"])
            out.append((row["left_key"], row["right_key"], row["similarity"]))
    return sorted(out, key=lambda m: (-m[2], m[0], m[1]))


def cheap_score(left: str, right: str) -> F.Column:
    """What a pair of keys looks like before it is compared: shared share of segments, common start, likeness of lengths."""
    a, b = _segments(left), _segments(right)
    overlap = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
    shorter, longer = (f(F.length(left), F.length(right)) for f in (F.least, F.greatest))
    steps = F.sequence(F.lit(1), F.greatest(shorter, F.lit(1)))
    start = F.size(F.filter(steps, lambda n: (n <= shorter) & (F.substr(F.col(left), F.lit(1), n) == F.substr(F.col(right), F.lit(1), n))))
    return overlap + start / F.greatest(F.lit(1), shorter) + shorter / F.greatest(F.lit(1), longer)
