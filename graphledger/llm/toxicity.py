"""Toxicity by compression distance.

Two dictionaries are trained by zstandard's trainer, one on toxic and one on
ordinary text. Whole texts would fill both with the same common prose (figures
in the README), so each is trained on the passages of its own class whose grams
that class holds far more often than the other, beyond chance; prose from
ordinary text, trained as well, follows in both, so that it compresses alike.
Each window of a text is compressed with both; where the toxic dictionary wins,
the text looks like toxic text. A document's wins are calibrated to a
probability on training rows.

Rows: a null text is empty; an empty text has no windows and gets the score of
no evidence at all. Repeated rows each get their row. Other columns are
ignored. Labels, language, source and doc_id never enter a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphledger.llm import arrays as A
from graphledger.llm.common import lean, texts, written

#: Distinct training texts of each class at most, the first by their hash, and the longest among them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 1 << 16
WINDOW = 160
GRAM = 5
HEAD_BYTES, TAIL_BYTES = 8 << 10, 24 << 10


@dataclass(frozen=True)
class Model:
    """Both dictionaries and the calibration: weights of the logarithms of what Scorer.wins counts, and of 1."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def _windows(data: bytes) -> list[bytes]:
    """The whole text in windows; each overlaps the next by a fifth, so that no passage is cut in both."""
    step = WINDOW - WINDOW // 5
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW // 5), step)] if data else []


def _gram_counts(samples: Sequence[bytes]) -> Counter:
    """In how many texts each gram stands."""
    out: Counter = Counter()
    for data in samples:
        out.update({data[i : i + GRAM] for i in range(len(data) - GRAM + 1)})
    return out


def _passages(data: bytes, grams: set[bytes]) -> list[bytes]:
    """What such grams cover of a text."""
    hit = np.fromiter((data[i : i + GRAM] in grams for i in range(max(0, len(data) - GRAM + 1))), bool)
    inside = A.covered(np.flatnonzero(hit), GRAM, len(data))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    return [data[s:e] for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _trained(samples: Sequence[bytes], size: int, k: int) -> bytes:
    """The content of a dictionary trained on the samples; too little to train on stands for itself, what most samples hold last."""
    try:
        return zstandard.train_dictionary(size, list(samples), k=k, d=8).as_bytes()[-size:]
    except zstandard.ZstdError:
        held = Counter(p for x in samples for p in set(x.split(b"\n")))
        return b"\n".join(sorted(held, key=lambda p: (held[p], p)))[-size:]


def _chance(c: int, k: int, share: float) -> float:
    """How likely c or more of k texts are of a class that has this share of all texts."""
    return sum(exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + i * log(share) + (k - i) * log1p(-share)) for i in range(c, k + 1))


def _set_apart(mine: Counter, n: int, other: Counter, m: int) -> set[bytes]:
    """Grams of at least twelve times the share here, and in so many of this class's texts that chance gives one such gram in all."""
    share = n / (n + m)
    sizes = np.bincount(np.fromiter((c + other.get(g, 0) for g, c in mine.items()), np.int64))
    # Grams of too few texts to tell whatever they are need no test (Tarone); the others share one false gram.
    at_least = np.cumsum(sizes[::-1])[::-1].tolist()
    tests = max((t for k, t in enumerate(at_least) if t * share**k <= 1), default=1)
    chance: dict[tuple[int, int], float] = {}
    out = set()
    for g, c in mine.items():
        o = other.get(g, 0)
        if share ** (c + o) * tests <= 1 and c * (m + 1) >= 12 * (o + 1) * n:
            if (c, o) not in chance:
                chance[c, o] = _chance(c, c + o, share)
            if chance[c, o] * tests <= 1:
                out.add(g)
    return out


class Scorer:
    """Wins of the toxic dictionary over the windows of a text."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.sizes = [self._sizer(d) for d in (toxic, ordinary)]

    @staticmethod
    def _sizer(content: bytes):
        params = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=17, hash_log=17, min_match=6, target_length=1, strategy=zstandard.STRATEGY_FAST,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=data, compression_params=params).compress

    def wins(self, data: bytes) -> tuple[float, ...]:
        """All windows' wins beyond chance together, the best window's, the clear ones' number, and all windows' number."""
        toxic, ordinary = self.sizes
        windows = _windows(data)
        gains = [len(ordinary(w)) - len(toxic(w)) for w in windows]
        return float(sum(g for g in gains if g > 1)), float(max(0, *gains, 0)), float(sum(g > 3 for g in gains)), float(len(gains))


def _features(wins: np.ndarray) -> np.ndarray:
    return np.column_stack((np.log1p(wins), np.ones(len(wins))))


def _probability(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))


def _calibrated(wins: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, ...]:
    """Logistic regression, each class weighted to its share among all distinct training texts."""
    x, y = _features(wins), toxic.astype(float)
    each = np.where(toxic, share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _probability(x, w)
        slope = x.T @ (each * (y - p)) - 1e-2 * w
        bend = (x * (each * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _dictionaries(samples: Sequence[bytes], toxic: np.ndarray) -> tuple[bytes, bytes]:
    by = [[s for s, t in zip(samples, toxic) if t == kind] for kind in (True, False)]
    counts = [_gram_counts(x) for x in by]
    heads = []
    for k in (0, 1):
        grams = _set_apart(counts[k], max(1, len(by[k])), counts[1 - k], max(1, len(by[1 - k])))
        own = (b"\n".join(_passages(x, grams)) for x in by[k])
        heads.append(_trained([x for x in own if x], HEAD_BYTES, 24))
    # Ordinary prose alone, so that neither dictionary knows from it what sets toxic text apart.
    tail = _trained([w for x in by[1] for w in _windows(x)], TAIL_BYTES, 64)
    size = max(8, *(len(h) for h in heads))
    return heads[0].rjust(size, b"\0") + tail, heads[1].rjust(size, b"\0") + tail


def fit(samples: Sequence[bytes], toxic: Sequence[bool], share: float) -> Model:
    """Trains on whole texts: two thirds make the dictionaries, the rest calibrates what these show."""
    flags = np.array(toxic, bool)
    learn = np.arange(len(flags)) % 3 != 0
    rest = np.flatnonzero(~learn)
    toxic_dictionary, ordinary = _dictionaries([samples[i] for i in np.flatnonzero(learn)], flags[learn])
    weights = (0.0, 0.0, 0.0, 0.0, -10.0)
    if len(rest):
        scorer = Scorer(toxic_dictionary, ordinary)
        weights = _calibrated(np.array([scorer.wins(samples[i]) for i in rest], float).reshape(-1, 4), flags[rest], share)
    return Model(toxic_dictionary, ordinary, weights)


def held_out() -> F.Column:
    """Rows that are never learnt from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most `rows` distinct labelled texts of each class that are not held out, the first by a hash of the text.

    Only texts up to SAMPLE_BYTES are learnt from; all texts are scored whole.
    """
    spark = docs.sparkSession
    flags = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    # Texts stay where they are; only their hashes and sizes meet the labels.
    hashed = texts(docs).where(~held_out()).select("doc_id", F.xxhash64("text").alias("order"), F.octet_length("text").alias("size"))
    known = hashed.join(flags, "doc_id").select("doc_id", "order", "size", (F.col("toxic") > 0).alias("toxic"))
    # Copies of a text share its hash and would fill the sample; each text counts once in each class.
    known = written(known.groupBy("order", "toxic").agg(F.min_by("size", "doc_id").alias("size"), F.min("doc_id").alias("doc_id")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(True, 0) / max(1, sum(counts.values()))
    short = known.where(f"size BETWEEN 1 AND {SAMPLE_BYTES}").select("doc_id", "order", "toxic")
    picked = [tuple(r) for kind in (True, False) for r in short.where(F.col("toxic") == kind).orderBy("order").limit(rows).collect()]
    chosen = F.broadcast(spark.createDataFrame(picked, "c_id long, c_order long, toxic boolean"))  # 2 * rows at most
    found = texts(docs).join(chosen, (F.col("doc_id") == F.col("c_id")) & (F.xxhash64("text") == F.col("c_order"))).select("text", "toxic", "c_order").distinct().collect()
    found.sort(key=lambda r: (r["c_order"], r["text"], r["toxic"]))
    return fit([r["text"].encode() for r in found], [r["toxic"] for r in found], share)


def _scores(scorer: Scorer, weights: np.ndarray, column: pa.Array) -> np.ndarray:
    wins = [scorer.wins(t.as_buffer().to_pybytes()) if t.is_valid else scorer.wins(b"") for t in column.cast(pa.large_binary())]
    return _probability(_features(np.array(wins, float).reshape(-1, 4)), weights)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, weights = Scorer(model.toxic, model.ordinary), np.array(model.weights)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(_scores(scorer, weights, batch.column("text")))], names=["doc_id", "score"])

    return run


def _keep(model: Model, text: int):
    """Rows whose column number `text` does not score as toxic; all columns go by place, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, weights = Scorer(model.toxic, model.ordinary), np.array(model.weights)
        for batch in batches:
            yield batch.filter(pa.array(_scores(scorer, weights, batch.column(text)) < 0.5))
        lean()

    return run


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: doc_id, held_out, score from 0 to 1, predicted (1 from 0.5 on)."""
    rows = texts(docs).mapInArrow(_score(model), "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, whose text does not score as toxic; a null text counts as empty."""
    return docs.mapInArrow(_keep(model, docs.columns.index("text")), docs.schema)
