"""Each operator against a brute-force version, on texts with copies, nulls, ties and odd bytes."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphledger.llm import arrays, common, encoders, huffman, mixing, ngram_jaccard, substring_dedup, suffix_dedup, toxicity, url_filter
from graphledger.llm.components import connected_components
from graphledger.llm.decontamination import contaminated, decontaminated, tile
from graphledger.llm.encoders import PieceCounter, WordEncoder
from graphledger.llm.exact_topk import Best, exact_topk, search_all
from graphledger.llm.token_binary import read_tokens, token_binary, write_tokens
from graphledger.llm.token_counts import CACHE, token_counts

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, block int, score double"  # two columns clash with inner names


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "lo", "é", "Mi", "n"]) for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    texts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] += " " + " ".join(passage) + "\n" + word()
    for i in range(1, n, 7):
        texts[i] = texts[i - 1]
    near = [word() for _ in range(150)]
    for i in range(2, n, 6):
        own = list(near)
        own[rng.randrange(150)] = word()
        texts[i] = "  ".join(own)
    texts += ["", None, " \t\n", "short one", "Short  ONE", "x " * 400, "\x00é\u3000\u00a0b " * 30]
    return [(i, t, 7, None) for i, t in enumerate(texts)] + [(None, texts[0], 1, 2.0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def removed_by(units, size):
    """Which units of each document lie in a run that a smaller id starts too."""
    first = {}
    key = lambda d: math.inf if d is None else d
    for d, u in units:
        for i in range(len(u) - size + 1):
            k = tuple(u[i : i + size])
            first[k] = min(first.get(k, math.inf), key(d))
    for d, u in units:
        mask = [False] * len(u)
        for i in range(len(u) - size + 1):
            if first[tuple(u[i : i + size])] < key(d):
                mask[i : i + size] = [True] * size
        yield d, mask


def test_substring_dedup(spark, docs, nothing):
    units = [(d, words_of(t)) for d, t, *_ in corpus()]
    want = {}
    for (d, mask), (_, u) in zip(removed_by(units, 13), units):
        kept = b" ".join(w for w, m in zip(u, mask) if not m)
        want[d] = (len(u), sum(mask), hashlib.sha256(kept).hexdigest(), kept.decode())
    rows = substring_dedup.substring_dedup(docs, with_text=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in rows} == want
    assert len(rows) == len(units) and any(m for _, m, *_ in want.values())
    assert substring_dedup.substring_dedup(nothing).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(spark, docs, nothing, hot):
    units = [(d, (t or "").encode()) for d, t, *_ in corpus()]
    want = {}
    for (d, mask), (_, u) in zip(removed_by(units, 50), units):
        spans = sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask))
        want[d] = (len(u), sum(mask), spans, bytes(b for b, m in zip(u, mask) if not m))
    rows = suffix_dedup.suffix_dedup(docs, hot=hot, with_kept=True).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows} == want
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept"]).hexdigest() for r in rows)
    assert suffix_dedup.suffix_dedup(nothing).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 35, 64])
def test_smallest_of_consecutive_hashes(size):
    """By upper halves, whatever the lower ones say; the first of equal ones, so that equal windows have one anchor."""
    rng = np.random.default_rng(size)
    hashes = (rng.integers(0, 5, 300, dtype=np.uint64) << np.uint64(62)) | rng.integers(0, 1 << 32, 300, dtype=np.uint64)
    upper = (hashes >> np.uint64(32)).tolist()
    want = [min(range(i, i + size), key=upper.__getitem__) for i in range(300 - size + 1)]
    assert suffix_dedup.sliding_argmin(hashes, size).tolist() == want


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_two_stage_sorting(letters):
    text = np.random.default_rng(letters).integers(0, letters, 500).astype(np.uint8)
    padded = np.concatenate((text, np.zeros(50 + 17, np.uint8)))
    order, words = suffix_dedup.suffix_order(padded, 50)
    raw = padded.tobytes()
    assert sorted(order.tolist()) == list(range(501))
    assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in range(501))
    shared = suffix_dedup.adjacent_prefixes(words, order, 50)
    assert [s >= 50 for s in shared[1:]] == [raw[i : i + 50] == raw[j : j + 50] for i, j in zip(order[1:], order)]


def shingles(text):
    w = [x.lower() for x in words_of(text)]  # bytes: A-Z alone
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = {d: shingles(t) for d, t in rows}
    name = {d: d for d in sets}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in combinations(sets, 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * either:
            x, y = sorted((find(a), find(b)))
            name[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_ngram_jaccard(spark, docs, nothing):
    rows = [(d, t) for d, t, *_ in corpus() if d is not None]
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.ngram_jaccard(docs).collect()}
    assert got.pop(None)[1] is None
    assert got == want and len({c for _, c in want.values()}) < len(want)
    kept = ngram_jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, *(d for d, (_, c) in want.items() if d == c)}
    assert ngram_jaccard.ngram_jaccard(nothing).count() == 0


def test_ngram_jaccard_chains_and_unlinked_sharers(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(30):  # each differs from the next a little more
        base = list(base)
        base[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(base)))
    line = " ".join(f"c{i}" for i in range(12))
    rows += [(100 + i, f"{line} " + " ".join(f"u{i}_{k % 3}" for k in range(4))) for i in range(40)]
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_components(spark):
    links = spark.createDataFrame([*((i, i + 1) for i in range(20)), (30, 31), (32, 31), (40, 40)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == dict.fromkeys(range(21), 0) | dict.fromkeys((30, 31, 32), 30)


def test_token_counts_and_cache(spark, docs, nothing, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {d: (len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for d, t, *_ in corpus()}
    path = f"file://{tmp_path}/cache"
    first = token_counts(docs, PIECES, limit=100, cache_path=path)
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in first.collect()} == want
    texts = {t or "" for _, t, *_ in corpus()}
    cache = spark.read.schema(CACHE).parquet(path)
    assert cache.count() == len(texts)
    spark.createDataFrame([(bytearray(hashlib.sha256(b"new").digest()), cache.first()["version"], 77)], CACHE).write.mode("append").parquet(path)
    more = spark.createDataFrame([(1, "new"), (2, "new"), (3, "newer")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(more, PIECES, cache_path=path).collect()} == {1: 77, 2: 77, 3: len(model.encode("newer"))}
    assert spark.read.schema(CACHE).parquet(path).count() == len(texts) + 2
    assert token_counts(nothing, PIECES).count() == 0


def odd_texts():
    rng = random.Random(9)
    letters = "abcdefgABC0123.,;:'!?-_\"äßéÀ½²ªº  \n\tŁ\u0301Σσ中🙂<|>▁"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", " ", "  a  b ", "we'll I'M 'S", "a" * 300, "<|endoftext|>x", "</s> <s>"]


def test_encoders_equal_their_libraries():
    pieces, words = PieceCounter(PIECES), WordEncoder(WORDS)
    assert pieces.wordwise and words.wordwise and words.stop_id >= 0
    texts = odd_texts()
    assert pieces.counts(texts) == [len(pieces.model.encode(t)) for t in texts]
    assert [x.tolist() for x in words.ids(texts)] == [words.model.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_equals_the_library_on_all_documents():
    """Every text of the table, with the memo cleared many times on the way."""
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    encoder = WordEncoder(WORDS)
    encoders.MEMO, kept = 20_000, encoders.MEMO
    try:
        found = encoder.ids(texts)
    finally:
        encoders.MEMO = kept
    assert encoder.wordwise and len(found) == len(texts)
    for text, ids in zip(texts, found):
        assert ids.tolist() == encoder.model.encode(text, add_special_tokens=False).ids


def test_memo_of_pieces():
    memo = encoders.Memo(slots=8)
    # Many with the same lower bits, so that slots collide and the table grows.
    hashes = np.array([(k << 40) | (k % 3) for k in range(500)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
    ids = [np.arange(k, k + k % 4, dtype="<u4").tobytes() for k in range(501)]
    held = lambda entry: [memo.flat[memo.begin[e] : memo.begin[e + 1]].tobytes() for e in entry.tolist()]
    assert memo.find(hashes).tolist() == [-1] * 501
    for i in range(0, 501, 100):
        assert memo.add(hashes[i : i + 100], ids[i : i + 100]).tolist() == list(range(i, min(i + 100, 501)))
    assert held(memo.find(hashes[:50])) == ids[:50]
    memo.shrink(501)
    assert len(memo) == 501
    memo.shrink(400)
    assert held(memo.find(hashes[:50])) == ids[:50] and (memo.find(hashes[50:]) < 0).all()
    memo.shrink(40)
    assert len(memo) == 20 and held(memo.find(hashes[30:50])) == ids[30:50]


def test_full_memo_keeps_what_comes_back():
    """The library is asked for frequent words once, however often the memo fills up."""
    words = WordEncoder(WORDS)
    asked, learn = Counter(), words._learn
    words._learn = lambda pieces: asked.update(pieces) or learn(pieces)
    frequent = [f"often{k}" for k in range(50)]
    encoders.MEMO, kept = 1000, encoders.MEMO
    try:
        found = [words.ids([" ".join([*frequent, *(f"once{n}x{k}" for k in range(300))])])[0] for n in range(20)]
    finally:
        encoders.MEMO = kept
    assert all(asked[w] == 1 for w in frequent) and len(words.memo) <= 1350
    assert found[19].tolist() == words.model.encode(" ".join([*frequent, *(f"once19x{k}" for k in range(300))]), add_special_tokens=False).ids


def test_special_tokens_in_other_cases_are_text():
    words = WordEncoder(WORDS)
    texts = ["<|ENDOFTEXT|> a", "x <|EndOfText|>y Z", "<|endoftext|> <|ENDOFTEXT|> B", "<|StartOfText|>", "<|ENDOF\nTEXT|>"]
    assert words.wordwise
    assert [x.tolist() for x in words.ids(texts)] == [words.model.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("n", "symbols"), [(1, 1), (5, 3), (127, 9), (128, 9), (129, 9), (70000, 4000)])
def test_huffman_round_trip(n, symbols):
    ids = (np.random.default_rng(n).zipf(1.3, n) % symbols).astype(np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=symbols), 13)
    assert lengths.max() <= 13
    bits, marks = huffman.encode(ids, huffman.canonical_codes(lengths), lengths)
    assert (huffman.decode(bits, marks, n, huffman.decode_table(lengths)) == ids).all()
    start = int(marks[-1])  # any checkpoint starts a decoder
    rest = ids[(len(marks) - 1) * huffman.STRIDE :]
    assert (huffman.decode(bits, np.array([start], "<u4"), len(rest), huffman.decode_table(lengths)) == rest).all()


def test_token_binary(spark, docs, nothing, tmp_path):
    model = WordEncoder(WORDS).model
    path = f"file://{tmp_path}/tokens"
    write_tokens(docs, WORDS, 2, path, 49408)
    rows = {r["doc_id"]: r for r in read_tokens(spark, path, with_ids=True).collect()}
    start = 0
    for d, t, *_ in sorted(corpus(), key=lambda r: (r[0] is None, r[0])):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        r = rows[d]
        assert (r["ids"], r["start"], r["n_tokens"], r["ids_crc32"]) == (ids, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_binary(nothing, WORDS).count() == 0


def test_exact_topk(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=8)], "x", 1) for i in range(300)]
    vectors += [(300 + i, vectors[i][1], "y", 2) for i in range(40)]  # ties
    vectors += [(900, None, "z", 0), (950, [], "z", 0), (1000, [1.0, float("nan")] * 4, "z", 0), (1050, [1.0, None] * 4, "z", 0), (1100, [1.0, 2.0], "z", 0), (None, [1.0] * 8, "z", 0)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, query_id string, rank int")
    good = {i: [math.floor(256 * x) for x in v] for i, v, *_ in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in good:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
            want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)}
    assert {tuple(r) for r in exact_topk(frame, 50).collect()} == want
    assert exact_topk(frame.limit(0), 50).count() == 0


@pytest.mark.parametrize("scale", [1, 1 << 20])
def test_maxscore_prunes_and_is_exact(scale):
    """Clustered vectors of 48 terms in several slices: equal to all products, with far fewer postings."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 40, (12, 48)) * np.linspace(3, 0.1, 48)
    matrix = (np.rint(centres[rng.integers(0, 12, 20_000)] + rng.normal(0, 6, (20_000, 48))) * scale).astype(np.int64)
    ids = np.arange(20_000)
    held = [(int(q), matrix[q], Best(5)) for q in ids[::1000]]
    parts = (slice(0, 9000), slice(9000, 20_000))
    seen = sum(search_all(held, ids[p], matrix[p], p.start == 0) for p in parts)
    assert seen < 0.6 * len(held) * matrix.size
    for q, v, best in held:
        scores = matrix @ v
        want = sorted(((-int(s), int(i)) for i, s in zip(ids, scores) if i != q))[:5]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want


def test_tiling_catches_reordered_passages(spark, nothing):
    item = " ".join(f"item{i}" for i in range(24))
    w = item.split()
    shuffled = " ".join(w[16:] + ["noise"] + w[:8] + ["more"] + w[8:16])
    rows = [(1, f"before {item} after"), (2, shuffled.upper().replace(" ", ", ")), (3, " ".join(w[:10])), (4, "clean text of no interest at all"), (5, None), (6, ""), (None, item), (7, " ".join(w[::-1]))]
    docs = spark.createDataFrame([(d, t, 1, 0.0) for d, t in rows], SCHEMA)
    bench = spark.createDataFrame([(10, item, "x"), (11, "too short", "x"), (12, None, "x"), (10, item, "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"], r["covered"]) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 10, 24), (2, 10, 24), (None, 10, 24)}
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 7, None}
    assert contaminated(nothing, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0
    assert tile(np.arange(10, dtype=np.uint64), np.arange(10, dtype=np.uint64), 5).all()


def greedy(item, text, least):
    """Greedy string tiling as its definition has it."""
    marked, taken = [False] * len(item), [False] * len(text)
    while True:
        best, found = least - 1, []
        for i, j in product(range(len(item)), range(len(text))):
            k = 0
            while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not marked[i + k] and not taken[j + k]:
                k += 1
            if k > best:
                best, found = k, []
            if k == best and k >= least:
                found.append((i, j))
        if not found:
            return marked
        for i, j in found:
            if not any(marked[i : i + best]) and not any(taken[j : j + best]):
                marked[i : i + best] = taken[j : j + best] = [True] * best


@pytest.mark.parametrize("seed", range(12))
def test_tiling_is_greedy(seed):
    rng = random.Random(seed)
    letters = 2 + seed % 4
    item, text = ([rng.randrange(letters) for _ in range(rng.randint(3, 60))] for _ in range(2))
    got = tile(np.array(item, np.uint64), np.array(text, np.uint64), 3)
    assert got.tolist() == greedy(item, text, 3)


def test_tiling_of_one_word_over_and_over():
    assert int(tile(np.full(60_000, 7, np.uint64), np.full(90_000, 7, np.uint64), 5).sum()) == 60_000
    assert int(tile(np.full(90_000, 7, np.uint64), np.full(60_003, 7, np.uint64), 5).sum()) == 60_003


def test_contaminated_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    words = lambda t: [w.lower() for w in re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", t or "")]
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        own = words(r["text"])
        seeds = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        for k, item in items.items():
            if any(tuple(item[i : i + 5]) in seeds for i in range(len(item) - 4)):
                covered = sum(greedy(item, own, 5))
                if covered >= 0.5 * len(item):
                    want.add((r["doc_id"], k, len(item), covered))
    got = {(r["doc_id"], r["item_id"], r["item_words"], r["covered"]) for r in contaminated(docs, bench).collect()}
    assert got == want and got


def thue_morse(first, second, n):
    return "".join((first, second)[bin(k).count("1") % 2] for k in range(n))


def test_related_words_are_told_apart(spark):
    """Two words of 1024 bytes that collide under every polynomial modulo 2**64."""
    one, two = thue_morse("a", "b", 1024), thue_morse("b", "a", 1024)
    rest = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([two, *rest])), (3, one), (4, two), (5, " ".join([one, *rest]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 13}
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard.ngram_jaccard(docs.where("doc_id > 2"), words=5).collect()} == {3: 3, 4: 4, 5: 5}
    bench = spark.createDataFrame([(9, " ".join([one] * 5))], "item_id long, text string")
    assert contaminated(spark.createDataFrame([(1, " ".join([two] * 5)), (2, " ".join([one] * 5))], "doc_id long, text string"), bench).collect()[0]["doc_id"] == 2


def test_toxicity_learns_and_leaves_clean_texts(spark, nothing):
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(80)).split()
    rows, labels = [], []
    for i in range(400):
        text = prose()
        if i % 4 == 0:
            for _ in range(3):
                text.insert(rng.randrange(80), rng.choice(["vilewretch", "grossfool"]))
        rows.append((i, " ".join(text), 1, 0.5))
        labels.append((i, int(i % 4 == 0), 9))
    rows += [(1000, "", 1, 0.5), (1001, None, 1, 0.5), (None, "ther on", 1, 0.5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([*labels, (5, None, 9), (None, 1, 9)], "doc_id long, toxic int, text int")
    model = toxicity.train(docs, known)
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(400))
    right = sum(got[i]["predicted"] == int(i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held)
    assert got[1000]["score"] == got[1001]["score"] < 0.5 and 0 <= got[None]["score"] <= 1
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["score"] < 0.5}
    assert {r["doc_id"]: r["text"] for r in kept.collect()}[1001] is None
    empty = toxicity.train(nothing, known.limit(0))
    assert toxicity.toxicity(nothing, empty).count() == 0


def prose_of(rng, size=80):
    return ["".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(size)]


@pytest.mark.parametrize("kind", [1, 0])
def test_toxicity_learns_beside_a_text_with_thousands_of_copies(spark, kind):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        text = prose_of(rng)
        if i % 4 == 0:
            for _ in range(3):
                text.insert(rng.randrange(80), rng.choice(["vilewretch", "grossfool"]))
        rows.append((i, " ".join(text), 1, 0.5))
    # The text that comes first by its hash, so that its copies stand before all others.
    lead = spark.createDataFrame([(" ".join(prose_of(rng)),) for _ in range(4000)], "text string").orderBy(F.xxhash64("text")).first()["text"]
    copies = range(1000, 1000 + 4000)
    docs = spark.createDataFrame([*rows, *((i, lead, 1, 0.5) for i in copies)], SCHEMA)
    labels = spark.createDataFrame([*((i, int(i % 4 == 0)) for i in range(400)), *((i, kind) for i in copies)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] == int(i % 4 == 0) for i in held) >= 0.95 * len(held)


@pytest.mark.parametrize("cues", [["".join(random.Random(i).choices("bcdfgijklmpquvwxyz", k=9)) for i in range(40)], ["zuqqi vub wixxo dyp kogga fuv jilbu mivvy puq"]])
def test_toxicity_learns_rare_and_long_cues(cues):
    """Forty words, each in a fortieth of the toxic texts; and a phrase of 45 bytes. All texts are of one size."""
    rng = random.Random(4)
    samples, toxic = [], []
    for i in range(3000):
        text = prose_of(rng, 150)
        if i % 2:
            cue = rng.choice(cues)
            for _ in range(3):
                text.insert(rng.randrange(40), cue)
        samples.append(" ".join(text).encode()[:400]), toxic.append(bool(i % 2))
    model = toxicity.fit(samples[:2700], toxic[:2700], 0.5)
    scorer = toxicity.Scorer(model.toxic, model.ordinary)
    scores = toxicity._probability(toxicity._features(np.array([scorer.wins(t) for t in samples[2700:]])), np.array(model.weights))
    assert np.mean((scores >= 0.5) == np.array(toxic[2700:])) >= 0.95


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while total < u:
        k += 1
        p *= rate / k
        total += p
    return k


@pytest.mark.parametrize("few", [mixing.FEW_SOURCES, 0])
def test_mixing(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = [(i, f"t{i}", "a" if i % 10 else "b", 1) for i in range(2000)] + [(5000, None, None, 1), (None, "n", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy_ int").drop("copy_")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, 1.0), ("unseen", 9.0)], "source string, weight double")
    sizes = Counter(r[2] for r in rows)
    want = Counter()
    for d, _, s, _ in rows:
        rate = {"a": 1.0, "b": 3.0, None: 1.0}[s] / 5 * 2002 / sizes[s]
        u = int(hashlib.md5(f"17:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) / (1 << 52)
        want[d] = poisson(u, rate)
    out = mixing.mix_sources(docs, weights, with_copy=True)
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == +want
    assert all(sorted(r["copy"] for r in got if r["doc_id"] == d) == list(range(1, n + 1)) for d, n in list(want.items())[:50])
    assert abs(sum(r["source"] == "b" for r in got) / len(got) - 0.6) < 0.05
    assert mixing.mix_sources(docs, weights).columns == docs.columns
    assert mixing.mix_sources(docs.limit(0)).count() == 0


INNER = ["copy", "copy_", "cdf", "r_source", "u", "u_", "drawn", "place", "nth", "row", "id", "content", "salt", "score", "block", "text_as_it_is", "payload", "_chosen", "component_id", "n"]


def test_stages_carry_columns_of_any_name(spark):
    """All but the last stage return the columns they got, nulls and repeated rows included, whatever they are called."""
    rows = [(i, f"clean text number {i} of a kind", "s", i) for i in range(6)] + [(1, "clean text number 1 of a kind", "s", 1), (None, None, None, None), (7, "", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, x long").select("doc_id", "text", "source", *(F.col("x").alias(c) for c in INNER))
    bench = spark.createDataFrame([(1, "some other words that nobody has here")], "item_id long, text string")
    model = toxicity.fit([], [], 0.0)
    outs = [toxicity.drop_toxic(docs, model), ngram_jaccard.one_of_each(docs), decontaminated(docs, bench), mixing.mix_sources(docs)]
    for out in outs:
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == (r["doc_id"] if r["text"] is not None else None) for c in INNER)
    assert [out.count() for out in outs[:3]] == [9, 9, 9]
    assert mixing.mix_sources(docs, with_copy=True).columns == [*docs.columns, "copy__"]


def test_url_filter(spark):
    urls = ["HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/1", "http://a.example.com/fr", "http://b.net/es/", "http://b.net", None, "no scheme", "x://notnet/es/", "http://c.co.uk?q", "http://bad.org/1", "http://good.org/1", "ftp://É.org/#"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(100 + i, f"http://bad.org/{i}", "h", "v") for i in range(60)] + [(300 + i, f"http://good.org/{i}", "h", "v") for i in range(60)], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([*((100 + i, 0) for i in range(60)), *((300 + i, 1) for i in range(60)), (None, 1), (301, None)], "page_id long, good int")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.url_filter(pages, labels, rules).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[2] == ("a.example.com", "/fr", "com/", "allow")
    assert got[3] == ("b.net", "/es/", "net/es/", "block")
    assert got[4][:3] == ("b.net", "", None)
    assert got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7][:3] == ("notnet", "/es/", None)
    assert got[8][:2] == ("c.co.uk", "")
    assert got[9][3] == "block" and got[10][3] == "allow"
    assert got[11][:2] == ("É.org", "/")
    assert len(got) == pages.count()
    assert url_filter.url_filter(pages.limit(0), labels, rules).count() == 0
    assert url_filter.url_filter(pages, labels.limit(0), []).count() == pages.count()


def test_registered_domains(spark):
    rows = spark.createDataFrame([("a.b.co.uk",), ("b.example.com",), ("localhost",), ("",), ("x.uk",)], "host string")
    d, s = url_filter.domain_and_suffix(F.col("host"))
    assert [tuple(r) for r in rows.select(d, s).collect()] == [("b.co.uk", "co.uk"), ("example.com", "com"), ("localhost", "localhost"), ("", ""), ("x.uk", "uk")]


def test_rolling_hashes_tell_sequences_apart():
    values = np.random.default_rng(0).integers(0, 3, 3000).astype(np.uint64)
    seen = defaultdict(set)
    for i, h in enumerate(arrays.rolling(arrays.mix(values.copy()), 6).tolist()):
        seen[h].add(tuple(values[i : i + 6].tolist()))
    assert all(len(s) == 1 for s in seen.values()) and len(seen) == len({tuple(values[i : i + 6].tolist()) for i in range(2995)})


def test_by_ids_keeps_columns(spark, docs):
    ids = spark.createDataFrame([(1,), (1,), (2,)], "doc_id long")
    assert common.by_ids(docs, ids, "left_anti").columns == docs.columns
    assert {r["doc_id"] for r in common.by_ids(docs, ids, "left_semi").collect()} == {1, 2}


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_binary"]
