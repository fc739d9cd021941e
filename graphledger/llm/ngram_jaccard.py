"""Near-duplicate documents: an exact Jaccard join of word-shingle sets, by grouped prefixes.

Shingles are put in one global order, those that few documents hold first;
two sets that are similar enough share a shingle in their short prefixes of
that order. Frequencies are counted exactly enough for it: every block of
documents sends each of its shingles once, and learns the size class of those
that another document has too. All others, the great majority, come first and
need no further work. The order decides speed alone, never the result.

* Documents with equal sets stand for each other from the start.
* Sets with the same prefix and size form a group (about GROUP sets; more make
  several groups). The prefixes of groups, not of documents, are matched, and
  lists of the same groups that several shingles make count once.
* Pairs of groups whose prefixes meet are filtered by sizes and by the places
  of the shared shingle; those left are expanded to their members, filtered by
  parity bits and verified on whole sets.
* Of each list of groups one is tested against all others; lists that this
  does not connect go on with many centres at once, small lists with all their
  pairs, until nothing is left. So large groups of near copies cost a few tests
  for each member instead of all pairs, and every pair of sets is either
  tested, excluded by a bound, or already connected.

Rows: without text or words a document has an empty set and links with
nothing; with fewer than `words` words its whole sequence is its one shingle.
A null doc_id links with nothing and gets a null component. Rows with the same
doc_id are one document with several sets. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphledger.llm import arrays as A
from graphledger.llm.blocks import blocked, opened
from graphledger.llm.common import bucket_count, by_ids, discard, texts, written
from graphledger.llm.components import merged

Key = tuple[pa.Scalar, ...]
#: Bits of a shingle's key within its bucket, and below them of its class.
KEY_BITS, CLASS_BITS = 36, 4
#: Tokens of this class (about 2 ** class documents) are dealt out over extra buckets.
HEAVY = 10
#: 512 bits of a set: which counts of its shingles by hash are odd. Two sets differ in as many shingles at least as in bits.
ODD = tuple(f"odd{k}" for k in range(8))
#: Sets of a group, about.
GROUP = 4
#: Centres of a list in its first round, and how many times as many in each further one.
MORE_CENTRES = 32
#: Bits of a shingle's hash below its rarity class.
BITS = 58
#: A prefix token is kept to this many bytes while lists are matched; sets are verified in full.
TOKEN_BYTES = 6
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of some texts, in order, and where each text's begin."""
    buf = _LOWER[buf]
    starts, ends, first = A.word_spans(buf, offsets)
    each = A.span_hashes(buf, starts, ends)
    at = A.whole_windows(first, words)
    full = A.rolling(each, words)[at]
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < words))
    counts = np.maximum(count - words + 1, 0)
    counts[short] = 1
    begin = np.concatenate(([0], np.cumsum(counts)))
    if not len(short):
        return full, begin
    up, down = A.powers(1, len(each) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each * up[:-1])))
    out = np.empty(int(begin[-1]), np.uint64)
    is_short = np.zeros(len(out), bool)
    is_short[begin[short]] = True
    out[is_short] = A.mix((total[first[short] + count[short]] - total[first[short]]) * down[first[short]])
    out[~is_short] = full
    return out, begin


def _joined(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket and KEY_BITS further bits of each hash, as one number."""
    return (((hashes >> A.U64(40)) % A.U64(buckets)) << A.U64(KEY_BITS)) | (hashes & A.U64((1 << KEY_BITS) - 1))


def _tally(buckets: int, words: int):
    """The shingles of a block, each once, with a class for how many documents here hold it."""

    def run(key: Key, table: pa.Table) -> pa.Table:
        _, buf, offsets = opened(table)
        found = []
        for i, j in A.runs(offsets):
            hashes, begin = shingle_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            joined, owner = _joined(hashes, buckets), A.owners(begin, np.arange(len(hashes)))
            order = np.argsort(joined, kind="stable")
            joined, owner = joined[order], owner[order]
            new = np.ones(len(joined), bool)
            new[1:] = (joined[1:] != joined[:-1]) | (owner[1:] != owner[:-1])
            joined = joined[new]
            first = A.group_starts(joined)
            found.append((joined[first], np.diff(np.append(first, len(joined)))))
        joined = np.concatenate([x for x, _ in found] or [np.empty(0, np.uint64)])
        count = np.concatenate([x for _, x in found] or [np.empty(0, np.int64)])
        if not len(joined):
            return _rows(KEYS_SCHEMA, [])
        order = np.argsort(joined, kind="stable")
        first = A.group_starts(joined[order])
        joined, count = joined[order][first], np.add.reduceat(count[order], first)
        packed = ((joined & A.U64((1 << KEY_BITS) - 1)) << A.U64(CLASS_BITS)) | np.minimum(np.log2(count), 15).astype(np.uint64)
        block = key[0].as_py()
        return _rows(KEYS_SCHEMA, [(b, block, A.narrow(packed[s:e], 5)) for b, s, e in A.rows_by((joined >> A.U64(KEY_BITS)).astype(np.int64))])

    return run


def _spread(key: Key, table: pa.Table) -> pa.Table:
    """Shingles of one bucket that two documents hold, told to all their blocks with the class of their number."""
    table = table.take(pa.array(np.argsort(table["block"].to_numpy(), kind="stable")))
    payloads = table["keys"].to_pylist()
    blocks = np.repeat(table["block"].to_numpy(), [len(x) // 5 for x in payloads])
    packed = A.widen(b"".join(payloads), 5)
    low, size = packed >> A.U64(CLASS_BITS), 1 << (packed & A.U64(15)).astype(np.int64)
    order = np.argsort(low, kind="stable")
    first = A.group_starts(low[order])
    total = np.add.reduceat(size[order], first) if len(first) else size[:0]
    spread = np.empty(len(low), np.int64)
    spread[order] = np.repeat(total, np.diff(np.append(first, len(low))))
    keep = spread > 1
    out = (low[keep] << A.U64(CLASS_BITS)) | np.minimum(np.log2(spread[keep]), 15).astype(np.uint64)
    bucket = key[0].as_py()
    return _rows(KEYS_SCHEMA, [(bucket, b, A.narrow(out[s:e], 5)) for b, s, e in A.rows_by(blocks[keep])])


KEYS = "bucket int, block int, keys binary"
KEYS_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary())])


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _prefixes(buckets: int, words: int, percent: int):
    """Each document's set by size and digest, and the part of its prefix that other documents may share."""

    def run(key: Key, table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, buf, offsets = opened(table)
        bucket = np.repeat(replies["bucket"].to_numpy().astype(np.uint64), [len(x) // 5 for x in replies["keys"].to_pylist()])
        packed = A.widen(b"".join(replies["keys"].to_pylist()), 5)
        known = (bucket << A.U64(KEY_BITS)) | (packed >> A.U64(CLASS_BITS))
        order = np.argsort(known)
        known, classes = known[order], packed[order] & A.U64(15)
        rows = []
        for i, j in A.runs(offsets):
            hashes, begin = shingle_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
            ordered = hashes >> A.U64(64 - BITS)
            if len(known):
                joined = _joined(hashes, buckets)
                place = np.minimum(np.searchsorted(known, joined), len(known) - 1)
                ordered |= np.where(known[place] == joined, classes[place] << A.U64(BITS), A.U64(0))
            for k in range(j - i):
                s = np.unique(ordered[begin[k] : begin[k + 1]])
                n = len(s)
                plain = A.mix(s & A.U64((1 << BITS) - 1))
                plain.sort()
                up, _ = A.powers(0, n + 1)
                digest = np.array([(plain * up[:n]).sum(), plain.sum()], np.uint64).view(np.int64)
                odd = np.packbits(np.bincount((s & A.U64(64 * len(ODD) - 1)).astype(np.int64), minlength=64 * len(ODD)).astype(np.uint8) & 1).view(np.int64)
                head = s[: n - -(-percent * n // 100) + 1] if n else s
                own = int(np.searchsorted(head, A.U64(1) << A.U64(BITS)))  # classes from 1 on
                rows.append((ids[i + k], n, int(digest[0]), int(digest[1]), hash_words(head), own, head[own:].astype("<u8").tobytes(), *odd.tolist()))
        columns = list(zip(*rows)) or [()] * (7 + len(ODD))
        arrays = [A.ids_back(np.array(columns[0], np.int64)), *(pa.array(list(c), t) for c, t in zip(columns[1:], (*[pa.int64()] * 4, pa.int32(), pa.binary(), *[pa.int64()] * len(ODD))))]
        return pa.table(arrays, names=["doc_id", "n", "s1", "s2", "pkey", "own", "prefix", *ODD])

    return run


def hash_words(values: np.ndarray) -> int:
    up, _ = A.powers(1, len(values) + 1)
    return int(A.mix(np.array([(A.mix(values.copy()) * up[: len(values)]).sum()], np.uint64)).view(np.int64)[0])


def _post(buckets: int):
    """Prefix tokens by bucket; tokens that are frequent for sure are dealt out over extra buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gid, n, own_ = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("gid", "n", "own"))
            prefix = batch.column("prefix").to_pylist()
            size = np.array([len(p) // 8 for p in prefix], np.int64)
            token = np.frombuffer(b"".join(prefix), "<u8")
            row = np.repeat(np.arange(len(gid)), size)
            place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size - own_, size)
            bucket = ((token >> A.U64(8 * TOKEN_BYTES - 12)) & A.U64((1 << 22) - 1)).astype(np.int64) % buckets
            often = (token >> A.U64(BITS)) >= HEAVY
            bucket[often] = buckets + (gid[row[often]] % buckets)
            order = np.argsort(bucket, kind="stable")
            out = []
            for b, i, j in A.rows_by(bucket[order]):
                at = order[i:j]
                own, index = np.unique(row[at], return_inverse=True)
                head = np.stack((gid[own], n[own])).astype("<i8").tobytes()
                body = np.stack((index, place[at])).astype("<u4").tobytes()
                out.append((b, len(own), len(at), head + body + A.narrow(token[at], TOKEN_BYTES)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "groups", "tokens", "payload"])

    return run


POSTING = "token long, gid long, n long, pos int"


def _meet(buckets: int):
    """The postings of tokens that two groups have; frequent ones all go on."""

    def run(key: Key, table: pa.Table) -> pa.Table:
        parts = []
        for g, t, payload in zip(table["groups"].to_pylist(), table["tokens"].to_pylist(), table["payload"].to_pylist()):
            head = np.frombuffer(payload, "<i8", 2 * g).reshape(2, g)
            body = np.frombuffer(payload, "<u4", 2 * t, offset=16 * g).reshape(2, t)
            token = A.widen(payload[16 * g + 8 * t :], TOKEN_BYTES)
            parts.append((token, head[0][body[0]], head[1][body[0]], body[1]))
        token, gid, n, pos = (np.concatenate(x) for x in zip(*parts))
        if key[0].as_py() < buckets:
            order = np.argsort(token, kind="stable")
            begin = A.group_starts(token[order])
            keep = np.empty(len(token), bool)
            size = np.diff(np.append(begin, len(token)))
            keep[order] = np.repeat(size > 1, size)
            token, gid, n, pos = token[keep], gid[keep], n[keep], pos[keep]
        return pa.table([pa.array(token.view(np.int64)), pa.array(gid), pa.array(n), pa.array(pos.astype(np.int32))], names=["token", "gid", "n", "pos"])

    return run


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = A.text_bytes(batch.column("text"))
            found = []
            for i, j in A.runs(offsets):
                hashes, begin = shingle_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                found.extend(np.unique(hashes[begin[k] : begin[k + 1]]).astype("<u8").tobytes() for k in range(j - i))
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.binary())], names=["rep", "shingles"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left_set"), batch.column("right_set")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate((x, y))
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * same >= percent * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def ngram_jaccard(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id.

    Two documents link when 100 * common shingles >= percent * all shingles of
    both; component_id is the smallest doc_id that links lead to, the
    document's own included.
    """
    if words < 1 or not 0 < percent <= 100:
        raise ValueError("words must be at least 1, percent from 1 to 100")
    buckets = bucket_count(docs)
    whole = texts(docs)
    dealt = blocked(docs)
    shared = dealt.groupBy("block").applyInArrow(_tally(buckets, words), KEYS).groupBy("bucket").applyInArrow(_spread, KEYS)
    odd = "".join(f", {x} long" for x in ODD)
    base = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_prefixes(buckets, words, percent), f"doc_id long, n long, s1 long, s2 long, pkey long, own int, prefix binary{odd}")
    base = written(base)
    real = base.where("n > 0 AND doc_id IS NOT NULL")
    reps = written(real.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), *(F.first(x).alias(x) for x in ("pkey", *ODD))))
    alike = reps.groupBy("pkey", "n").agg(F.count(F.lit(1)).alias("alike"))
    dealt_out = reps.join(alike, ["pkey", "n"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("alike") / GROUP)))
    groups = dealt_out.groupBy("pkey", "n", "part").agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("many"))
    members = written(dealt_out.join(groups, ["pkey", "n", "part"]).select("rep", "gid", "n", "many", "s1", "s2", *ODD))
    leaders = members.where("rep = gid").select("gid", "s1", "s2")
    marked = real.join(leaders, (real.doc_id == leaders.gid) & (real.s1 == leaders.s1) & (real.s2 == leaders.s2)).select("gid", "n", "own", "prefix")
    posted = written(marked.mapInArrow(_post(buckets), "bucket int, groups int, tokens int, payload binary").groupBy("bucket").applyInArrow(_meet(buckets), POSTING))
    # Shingles of one passage make the same list; one of them stands for all.
    same = posted.groupBy("token").agg(F.count(F.lit(1)).alias("size"), *(F.bit_xor(F.xxhash64("gid", F.lit(k))).alias(f"x{k}") for k in (0, 1)), F.min("gid").alias("low"), F.max("gid").alias("high"))
    kept = same.where("size > 1").groupBy("size", "x0", "x1", "low", "high").agg(F.min("token").alias("token")).select("token")
    lists = written(posted.join(kept, "token").join(members.where("rep = gid").select("gid", "many", *ODD), "gid").select("token", "gid", "n", "pos", "many", *ODD))
    labels = _connected(whole, lists, members, words, percent)
    named = reps.join(labels, reps.rep == labels.node, "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id"))
    # Rows with the same doc_id are one document, whatever their sets.
    out = base.drop("prefix", "pkey", "own", *ODD).join(named, ["s1", "s2", "n"], "left")
    discard(posted, lists, members)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def _closeness(percent: int):
    """Whether sizes and places of a shared token leave room for enough overlap."""

    def near(n1: str, p1: str, n2: str, p2: str) -> str:
        need = f"{percent} * ({n1} + {n2})"
        most = f"least({p1}, {p2}) + 1 + least({n1} - {p1}, {n2} - {p2}) - 1"
        return f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) AND {100 + percent} * ({most}) >= {need}"

    return near


def _apart(left: str, right: str) -> str:
    """In how many parity bits two sets differ, as SQL."""
    return " + ".join(f"bit_count({left}{x} ^ {right}{x})" for x in ODD)


def _similar_enough(n: str, m: str, apart: str, percent: int) -> str:
    """Whether sets of these sizes that differ in `apart` shingles at least may link."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) AND 100 * ({n} + {m} - ({apart})) >= {percent} * ({n} + {m} + ({apart}))"


def _group_pairs(left: DataFrame, share: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of groups to expand, and the centres. left: lists with the span of components of each group, and the list's size."""
    near = _closeness(percent)
    part = F.when(F.col("size") <= 4 * share, F.col("gid")).otherwise(F.pmod(F.xxhash64("gid"), F.lit(share))) if share > 1 else F.lit(0)
    kept = ("gid", "n", "pos", "many", "low", "high", *ODD)
    centres = left.groupBy("token", part.alias("part")).agg(F.min(F.struct(*kept)).alias("c")).select("token", "c.*")
    c = centres.select("token", *(F.col(x).alias(f"c_{x}") for x in kept))
    pairs = left.join(c, "token").where("gid <> c_gid AND NOT (low = high AND c_low = c_high AND low = c_low)").where(near("n", "pos", "c_n", "c_pos"))
    # The bits of a group of one are its member's.
    pairs = pairs.where(f"many > 1 OR c_many > 1 OR {_similar_enough('n', 'c_n', _apart('', 'c_'), percent)}")
    return pairs.select(F.least("gid", "c_gid").alias("a"), F.greatest("gid", "c_gid").alias("b")).distinct(), centres.select("token", "gid")


def _expanded(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members of paired groups that sizes and bits leave; GROUP squared for each pair of groups, about."""
    x, y = (members.select(F.col("gid").alias(g), *(F.col(k).alias(f"{g}_{k}") for k in ("rep", "n", *ODD))) for g in ("a", "b"))
    met = pairs.join(x, "a").join(y, "b").where("a <> b OR a_rep < b_rep").where(_similar_enough("a_n", "b_n", _apart("a_", "b_"), percent))
    return met.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"))


def _verified(whole: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that link by their whole sets; only texts that a pair names are read into sets."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = written(by_ids(whole, wanted, "left_semi").mapInArrow(_whole_sets(words), "rep long, shingles binary"))
    seen = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right_set")), "b")
    seen = seen.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left_set")), "a").select("a", "b", "left_set", "right_set")
    links = written(seen.mapInArrow(_verify(percent), "a long, b long").distinct())
    discard(sets)
    return links


def _connected(whole: DataFrame, lists: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) of all sets that links connect; see the module's text."""
    left = lists.withColumns({"low": F.col("gid"), "high": F.when(F.col("many") > 1, F.bitwise_not("gid")).otherwise(F.col("gid")), "size": F.lit(0)})
    tested, labels, share = None, None, 1
    while True:
        pairs, centres = _group_pairs(left, share, percent)
        if tested is None:
            inside = members.where("many > 1").select(F.col("gid").alias("a"), F.col("gid").alias("b")).distinct()
            pairs = written(pairs.unionByName(inside))
        else:
            pairs = written(written(pairs).join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        if labels is None or not pairs.isEmpty():
            links = _verified(whole, written(_expanded(pairs, members, percent)), words, percent)
            if labels is None or not links.isEmpty():
                labels = merged(labels, links)
        # What is left: lists without the groups that were tested against all, while they are not one component.
        rest = left.drop("low", "high", "size").join(centres, ["token", "gid"], "left_anti")
        held = members.join(rest.select("gid").distinct(), "gid", "left_semi").join(labels, members.rep == labels.node, "left").groupBy("gid").agg(F.min(F.coalesce("component", "rep")).alias("low"), F.max(F.coalesce("component", "rep")).alias("high"))
        rest = written(rest.join(held, "gid"))
        open_ = rest.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count(F.lit(1)).alias("size")).where("least <> most AND size > 1").select("token", "size")
        before, left = left, written(rest.join(open_, "token"))
        discard(rest, before if share > 1 else None)
        if left.isEmpty():
            return labels
        share *= MORE_CENTRES


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, without those that links lead to a smaller doc_id from. Null doc_ids stay."""
    judged = ngram_jaccard(docs, words, percent)
    return by_ids(docs, judged.where("doc_id <> component_id"), "left_anti")
