"""Public tokenizers with a memo of words; every result is what the library gives for the whole text.

Both libraries work word by word wherever a space stands, so a text's tokens
are those of its pieces between spaces. The memo holds pieces the library has
encoded; it is bounded and only saves time. WordEncoder's memo knows a piece by
a 64-bit hash of its bytes, so that pieces are found without touching each.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

from graphledger.llm import arrays as A

#: Pieces that a memo holds at most, but for those of one run of text (under 100 MB). A full one of WordEncoder keeps what came back.
MEMO = 400_000
#: Longer pieces are encoded each time they occur.
LONG = 64


class PieceCounter:
    """Counts of a sentencepiece model's tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.memo: dict[str, int] = {"": 1}
        self.wordwise = self._is_wordwise()

    def _is_wordwise(self) -> bool:
        """No token reaches over the start of a word, and spaces are kept one by one."""
        names = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any("▁" in name.lstrip("▁") for name in names):
            return False
        probes = ["a b", " a", "a ", "a  b   c ", "  ", "x\n y", "é ß\t z", "a b c"]
        return all(self._count([p]) == [len(self.model.encode(p))] for p in probes)

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if "  " in text or text[0] == " ":
            return re.split("(?<=[^ ]) ", text)
        return text.split(" ")

    def _count(self, texts: Sequence[str]) -> list[int]:
        if len(self.memo) > MEMO:
            self.memo = {"": 1}
        # The word mark itself may stand in a text, and then looks like a space to the model.
        split = [self._pieces(t) if t and "▁" not in t else None for t in texts]
        new = list(set(chain.from_iterable(s for s in split if s)) - self.memo.keys())
        self.memo.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
        get = self.memo.__getitem__
        out = [sum(map(get, s)) if s else len(self.model.encode(t)) for t, s in zip(texts, split)]
        for piece in new:
            if len(piece) > LONG:
                del self.memo[piece]
        return out

    def counts(self, texts: Sequence[str]) -> list[int]:
        if not self.wordwise:
            return [len(x) for x in self.model.encode(list(texts), num_threads=1)]
        return list(chain.from_iterable(self._count(texts[i : i + 256]) for i in range(0, len(texts), 256)))


class Memo:
    """The ids of pieces by the pieces' hashes: an open-addressed table in arrays, asked for many pieces at once."""

    def __init__(self, slots: int = 1 << 15):
        self.entry, self.key = np.full(slots, -1, np.int32), np.zeros(slots, np.uint64)
        self.hashes, self.again = np.empty(slots, np.uint64), np.zeros(slots, bool)
        self.begin, self.flat = np.zeros(slots + 1, np.int64), np.empty(slots, np.uint32)
        self.n = 0

    def __len__(self) -> int:
        return self.n

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        mask = np.int64(len(self.entry) - 1)
        at = hashes.view(np.int64) & mask
        out = self.entry[at].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (self.key[at] != hashes))
        at = at[open_]
        while len(open_):
            at = (at + 1) & mask
            out[open_] = self.entry[at]
            on = (out[open_] >= 0) & (self.key[at] != hashes[open_])
            open_, at = open_[on], at[on]
        self.again[out[out >= 0]] = True
        return out

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Adds distinct hashes that are not in it, each with its ids; returns their entries."""
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        return self._add(hashes, sizes, np.frombuffer(b"".join(ids), "<u4"))

    def _add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        n, used = self.n, int(self.begin[self.n])
        need, total = n + len(hashes), used + len(ids)
        if need > len(self.hashes):
            self.hashes, self.again, self.begin = (np.concatenate((x, np.zeros(need, x.dtype))) for x in (self.hashes, self.again, self.begin))
        if total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(total, np.uint32)))
        self.hashes[n:need], self.again[n:need], self.flat[used:total] = hashes, False, ids
        self.begin[n + 1 : need + 1] = used + np.cumsum(sizes)
        self.n, first = need, n
        if 2 * need > len(self.entry):
            slots = 1 << (2 * need - 1).bit_length()
            self.entry, self.key, first = np.full(slots, -1, np.int32), np.zeros(slots, np.uint64), 0
        mine = np.arange(first, need, dtype=np.int32)
        mask = np.int64(len(self.entry) - 1)
        at = self.hashes[first:need].view(np.int64) & mask
        while len(mine):
            free = self.entry[at] < 0
            self.entry[at[free]] = mine[free]  # of those that meet in a slot one stays
            won = self.entry[at] == mine
            self.key[at[won]] = self.hashes[mine[won]]
            mine, at = mine[~won], (at[~won] + 1) & mask
        return np.arange(n, need)

    def shrink(self, limit: int) -> None:
        """Over the limit, only pieces that were found again since the last time stay, half the limit at most."""
        if self.n <= limit:
            return
        keep = np.flatnonzero(self.again[: self.n])[-(limit // 2) :]
        sizes = self.begin[keep + 1] - self.begin[keep]
        at = np.repeat(self.begin[keep] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        hashes, ids = self.hashes[keep], self.flat[at]
        self.__init__()
        self._add(hashes, sizes, ids)


class WordEncoder:
    """Ids of a tokenizers-library tokenizer whose words end at white space; the library encodes every piece.

    New pieces go to the library many at a time. Where its pattern parts
    letters from full stops, a full stop stands between pieces of letters;
    other pieces have a special token between them, at which the library cuts
    before all else. So each piece is encoded by itself. Each new encoder
    compares this with whole texts on samples; where they differ, the library
    gets every text as it is.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self._forget()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        between = [t for t in spec["added_tokens"] if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.between, self.between_id = (between[-1]["content"], between[-1]["id"]) if between else ("", -1)
        self.stop_id = -1
        stop = self.model.encode(".", add_special_tokens=False).ids
        pairs = ["ab.cd", "é.x", "a.b.c", "the.er.ing.th.ne"]
        self.marks = {m: self._plain(m) for m in ".,"}
        if len(stop) == 1 and all(self._plain(p) == np.uint32(stop[0]).tobytes().join(map(self._plain, p.split("."))) for p in pairs) and all(self._plain(p + m) == self._plain(p) + x for p in ("ab", "é", "the") for m, x in self.marks.items()):
            self.stop_id = stop[0]
        probes = ["a b", " a", "a ", "Ab, c. d., e.. f.", "a  B.c ", "it's 42 o'clock", "x\n y z", "É é İ", "<|endoftext|> a", "<|ENDOFTEXT|> a", "b<|EndOfText|>A <|StartOfText|>", "Straße, niño; 'll 'S ½ — naïve!!", "thththe ererer.Thion'd", "\x00 \t\u00a0x ª"]
        self.wordwise = bool(between)
        self.wordwise = self.wordwise and all(x.tobytes() == self._plain(p) for x, p in zip(self.ids(probes), probes))
        self._forget()

    def _plain(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _spans(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces between blanks, and each text's first; a last mark behind a letter is a piece of its own."""
        starts, ends, first = A.word_spans(buf, offsets)
        if self.stop_id < 0 or not len(starts):
            return starts, ends, first
        last, before = buf[ends - 1], buf[np.maximum(ends - 2, 0)]
        cut = (ends - starts > 1) & ((last == 44) | (last == 46)) & (before >= 97) & (before <= 122)
        extra = np.cumsum(cut)
        at = np.flatnonzero(cut)
        return np.insert(starts, at + 1, ends[at] - 1), np.insert(ends, at, ends[at] - 1), first + np.concatenate(([0], extra))[first]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        known: dict[str, bytes] = {}
        alone = {p for p in pieces if "<" in p and any(t in p for t in self.special)}
        letters = [p for p in pieces if p.isalpha() and (p.isascii() or p.lower().isalpha())] if self.stop_id >= 0 else []
        others = list(set(pieces).difference(letters, alone))
        known.update((p, self._plain(p)) for p in alone)
        self._many(letters, ".", self.stop_id, known)
        self._many(others, self.between, self.between_id, known)
        return [known[p] for p in pieces]

    def _many(self, pieces: list[str], between: str, between_id: int, known: dict[str, bytes]) -> None:
        parts = [pieces[i : i + 64] for i in range(0, len(pieces), 64)]
        for part, e in zip(parts, self.model.encode_batch_fast([between.join(x) for x in parts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == between_id)).tolist()
            if len(cuts) == len(part) - 1:
                known.update((p, raw[i:j]) for p, i, j in zip(part, [0, *(c + 4 for c in cuts)], [*cuts, len(raw)]))
            else:
                known.update((p, self._plain(p)) for p in part)

    def _forget(self) -> None:
        self.memo = Memo()

    def _run(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and where each text's begin."""
        low = A.LOWER[buf]
        for k in np.unique(A.owners(offsets, np.flatnonzero(buf == 60))).tolist():
            # Case matters to special tokens, which the library looks for in the text as it is.
            low[offsets[k] : offsets[k + 1]] = buf[offsets[k] : offsets[k + 1]]
        starts, ends, first = self._spans(low, offsets)
        hashes = A.span_hashes(low, starts, ends)
        self.memo.shrink(MEMO)
        word = self.memo.find(hashes)
        missed = np.flatnonzero(word < 0)
        if len(missed):
            new, lead, place = np.unique(hashes[missed], return_index=True, return_inverse=True)
            raw, s, e = low.tobytes(), starts[missed[lead]].tolist(), ends[missed[lead]].tolist()
            word[missed] = self.memo.add(new, self._learn([raw[i:j].decode() for i, j in zip(s, e)]))[place]
        sizes = self.memo.begin[word + 1] - self.memo.begin[word]
        done = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(int(done[-1])) + np.repeat(self.memo.begin[word] - done[:-1], sizes)
        return self.memo.flat[at], done[first]

    def ids(self, texts: Sequence[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.wordwise:
            return [np.frombuffer(self._plain(t), "<u4") for t in column.to_pylist()]
        buf, offsets = A.text_bytes(column)
        out: list[np.ndarray] = []
        for i, j in A.runs(offsets):
            ids, begin = self._run(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out.extend(ids[s:e] for s, e in zip(begin[:-1].tolist(), begin[1:].tolist()))
        return out
