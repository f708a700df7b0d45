"""Token ids of whole columns of texts, with each distinct word encoded once in a worker.

A tokenizer that lower-cases, cuts at white space, and takes runs of letters and runs of marks apart encodes a text
as the concatenation of its pieces: blank-separated words, cut again where ASCII letters or digits meet ASCII marks
(the apostrophe, which may start a contraction, cuts nothing). Pieces are found and hashed in numpy, and a worker
keeps the ids of those it has met, so only new ones are encoded. Batches in which the text of an added token occurs
are cut at white space only. Other tokenizers, told by their file, encode text by text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from pricewright.llm.textkernel import ranges, split_words

#: Pieces that a worker keeps before it starts afresh: bounds its memory, changes no result.
KEPT = 1_500_000
#: Stands between words that are encoded as one text; words that hold it are encoded one by one.
MARK = "\x01"
#: 1: ASCII letters and digits, 2: ASCII marks but the apostrophe; a piece ends where the two meet.
_KINDS = np.array([1 if chr(b).isalnum() else 2 if b > 32 and b not in (39, 127) else 0 for b in range(128)] + [0] * 128, np.uint8)
#: Fixed value: the pattern of the pre-tokenizer for which the pieces hold.
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def by_pieces(tokenizer) -> bool:
    """Whether the tokenizer is of the kind whose texts can be encoded piece by piece."""
    said = json.loads(tokenizer.to_str())
    first = ((said["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    steps = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
    return steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern", {}).get("Regex") == _PATTERN and said["model"].get("dropout") is None


class Table:
    """Numbers of 64-bit keys, in open addressing over numpy arrays."""

    def __init__(self):
        self.bits, self.n = 16, 0
        self.keys, self.values = np.zeros(1 << 16, np.uint64), np.full(1 << 16, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for none."""
        out, left, mask = np.full(len(keys), -1, np.int32), np.arange(len(keys)), (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            v, hit = self.values[slot], self.keys[slot] == keys[left]
            done = hit | (v < 0)
            out[left[hit & (v >= 0)]] = v[hit & (v >= 0)]
            left, slot = left[~done], (slot[~done] + 1) & mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Gives new distinct keys the next numbers."""
        values = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        if self.n * 2 > len(self.keys):
            full = self.values >= 0
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            while self.n * 2 > 1 << self.bits:
                self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, mask = np.arange(len(keys)), (1 << self.bits) - 1
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(left):
            free = self.values[slot] < 0
            self.values[slot[free]] = values[left[free]]  # of several in one slot the last stays
            self.keys[slot[free]] = keys[left[free]]
            placed = free & (self.values[slot] == values[left])
            self.keys[slot[placed]] = keys[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & mask


class WordEncoder:
    """Encodes columns of texts by a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.pieces = by_pieces(self.tokenizer)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        mark = self.tokenizer.encode(f" {MARK} ", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.of = Table()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)  # of piece i's ids: ends[i] to ends[i + 1]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and how many each has: one text of all words with a mark between, cut at the mark's id."""
        texts = [w.decode("utf-8", "replace") for w in words]
        if self.mark is not None and not any(MARK in t for t in texts):
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join([*texts, ""])], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(words):
                return ids[ids != self.mark], np.diff(at, prepend=-1) - 1
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.uint32, int(lengths.sum())), lengths

    def _learn(self, words: list[bytes], keys: np.ndarray) -> None:
        new, lengths = self._encode_words(words)
        n = self.of.n
        used = int(self.ends[n])
        while used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[used : used + len(new)] = new
        self.ends[n + 1 : n + 1 + len(words)] = used + np.cumsum(lengths)
        self.of.add(keys)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and how many each has; null is empty."""
        if not self.pieces:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter((i for x in lists for i in x), np.uint32, int(counts.sum())), counts
        words = split_words(texts, lower=True, kinds=_KINDS)
        raw = words.data.tobytes()
        if any(t in raw for t in self.added):  # in lower case: may be too careful, never too bold
            words = split_words(texts)
            raw = words.data.tobytes()
        keys, first, at = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if self.of.n > KEPT:
            self._clear()
        number = self.of.find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = np.arange(self.of.n, self.of.n + len(new))
            a, b = words.starts[first[new]].tolist(), words.ends[first[new]].tolist()
            self._learn([raw[x:y] for x, y in zip(a, b, strict=True)], keys[new])
        at = number[at]
        starts = self.ends[at]
        lengths = self.ends[at + 1] - starts
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[ranges(starts, lengths)], np.diff(upto[words.first])

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with ``end_id`` after each text; returns the ids and the n + 1 offsets of the texts."""
        ids, counts = self.encode(texts)
        offsets = np.concatenate([[0], np.cumsum(counts + 1)])
        out = np.full(int(offsets[-1]), end_id, np.uint32)
        out[ranges(offsets[:-1], counts)] = ids
        return out, offsets


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
