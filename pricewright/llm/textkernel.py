"""Words and their 64-bit hashes for a whole Arrow column of texts at once, in numpy.

A text column in Arrow is one byte buffer with offsets. Words are found with a byte table, and each word's
hash is a difference of prefix sums of ``T[byte] * P**position`` modulo 2**64, shifted back by the inverse
power, then mixed. The buffer is taken in pieces cut between words, so memory is bounded by the longest word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_IP = pow(_P, -1, 1 << 64)
PIECE = 1 << 18
#: Bytes between words: the blank and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Bytes outside runs of letters: ASCII that is no letter (bytes of other alphabets count as letters).
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser with multiplications and shifts, in place."""
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


_T = mix(np.arange(1, 257, dtype=_U) * _U(_P)) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(PIECE, 1 << (n - 1).bit_length())
        for name, base in (("p", _P), ("i", _IP)):
            table = np.full(size, _U(base))
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["p"], _powers["i"]


@dataclass
class Words:
    data: np.ndarray  #: bytes of all texts
    offsets: np.ndarray  #: of each text in data, and the end
    starts: np.ndarray  #: of each word in data
    ends: np.ndarray
    first: np.ndarray  #: index of each text's first word, and the number of words

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A hash for each word, or for its first ``prefix`` bytes (longer words only keep those)."""
        stop = self.ends if prefix is None else np.minimum(self.ends, self.starts + prefix)
        out, i, n = np.empty(len(self.starts), _U), 0, len(self.starts)
        while i < n:
            at = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, at + PIECE, "right")))
            piece = self.data[at : self.ends[j - 1]]
            power, inverse = _tables(len(piece) + 1)
            total = np.zeros(len(piece) + 1, _U)
            np.cumsum(_T[piece] * power[: len(piece)], out=total[1:])
            s = self.starts[i:j] - at
            out[i:j] = (total[stop[i:j] - at] - total[s]) * inverse[s]
            i = j
        return mix(out + (stop - self.starts).astype(_U))

    def text_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each text's offsets; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split_words(texts: pa.Array | pa.ChunkedArray, lower: bool = False, between: np.ndarray = BLANK, kinds: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that are not in ``between``, none across two texts; ``lower`` maps A-Z to a-z first.

    With ``kinds`` (a number for each byte), runs are also cut where 1 meets 2 or 2 meets 1.
    """
    data, offsets = text_bytes(texts)
    if lower:
        data = LOWER[data]
    word = ~between[data]
    n = len(data)
    begins, ends = word.copy(), word.copy()
    if n:
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        if kinds is not None:
            kind = kinds[data]
            cut = np.flatnonzero((kind[1:] | kind[:-1]) == 3)
            begins[cut + 1] = True
            ends[cut] = True
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] = word[edge]
        ends[edge - 1] = word[edge - 1]
    starts = np.flatnonzero(begins)
    return Words(data, offsets, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` consecutive word hashes (those across two texts are the caller's to leave out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = h[:n] * _U(_P) + _U(k)
    for j in range(1, k):
        out *= _U(0xD6E8FEB86659FD93)
        out += h[j : j + n]
        out ^= out >> _U(29)
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each start and length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def squeeze(texts: pa.Array) -> pa.Array:
    """Each text compressed, its length in bytes before it, for a trip through a shuffle; null stays null."""
    out = []
    for t in texts.to_pylist():
        raw = None if t is None else t.encode()
        out.append(None if raw is None else len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b""))
    return pa.array(out, pa.binary())


def unsqueeze(squeezed: pa.Array) -> pa.Array:
    out = []
    for z in squeezed.to_pylist():
        n = 0 if z is None else int.from_bytes(z[:8], "little")
        out.append(None if z is None else pa.decompress(z[8:], n, codec="zstd", asbytes=True).decode() if n else "")
    return pa.array(out, pa.string())
