"""Vectorised word kernel over Arrow text buffers.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``. Bytes of many texts are
hashed at once with a prefix polynomial modulo 2**64: the hash of a word (or
line) is a difference of two prefix sums, shifted back by the inverse power of
its position, then mixed. No Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 18
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls while small."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, SLICE_BYTES * 2)
        held = np.full(size, base, U)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if size <= SLICE_BYTES * 4:
            _powers[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), wrapping."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Texts:
    """Some texts as one byte buffer with offsets; nulls are empty."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self.n = len(off) - 1
        b = buf
        space = (b == 32) | ((b >= 9) & (b <= 13))
        before = np.ones(len(b), bool)
        before[1:] = space[:-1]
        after = np.ones(len(b), bool)
        after[:-1] = space[1:]
        heads = off[:-1][off[:-1] < off[1:]]
        before[heads] = True
        after[off[1:][off[:-1] < off[1:]] - 1] = True
        word = ~space
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.first = np.searchsorted(self.start, off)  # first word of each text

    def folded(self) -> np.ndarray:
        """A-Z lower-cased, all else untouched."""
        return np.where((self.buf >= 65) & (self.buf <= 90), self.buf + 32, self.buf).astype(np.uint8)

    @staticmethod
    def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.zeros(len(buf) + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * powers(BASE, len(buf)), out=total[1:])
        h = (total[end] - total[start]) * powers(INVERSE, len(buf) + 1)[start]
        return mix(h ^ ((end - start).astype(U) * U(0xD6E8FEB86659FD93)))

    def word_hashes(self, fold: bool) -> np.ndarray:
        return self.hashes(self.folded() if fold else self.buf, self.start, self.end)

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Sum over each text of a per-byte weight."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(weight, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]


def chain(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of the k words from each position on."""
    x = np.full(len(at), k, U)
    for j in range(k):
        x = mix(x * U(0x2545F4914F6CDD1D) + h[at + j])
    return x


def slices(text: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, Texts]]:
    """(from, to, Texts) over consecutive rows of about SLICE_BYTES; one longer text is a slice of its own."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, len(text))
        yield lo, hi, Texts(whole[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def chunks(text: pa.Array, size: int | None = None) -> Iterator[tuple[int, Texts]]:
    """(first row, Texts) of about ``size`` bytes (SLICE_BYTES) each; a longer text comes in parts that are cut at white space.

    Texts without a byte may be missed out.
    """
    size = size or SLICE_BYTES
    text = text.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, stop = int(off[0]), int(off[-1])
    while lo < stop:
        hi = stop
        if lo + size < stop:
            hi = int(off[np.searchsorted(off, lo + size, "right") - 1])
            if hi <= lo:  # within one text: up to white space, or to its end
                end = int(off[np.searchsorted(off, lo, "right")])
                hi = lo + size
                while hi < end:
                    near = whole[hi : min(hi + size, end)]
                    gap = np.flatnonzero((near == 32) | ((near >= 9) & (near <= 13)))
                    if len(gap):
                        hi += int(gap[0])
                        break
                    hi += len(near)
        i, j = int(np.searchsorted(off, lo, "right")) - 1, int(np.searchsorted(off, hi, "left"))
        yield i, Texts(whole[lo:hi], np.clip(off[i : j + 1], lo, hi) - lo)
        lo = hi


class Slots:
    """Places of things known by a 64-bit hash. A slot holds the last one that fell on it, so memory is bounded and what was lost is new again."""

    def __init__(self, bits: int):
        self.shift = U(64 - bits)
        self.key, self.at = np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int32)

    def clear(self) -> None:
        self.at[:] = -1

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The places of h (any for new ones); where new ones stand in h, which of them comes first for each hash, and each one's number among those."""
        slot = (h >> self.shift).astype(np.int64)
        at = self.at[slot].astype(np.int64)
        new = np.flatnonzero((self.key[slot] != h) | (at < 0))
        _, one, back = np.unique(h[new], return_index=True, return_inverse=True)
        return at, new, new[one], back

    def put(self, h: np.ndarray, at: np.ndarray) -> None:
        slot = (h >> self.shift).astype(np.int64)
        self.key[slot], self.at[slot] = h, at


def shingle_sets(t: Texts, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, A-Z folded.

    A text with 1 to k-1 words has its whole sequence as its one shingle; a
    text without words has none.
    """
    h = t.word_hashes(True)
    at = np.arange(max(len(h) - k + 1, 0))
    at = at[t.doc[at] == t.doc[at + k - 1]] if len(at) else at
    s = chain(h, at, k)
    bounds = np.searchsorted(at, t.first)
    out = []
    for d in range(t.n):
        lo, hi = bounds[d], bounds[d + 1]
        w = t.first[d + 1] - t.first[d]
        if w >= k:
            out.append(np.unique(s[lo:hi]))
        elif w:
            out.append(chain(h, t.first[d : d + 1], int(w)))
        else:
            out.append(np.zeros(0, U))
    return out


def filtered(docs: DataFrame, keep: Callable[[pa.Array], Iterator[np.ndarray]]) -> DataFrame:
    """The rows of docs that keep(texts) lets through, part by part; all columns as they are, whatever they are called."""
    at = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = [np.zeros(0, bool), *keep(b.column(at))]
            yield b.filter(pa.array(np.concatenate(mask)))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
