"""Fill-in-the-middle: texts cut at unit boundaries, their parts put in another order between sentinels.

One byte automaton does all the reading. Its state is how much of a sentinel
stands behind it, whether a unit ends there, and how many bytes of a UTF-8
character are still to come; a transition counts a character, a unit's
beginning, a sentinel's end, or nothing. It forgets all but its last few bytes
(``memory``, found from the table), so a block of bytes is run by that many
table look-ups, all positions at once, and blocks follow one another with those
bytes carried over. A first pass counts; a second one finds the places of the
cuts among the units' beginnings.

Defined results: null text is empty; an empty text, one that holds a sentinel
and one that the draw leaves alone stay as they are (``plain``). A null doc_id
draws as an empty one; rows of equal doc_id and text give equal rows. Very long
texts are read whole, in blocks. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a transition counts.
CHAR, UNIT, MARK = 1, 2, 4
#: The symbol beyond the bytes that stands between texts.
RESET = 256
BLOCK_BYTES = 1 << 20
SCHEMA = "doc_id string, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        """None may begin where another (or itself) ends, or lie in another: then no text makes a false one beside a true one."""
        for a in self.all:
            for b in self.all:
                if not a or (a is not b and b in a) or any(a.endswith(b[:i]) for i in range(1, len(b))):
                    raise ValueError(f"sentinels overlap: {a!r}, {b!r}")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class Automaton:
    """The table for some sentinels and the byte that ends a unit."""

    def __init__(self, sentinels: tuple[str, ...], end: bytes = b"\n"):
        words = [s.encode() for s in sentinels]
        start = (b"", True, 0)
        number, queue, nexts, counts = {start: 0}, deque([start]), [], []
        while queue:
            behind, fresh, due = queue.popleft()
            row, count = [], []
            for byte in range(256):
                inside = due > 0 and byte >> 6 == 2
                seen = behind + bytes([byte])
                marked = any(seen.endswith(w) for w in words)
                # the longest ending that begins a sentinel
                keep = next(seen[i:] for i in range(len(seen) + 1) if any(w.startswith(seen[i:]) and w != seen[i:] for w in words))
                left = due - 1 if inside else 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
                to = (keep, bytes([byte]) == end, left)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                row.append(number[to])
                count.append((0 if inside else CHAR | UNIT * fresh) | MARK * marked)
            nexts.append([*row, 0])
            counts.append([*count, 0])
        table, emits = np.array(nexts), np.array(counts)
        # bytes that do the same everywhere are one class
        _, first, of = np.unique(np.concatenate([table, emits]), axis=1, return_index=True, return_inverse=True)
        self.of = of.ravel().astype(np.uint8)
        self.width = len(first)
        self.next = table[:, first].astype(np.uint16).ravel()
        self.emit = emits[:, first].astype(np.uint8).ravel()
        self.memory = self._memory(table[:, first])

    @staticmethod
    def _memory(table: np.ndarray) -> int:
        """After so many symbols the state no longer depends on where the run began."""
        apart = ~np.eye(len(table), dtype=bool)
        for steps in range(len(table) ** 2):
            if not apart.any():
                return steps
            a, b = np.nonzero(apart)
            apart = np.zeros_like(apart)
            for c in range(table.shape[1]):
                apart[table[a, c], table[b, c]] = True
            np.fill_diagonal(apart, False)
        raise ValueError("the automaton remembers without end")

    def run(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """What each byte counts; a text begins at each of off."""
        out = np.zeros(len(data), np.uint8)
        m, w = self.memory, np.uint16(self.width)
        heads = off[:-1]
        for lo in range(0, len(data), BLOCK_BYTES):
            hi = min(lo + BLOCK_BYTES, len(data))
            back = max(lo - m, 0)
            # a reset before each text's first byte
            at = heads[np.searchsorted(heads, back) : np.searchsorted(heads, hi)] - back
            at = np.unique(at)
            symbols = np.insert(self.of[data[back:hi]], at, self.of[RESET])
            symbols = np.concatenate([np.full(m + 1, self.of[RESET], np.uint8), symbols]).astype(np.uint16)
            n = len(symbols) - m
            state = np.zeros(n, np.uint16)  # before symbol m, m + 1, ...
            for j in range(m):
                state = self.next[state * w + symbols[j : j + n]]
            made = self.emit[state * w + symbols[m:]]
            true = np.ones(n, bool)
            true[0] = False
            true[at + np.arange(len(at)) + 1] = False
            out[lo:hi] = made[true][lo - back :]
        return out


def draws(seed: int, ident: str) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers that depend on nothing else."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{ident}".encode()).digest()[:16])


def transform(docs: DataFrame, seed: int = 7, percent: int = 100, spm: int = 50, sentinels: Sentinels | None = None) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every text of docs(doc_id, text) cut into n lines and put together anew.

    ``percent`` of the texts are cut, of these ``spm`` percent have the suffix
    first (form ``spm``: suffix, prefix, middle), the others the prefix (``psm``).
    """
    sentinels = sentinels or Sentinels()
    p, s, m = (x.encode() for x in sentinels.all)
    machine = Automaton(sentinels.all)

    def work(batch: pa.RecordBatch, lo: int, hi: int) -> pa.RecordBatch:
        text = batch.column(1).slice(lo, hi - lo).cast(pa.large_string()).fill_null("")
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        held = text.buffers()[2]
        data = np.frombuffer(held, np.uint8)[off[0] : off[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
        off = off - off[0]
        counted = machine.run(data, off)
        begins = np.flatnonzero(counted & UNIT)
        marks = np.flatnonzero(counted & MARK)
        first = np.searchsorted(begins, off)
        clean = np.diff(np.searchsorted(marks, off)) == 0
        raw = data.tobytes()
        cols: list[list] = [[], [], [], [], []]
        for i, ident in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
            a, z, n = int(off[i]), int(off[i + 1]), int(first[i + 1] - first[i])
            h1, h2, h3, h4 = draws(seed, ident or "")
            if not n or not clean[i] or h3 % 100 >= percent:
                row = (n, "plain", None, None, raw[a:z])
            else:
                cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
                b, c = (int(begins[first[i] + u]) if u < n else z for u in cuts)
                chars = [int(np.count_nonzero(counted[x:y] & CHAR)) for x, y in ((a, b), (b, c))]
                pre, mid, suf = raw[a:b], raw[b:c], raw[c:z]
                form, parts = ("spm", (s, suf, p, pre, m, mid)) if h4 % 100 < spm else ("psm", (p, pre, s, suf, m, mid))
                row = (n, form, *chars, b"".join(parts))
            for col, value in zip(cols, row, strict=True):
                col.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        made = [pa.array(c, k) for c, k in zip(cols[:4], kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *made, pa.array(cols[4], pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(_lengths(b.column(1)))
            lo = 0
            while lo < b.num_rows:
                reach = (size[lo - 1] if lo else 0) + BLOCK_BYTES
                hi = max(lo + 1, int(np.searchsorted(size, reach, "right")))
                yield work(b, lo, hi)
                lo = hi

    kind = docs.schema["doc_id"].dataType
    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, SCHEMA).withColumn("doc_id", F.col("doc_id").cast(kind))


def _lengths(text: pa.Array) -> np.ndarray:
    """Bytes of each text."""
    text = text.cast(pa.large_string()).fill_null("")
    return np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])


def restored(output: Column, form: Column, sentinels: Sentinels | None = None) -> Column:
    """The text that an output was made from."""
    p, s, m = (sentinels or Sentinels()).all

    def parts(a: str, b: str) -> tuple[Column, Column, Column]:
        """What follows a, b and the middle's sentinel."""
        at, last = F.instr(output, b), F.instr(output, m)
        return (
            F.substring(output, F.lit(len(a) + 1), at - len(a) - 1),
            F.substring(output, at + len(b), last - at - len(b)),
            F.substring(output, last + len(m), F.length(output)),
        )

    pre, suf, mid = parts(p, s)
    suf2, pre2, mid2 = parts(s, p)
    return F.when(form == "psm", F.concat(pre, mid, suf)).when(form == "spm", F.concat(pre2, mid2, suf2)).otherwise(output)


def digests(docs: DataFrame, **options: object) -> DataFrame:
    """transform() with hashes of the output and of the text rebuilt from it in place of the output."""
    made = transform(docs, **options)
    back = restored(F.col("output"), F.col("form"), options.get("sentinels"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )
