"""Best-fit packing by length-histogram planning.

Texts are encoded once and cut into pieces of at most ``capacity`` tokens. Only
the histogram of piece lengths (at most ``capacity`` numbers) reaches the
driver, where best-fit-decreasing runs over counts: a step places all it can of
one length into one run of equally filled sequences. The plan is a short list
of slots, (length, ranks, sequences, offset); every piece then finds its place
by its rank among the pieces of its length.

Defined results: null text is empty and still holds its closing id. Rows with
equal doc_id are packed each on its own. Texts of any length are encoded whole,
in parts that are cut at white space. Pieces of one length are ranked by lot,
doc_id, piece and checksum; equal ones may change places, which changes no
column but sequence_id. An empty table gives an empty one. Extra columns are
ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakmill.llm.words import Slots, Texts, chunks
from peakmill.runtime import materialize

CAPACITY = 2048
#: A worker's cache: slots for pieces of text, and the ids that it holds before it starts anew.
SLOT_BITS = 19
ARENA = 1 << 22
#: Words that are encoded as one string.
JOINED = 256
#: Rows whose ids are held together.
ROWS = 256
#: Rows of one rank group, about.
LOT = 200_000
END = np.zeros(1, "<u4").tobytes()
MARK = np.zeros(256, bool)
MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_held: dict[str, "Words"] = {}


def latin(buf: np.ndarray) -> np.ndarray:
    """Bytes of letters: A-Z, a-z and U+00C0 to U+023F but for the two signs and the dotted capital I there."""
    lead = (buf >= 0xC3) & (buf <= 0xC8)
    after = np.zeros(len(buf), bool)
    after[1:] = lead[:-1]
    other = np.zeros(len(buf), bool)
    if lead.any():
        other[1:] = ((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))) | ((buf[:-1] == 0xC4) & (buf[1:] == 0xB0))
    return ASCII_LETTER[buf] | lead | (after & ~other)


class Words:
    """A worker's tokenizer with a bounded cache of the ids of words.

    The tokenizer lower-cases, drops white space and never joins across it, so
    words are encoded alone. Letters and the marks after them are pieces of
    their own for it, so a word of Latin letters and ASCII marks is looked up
    as two units; any other word is one. Units are known by their 64-bit hash
    and length; a slot of the cache holds the last unit that fell on it, and
    units that are not there are encoded anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.slots = Slots(SLOT_BITS)
        self.where, self.many, self.known = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32), 0
        self.arena, self.used = np.zeros(ARENA // 4, np.uint32), 0

    def _alone(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, many encoded as one string and told apart by the tokens that end a word; and their numbers."""
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        ids, many = [], []
        for group, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            own = np.array(e.ids, np.uint32)
            stop = np.flatnonzero(self.ends[own]) + 1
            if len(stop) == len(group):
                ids.append(own)
                many.append(np.diff(stop, prepend=0))
            else:  # a letter that the tokenizer takes for something else
                found = self._alone(group)
                ids += found
                many.append(np.array([len(x) for x in found], np.int64))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *many])

    def _learn(self, raw: bytes, folded: bytes, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the units begin in the arena, and how many they are; plain: units of letters."""
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        a, b, n = start[order].tolist(), end[order].tolist(), int(plain.sum())
        ids, many = self._letters([folded[i:j].decode() for i, j in zip(a[:n], b[:n], strict=True)])
        # not folded: upper case matters to control strings
        rest = self._alone([raw[i:j].decode() for i, j in zip(a[n:], b[n:], strict=True)])
        ids = np.concatenate([ids, *rest])
        many = np.concatenate([many, np.array([len(x) for x in rest], np.int64)])
        if self.used + len(ids) > len(self.arena):
            self.arena = np.concatenate([self.arena[: self.used], np.zeros(len(self.arena) + len(ids), np.uint32)])
        self.arena[self.used : self.used + len(ids)] = ids
        where = np.empty(len(order), np.int64)
        count = np.empty(len(order), np.int64)
        where[order] = self.used + np.cumsum(many) - many
        count[order] = many
        self.used += len(ids)
        return where, count

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one number more than texts)."""
        if self.used > ARENA or self.known > 1 << SLOT_BITS:
            self.clear()
        folded = t.folded()
        letter = latin(t.buf)
        total = np.concatenate([[0], np.cumsum(letter)])
        mark = np.concatenate([[0], np.cumsum(MARK[t.buf])])
        start, end = t.start, t.end
        letters = total[end] - total[start]
        # letters first, marks after them, and nothing else: two units
        middle = start + letters
        split = (letters > 0) & (total[middle] - total[start] == letters) & (mark[end] - mark[middle] == end - middle)
        plain = split | (letters == end - start)
        two = split & (middle < end)
        place = np.arange(len(start)) + np.cumsum(two) - two
        first, last = np.empty(len(start) + int(two.sum()), np.int64), np.empty(len(start) + int(two.sum()), np.int64)
        kind = np.zeros(len(first), bool)
        first[place], last[place], kind[place] = start, np.where(two, middle, end), plain
        first[place[two] + 1], last[place[two] + 1] = middle[two], end[two]
        bounds = np.append(place, len(first))[t.first]

        h = Texts.hashes(folded, first, last)
        # case matters to other words: their hash is of the word as it is
        odd = np.flatnonzero(~kind)
        if len(odd):
            h[odd] = ~Texts.hashes(t.buf, first[odd], last[odd])
        at, miss, new, back = self.slots.look(h)
        where, many = self.where[at].astype(np.int64), self.many[at].astype(np.int64)
        if len(new):
            w, m = self._learn(t.buf.tobytes(), folded.tobytes(), first[new], last[new], kind[new])
            where[miss], many[miss] = w[back], m[back]
            held = slice(self.known, self.known + len(new))
            if held.stop > len(self.where):
                self.where, self.many = (np.concatenate([x, np.zeros(len(x) + len(new), np.int32)]) for x in (self.where, self.many))
            self.where[held], self.many[held] = w, m
            self.slots.put(h[new], np.arange(held.start, held.stop))
            self.known = held.stop
        upto = np.concatenate([[0], np.cumsum(many)])
        ids = self.arena[np.repeat(where - upto[:-1], many) + np.arange(upto[-1])]
        return ids, upto[bounds]


def encoder(path: str) -> Words:
    if path not in _held:
        _held.clear()
        _held[path] = Words(path)
    return _held[path]


def encode_texts(path: str, texts: pa.Array) -> list[bytes]:
    """Ids of whole texts as little-endian bytes; null is empty."""
    words = encoder(path)
    parts: list[list[bytes]] = [[] for _ in range(len(texts))]
    for i, t in chunks(texts):
        ids, at = words.encode(t)
        data, at = ids.astype("<u4").tobytes(), (at * 4).tolist()
        for n in range(t.n):
            if at[n] < at[n + 1]:
                parts[i + n].append(data[at[n] : at[n + 1]])
    return [p[0] if len(p) == 1 else b"".join(p) for p in parts]


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, lot) of docs(doc_id, text); lot spreads the pieces evenly."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encode_texts(path, b.column("text"))):
                    ids += END
                    for j, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[lo : lo + 4 * capacity]
                        row.append(i)
                        piece.append(j)
                        start.append(lo // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                own = (np.arange(count, count + len(row), dtype=np.uint64) + np.array(crc, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                count += len(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row, pa.int64()))]
                    + [pa.array(x, pa.int64()) for x in (piece, start, length, crc)]
                    + [pa.array((own >> np.uint64(2)).astype(np.int64))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "lot"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint, lot bigint"
    )


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Slots [length, first rank, sequences, first sequence, offset] and the number of sequences.

    Best-fit decreasing: the next length goes where the least room is left
    that still takes it, and on into the same sequences while they take more.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs of (first sequence, how many)
    slots, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                need = -(-left // (capacity // length))
                room.setdefault(capacity, []).append((opened, need))
                opened += need
                fit = capacity
            first, n = room[fit].pop()
            if not room[fit]:
                del room[fit]
            per = fit // length
            use = min(n, -(-left // per))
            if use < n:
                room.setdefault(fit, []).append((first + use, n - use))
            full, rest = divmod(min(left, use * per), per)
            for j in range(per):
                m = full + (j < rest)
                if m:
                    slots.append((length, rank, m, first, capacity - fit + j * length))
                    rank += m
                    left -= m
            if full:
                room.setdefault(fit - per * length, []).append((first, full))
            if rest:
                room.setdefault(fit - rest * length, []).append((first + full, 1))
        room.pop(0, None)
    return np.array(slots, np.int64).reshape(-1, 5), opened


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    # few and even files, however many parts the texts came in
    pieces = materialize(cut(docs, path, capacity).hint("rebalance"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    slots, _ = plan(counts, capacity)
    held = spark.sparkContext.broadcast(slots)
    # rank within length: within an even lot, plus what the lots before hold
    lots = max(8, sum(counts.values()) // LOT)
    dealt = pieces.withColumn("lot", F.pmod("lot", F.lit(lots)))
    before = Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "lot").count().select("length", "lot", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = (
        dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "lot").orderBy("doc_id", "piece", "ids_crc32")))
        .join(base, ["length", "lot"])
        .select(*pieces.columns[:5], (F.col("base") + F.col("rank") - 1).alias("rank"))
    )
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        key = (s[:, 0] << 48) | s[:, 1]
        order = np.argsort(key)
        s, key = s[order], key[order]
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(key, (b.column("length").to_numpy() << 48) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(s[at, 3] + rank - s[at, 1]), pa.array(s[at, 4])],
                [*b.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place, f"doc_id {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
