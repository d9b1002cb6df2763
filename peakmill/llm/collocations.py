"""Phrases whose words stand together more often than their parts would have it, by language.

Each task gathers texts into shards, numbers a shard's words, and sorts the
suffixes of that sequence by prefix doubling in numpy: ranks by one word, by
two, and so on, until they cover the longest phrase. Neighbouring suffixes that
share their first n words (an LCP interval) are one n-word phrase, the
interval's length its count. Counts of equal phrases are then summed over all
shards by a shuffle on the phrase itself, which splits any frequent word's
phrases. Words and pairs are counted first; of longer phrases only those are
handed on whose every shorter part is frequent enough, by a filter of bounded
size that may let others through, which the threshold then drops.

Defined results: null text is empty, null language is ``und``. Equal rows count
as often as they come. A piece of any length is counted whole; a text is read in
parts that end at piece boundaries. Ties are ordered by phrase. Empty tables
give no rows. Extra columns are ignored. Counts are exact below 10**16, and so
are scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakmill.llm.words import Texts, U, chain, mix
from peakmill.runtime import materialize

#: Bytes of text that are one shard, about.
SHARD_BYTES = 4 << 20
#: The filter has at most so many bits (as a power of two); a fuller one lets more through.
MOST_BITS = 26
PAIR = 2
#: Parts in which a language's phrases are ranked before they are ranked together: SALTS * top rows a language at most.
SALTS = 16
#: Fixed by the contract: what ends a piece, and what ends a word within one.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2


class Shard:
    """The words of some texts in order, as numbers, zero after each piece.

    A number stands for a word in a language, so phrases of two languages differ.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, langs: pa.Array):
        low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
        kind = _KIND[low]
        word = kind == 0
        heads = off[:-1][off[:-1] < off[1:]]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        begins[heads] |= word[heads]
        ends[heads[1:] - 1] |= word[heads[1:] - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        lens = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=lens[1:])
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(lens), pa.py_buffer(low[word])).dictionary_encode()
        self.words = words.dictionary.cast(pa.string())
        doc = np.searchsorted(off, start, "right") - 1
        langs = langs.dictionary_encode()
        self.langs = langs.dictionary
        lang = np.asarray(langs.indices).astype(np.int64)[doc]
        self.n_langs = max(1, len(self.langs))
        # a piece ends where a separator or another text comes before the next word
        stops = np.cumsum(kind == 2)[start] if len(start) else np.zeros(0, np.int64)
        fresh = np.ones(len(start), bool)
        fresh[1:] = (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])
        self.counts = np.bincount(lang, minlength=self.n_langs)
        at = np.arange(len(start)) + np.cumsum(fresh) - 1
        self.seq = np.zeros(len(start) + int(fresh.sum()), np.int64)
        self.seq[at] = np.asarray(words.indices).astype(np.int64) * self.n_langs + lang + 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each place of seq, of its word and language; zero between pieces."""
        w, g = hashes_of(self.words), hashes_of(self.langs.cast(pa.string()))
        code = self.seq - 1
        full = mix(w[code // self.n_langs] + mix(g[code % self.n_langs]) * U(3)) if len(self.words) else np.zeros(len(code), U)
        return np.where(self.seq > 0, full, U(0))


def hashes_of(values: pa.Array) -> np.ndarray:
    """64-bit hashes of whole strings."""
    values = values.cast(pa.large_string())
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts.hashes(buf, off[:-1] - off[0], off[1:] - off[0])


def ranks(values: np.ndarray) -> np.ndarray:
    """Dense ranks from 0."""
    order = np.argsort(values)
    held = values[order]
    new = np.zeros(len(held), np.int64)
    new[1:] = held[1:] != held[:-1]
    out = np.empty(len(held), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_array(seq: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of seq in the order of their first depth words, and of each with the one before it how many of those they share (its LCP).

    Ranks by 1, 2, 4, ... words are doubled; the last step takes what is missing.
    """
    n = len(seq)
    known = {1: ranks(seq)}
    reach = 1
    while reach < depth:
        step = min(reach, depth - reach)
        ahead = np.zeros(n, np.int64)  # the sequence ends with a zero, whose rank is the least
        ahead[: n - step] = known[reach][step:]
        known[reach + step] = ranks(known[reach] * (n + 1) + ahead)
        reach += step
    order = np.argsort(known[reach], kind="stable")
    lcp = np.zeros(n, np.int64)
    # how many words two suffixes share: the largest known stretch that is equal, then on from there
    left, right = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(n - 1, 0), np.int64)
    for size in sorted((s for s in known if s & (s - 1) == 0), reverse=True):
        for _ in range(2 if size * 2 > depth else 1):
            ok = (shared + size <= depth) & (left < n) & (right < n)
            ok[ok] = known[size][left[ok]] == known[size][right[ok]]
            shared[ok] += size
            left[ok] += size
            right[ok] += size
    lcp[1:] = shared
    return order, lcp


def run_lengths(seq: np.ndarray) -> np.ndarray:
    """How many words stand from each place to the end of its piece."""
    n = len(seq)
    ends = np.flatnonzero(seq == 0)
    place = np.arange(n)
    return ends[np.searchsorted(ends, place)] - place if n else place


def least_between(lcp: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """LCPs of the suffixes that stay, each with the one before it: the least of all in between."""
    return np.minimum.reduceat(lcp[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1])) if len(kept) else lcp[:0]


def interval_counts(shard: Shard, sizes: range, allowed: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, counts) for n in sizes: a place where each n-word phrase stands, and how often it does in the shard.

    With allowed, only phrases that begin at those places.
    """
    seq = shard.seq
    order, lcp = suffix_array(seq, sizes[-1])
    left = run_lengths(seq)
    if allowed is not None:
        kept = np.flatnonzero(allowed[order])
        lcp, order = least_between(lcp, kept), order[kept]
    for n in sizes:
        whole = np.flatnonzero(left[order] >= n)
        if not len(whole):
            continue
        heads = np.flatnonzero(np.append(True, least_between(lcp, whole)[1:] < n))
        yield n, order[whole[heads]], np.diff(np.append(heads, len(whole)))


def phrases_at(shard: Shard, places: np.ndarray, n: int) -> pa.Array:
    """Phrases as strings, each with a tab and its language behind it; words hold no tab."""
    code = shard.seq[places[:, None] + np.arange(n)] - 1
    parts = [shard.words.take(pa.array(code[:, i] // shard.n_langs)) for i in range(n)]
    joined = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
    return pc.binary_join_element_wise(joined, shard.langs.take(pa.array(code[:, 0] % shard.n_langs)), "\t")


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of about SHARD_BYTES; a longer text comes in parts that end where a piece does."""
    bufs: list[np.ndarray] = []
    langs: list[str] = []
    held = 0

    def made() -> Shard:
        off = np.zeros(len(bufs) + 1, np.int64)
        np.cumsum([len(b) for b in bufs], out=off[1:])
        return Shard(np.concatenate(bufs) if bufs else np.zeros(0, np.uint8), off, pa.array(langs, pa.string()))

    for b in batches:
        text = b.column(0).cast(pa.large_string()).fill_null("")
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = text.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        for i, lang in enumerate(b.column(1).to_pylist()):
            lo, end = int(off[i]), int(off[i + 1])
            while lo < end:
                hi = _cut(whole, lo, end)
                bufs.append(whole[lo:hi])
                langs.append("und" if lang is None else lang)
                held += hi - lo
                lo = hi
                if held >= SHARD_BYTES:
                    yield made()
                    bufs, langs, held = [], [], 0
        # views of a batch don't outlive it
        bufs = [x.copy() for x in bufs]
    if bufs:
        yield made()


def _cut(whole: np.ndarray, lo: int, end: int) -> int:
    """Where the part that begins at lo ends: at end, or behind the first piece boundary SHARD_BYTES on."""
    hi = lo + SHARD_BYTES
    while hi < end:
        stop = np.flatnonzero(_KIND[whole[hi : min(hi + SHARD_BYTES, end)]] == 2)
        if len(stop):
            return hi + int(stop[0]) + 1
        hi += SHARD_BYTES
    return end


def _emit(shard: Shard, found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for n, places, counts in found:
        for lo in range(0, len(places), 200_000):
            keys = phrases_at(shard, places[lo : lo + 200_000], n)
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts[lo : lo + 200_000].astype(np.int64))], ["key", "cnt"])


def summed(parts: DataFrame, least: int) -> DataFrame:
    """(key, cnt) over all shards, from least on. Shards have counted already: no second partial aggregate before the shuffle."""
    dealt = parts.repartition("key")
    return dealt.groupBy("key").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= least)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def first_counts(docs: DataFrame, most: int, least: int) -> DataFrame:
    """(key, cnt) of words and pairs, and of each language ``\\t\\t`` and its name with the number of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            held = np.flatnonzero(shard.counts)
            totals = pc.binary_join_element_wise(pa.array(["\t"] * len(held)), shard.langs.take(pa.array(held)), "\t")
            yield pa.RecordBatch.from_arrays([totals, pa.array(shard.counts[held].astype(np.int64))], ["key", "cnt"])
            yield from _emit(shard, interval_counts(shard, range(1, min(PAIR, most) + 1)))

    counted = _texts(docs).mapInArrow(run, "key string, cnt bigint")
    every = counted.repartition("key").groupBy("key").agg(F.sum("cnt").alias("cnt"))
    return materialize(every.where((F.col("cnt") >= least) | F.col("key").startswith("\t\t")), "phrases")


def filter_of(frequent: DataFrame, bits: int, size: int) -> np.ndarray:
    """Bytes of which the bits are set where the hashes of the phrases of that size fall; parts are joined by word, at most 2**bits bits in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            slot = key_hashes(b.column(0), size) >> U(64 - bits)
            np.bitwise_or.at(held, (slot >> U(3)).astype(np.int64), np.left_shift(1, (slot & U(7)).astype(np.uint8)).astype(np.uint8))
        words = held.view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].astype(np.int64))], ["at", "word"])

    rows = frequent.select("key").mapInArrow(run, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["at"].to_numpy()] = rows["word"].to_numpy()
    return out.view(np.uint8)


def key_hashes(keys: pa.Array, size: int) -> np.ndarray:
    """Hashes of phrases of that many words as _places() has them."""
    split = pc.split_pattern(keys.cast(pa.string()), "\t", max_splits=1)
    words = pc.list_flatten(pc.split_pattern(pc.list_element(split, 0), " "))
    lang = np.repeat(mix(hashes_of(pc.list_element(split, 1))), size)
    full = mix(hashes_of(words) + lang * U(3))
    return chain(full, np.arange(len(keys)) * size, size)


def allowed_places(shard: Shard, filters: np.ndarray, bits: int, size: int) -> np.ndarray:
    """Places from which size + 1 words stand of which the first and the last size are let through."""
    n = len(shard.seq)
    h = shard.hashes()
    at = np.arange(max(n - size + 1, 0))
    slot = chain(h, at, size) >> U(64 - bits)
    ok = np.zeros(n + 1, bool)
    ok[: len(at)] = (filters[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 == 1
    return ok[:-1] & ok[1:] & (run_lengths(shard.seq) > size)


def longer_counts(docs: DataFrame, frequent: DataFrame, size: int, least: int) -> DataFrame:
    """(key, cnt) of phrases of size + 1 words, from the frequent ones of size words."""
    n = frequent.count()
    bits = min(MOST_BITS, max(12, math.ceil(math.log2(max(n, 1) * 16))))
    held = docs.sparkSession.sparkContext.broadcast(filter_of(frequent, bits, size))  # at most 2**MOST_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            ok = allowed_places(shard, held.value, bits, size)
            if ok.any():
                yield from _emit(shard, interval_counts(shard, range(size + 1, size + 2), ok))

    return materialize(summed(_texts(docs).mapInArrow(run, "key string, cnt bigint"), least), "phrases")


def counted(docs: DataFrame, most: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, cnt) of phrases of up to most words that come least times or more, and (lang, n) of all words."""
    first = first_counts(docs, most, least)
    total = first.where(F.col("key").startswith("\t\t"))
    words = F.size(F.split(F.substring_index("key", "\t", 1), " "))
    level = first.where(~F.col("key").startswith("\t\t")).withColumn("size", words)
    found = [level]
    for size in range(PAIR, most):
        level = longer_counts(docs, level.where(F.col("size") == size), size, least).withColumn("size", F.lit(size + 1))
        found.append(level)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    lang = F.expr("substr(key, instr(key, '\t') + 1)")
    return every.select(lang.alias("lang"), F.substring_index("key", "\t", 1).alias("phrase"), "size", "cnt"), total.select(F.expr("substr(key, 3)").alias("lang"), F.col("cnt").alias("n"))


def _part(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, most: int = 3, least: int = 10, top: int = 2000, cover: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``most`` words by score.

    A phrase that comes a times is cut where floor(10**6 a a / (l r)) is lowest,
    l and r being its parts' counts. One whose words stand inside a longer
    phrase that comes at least ``cover`` percent as often is dropped.
    """
    phrases, totals = counted(docs, most, least)
    held = phrases.select("lang", "phrase", F.col("cnt").alias("c"))
    rows = phrases.where("size > 1").select("lang", "phrase", "size", F.col("cnt").alias("a"), F.split("phrase", " ").alias("w"))
    # longer phrases that hold a candidate
    inner = rows.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    covered = inner.select("lang", _part(F.col("w"), F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    free = rows.join(covered, ["lang", "phrase"], "left").where(F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * cover))
    cuts = free.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), 1, F.col("k")).alias("left"), _part(F.col("w"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    # a frequent word begins or ends many phrases: AQE splits its side of these joins
    cuts = cuts.join(held.select("lang", F.col("phrase").alias("left"), F.col("c").alias("l")), ["lang", "left"])
    cuts = cuts.join(held.select("lang", F.col("phrase").alias("right"), F.col("c").alias("r")), ["lang", "right"])
    scored = cuts.withColumn("score", F.expr("cast(a as decimal(16)) * cast(a as decimal(16)) * 1000000 div (cast(l as decimal(16)) * cast(r as decimal(16)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # a language's first ones are among the first of its parts
    part = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
