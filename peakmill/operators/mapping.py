"""Mapping sequences onto longer ones: exactly, by approximate hits, by edit distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakmill.functions.alignment import Scoring, banded_local, banded_scores
from peakmill.functions.distances import infix_distances, near_pairs, sparse_linkage
from peakmill.functions.frames import frame
from peakmill.functions.kernels import global_alignment
from peakmill.functions.sequence import hamming, hit_offsets, kmers
from peakmill.operators.components import components
from peakmill.operators.windows import best_per_key
from peakmill.runtime import materialize


#: Letters by which a sequence is looked up before it is compared.
SEED = 14
#: Letters of a block that is rare enough to be looked up alone.
LONG_BLOCK = 8


def containment(patterns: DataFrame, targets: DataFrame) -> DataFrame:
    """(pattern_id, target_id, start): every place of every pattern in every target, from 0.

    A pattern's first SEED letters (all of a shorter one) meet the target's
    substrings of that length in an equi-join; what meets is compared in full.
    """
    size = F.least(F.lit(SEED), F.length("seq"))
    p = patterns.where("length(seq) > 0").select("pattern_id", F.col("seq").alias("pattern"), size.alias("size"), F.substring("seq", F.lit(1), size).alias("gram"))
    t = grams(targets, p.select("size").distinct(), "target_id", "seq")
    met = t.join(p, ["size", "gram"])
    # the text once a target that anything met, not once a substring
    near = met.join(targets.select("target_id", "seq"), "target_id")
    return near.where(F.expr("substr(seq, start + 1, length(pattern)) = pattern")).select("pattern_id", "target_id", "start")


def first_containment(patterns: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, pattern_id, start): the first place of any pattern in each target that holds one."""
    return best_per_key(containment(patterns, targets), ["target_id"], [F.col("start"), F.col("pattern_id")])


def grams(targets: DataFrame, sizes: DataFrame, ident: str, seq: str) -> DataFrame:
    """(ident, size, start, gram): all substrings of the sizes, of which there are SEED at most."""
    sized = targets.join(F.broadcast(sizes), F.length(seq) >= F.col("size"))
    return sized.select(ident, "size", F.posexplode(kmers(F.col(seq), F.col("size"))).alias("start", "gram"))


#: Bits of the sieve of words_met(), which goes to every task.
SIEVE = 22
#: Letters of targets that are hashed at a time, or one target.
LETTERS = 1 << 20


def word_hashes(letters: np.ndarray, size: int) -> np.ndarray:
    """A number of SIEVE bits for every ``size`` code points in a row, by doubling."""
    p, m, at, h = 0x9E3779B97F4A7C15, 1, 0, letters.astype(np.uint64) + np.uint64(1)
    out = np.full(max(len(letters) - size + 1, 0), size, np.uint64)
    while size and len(out):
        if size & 1:
            out = out * np.uint64(pow(p, m, 1 << 64)) + h[at : at + len(out)]
            at += m
        size >>= 1
        h = h[: len(h) - m] * np.uint64(pow(p, m, 1 << 64)) + h[m:] if size else h
        m *= 2
    return ((out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SIEVE)


def words_met(targets: DataFrame, words: DataFrame, ident: str, seq: str) -> DataFrame:
    """(ident, size, start, gram): those of grams() that are among words(size, gram), and a few others; a join decides.

    The words' hashes are bits of one map, of bounded size, by which tasks sift
    targets' substrings before these become rows.
    """
    number = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for size, g in f.groupby("size"):
                yield pd.DataFrame({"size": size, "bit": np.unique(word_hashes(number(g["gram"]), int(size))[:: int(size)]).astype(np.int64)})

    known = words.where("size > 0").select("size", "gram").mapInPandas(hashed, "size int, bit bigint")
    known = known.groupBy("bit").agg(F.collect_set("size").alias("sizes")).toArrow()  # at most 2**SIEVE rows
    on = np.zeros(1 << SIEVE, bool)
    on[known.column("bit").to_numpy()] = True
    sizes = sorted({x for row in known.column("sizes").to_pylist() for x in row})
    held = targets.sparkSession.sparkContext.broadcast(np.packbits(on, bitorder="little"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length = f[seq].str.len().to_numpy(np.int64)
            lot = (np.cumsum(length) - length) // LETTERS
            for _, g in f.groupby(lot):
                texts = g[seq].tolist()
                letters, n = number(texts), np.array([len(t) for t in texts])
                first = np.cumsum(n) - n
                for size in sizes:
                    bit = word_hashes(letters, size)
                    at = np.flatnonzero((held.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                    row = np.searchsorted(first, at, side="right") - 1
                    start = at - first[row]
                    ok = start + size <= n[row]
                    row, start = row[ok], start[ok]
                    if len(row):
                        grams_ = [texts[r][i : i + size] for r, i in zip(row.tolist(), start.tolist(), strict=True)]
                        yield pd.DataFrame({ident: g[ident].to_numpy()[row], "size": size, "start": start, "gram": grams_})

    kind = targets.schema[ident].dataType.simpleString()
    texts = targets.select(ident, seq).where(F.col(seq).isNotNull())
    return texts.mapInPandas(run, f"{ident} {kind}, size int, start int, gram string")


def map_longest_first(sequences: list[tuple[str, int]], compat: bool = False) -> list[tuple[str, list[int]]]:
    """Profiles (sequence, count of each base) of one component's sequences.

    The longest become profiles, one a line. Each shorter group is summed by
    sequence and mapped onto the profiles there were before its round: a single
    place takes the whole count, several share it in proportion to their mean
    coverage, half-even, in descending weight; the last share takes what is
    left. compat: what rounding leaves over is lost if the last share is less.
    Sequences without a place become profiles after their round. One automaton
    of all shorter sequences finds the places of every length while it reads a
    profile once, when that is made. Sequences without letters lie nowhere and
    become profiles last.
    """
    by: dict[int, list[tuple[str, int]]] = {}
    for s, c in sequences:
        by.setdefault(len(s), []).append((s, c))
    sizes = sorted(by, reverse=True)
    shorter = ahocorasick.Automaton()
    for size in sizes[1:]:
        for s, _ in by[size]:
            if s:
                shorter.add_word(s, s)
    if len(shorter):
        shorter.make_automaton()
    profiles: list[tuple[str, list[int]]] = []
    places: dict[str, list[tuple[int, int]]] = {}

    def make(rows: list[tuple[str, int]]) -> None:
        for seq, c in sorted(rows):
            if len(shorter):
                for end, s in shorter.iter(seq):
                    if len(s) < len(seq):
                        places.setdefault(s, []).append((len(profiles), end + 1 - len(s)))
            profiles.append((seq, [c] * len(seq)))

    for nth, size in enumerate(sizes):
        if not nth:
            make(by[size])
            continue
        wanted: dict[str, int] = {}
        for s, c in by[size]:
            wanted[s] = wanted.get(s, 0) + c
        for s in sorted(wanted.keys() & places.keys()):
            count = wanted.pop(s)
            found = [(sum(profiles[p][1][at : at + size]) / size, p, at) for p, at in places.pop(s)]
            found.sort(key=lambda x: -x[0])
            total, left = sum(w for w, _, _ in found), count
            for i, (w, p, at) in enumerate(found):
                share = round(w * count / total) if total else 0
                if len(found) == 1 or i == len(found) - 1 and (share >= left or not compat):
                    share = left
                share = min(share, left)
                left -= share
                for x in range(at, at + size):
                    profiles[p][1][x] += share
        make(list(wanted.items()))
    return profiles


def exact_profiles(assembled: DataFrame, key: str = "comp_id", compat: bool = False) -> DataFrame:
    """(key, profile_id, seq, base_counts) of assembled(key, seq, cnt); a component is one row of a task, as most have one sequence or two."""
    kind = assembled.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, ends = b.column(0), b.column(1).offsets.to_numpy()
            seqs, cnts = (c.to_pylist() for c in b.column(1).values.flatten())
            made, row = [], []
            letters = 0
            for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                profiles = map_longest_first(list(zip(seqs[lo:hi], cnts[lo:hi], strict=True)), compat)
                made += [(n, s, np.array(c, np.int64)) for n, (s, c) in enumerate(profiles)]
                row += [i] * len(profiles)
                letters += sum(len(s) for s, _ in profiles)
                if letters >= LETTERS or i == len(b) - 1:
                    yield profile_batch(names.take(pa.array(row, pa.int32())), made)
                    made, row, letters = [], [], 0

    def profile_batch(names: pa.Array, made: list[tuple[int, str, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.cumsum([0, *(len(c) for _, _, c in made)]).astype(np.int32)
        counts_ = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int64), *(c for _, _, c in made)])))
        columns = [names, pa.array([n for n, _, _ in made], pa.int64()), pa.array([s for _, s, _ in made], pa.string()), counts_]
        return pa.RecordBatch.from_arrays(columns, names=[key, "profile_id", "seq", "base_counts"])

    each = assembled.groupBy(key).agg(F.collect_list(F.struct("seq", F.col("cnt").cast("bigint").alias("cnt"))).alias("rows"))
    return each.mapInArrow(run, f"{key} {kind}, profile_id bigint, seq string, base_counts array<bigint>")


def _extend(query: str, target: str, q: int, t: int, word: int) -> tuple[int, int, int, int]:
    """Ungapped extension of a shared word both ways to the stretch with most (equal - 2 * other): qstart, qend, tstart, equal; ends exclusive."""
    best = score = 0
    right = q + word
    for i in range(min(len(query) - right, len(target) - t - word)):
        score += 1 if query[q + word + i] == target[t + word + i] else -2
        if score > best:
            best, right = score, q + word + i + 1
        if score < best - 10:
            break
    best = score = 0
    left = q
    for i in range(1, min(q, t) + 1):
        score += 1 if query[q - i] == target[t - i] else -2
        if score > best:
            best, left = score, q - i
        if score < best - 10:
            break
    off = t - q
    return left, right, left + off, sum(query[x] == target[x + off] for x in range(left, right))


def approximate_hits(queries: DataFrame, profiles: DataFrame, k: int, identity: float = 90.0) -> DataFrame:
    """Hits of queries(query) on profiles(profile_id, seq): a shared word, extended without gaps.

    A hit passes with ``identity`` percent of k letters equal, so a query of n
    letters may miss n less that many, and one of one block more than these is
    whole: such blocks are the words that are looked up. A query so long that
    its blocks would be shorter than k // 3 is looked up by all its words of
    that length. Words meet in an equi-join; each diagonal of a pair is extended
    once, in Arrow batches. Places count from 1, ends are inclusive.
    """
    word = max(1, k // 3)
    misses = F.greatest(F.length("query") - F.ceil(F.lit(identity * k / 100)).cast("int"), F.lit(0))
    block = F.floor(F.length("query") / (misses + 1)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), misses), lambda i: F.struct((i * block).alias("q"), F.substring("query", i * block + 1, block).alias("w")))
    words = F.transform(kmers(F.col("query"), word), lambda w, i: F.struct(i.alias("q"), w.alias("w")))
    q = queries.select("query", F.explode(F.when(block >= word, blocks).otherwise(words)).alias("x")).select("query", "x.q", "x.w", F.length("x.w").alias("size"))
    # as many sizes as lengths of queries, which are k-mers
    sizes = q.select("size").distinct()
    sized = profiles.join(F.broadcast(sizes), F.length("seq") >= F.col("size"))
    t = sized.select(F.col("profile_id").alias("target"), "size", F.posexplode(kmers(F.col("seq"), F.col("size"))).alias("t", "w"))
    seeds = q.join(t, ["size", "w"]).groupBy("query", "target", (F.col("t") - F.col("q")).alias("diagonal")).agg(F.min(F.struct("q", "size")).alias("seed"))
    seeds = seeds.select("query", "target", "diagonal", "seed.q", "seed.size")
    pairs = seeds.join(profiles.select(F.col("profile_id").alias("target"), "seq"), "target")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (a, p, *_extend(a, s, int(i), int(i + d), int(n)))
                for a, p, s, i, d, n in zip(f["query"], f["target"], f["seq"], f["q"], f["diagonal"], f["size"], strict=True)
            ]
            g = pd.DataFrame(rows, columns=["query", "target", "qs", "qe", "ts", "same"])
            size = (g["qe"] - g["qs"]).astype("int64")
            yield pd.DataFrame(
                {
                    "query": g["query"], "target": g["target"], "pident": 100.0 * g["same"] / size.where(size > 0, 1), "length": size,
                    "mismatch": size - g["same"], "gapopen": 0, "qstart": g["qs"] + 1, "qend": g["qe"], "sstart": g["ts"] + 1, "send": g["ts"] + size,
                }
            )

    kind = profiles.schema["profile_id"].dataType.simpleString()
    hits = pairs.mapInPandas(
        run, f"query string, target {kind}, pident double, length bigint, mismatch bigint, gapopen bigint, qstart bigint, qend bigint, sstart bigint, send bigint"
    )
    return passing_hits(hits, k, identity).dropDuplicates(["query", "target", "qstart", "sstart", "length"])


def gapped_hits(queries: DataFrame, profiles: DataFrame, word: int, identity: float = 0.0, expect: float = 1e-6, half: int = 16, scoring: Scoring | None = None) -> DataFrame:
    """Hits of queries(query) on profiles(profile_id, seq) with gaps: query, target, pident, length, mismatch, gapopen, qstart, qend, sstart, send, evalue, bitscore.

    Pairs that share a word are aligned locally in a band of ``half`` places to
    either side of where the shared words lie: seeds are gathered by stretches
    of half // 2 diagonals, each of which is aligned once. Only the part of a
    target that the band can reach goes to the tasks, where scores are worked
    out first, and alignments of those that suffice. A hit stays if chance would
    give fewer than ``expect`` of its score among all letters of the profiles, and if ``identity`` percent of its columns are equal. Places count
    from 1, ends are inclusive; of hits on the same places one is returned.
    Null or short sequences have no words. Equal profiles are hit each.
    """
    c = scoring or Scoring()
    step = max(1, half // 2)
    q = queries.select("query").where(F.length("query") >= word).distinct().select("query", F.posexplode(kmers(F.col("query"), word)).alias("q", "w"))
    words = q.select(F.lit(word).alias("size"), F.col("w").alias("gram"))
    t = words_met(profiles.select(F.col("profile_id").alias("target"), "seq"), words, "target", "seq").select("target", F.col("start").alias("t"), F.col("gram").alias("w"))
    stretch = F.floor((F.col("t") - F.col("q")) / step).cast("bigint")
    seeds = materialize(q.join(t, "w").select("query", "target", stretch.alias("stretch")).distinct(), "seeds")
    middle = F.col("stretch") * step + step // 2
    reach = half + step
    first = F.greatest(middle - reach, F.lit(0))
    total = profiles.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("total"))  # one row
    pairs = seeds.join(_met(profiles.select(F.col("profile_id").alias("target"), "seq"), seeds, "target"), "target").crossJoin(F.broadcast(total)).select(
        "query", "target", "total", first.alias("first"), (middle - first).alias("diagonal"), F.substring("seq", (first + 1).cast("int"), (middle + F.length("query") + reach - first).cast("int")).alias("part")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # texts of like length together; about as many cells a time, whatever the length
            f = f.assign(size=f["query"].str.len()).sort_values("size", kind="stable")
            lo = 0
            while lo < len(f):
                hi = lo + min(len(f) - lo, 2048)
                g = f.iloc[lo:hi]
                lo = hi
                score = banded_scores(g["query"].tolist(), g["part"].tolist(), g["diagonal"].to_numpy(), reach, c)
                # a little more than what stays at the end
                g = g[(score > 0) & (c.expect(score, g["size"].to_numpy(), g["total"].to_numpy(float)) <= expect * (1 + 1e-6))]
                if not len(g):
                    continue
                r = banded_local(g["query"].tolist(), g["part"].tolist(), g["diagonal"].to_numpy(), reach, c)
                size = np.maximum(r["length"], 1)
                made = pd.DataFrame(
                    {
                        "query": g["query"].to_numpy(), "target": g["target"].to_numpy(), "pident": 100.0 * r["same"] / size, "length": r["length"],
                        "mismatch": r["length"] - r["gaps"] - r["same"], "gapopen": r["gapopen"], "qstart": r["qstart"] + 1, "qend": r["qend"],
                        "sstart": r["sstart"] + 1 + g["first"].to_numpy(), "send": r["send"] + g["first"].to_numpy(), "score": r["score"], "total": g["total"].to_numpy(),
                    }
                )
                yield made

    kind = profiles.schema["profile_id"].dataType.simpleString()
    found = pairs.mapInPandas(
        run, f"query string, target {kind}, pident double, length bigint, mismatch bigint, gapopen bigint, qstart bigint, qend bigint, sstart bigint, send bigint, score double, total bigint"
    ).dropDuplicates(["query", "target", "qstart", "qend", "sstart", "send"])
    chance = F.lit(c.k) * F.length("query") * F.col("total") * F.exp(-F.lit(c.lam) * F.col("score"))
    bits = (F.lit(c.lam) * F.col("score") - F.log(F.lit(c.k))) / F.log(F.lit(2.0))
    rated = found.withColumn("evalue", chance).withColumn("bitscore", bits)
    return rated.where((F.col("evalue") <= expect) & (F.col("pident") >= identity)).drop("total", "score")


def _met(profiles: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The profiles that materialized pairs name: these ids are small where few profiles are met, so that their texts needn't be shuffled to find them."""
    return profiles.join(pairs.select(key).distinct(), key, "left_semi")


def passing_hits(hits: DataFrame, k: int, identity: float) -> DataFrame:
    return hits.where(F.col("pident") * F.col("length") / 100 >= F.lit(identity) / 100 * k)


def best_hits(hits: DataFrame, *order: str) -> DataFrame:
    """One hit a query: most equal letters, then longest, then the first by the given columns."""
    same = (F.col("pident") * F.col("length")).desc()
    return best_per_key(hits, ["query"], [same, F.col("length").desc(), *map(F.col, order)])


def add_hits(profiles: DataFrame, hits: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """profiles(profile_id, seq, base_counts) with the counts(query, cnt) of their hits added on the bases these cover.

    Differences at a hit's two ends are summed and accumulated, so a hit costs
    two rows however long it is.
    """
    off = hits.join(counts, "query").withColumn("o", hit_offsets(F.col("qstart"), F.col("sstart"), k))
    step = off.select(
        F.col("target").alias("profile_id"),
        F.explode(F.array(F.struct(F.col("o.abs_sstart").alias("at"), F.col("cnt").alias("d")), F.struct((F.col("o.abs_sstart") + F.col("o.used_length")).alias("at"), (-F.col("cnt")).alias("d")))).alias("s"),
    ).select("profile_id", "s.at", "s.d")
    summed = step.groupBy("profile_id", "at").agg(F.sum("d").alias("d")).groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "d"))).alias("steps"))
    at = F.sequence(F.lit(0), F.size("base_counts") - 1)
    deltas = F.transform(at, lambda i: F.coalesce(F.try_element_at("steps", i.cast("bigint")), F.lit(0).cast("bigint")))
    empty = F.struct(F.lit(0).cast("bigint").alias("run"), F.array().cast("array<bigint>").alias("out"))
    walk = F.aggregate(deltas, empty, lambda a, d: F.struct((a["run"] + d).alias("run"), F.array_append(a["out"], a["run"] + d).alias("out")))["out"]
    joined = profiles.join(summed, "profile_id", "left")
    added = F.when(F.col("steps").isNull(), F.col("base_counts")).otherwise(F.zip_with("base_counts", walk, lambda a, b: a + b))
    return joined.withColumn("base_counts", added).drop("steps")


def nearest_profiles(queries: DataFrame, profiles: DataFrame, bound: int) -> DataFrame:
    """(query, cnt, profile_id, start, end, distance, mean): all nearest profiles of queries(query, cnt) within the bound.

    A match with at most ``bound`` edits leaves one of bound + 1 equal blocks of
    the query intact, so pairs that share a block's first letters are the only
    candidates.
    """
    block = F.floor(F.length("query") / (bound + 1)).cast("int")
    size = F.least(F.lit(SEED), block)
    seeds = F.transform(F.sequence(F.lit(0), F.lit(bound)), lambda i: F.substring("query", i * block + 1, size))
    q = queries.where(F.length("query") > bound).select("query", "cnt", size.alias("size"), F.explode(F.array_distinct(seeds)).alias("gram"))
    # substrings that no query has are neither rows nor shuffled: pairs are made different after the join
    t = words_met(profiles, q, "profile_id", "seq").select("profile_id", "size", "gram")
    met = materialize(q.join(t, ["size", "gram"]).select("query", "cnt", "profile_id").distinct(), "met")
    pairs = met.join(_met(profiles.select("profile_id", "seq", "base_counts"), met, "profile_id"), "profile_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            d, start, end = infix_distances(f["query"].tolist(), f["seq"].tolist(), bound)
            f = f.assign(start=start, end=end, distance=d)[d >= 0]
            parts = [counts[a : b + 1] for counts, a, b in zip(f["base_counts"], f["start"], f["end"], strict=True)]
            f = f.assign(mean=np.array([float(sum(x)) / max(len(x), 1) for x in parts], float))
            yield f[["query", "cnt", "profile_id", "start", "end", "distance", "mean"]]

    kind = profiles.schema["profile_id"].dataType.simpleString()
    found = pairs.select("query", "cnt", "profile_id", "seq", "base_counts").mapInPandas(run, f"query string, cnt bigint, profile_id {kind}, start bigint, end bigint, distance bigint, mean double")
    least = found.groupBy("query").agg(F.min("distance").alias("distance"))
    return found.join(least, ["query", "distance"]).select(*found.columns)


def contributions(nearest: DataFrame, how: str = "scaled") -> DataFrame:
    """(profile_id, start, end, add): each query's count shared by mean counts of its nearest profiles, or all to the most abundant (max)."""
    from peakmill.operators.windows import proportional_share

    if how == "scaled":
        return proportional_share(nearest, ["query"], "mean", "cnt").where("share > 0").select("profile_id", "start", "end", F.col("share").alias("add"))
    if how == "max":
        return best_per_key(nearest, ["query"], [F.col("mean").desc(), F.col("profile_id"), F.col("start")]).select("profile_id", "start", "end", F.col("cnt").alias("add"))
    raise ValueError(f"unknown way to contribute: {how}")


def numbered_by_length(sequences: DataFrame, key: str) -> DataFrame:
    """(seq, key, nth) of each different one of sequences(seq): its length, and how many rows of that length come before it in order.

    Ranges of (length, sequence) are counted each by itself, then raised by what
    the ranges before hold: no length needs to fit into one task, and copies are
    counted before they are shuffled.
    """
    n = sequences.sparkSession.sparkContext.defaultParallelism
    each = sequences.where("seq is not null").groupBy("seq").agg(F.count("*").alias("n_")).withColumn(key, F.length("seq"))
    ranged = materialize(each.repartitionByRange(n, key, "seq").withColumn("range_", F.spark_partition_id()), "ranged")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy("range_", key).agg(F.sum("n_").alias("m_"))  # a row a range and length
    held = held.select("range_", key, F.sum("m_").over(earlier(key).orderBy("range_")).alias("before_"))
    within = F.sum("n_").over(earlier("range_", key).orderBy("seq"))
    zero = F.lit(0).cast("bigint")
    return ranged.withColumn("within_", within).join(held, ["range_", key]).select("seq", key, (F.coalesce("within_", zero) + F.coalesce("before_", zero)).alias("nth"))


def near_sequences(numbers: DataFrame, most: int, key: str) -> DataFrame:
    """(key, nth, other, distance): pairs of different sequences of one length, of numbers(seq, key, nth), with ``most`` differing places or fewer.

    Such a pair has one of most + 1 blocks in common, and two of most + 2:
    single blocks where these have LONG_BLOCK letters, else pairs of blocks, as
    short ones are common, meet in an equi-join that compares what meets and
    lets only near pairs out. Sequences of ``most`` letters or fewer, which are
    all near each other, are left out.
    """

    def block(n: int, b: Column) -> Column:
        a, z = F.floor(F.col(key) * b / n).cast("int"), F.floor(F.col(key) * (b + 1) / n).cast("int")
        return F.substring("seq", a + 1, z - a)

    ones, twos = most + 1, most + 2
    at = F.sequence(F.lit(0), F.lit(twos - 1))
    single = F.transform(F.sequence(F.lit(0), F.lit(ones - 1)), lambda b: F.struct(b.alias("b"), block(ones, b).alias("w")))
    two = lambda i, j: F.struct((i * twos + j).alias("b"), F.concat(block(twos, i), block(twos, j)).alias("w"))
    double = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j > i), lambda j: two(i, j))))
    keyed = F.when(F.col(key) >= ones * LONG_BLOCK, single).otherwise(double)
    parts = numbers.where(F.col(key) > most).select(key, "nth", "seq", F.explode(keyed).alias("x")).select(key, "nth", "seq", "x.b", "x.w")
    other = parts.select(key, "b", "w", F.col("nth").alias("other"), F.col("seq").alias("other_seq"))
    far = hamming(F.col("seq"), F.col("other_seq"))
    # edits are at most the differing places, and are bounded in compiled code: few pairs are compared letter by letter
    maybe = F.levenshtein("seq", "other_seq", most) >= 0
    near = parts.join(other, [key, "b", "w"]).where((F.col("nth") < F.col("other")) & maybe & (far <= most))
    return near.select(key, "nth", "other", far.alias("distance")).distinct()


def cluster_sequences(sequences: DataFrame, threshold: float, key: str = "size") -> DataFrame:
    """sequences(seq, cnt) with cluster: complete linkage on differing places, within each length.

    A cluster is named by how many rows of its length come before its first
    sequence. Only pairs nearer than the threshold matter; what these connect is
    one group of linkage, whose memory is that of its near pairs. Equal
    sequences share a cluster, and so do all of a length below the threshold,
    which are near each other. Null sequences are left out.
    """
    sequences = sequences.select("seq", "cnt")
    most = max(0, math.ceil(threshold) - 1)
    numbers = materialize(numbered_by_length(sequences, key), "numbered")
    pairs = materialize(near_sequences(numbers, most, key), "near")
    node = lambda c: F.struct(F.col(key), F.col(c).alias("nth"))
    group = components(pairs.select(node("nth").alias("src"), node("other").alias("dst")))
    grouped = pairs.join(group.select(F.col(f"node.{key}").alias(key), F.col("node.nth").alias("nth"), F.col("component.nth").alias("group")), [key, "nth"])

    def work(g: pd.DataFrame) -> pd.DataFrame:
        label = sparse_linkage(zip(g["nth"].tolist(), g["other"].tolist(), g["distance"].tolist(), strict=True), threshold)
        return frame({key: [g[key].iloc[0]] * len(label), "nth": list(label), "cluster": list(label.values())})

    labels = grouped.groupBy(key, "group").applyInPandas(work, f"{key} int, nth bigint, cluster bigint")
    alone = F.when(F.col(key) <= most, F.lit(0)).otherwise(F.col("nth"))
    named = numbers.join(labels, [key, "nth"], "left").select("seq", key, F.coalesce("cluster", alone).cast("int").alias("cluster"))
    return sequences.join(named, "seq").select("seq", "cnt", key, "cluster")


def base_profile(sequences: DataFrame, key: str) -> DataFrame:
    """(key, pos, base, weight): summed counts of each base at each place of equally long sequences(key, seq, cnt)."""
    rows = sequences.select(key, "cnt", F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")
    return rows.groupBy(key, "pos", "base").agg(F.sum("cnt").alias("weight"))


def consensus(profile: DataFrame, key: str) -> DataFrame:
    """(key, seq): the heaviest base of each place; ties go to the first of A, C, G, T, gap."""
    place = F.array_position(F.array(*map(F.lit, "ACGT-")), F.col("base"))
    best = profile.groupBy(key, "pos").agg(F.max_by("base", F.struct("weight", -place)).alias("base"))
    return best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("seq"))


class GappedProfile:
    """Base weights A, C, G, T, gap by column, to which gapped sequences are added one by one.

    ``rows`` holds each sequence, its count and the columns of its letters by
    names that stay when columns open between them; ``places`` turns these into
    numbers at the end.
    """

    ALPHABET = "ACGT-"

    def __init__(self, seq: str, cnt: int):
        self.columns = [[cnt if b == a else 0 for a in self.ALPHABET] for b in seq]
        self.names = list(range(len(seq)))
        self.total = cnt
        self.rows = [(seq, cnt, list(self.names))]

    def consensus(self) -> str:
        return "".join(self.ALPHABET[max(range(5), key=lambda i: (c[i], -i))] for c in self.columns)

    def add(self, seq: str, cnt: int) -> None:
        """Align to the consensus; letters only in seq open gap columns, which earlier sequences fill with gaps."""
        _, ops = global_alignment(self.consensus(), seq)
        i = j = 0
        at = []
        for op in ops:
            if op == "I":
                self.columns.insert(i, [0, 0, 0, 0, self.total])
                self.names.insert(i, len(self.names))
            if op == "D":
                self.columns[i][4] += cnt
            else:
                self.columns[i][self.ALPHABET.find(seq[j])] += cnt
                at.append(self.names[i])
                j += 1
            i += 1
        self.total += cnt
        self.rows.append((seq, cnt, at))

    def places(self) -> list[tuple[str, int, list[int]]]:
        """Each sequence with its count and the column, from 0, of each of its letters."""
        now = {name: i for i, name in enumerate(self.names)}
        return [(seq, cnt, [now[x] for x in at]) for seq, cnt, at in self.rows]


def approximate_profiles(sequences: list[tuple[str, int]], misses: int, clusters_within: float) -> list[GappedProfile]:
    """Longest first: clusters of each length become profiles unless they lie within ``misses`` edits in one."""
    by: dict[int, list[tuple[str, int]]] = {}
    for s, c in sequences:
        by.setdefault(len(s), []).append((s, c))
    profiles: list[GappedProfile] = []
    for size in sorted(by, reverse=True):
        rest = []
        texts = [p.consensus().replace("-", "") for p in profiles]
        for s, c in sorted(by[size], key=lambda x: (-x[1], x[0])):
            far = infix_distances([s] * len(texts), texts, misses)[0]
            found = [(int(d), i) for i, d in enumerate(far) if d >= 0]
            if found:
                nearest = min(found)[1]
                profiles[nearest].add(s, c)
                texts[nearest] = profiles[nearest].consensus().replace("-", "")
            else:
                rest.append((s, c))
        if rest:
            linked = sparse_linkage(near_pairs([s for s, _ in rest], math.ceil(clusters_within) - 1), clusters_within)
            labels = [linked.get(i, i) for i in range(len(rest))]
            for label in dict.fromkeys(labels):
                members = [m for m, own in zip(rest, labels, strict=True) if own == label]
                made = GappedProfile(*members[0])
                for m in members[1:]:
                    made.add(*m)
                profiles.append(made)
    return profiles


def gapped_profiles(sequences: DataFrame, misses: int = 5, clusters_within: float = 5.0, key: str = "comp_id") -> DataFrame:
    """(key, profile_id, pos, base, weight) of sequences(key, seq, cnt), mapped longest first within ``misses`` edits; a component is one group."""
    kind = sequences.schema[key].dataType.simpleString()

    def work(g: pd.DataFrame) -> pd.DataFrame:
        made = approximate_profiles([(s, int(c)) for s, c in zip(g["seq"], g["cnt"], strict=True)], misses, clusters_within)
        rows = [(g[key].iloc[0], i, pos, GappedProfile.ALPHABET[b], w) for i, p in enumerate(made) for pos, column in enumerate(p.columns) for b, w in enumerate(column) if w]
        return frame(dict(zip([key, "profile_id", "pos", "base", "weight"], zip(*rows, strict=True) if rows else [[]] * 5, strict=True)))

    return sequences.groupBy(key).applyInPandas(work, f"{key} {kind}, profile_id bigint, pos bigint, base string, weight bigint")


def gapped_alignments(sequences: DataFrame, misses: int = 5, clusters_within: float = 5.0, key: str = "comp_id") -> DataFrame:
    """(key, profile_id, seq, cnt, places): the column of each letter of each sequence in the profile of gapped_profiles() that took it."""
    kind = sequences.schema[key].dataType.simpleString()

    def work(g: pd.DataFrame) -> pd.DataFrame:
        made = approximate_profiles([(s, int(c)) for s, c in zip(g["seq"], g["cnt"], strict=True)], misses, clusters_within)
        rows = [(g[key].iloc[0], i, *x) for i, p in enumerate(made) for x in p.places()]
        return frame(dict(zip([key, "profile_id", "seq", "cnt", "places"], zip(*rows, strict=True) if rows else [[]] * 5, strict=True)))

    return sequences.groupBy(key).applyInPandas(work, f"{key} {kind}, profile_id bigint, seq string, cnt bigint, places array<int>")
