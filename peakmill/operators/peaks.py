"""Profiles to peaks: coverage of both samples, segmentation, test against the control, merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from peakmill.functions.frames import frame, whole_groups
from peakmill.functions.kernels import gaussian_hmms, mann_whitney_greater, peak_ranges, rolling_mean
from peakmill.functions.normal import rank_test_p
from peakmill.operators.counts import arm_windows, count_arms_listed, kmer_fractions, outer_counts, reconstruction
from peakmill.operators.windows import base_coverage, median_gate, significant, u_statistic
from peakmill.runtime import materialize, spread


def long_enough(profiles: DataFrame, k: int, fraction: float | None) -> DataFrame:
    """Profiles of fraction * k bases or more; all of them for no fraction or one up to 1."""
    return profiles if not fraction or fraction <= 1 else profiles.where(F.length("seq") >= F.lit(fraction * k))


def position_vectors(profiles: DataFrame, treat: DataFrame, ctrl: DataFrame, k: int, factor: float = 0.99) -> DataFrame:
    """(profile_id, pos, treat, ctrl): both samples' coverage of profiles(profile_id, seq, base_counts) by base."""
    return _positions(profiles, reconstruction(outer_counts(treat, ctrl, ["kmer"]), factor=factor), k)


def positions_of_reads(profiles: DataFrame, reads: DataFrame, k: int, treated: Column, factor: float = 0.99) -> DataFrame:
    """position_vectors of reads(seq): only the profiles' own k-mers are counted, the control's scale comes from the reads' lengths."""
    profiles = spread(profiles)
    # whole sequences are the list: a k-mer that several have is one all the same
    both = count_arms_listed(reads, profiles.select(F.col("seq").alias("kmer")), k, treated)
    return _positions(profiles, reconstruction(both, factor=factor, totals=arm_windows(reads, k, treated)), k)


def _placed_kmers(profiles: DataFrame, k: int) -> DataFrame:
    """(profile_id, pos, kmer, used): every k-mer of profiles(profile_id, seq, base_counts) with the least count of its bases."""
    fields = {f.name: f.dataType for f in profiles.schema}
    result = StructType([StructField("profile_id", fields["profile_id"]), StructField("pos", IntegerType()), StructField("kmer", StringType()), StructField("used", LongType())])
    schema = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, found, used, held = [], [], [], [], 0

            def out() -> pa.RecordBatch:
                ids = b.column(0).take(pa.array(np.repeat(np.array(at), [len(x) for x in pos])))
                return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(pos)), pa.array(found, pa.string()), pa.array(np.concatenate(used))], schema=schema)

            for i, (seq, counts) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                n = len(seq or "") - k + 1
                if n < 1 or not counts.is_valid:
                    continue
                at.append(i)
                pos.append(np.arange(n, dtype=np.int32))
                found += [seq[a : a + k] for a in range(n)]
                used.append(sliding_window_view(counts.values.to_numpy(), k).min(1).astype(np.int64))
                held += n
                if held >= PLACES:
                    yield out()
                    at, pos, found, used, held = [], [], [], [], 0
            if held:
                yield out()

    return profiles.select("profile_id", "seq", "base_counts").mapInArrow(run, result)


def _positions(profiles: DataFrame, both: DataFrame, k: int) -> DataFrame:
    parts = kmer_fractions(_placed_kmers(profiles, k), both, ["kmer"])
    last = profiles.where((F.length("seq") >= k) & F.col("base_counts").isNotNull()).groupBy("profile_id").agg((F.max(F.length("seq")) - k).alias("n_"))
    cover = base_coverage(parts, "profile_id", "pos", ["treat_frac", "ctrl_frac"], k, last)
    return cover.select("profile_id", "pos", F.col("treat_frac").alias("treat"), F.col("ctrl_frac").alias("ctrl"))


def segments(y: np.ndarray, states: int, k: int) -> np.ndarray:
    """State of each position: one segment below 1.75 k, else the model's, with a state less where one dies out."""
    return segments_of([y], states, k)[0]


def segments_of(profiles: list[np.ndarray], states: int, k: int) -> list[np.ndarray]:
    """segments() of each profile; their models are fitted together."""
    found: list[np.ndarray] = [np.zeros(len(y), np.int64) for y in profiles]
    left = [i for i, y in enumerate(profiles) if len(y) >= 1.75 * k]
    for n in (states, states - 1):
        if left and n >= 1:
            for i, path in zip(left, made := gaussian_hmms([profiles[i] for i in left], n), strict=True):
                if path is not None:
                    found[i] = path
            left = [i for i, path in zip(left, made, strict=True) if path is None]
    return found


def state_ranges(states: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of equal state, ends exclusive."""
    if not len(states):
        return []
    cut = np.flatnonzero(np.diff(states)) + 1
    edges = [0, *cut.tolist(), len(states)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def call(y: np.ndarray, seq: str, k: int, alpha: float, states: int = 5, least: float = 10.0, compat: bool = False) -> list[tuple[int, int, str, float]]:
    """(start, end, seq, p) of significant stretches of one profile; adjacent significant segments merge, p is their largest.

    compat: a segment with p exactly 0 vanishes, as older results have it.
    """
    return [(a, b, seq[a:b], p) for a, b, p in stretches(y, segments(y, states, k), k, alpha, least, compat)]


def stretches(y: np.ndarray, found: np.ndarray, k: int, alpha: float, least: float = 10.0, compat: bool = False) -> list[tuple[int, int, float]]:
    """(start, end, p) of call(), of the states that were found."""
    value = np.full(len(y), np.nan)
    for a, b in state_ranges(found):
        if np.median(y[a:b, 0]) >= least:
            _, p = mann_whitney_greater(y[a:b, 0], y[a:b, 1])
            if p <= alpha and not (compat and p == 0):
                value[a:b] = p
    out = []
    for a, b in state_ranges((~np.isnan(value)).astype(int)):
        if not np.isnan(value[a]) and b - a >= k:
            out.append((a, b, float(value[a:b].max())))
    return out


def _matrix(g: pd.DataFrame) -> np.ndarray:
    return np.nan_to_num(g[["treat", "ctrl"]].to_numpy(float), nan=0.0, posinf=np.finfo(np.float32).max)


#: Places of profiles that are worked on at a time, if no profile has more.
PLACES = 1 << 18


def _by_profile(positions: DataFrame, work: Callable[[list[np.ndarray]], list[tuple[list, ...]]], names: list[str], kinds: str) -> DataFrame:
    """(profile_id, names) of work(matrices of whole profiles), which returns the columns of each; profiles are dealt over the shuffle's parts and stream through them, in order."""
    kind = positions.schema["profile_id"].dataType.simpleString()
    parts = int(positions.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in whole_groups(frames, "profile_id", PLACES):
            made = work([_matrix(g) for g in groups])
            ids = [g["profile_id"].iloc[0] for g, columns in zip(groups, made, strict=True) for _ in columns[0]]
            yield frame({"profile_id": ids} | {n: [x for columns in made for x in columns[i]] for i, n in enumerate(names)})

    dealt = positions.select("profile_id", "pos", "treat", "ctrl").repartition(parts, "profile_id").sortWithinPartitions("profile_id", "pos")
    return dealt.mapInPandas(run, f"profile_id {kind}, {kinds}")


def _spelled(found: DataFrame, profiles: DataFrame) -> DataFrame:
    """found(profile_id, peak_i, start, end, pvalue) with seq; a profile's text meets its peaks, not its places."""
    part = F.expr("substr(seq, cast(start as int) + 1, cast(end - start as int))")
    return found.join(profiles.select("profile_id", "seq"), "profile_id").select("profile_id", "peak_i", "start", "end", part.alias("seq"), "pvalue")


def call_peaks(positions: DataFrame, profiles: DataFrame, k: int, alpha: float, states: int = 5, least: float = 10.0, compat: bool = False) -> DataFrame:
    """(profile_id, peak_i, start, end, seq, pvalue); a profile is one task's work."""

    def work(ys: list[np.ndarray]) -> list[tuple[list, ...]]:
        found = [stretches(y, s, k, alpha, least, compat) for y, s in zip(ys, segments_of(ys, states, k), strict=True)]
        return [(list(range(len(f))), [x[0] for x in f], [x[1] for x in f], [x[2] for x in f]) for f in found]

    found = _by_profile(positions, work, ["peak_i", "start", "end", "pvalue"], "peak_i bigint, start bigint, end bigint, pvalue double")
    return _spelled(found, profiles)


def tested_segments(segments_: DataFrame, samples: DataFrame, alpha: float, replicates: int = 1, share: float = 0.5, least: float = 10.0) -> DataFrame:
    """(profile_id, start, end, pvalue) of segments(profile_id, start, end) in which treatment is above control.

    samples(profile_id, pos, sample, treated, value). A segment is tested once
    for each pair of a treatment and a control sample, as joins and aggregates:
    ranks within segment and pair, U, its p-value as a column. It passes if that
    share of the pairs passes alpha, corrected for replicates, and the median
    of its treatment values is ``least`` or more. Samples are few, as replicates.
    """
    rows = samples.join(segments_.select("profile_id", "start", "end"), "profile_id").where("pos >= start and pos < end")
    names = materialize(samples.select("sample", "treated").distinct(), "samples")
    pairs = names.where("treated").select(F.col("sample").alias("t")).crossJoin(names.where("not treated").select(F.col("sample").alias("c")))  # a row a pair of replicates
    each = rows.join(pairs, ((F.col("sample") == F.col("t")) & F.col("treated")) | ((F.col("sample") == F.col("c")) & ~F.col("treated")))
    keys = ["profile_id", "start", "end"]
    tests = u_statistic(each, [*keys, "t", "c"], "treated", "value")
    rated = tests.withColumn("p", rank_test_p(F.col("u"), F.col("n1"), F.col("n2"), F.col("tie")))
    high = median_gate(rows.where("treated"), keys, "value", least).select(*keys)
    return significant(rated, keys, "p", alpha, replicates, share).join(high, keys, "left_semi")


def segment_profiles(positions: DataFrame, k: int, states: int = 5) -> DataFrame:
    """(profile_id, start, end, state, median) of the model's segments."""

    def work(ys: list[np.ndarray]) -> list[tuple[list, ...]]:
        out = []
        for y, s in zip(ys, segments_of(ys, states, k), strict=True):
            r = state_ranges(s)
            out.append(([a for a, _ in r], [b for _, b in r], [int(s[a]) for a, _ in r], [float(np.median(y[a:b, 0])) for a, b in r]))
        return out

    return _by_profile(positions, work, ["start", "end", "state", "median"], "start bigint, end bigint, state bigint, median double")


def prominence_peaks(
    positions: DataFrame, profiles: DataFrame, k: int, alpha: float = 0.1, prominence: float = 15.0, window: int = 120, smooth: int = 100, compat: bool = False
) -> DataFrame:
    """(profile_id, peak_i, start, end, seq, pvalue) of peaks of the smoothed treatment curve.

    The curve is a rolling mean of min(smooth, a twentieth of the profile)
    places; ranges are moved by half that width back onto the profile (compat:
    not moved, and insignificant ones come too).
    """

    def one(y: np.ndarray) -> tuple[list, ...]:
        width = max(1, min(smooth, -(-len(y) // 20)))
        shift = 0 if compat else (width - 1) // 2
        out = []
        for a, b in peak_ranges(rolling_mean(y[:, 0], width), prominence, window):
            a, b = a + shift, min(b + shift, len(y))
            _, p = mann_whitney_greater(y[a:b, 0], y[a:b, 1])
            if b - a >= k and (p <= alpha or compat):
                out.append((a, b, p))
        return list(range(len(out))), [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]

    found = _by_profile(positions, lambda ys: [one(y) for y in ys], ["peak_i", "start", "end", "pvalue"], "peak_i bigint, start bigint, end bigint, pvalue double")
    return _spelled(found, profiles)


def captured(sequences: DataFrame, ranges: DataFrame, min_size: int = 0, max_size: int | None = None, how: str = "min") -> DataFrame:
    """(profile_id, peak_i, seq, cnt): the part of sequences(profile_id, seq, counts) in each of ranges(profile_id, peak_i, start, end), with its least (or mean) count."""
    rows = sequences.join(ranges, "profile_id").withColumn("size", F.col("end") - F.col("start"))
    part = F.slice("counts", (F.col("start") + 1).cast("int"), F.col("size").cast("int"))
    value = F.array_min(part) if how == "min" else F.aggregate(part, F.lit(0.0), lambda a, c: a + c) / F.size(part)
    kept = rows.where((F.col("size") > min_size) & (F.lit(True) if max_size is None else F.col("size") < max_size))
    return kept.select("profile_id", "peak_i", F.expr("substr(seq, cast(start as int) + 1, cast(size as int))").alias("seq"), value.alias("cnt"))


def profile_columns(weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, columns): by place of a gapped profile's consensus, its column; of weights(keys, pos, base, weight). Columns where gaps weigh most have no place."""
    place = F.array_position(F.array(*map(F.lit, "ACGT-")), F.col("base"))
    best = weights.groupBy(*keys, "pos").agg(F.max_by("base", F.struct("weight", -place)).alias("base"))
    return best.where("base <> '-'").groupBy(*keys).agg(F.array_sort(F.collect_list("pos")).alias("columns"))


def gapped_ranges(ranges: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, peak_i, start, end): ranges(keys, peak_i, start, end) of consensus places as ranges of columns, ends exclusive.

    A range takes the gap columns between its places; one that hangs over the
    consensus is cut there, one that lies beyond it, is empty or has no start or
    end is left out.
    """
    at = ranges.select(*keys, "peak_i", "start", "end").join(columns.select(*keys, "columns"), keys)
    a, z = F.greatest(F.col("start"), F.lit(0)).cast("int"), F.least(F.col("end"), F.size("columns")).cast("int")
    whole = F.col("start").isNotNull() & F.col("end").isNotNull()
    return at.where(whole & (a < z)).select(*keys, "peak_i", F.get("columns", a).alias("start"), (F.get("columns", z - 1) + 1).alias("end"))


def captured_gapped(
    alignments: DataFrame, ranges: DataFrame, keys: list[str], min_size: int = 0, max_size: int | None = None, how: str = "min"
) -> DataFrame:
    """(keys, peak_i, seq, cnt): what of each alignment lies in each of ranges(keys, peak_i, start, end) of columns, gaps left out, with its least (or mean) count.

    alignments(keys, seq, counts, places) name the column of each letter, in
    ascending order, so the letters in a range are those from as many as lie
    before its start to as many as lie before its end. Parts have more than
    min_size letters and fewer than max_size; null texts or places give none.
    """
    before = lambda c: F.size(F.filter("places", lambda p: p < F.col(c)))
    rows = alignments.select(*keys, "seq", "counts", "places").join(ranges.select(*keys, "peak_i", "start", "end"), keys)
    rows = rows.withColumn("first_", before("start")).withColumn("size_", before("end") - F.col("first_"))
    kept = rows.where((F.col("size_") > max(min_size, 0)) & (F.lit(True) if max_size is None else F.col("size_") < max_size))
    part = F.slice("counts", F.col("first_") + 1, F.col("size_"))
    value = F.array_min(part) if how == "min" else F.aggregate(part, F.lit(0.0), lambda a, c: a + c) / F.size(part)
    return kept.select(*keys, "peak_i", F.expr("substr(seq, first_ + 1, size_)").alias("seq"), value.alias("cnt"))


def replicated_rows(sequences: DataFrame) -> DataFrame:
    """Each sequence as many times as its count, for tools that take no weights."""
    return sequences.where("cnt >= 1").select("profile_id", "seq", F.explode(F.sequence(F.lit(1), F.col("cnt").cast("int"))).alias("copy"))


def weighted_output(sequences: DataFrame, ranges: DataFrame, mode: str = "consensus") -> DataFrame:
    """mode ``consensus``: one sequence a range, the most frequent; ``sq_count``: all with counts; ``meme``: repeated by count."""
    rows = captured(sequences, ranges)
    if mode == "sq_count":
        return rows
    if mode == "meme":
        return replicated_rows(rows)
    if mode == "consensus":
        return rows.groupBy("profile_id", "peak_i").agg(F.max_by("seq", F.struct("cnt", "seq")).alias("seq"))
    raise ValueError(f"unknown weighting mode: {mode}")
