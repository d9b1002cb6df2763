from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakmill.functions import codes
from peakmill.functions import sequence as S
from peakmill.operators import assembly, bubbles, counts, graph, mapping, peaks, replicates, windows
from peakmill.operators.components import components
from peakmill.plans.config import Config
from peakmill.plans.pipeline import call_peaks, draw, graph_and_counts
from peakmill.runtime import materialize, shared_dir
from peakmill.sources import readers, writers

TURN = str.maketrans("ACGT", "TGCA")


def kmers(s, k):
    return [s[i : i + k] for i in range(len(s) - k + 1)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_count_and_control(spark):
    t = spark.createDataFrame([("ACGTACGT",), ("ACGTT",), ("AC",), (None,)], "seq string")
    c = spark.createDataFrame([("ACGGTA",)], "seq string")
    got = counts.count_kmers(t, 3)
    assert rows(got) == [("ACG", 3), ("CGT", 3), ("GTA", 1), ("GTT", 1), ("TAC", 1)]
    assert rows(counts.count_kmers(t, 3, both_strands=True)) == [("AAC", 1), ("ACG", 6), ("GTA", 2)]
    fixed = counts.subtract_control(got, counts.count_kmers(c, 3))
    assert rows(fixed) == [("CGT", 3), ("GTT", 1), ("TAC", 1)]
    assert rows(counts.low_abundance(fixed, 2)) == [("GTT", 1), ("TAC", 1)]
    empty = counts.count_kmers(c.limit(0), 3)
    assert rows(counts.subtract_control(got, empty)) == rows(got)


@pytest.mark.parametrize("k", [3, 11, 18, 19, 25, 31, 32, 40])
def test_counts_in_any_length(spark, k):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGT" * 20 + "N") for _ in range(rng.randint(0, 300))) for _ in range(30)] + ["A" * 60, "", None]
    arms = [i % 2 for i in range(len(seqs))]
    df = spark.createDataFrame(list(zip(arms, seqs, strict=True)), "arm int, seq string")
    pure = lambda s: [x for x in kmers(s or "", k) if "N" not in x]
    assert dict(rows(counts.count_kmers(df, k))) == Counter(x for s in seqs for x in pure(s))
    assert dict(rows(counts.count_kmers(df, k, both_strands=True))) == Counter(min(x, x.translate(TURN)[::-1]) for s in seqs for x in pure(s))
    t, c = (Counter(x for a, s in zip(arms, seqs, strict=True) if a == n for x in pure(s)) for n in (1, 0))
    both = counts.count_arms(df, k, F.col("arm") == 1)
    assert rows(both) == sorted((x, t[x], c[x]) for x in {*t, *c})
    joined = counts.outer_counts(*(counts.count_kmers(df.where(F.col("arm") == n), k) for n in (1, 0)), ["kmer"])
    assert rows(joined) == rows(both)
    split = [counts.count_kmers(df.where(F.col("arm") == n), k) for n in (1, 0)]
    assert rows(counts.corrected_arms(both)) == rows(counts.subtract_control(*split))
    listed = counts.distinct_kmers(df.limit(3), k)
    assert dict(rows(counts.count_listed(df, listed, k))) == {x: t[x] + c[x] for (x,) in rows(listed)}


def test_counts_across_pieces(monkeypatch):
    """Reads are cut into pieces and blocks of letters; windows over the cuts count once, none spans two reads."""
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    for name, n in (("PIECE", 50), ("BLOCK", 8), ("HELD", 400)):
        monkeypatch.setattr(codes, name, n)
    dealt = pa.schema([("side", pa.int32()), ("lot", pa.int32()), ("codes", pa.binary()), ("n", pa.binary())])
    result = pa.schema([("kmer", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
    for k in (1, 2, 3, 4, 7, 17):
        sides = [i % 2 for i in range(len(seqs))]
        text = pa.RecordBatch.from_arrays([pa.array(sides, pa.int32()), pa.array(seqs)], names=["side", "seq"])
        made = codes.merged(pa.Table.from_batches(codes.tallies(iter([text]), k, False, 5, dealt), dealt), k, 2, False, result)
        a, b = (Counter(x for s, n in zip(seqs, sides, strict=True) if n == side for x in kmers(s, k) if "N" not in x) for side in (0, 1))
        assert sorted(zip(*(c.to_pylist() for c in made.columns), strict=True)) == sorted((x, a[x], b[x]) for x in {*a, *b})
    assert len(codes.window_codes(np.zeros(2, np.uint8), 3)) == 0


@pytest.mark.parametrize("k", [16, 17, 23, 24, 31])
def test_long_windows_are_dealt_as_stretches(monkeypatch, k):
    """F4 to F10: windows of over 15 letters take four bytes each at most, in any cut of pieces and blocks; a code and its count took twelve."""
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGT" * 30 + "N") for _ in range(rng.randint(0, 900))) for _ in range(30)] + ["A" * 3000, "ACGT" * 99, None, "AC", "".join(rng.choice("ACGT") for _ in range(k))]
    sides = [i % 3 for i in range(len(seqs))]
    text = pa.RecordBatch.from_arrays([pa.array(sides, pa.int32()), pa.array(seqs)], names=["side", "seq"])
    want = [Counter(x for s, n in zip(seqs, sides, strict=True) if n == side and s for x in kmers(s, k) if "N" not in x) for side in range(3)]
    dealt = pa.schema([("side", pa.int32()), ("lot", pa.int32()), ("letters", pa.binary()), ("n", pa.binary())])
    result = pa.schema([("kmer", pa.string()), *((x, pa.int64()) for x in "abc")])
    for piece, block in ((1 << 23, 1 << 15), (700, 64), (97, 13)):
        monkeypatch.setattr(codes, "PIECE", piece)
        monkeypatch.setattr(codes, "BLOCK", block)
        made = pa.Table.from_batches(codes.stretches(iter([text]), k, 5, dealt), dealt)
        if piece > 1000:
            assert sum(len(x) for c in ("letters", "n") for x in made[c].to_pylist()) < 4 * sum(map(Counter.total, want))
        # each window's counts lie in one lot
        got = [r for lot in sorted(set(made["lot"].to_pylist())) for r in zip(*(c.to_pylist() for c in codes.merged(made.filter(pa.array(made["lot"].to_numpy() == lot)), k, 3, False, result).columns), strict=True)]
        assert sorted(got) == sorted((x, *(w[x] for w in want)) for x in set().union(*want))


@pytest.mark.parametrize("k", [3, 31, 33])
def test_counts_corrected_and_summed(spark, monkeypatch, k):
    """F2 to F10: as corrected by replicate and added up afterwards; only k-mers that stay are spelled, where all were before."""
    rng = random.Random(k)
    stem = "".join(rng.choice("ACGT") for _ in range(120))
    data = [(i % 3, "t" if rng.random() < 0.6 else "c", stem[(a := rng.randrange(60)) : a + 60] + rng.choice("ACGTN")) for i in range(40)] + [(7, "t", stem), (8, "c", stem)]
    reads = spark.createDataFrame(data, "replicate int, arm string, seq string").repartition(3)
    treated = F.col("arm") == "t"
    want = counts.corrected_arms(counts.count_arms(reads, k, treated, "replicate"), "replicate").groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
    for least, below in ((1, None), (2, None), (1, 3)):
        assert rows(counts.summed_corrected(reads, k, treated, "replicate", least=least, below=below)) == rows(want.where(F.col("cnt") >= least).where(F.col("cnt") < (below or 1 << 30)))
    one = reads.where("replicate = 1")
    assert rows(counts.summed_corrected(one, k, treated)) == rows(counts.corrected_arms(counts.count_arms(one, k, treated)))
    assert counts.summed_corrected(reads.limit(0), k, treated, "replicate").count() == 0


def test_sums_by_side(monkeypatch):
    """Few repeats are sorted as numbers, many by places: the same sums."""
    rng = np.random.default_rng(3)
    for most in (1, 9):
        blocks = [(int(rng.integers(3)), c.astype(np.int64), rng.integers(1, most + 1, len(c)).astype(np.int32)) for c in (np.unique(rng.integers(0, 50, 30)) + (1 << 61) for _ in range(9))]
        want = [Counter() for _ in range(3)]
        for s, c, n in blocks:
            want[s].update(dict(zip(c.tolist(), n.tolist(), strict=True)))
        found, sums = codes.side_sums([(s, c.tobytes(), n.tobytes()) for s, c, n in blocks], 31, 3)
        assert found.tolist() == sorted(set().union(*want)) and [[w[c] for c in found.tolist()] for w in want] == [x.tolist() for x in sums]


def test_label_beside_a_half(spark):
    """Labels above and below a ten-thousandth round the same number, as does the SQL of pvalue_digits; before: 0.0001149."""
    df = spark.createDataFrame([(0.00011494999999999999,), (0.5,), (3.25e-05,), (None,)], "p double")
    assert [r[0] for r in df.select(S.pvalue_label(F.col("p"))).collect()][:3] == ["0.000115", "0.5", "3.25e-05"]


def test_replicate_counts_by_strand(spark):
    """FX3 and FX6 on hand: the graph's threshold, its k-mers' counts by strand, their correction by the control."""
    treat = spark.createDataFrame([("ACGTT",)] * 6 + [("AACGT",)] * 2 + [("GGGGA",)] * 3, "seq string")
    ctrl = spark.createDataFrame([("ACGTT",)] * 2 + [("TCCCC",)] * 50, "seq string")
    least, vertices, _, arms, fixed = graph_and_counts(treat, ctrl, Config(k=5, min_abundance=2))
    # canonical counts: AACGT 8 (2 and 6 turned), GGGGA 3 under TCCCC; 2 * 2 keeps the first, both ways
    assert least == 2 and sorted(r.seq for r in vertices.collect()) == ["AACGT", "ACGTT"]
    assert rows(arms) == [("AACGT", 2, 0), ("ACGTT", 6, 2)]
    # scale 0.99 * 8 / 2 = 3.96; 6 - round(7.92) is below zero and goes
    assert rows(fixed) == [("AACGT", 2)]
    # unitigs of k-mers seen twice: means 8 and 3; the 50th percentile is 5.5
    assert graph_and_counts(treat, ctrl, Config(k=5, percentile=50.0))[0] == 6


def test_drawing(spark, tmp_path):
    v = spark.createDataFrame([(1, "ACGT", [2, 4], 1), (2, "GTA", [9], 1)], "vid long, seq string, counts array<int>, comp_id long")
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    for unwrap, nodes, arcs in ((False, 2, 1), (True, 3, 2)):
        draw(v, e, str(tmp_path / f"d{unwrap}"), 3, 2, unwrap)
        lines = [r.value for r in spark.read.text(str(tmp_path / f"d{unwrap}")).collect()]
        assert (sum("label" in x for x in lines), sum("->" in x for x in lines)) == (nodes, arcs)


def test_scalars(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("x")).collect()[0][0]
    assert v(S.reverse_complement(F.lit("ACCGT"))) == "ACGGT"
    assert v(S.reverse_complement(F.lit("ACCGT"), compat=True)) == "ACCCT"
    assert v(S.window_min(F.array(*map(F.lit, [4, 4, 7, 7, 7])), 3)) == [4, 4, 7]
    assert v(S.window_min(F.array(F.lit(1)), 3)) == []
    assert v(S.kmers(F.lit("AC"), 3)) == []
    assert v(S.overlap_join(F.array(F.lit("ACGT"), F.lit("GTA")), 3)) == "ACGTA"
    assert v(S.pvalue_label(F.lit(3e-8))) == "<1e-07"
    for x in (0.0123456789, 1.0, 0.5, 0.05, 0.0001, 0.00012, 0.00009999, 0.0000123, 0.00001, 0.0000102, 0.000002, 1e-7, 4.6e-7, 0.99999999):
        assert v(S.pvalue_label(F.lit(x))) == str(round(x, 7))
    assert v(S.pvalue_from_label(F.lit("a__pvalues_<1e-07"))) == 1e-7
    assert v(S.decode_id(S.encode_id(F.lit(-7)))) == -7
    assert v(S.iupac(F.array(F.lit("G"), F.lit("A"), F.lit("-")))) == "R"
    assert v(S.hamming(F.lit("ACGT"), F.lit("AGGA"))) == 2
    assert v(S.sliding_hamming(F.lit("TTACGT"), F.lit("ACG"))) == 0
    assert [tuple(x) for x in v(S.nonzero_fragments(F.array(*map(F.lit, [5, 0, 6, 7, 0])), F.lit("ACGTACC"), 3))] == [(0, "ACG", [5]), (2, "GTAC", [6, 7])]
    assert v(S.fraction(F.lit(0.0), F.lit(0.0))) == 0 and v(S.fraction(F.lit(1.0), F.lit(0.0))) == float("inf")
    assert v(S.half_even(F.lit(2.5))) == 2
    assert v(S.merge_match(F.lit("AC-T"), F.lit("AGGT"), F.lit("|. |"))) == "A.GT"
    assert v(S.counts_from_text(S.counts_to_text(F.array(F.lit(3), F.lit(4))))) == [3, 4]
    assert len(v(S.name_of(F.lit("x")))) == 8


def test_components_ignore_order(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    up = {}

    def find(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    want = sorted((v, find(v)) for v in up)
    for shuffled in (edges, [(b, a) for a, b in edges[::-1]]):
        assert rows(components(spark.createDataFrame(shuffled, "src long, dst long"))) == want
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert rows(components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long"))) == [(1, 1)]


def test_unitigs_spell_each_kmer_once(spark):
    rng = random.Random(2)
    k = 5
    ring = "ACGTTGCATTG"
    seqs = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(3)] + [ring + ring[: k - 1]]
    every = {x for s in seqs for x in kmers(s, k)}
    v, e = graph.unitigs(spark.createDataFrame([(x,) for x in every], "kmer string"))
    got = v.collect()
    spelled = Counter(x for r in got for x in kmers(r.seq, k))
    assert spelled == Counter(every | {x.translate(TURN)[::-1] for x in every})
    by = {r.vid: r.seq for r in got}
    assert len(by) == len(got)
    assert all(by.get(-i, s.translate(TURN)[::-1]) == s.translate(TURN)[::-1] for i, s in by.items())
    assert all(by[a][-(k - 1) :] == by[b][: k - 1] for a, b in e.collect())


@pytest.mark.parametrize(("k", "lot"), [(5, 7), (11, 50), (31, 40), (35, 1 << 20)])
def test_unitigs_over_lots(spark, monkeypatch, k, lot):
    """F3 to F10, F29: chains and rings over many lots, with counts, are those of a walk; pieces are ranked, where each k-mer was before."""
    rng = random.Random(k)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    ring, stem = word(90), word(150)
    seqs = [ring + ring[: k - 1], stem + word(60), stem + word(60), word(40), "A" * 50, word(300)]
    cnt = Counter(x for s in seqs for x in kmers(s, k))
    turned = lambda s: s.translate(TURN)[::-1]
    every = {x for c in cnt for x in (c, turned(c))}
    ons = {x: [x[1:] + b for b in "ACGT" if x[1:] + b in every] for x in every}
    ins = Counter(y for ys in ons.values() for y in ys)
    step = {x: ys[0] for x, ys in ons.items() if len(ys) == 1 and ins[ys[0]] == 1 and ys[0] not in (x, turned(x))}
    heads = sorted(every - set(step.values()))
    walks, seen = [], set()
    for x in [*heads, *sorted(every)]:
        if x not in seen:
            walks.append([x])
            while (y := step.get(walks[-1][-1])) and y != x:
                walks[-1].append(y)
            seen.update(walks[-1])
    want = sorted((w[0] + "".join(x[-1] for x in w[1:]), [max(cnt[x], cnt[turned(x)]) for x in w]) for w in walks)
    links = sorted((a[-1], b[0]) for a in walks for b in walks if b[0] in ons[a[-1]])

    monkeypatch.setattr(graph, "LOT", lot)
    written = {}

    def noted(df, name):
        made = materialize(df, name)
        written.setdefault(name, made.count())
        return made

    monkeypatch.setattr(graph, "materialize", noted)
    v, e = graph.unitigs(spark.createDataFrame(list(cnt.items()), "kmer string, cnt long").repartition(3), counted=True)
    got = v.collect()
    assert sorted((r.seq, r.counts) for r in got) == want
    assert all(r.kmers == kmers(r.seq, k) for r in got)
    by = {r.vid: r.seq for r in got}
    assert sorted((by[a][-k:], by[b][:k]) for a, b in e.collect()) == links
    assert k < 31 or written["hooks"] < len(every) / 4


def test_split_and_edges(spark):
    v = spark.createDataFrame([(7, "ACGTACC", [5, 1, 6, 7, 0]), (8, "CCA", [9]), (9, "TAC", [9])], "vid long, seq string, counts array<int>")
    e = spark.createDataFrame([(9, 7), (7, 8)], "src long, dst long")
    made, kept = graph.split_low(v, e, 2, 3)
    assert sorted((r.seq, r.counts) for r in made.collect()) == [("ACG", [5]), ("CCA", [9]), ("GTAC", [6, 7]), ("TAC", [9])]
    assert rows(kept) == [(9, 7)]
    anti = graph.without_antiparallel(spark.createDataFrame([(1, 2, 0), (2, 1, 1), (2, 3, 2), (3, 3, 3)], "src long, dst long, o int"), "o")
    assert rows(anti.select("src", "dst")) == [(1, 2), (2, 3)]
    checked = graph.checked_edges(
        spark.createDataFrame([(1, "ACG"), (2, "CGT"), (3, "GTA")], "vid long, seq string"), spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long"), 3
    )
    assert rows(checked) == [(1, 2)]


def test_assembly_conserves_counts():
    assert sorted(assembly.peel_alone("ACGTA", [3, 1, 2], 3)) == [("ACG", 2), ("ACGTA", 1), ("GTA", 1)]
    assert assembly.assemble(bubbles.load(3, [(1, "ACGT", [4, 4], [2]), (2, "GTA", [4], [])])) == [("ACGTA", 4)]
    rng = random.Random(3)
    for _ in range(60):
        k = 4
        names = sorted({x for _ in range(2) for x in kmers("".join(rng.choice("ACGT") for _ in range(14)), k)})
        count = {x: rng.randint(1, 5) for x in names}
        ids = {x: i for i, x in enumerate(names, 1)}
        g = bubbles.load(k, [(ids[x], x, [count[x]], [ids[y] for y in names if y[:-1] == x[1:] and y != x]) for x in names])
        got = Counter()
        for s, n in assembly.assemble(g):
            for x in kmers(s, k):
                got[x] += n
        assert got == Counter(count)


def test_bubble_is_merged(spark):
    v = spark.createDataFrame(
        [(1, "AACCGT", [9, 9, 9], 1), (2, "CGTAGGAT", [9] * 5, 1), (3, "CGTTGGAT", [1] * 5, 1), (4, "GATCCA", [9, 9, 9], 1)], "vid long, seq string, counts array<int>, comp_id long"
    )
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "src long, dst long")
    left, edges, archived = bubbles.split_result(bubbles.correct_components(v, e, 4, 10))
    assert sorted((r.vid, r.counts) for r in left.collect()) == [(1, [9, 9, 9]), (2, [10] * 5), (4, [9, 9, 9])]
    assert rows(edges.select("src", "dst")) == [(1, 2), (2, 4)]
    assert [(r.kind, r.edit_distance) for r in archived.collect()] == [("count included", 1)]


def test_longest_first_mapping():
    made = dict(mapping.map_longest_first([("AAACCC", 10), ("AAAC", 4), ("GGG", 2), ("CC", 6)]))
    assert made == {"AAACCC": [14, 14, 14, 17, 16, 13], "GGG": [2, 2, 2]}


def test_longest_first_mapping_against_a_scan_a_length():
    """The automaton finds what reading all profiles again for each length finds."""
    import random

    def plain(sequences, compat):
        by = {}
        for s, c in sequences:
            by.setdefault(len(s), []).append((s, c))
        made = []
        for nth, size in enumerate(sorted(by, reverse=True)):
            wanted = {}
            for s, c in by[size]:
                wanted[s] = wanted.get(s, 0) + c
            if not nth:
                made = [(s, [c] * size) for s, c in sorted(by[size])]
                continue
            new = []
            for s, c in sorted(wanted.items()):
                at = [(p, i) for p, (t, _) in enumerate(made) for i in range(len(t) - size + 1) if t[i : i + size] == s]
                if not at:
                    new.append((s, [c] * size))
                    continue
                weigh = sorted(((sum(made[p][1][i : i + size]) / size, p, i) for p, i in at), key=lambda x: -x[0])
                total, left = sum(w for w, _, _ in weigh), c
                for n, (w, p, i) in enumerate(weigh):
                    share = round(w * c / total) if total else 0
                    if len(weigh) == 1 or n == len(weigh) - 1 and (share >= left or not compat):
                        share = left
                    share = min(share, left)
                    left -= share
                    for x in range(i, i + size):
                        made[p][1][x] += share
            made += new
        return made

    rng = random.Random(5)
    for _ in range(300):
        rows = [("".join(rng.choices("AC", k=rng.randint(1, 9))), rng.randint(1, 9)) for _ in range(rng.randint(0, 12))]
        for compat in (False, True):
            assert mapping.map_longest_first(rows, compat) == plain(rows, compat)
    assert mapping.map_longest_first([("AC", 2), ("", 3)]) == [("AC", [2, 2]), ("", [])]


def test_clusters_are_those_of_dense_linkage(spark):
    """Within each length, copies and texts below the threshold included; tables without rows or texts give none."""
    import random

    import numpy as np

    from peakmill.functions.kernels import complete_linkage

    rng = random.Random(3)
    made = ["".join(rng.choices("ACGT" if n > 4 else "AC", k=n)) for n in [0, 2, 4, 4, 4, 6, 6, 6, 9, 9, 40] * 12]
    made += ["".join(c if rng.random() > 0.15 else "T" for c in s) for s in made]
    table = spark.createDataFrame([(s, 1, "x") for s in made] + [(None, 1, "x")], "seq string, cnt long, nth string")
    for threshold in (1.0, 2.5, 4.0):
        want = []
        for n in {len(s) for s in made}:
            each = sorted(s for s in made if len(s) == n)
            far = np.array([[sum(a != b for a, b in zip(s, t, strict=True)) for t in each] for s in each])
            want += [(s, 1, n, c) for s, c in zip(each, complete_linkage(far, threshold), strict=True)]
        assert rows(mapping.cluster_sequences(table, threshold)) == sorted(want)
    assert mapping.cluster_sequences(table.where("seq is null"), 3.0).count() == 0


def test_capture_on_gapped_alignments(spark):
    """Ranges of a consensus become columns; letters in gap columns go with their range; odd ranges and null rows give none."""
    weights = spark.createDataFrame([(1, i, b, w) for i, c in enumerate(["A3", "C3", "-2G1", "T3", "A3"]) for b, w in zip(c[::2], map(int, c[1::2]), strict=True)], "p int, pos int, base string, weight int")
    columns = peaks.profile_columns(weights, ["p"])
    assert rows(columns.selectExpr("p", "cast(columns as string)")) == [(1, "[0, 1, 3, 4]")]
    ranges = spark.createDataFrame([(1, 0, 1, 3), (1, 1, 3, 99), (1, 2, 2, 2), (1, 3, 7, 9), (1, 4, None, 2), (2, 5, 0, 1)], "p int, peak_i int, start int, end int")
    wide = peaks.gapped_ranges(ranges, columns, ["p"])
    assert rows(wide) == [(1, 0, 1, 4), (1, 1, 4, 5)]
    made = [(1, "ACTA", [4, 3, 2, 1], [0, 1, 3, 4], 7), (1, "ACGTA", [5, 6, 7, 8, 9], [0, 1, 2, 3, 4], 7), (1, "A", [2], [0], 7), (1, None, None, None, 7), (1, "", [], [], 7)]
    table = spark.createDataFrame(made, "p int, seq string, counts array<int>, places array<int>, end int")
    assert rows(peaks.captured_gapped(table, wide, ["p"])) == [(1, 0, "CGT", 6), (1, 0, "CT", 2), (1, 1, "A", 1), (1, 1, "A", 9)]
    assert rows(peaks.captured_gapped(table, wide, ["p"], 1, 3, "mean")) == [(1, 0, "CT", 2.5)]
    assert peaks.captured_gapped(table.limit(0), wide, ["p"]).count() == 0


def test_columns_of_gapped_profiles():
    """A profile's columns add up to what its alignments say, letter by letter and gap by gap, however many columns open."""
    import random

    rng = random.Random(8)
    for _ in range(60):
        base = "".join(rng.choices("ACGT", k=24))
        made = [(base, 9)]
        for _ in range(8):
            s = list(base)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(s))
                s[i : i + rng.randint(0, 1)] = rng.choice(["", "A", "CG"])
            made.append(("".join(s), rng.randint(1, 3)))
        got = mapping.approximate_profiles(made, 6, 4.0)
        assert sorted((s, c) for p in got for s, c, _ in p.places()) == sorted(made)
        for p in got:
            for i, column in enumerate(p.columns):
                want = dict.fromkeys("ACGT-", 0)
                for s, c, at in p.places():
                    assert at == sorted(set(at)) and len(at) == len(s)
                    want[s[at.index(i)] if i in at else "-"] += c
                assert column == [want[b] for b in "ACGT-"]


def test_containment_and_hits(spark):
    p = spark.createDataFrame([(1, "ACG"), (2, "A" * 20), (3, "")], "pattern_id long, seq string")
    t = spark.createDataFrame([(1, "ACGACG"), (2, "C" + "A" * 21)], "target_id long, seq string")
    assert rows(mapping.containment(p, t)) == [(1, 1, 0), (1, 1, 3), (2, 2, 1), (2, 2, 2)]
    profiles = spark.createDataFrame([(5, "ACGTACGT", [5] * 8)], "profile_id long, seq string, base_counts array<bigint>")
    hits = spark.createDataFrame([("q", 5, 2, 1)], "query string, target long, qstart int, sstart int")
    added = mapping.add_hits(profiles, hits, spark.createDataFrame([("q", 3)], "query string, cnt long"), 4)
    assert added.collect()[0].base_counts == [8, 8, 8, 5, 5, 5, 5, 5]
    q = spark.createDataFrame([("ACGTTCGT", 4)], "query string, cnt long")
    near = mapping.nearest_profiles(q, profiles, 1).collect()
    assert [(r.profile_id, r.distance) for r in near] == [(5, 1)]
    found = mapping.approximate_hits(spark.createDataFrame([("CGTACG",)], "query string"), profiles, 6).collect()
    assert (found[0].sstart, found[0].length, found[0].pident) == (2, 6, 100.0)


def test_approximate_hits_against_brute_force(spark):
    rng = random.Random(11)
    k, identity = 11, 90.0
    profiles = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randint(8, 90)))) for i in range(12)]
    queries = ["".join(rng.choice("ACGT") for _ in range(k)) for _ in range(40)]
    for _ in range(120):
        p = rng.choice([s for _, s in profiles if len(s) > k])
        at = rng.randint(0, len(p) - k)
        q = list(p[at : at + k])
        q[rng.randrange(k)] = rng.choice("ACGT")
        queries.append("".join(q))
    want = set()
    for q in set(queries):
        for i, s in profiles:
            for d in range(-k, len(s)):
                # the extension of any whole word on the diagonal that passes
                for x in range(k - 2):
                    if x + d >= 0 and x + 3 + d <= len(s) and q[x : x + 3] == s[x + d : x + 3 + d]:
                        a, b, ts, same = mapping._extend(q, s, x, x + d, 3)
                        if same >= identity / 100 * k:
                            want.add((q, i, a + 1, ts + 1, b - a))
    found = mapping.approximate_hits(spark.createDataFrame([(q,) for q in set(queries)], "query string"), spark.createDataFrame(profiles, "profile_id long, seq string"), k, identity)
    got = {(r.query, r.target, r.qstart, r.sstart, r.length) for r in found.collect()}
    assert got == want and len(want) > 80


@pytest.mark.parametrize("one_window", [1 << 20, 0])
def test_u_statistic_of_odd_rows(spark, monkeypatch, one_window):
    monkeypatch.setattr(windows, "ONE_WINDOW", one_window)
    rng = random.Random(4)
    data = [(rng.choice([None, "a", "b"]), rng.random() < 0.4, rng.choice([None, 1.0, 2.0, float(rng.randint(0, 40))])) for _ in range(400)] + [("alone", True, 1.0)]
    got = {r.k: r for r in windows.u_statistic(spark.createDataFrame(data, "k string, f boolean, v double"), ["k"], "f", "v").collect()}
    assert set(got) == {None, "a", "b", "alone"}
    for key, r in got.items():
        x = [v if v is not None else -1 for k, f, v in data if k == key and f]
        y = [v if v is not None else -1 for k, f, v in data if k == key and not f]
        assert (r.n1, r.n2) == (len(x), len(y))
        assert r.u == sum((a > b) + (a == b) / 2 for a in x for b in y)


def test_windows(spark):
    v = spark.createDataFrame([(1, 0, 5.0), (1, 1, 2.0), (1, 2, 9.0)], "id int, pos int, v double")
    assert [r.v for r in windows.base_coverage(v, "id", "pos", ["v"], 3).orderBy("pos").collect()] == [5, 5, 9, 9, 9]
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate([0, 0, 1, 1, 1, 0])], "id int, pos int, s int")
    assert [(r.start, r.end) for r in windows.run_blocks(s, "id", "pos", "s").orderBy("start").collect()] == [(0, 2), (2, 5), (5, 6)]


def test_peaks_and_replicates(spark):
    import numpy as np

    y = np.array([[1.0, 1]] * 30 + [[40.0, 1]] * 30 + [[1.0, 1]] * 30) + np.arange(90)[:, None] % 3 * 0.1
    found = peaks.call(y, "ACG" * 30, 10, 0.05)
    assert len(found) == 1 and abs(found[0][0] - 30) <= 2 and abs(found[0][1] - 60) <= 2
    a = spark.createDataFrame([("TTACGTACGTACGG", 0.01), ("GGGGGGGGGGGGGG", 0.02)], "seq string, pvalue double")
    b = spark.createDataFrame([("ACGTACGTAC", 0.03)], "seq string, pvalue double")
    got = replicates.reconcile([a, b]).collect()
    assert [(r.seq, r.pvalue, r.variants) for r in got] == [("TTACGTACGTACGG", 0.03, [])]
    assert replicates.tournament([a, b]).collect()[0].seq == "TTACGTACGTACGG"
    with pytest.raises(ValueError, match="two replicates"):
        replicates.reconcile([a])


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">r1 x\nACG\nTT\n>r2\nGG\n")
    (tmp_path / "odd.fa").write_text(">r1 a>b > c\r\nAC\r\n\r\nGT\r\n>r2\n>r3>\nTT")
    got = readers.reads(spark, str(tmp_path / "odd.fa")).collect()
    assert sorted((r.read_id, r.header, r.seq) for r in got) == [("r1", "r1 a>b > c", "ACGT"), ("r2", "r2", ""), ("r3>", "r3>", "TT")]
    (tmp_path / "b.fastq").write_text("@q1\nACGT\n+\n@III\n@q2\nTT\n+\nII\n")
    assert sorted((r.read_id, r.seq) for r in readers.reads(spark, str(tmp_path / "a.fasta")).collect()) == [("r1", "ACGTT"), ("r2", "GG")]
    assert sorted((r.read_id, r.seq) for r in readers.reads(spark, str(tmp_path / "b.fastq")).collect()) == [("q1", "ACGT"), ("q2", "TT")]
    with pytest.raises(ValueError, match="unknown format"):
        readers.reads(spark, "x.txt")
    v = spark.createDataFrame([(1, "ACGT", [3, 4])], "vid long, seq string, counts array<int>")
    e = spark.createDataFrame([(1, -2)], "src long, dst long")
    writers.unitigs(v, e, str(tmp_path / "g"))
    back_v, back_e = readers.graph(spark, str(tmp_path / "g"))
    assert [(r.vid, r.seq, r.counts, r.kc) for r in back_v.collect()] == [(1, "ACGT", [3, 4], 7)]
    assert rows(back_e.select("src", "dst")) == [(1, -2)]
    p = spark.createDataFrame([(4, 0, "ACG", 3e-8)], "profile_id long, peak_i long, seq string, pvalue double")
    writers.peaks(p, str(tmp_path / "p"))
    assert [(r.seq, r.pvalue) for r in readers.peaks(spark, str(tmp_path / "p")).collect()] == [("ACG", 1e-7)]
    writers.profiles(spark.createDataFrame([("AC", [1, 2])], "seq string, base_counts array<int>"), str(tmp_path / "f"))
    assert [(r.seq, r.base_counts) for r in readers.profiles(spark, str(tmp_path / "f")).collect()] == [("AC", [1, 2])]


def test_planted_region_is_found(spark):
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(2000))

    def reads(background, planted, seed):
        r = random.Random(seed)
        out = [genome[p : p + 60] for p in (r.randint(0, 1940) for _ in range(background))]
        out += [genome[p : p + 60] for p in (r.randint(800, 890) for _ in range(planted))]
        return spark.createDataFrame([(x,) for x in out], "seq string")

    pairs = [(reads(100, 300, 1), reads(150, 0, 2)), (reads(100, 300, 3), reads(150, 0, 4))]
    got = call_peaks(spark, pairs, Config(k=15, min_abundance=20)).collect()
    assert got
    for r in got:
        at = max(genome.find(r.seq), genome.find(r.seq.translate(TURN)[::-1]))
        assert 780 <= at and at + len(r.seq) <= 970


@pytest.mark.parametrize("one_window", [1 << 20, 0])
def test_exact_quantile(spark, monkeypatch, one_window):
    import numpy as np

    monkeypatch.setattr(windows, "ONE_WINDOW", one_window)
    rng = random.Random(7)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *map(float, range(9))])) for _ in range(300)] + [("one", 4.5), ("null", None)]
    df = spark.createDataFrame(data, "k string, v double")
    for share in (0.0, 0.37, 0.5, 0.95, 1.0):
        got = {r.k: r.quantile for r in windows.exact_quantile(df, ["k"], "v", share).collect()}
        by = {k: [v for q, v in data if q == k and v is not None] for k, _ in data}
        want = {str(k): float(np.quantile(v, share)) for k, v in by.items() if v}
        assert {str(k): v for k, v in got.items()} == pytest.approx(want)
        every = [v for _, v in data if v is not None]
        assert windows.exact_quantile(df, [], "v", share).collect()[0].quantile == pytest.approx(float(np.quantile(every, share)))
    assert windows.exact_quantile(df.limit(0), [], "v", 0.5).count() == 0


def test_graphs_of_several_keys(spark):
    """sequences that share k-mers make one graph together, and each its own by key; before, there was only the former."""
    a, b = "ACCGATTTGCC", "GGTATTTGTC"
    df = spark.createDataFrame([(i, x) for i, s in ((1, a), (2, b)) for x in kmers(s, 5)], "item int, kmer string")
    turned = lambda s: s.translate(TURN)[::-1]
    v, e = graph.unitigs(df, "item")
    assert rows(v.select("item", "seq")) == sorted((i, x) for i, s in ((1, a), (2, b)) for x in (s, turned(s)))
    assert e.count() == 0 and v.select("vid").distinct().count() == 4
    assert graph.unitigs(df.drop("item").distinct())[0].count() > 4


def test_rounds_leave_one_table(spark, monkeypatch):
    """F6 to F10: of the tables of k-mers and of ranking's rounds the last one stays on disk; before, each round's stayed to the end."""
    rng = random.Random(4)
    monkeypatch.setattr(graph, "LOT", 200)
    text = "".join(rng.choice("ACGT") for _ in range(3000))
    df = spark.createDataFrame([(w,) for w in kmers(text, 21)], "kmer string")
    there = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:"), "peakmill").iterdir() if list(p.glob("*.parquet"))}
    old = there() if Path(shared_dir(spark).removeprefix("file:"), "peakmill").exists() else set()
    v, e = graph.unitigs(df)
    assert sorted(r.seq for r in v.collect()) == sorted([text, text.translate(TURN)[::-1]]) and e.count() == 0
    left = Counter(name.split("-")[0] for name in there() - old)
    assert left["chains"] == 1 and left["kmers"] == 0 and left["pieces"] == 1


def test_positions_of_reads(spark):
    """As from the counts of all k-mers, with letters other than A, C, G and T, and k-mers that no read has."""
    reads = spark.createDataFrame([("t", "ACGTACGGNACGT"), ("c", "ACGGTTACGNNT"), ("t", "ACG"), ("c", None), ("t", "GGTTAC")], "arm string, seq string")
    profiles = spark.createDataFrame([(1, "ACGTTAC", [3] * 7), (2, "CCCCGTAC", [2] * 8)], "profile_id bigint, seq string, base_counts array<bigint>")
    arm = lambda x: counts.count_kmers(reads.where(F.col("arm") == x), 4)
    want = peaks.position_vectors(profiles, arm("t"), arm("c"), 4)
    got = peaks.positions_of_reads(profiles, reads, 4, F.col("arm") == "t")
    assert str(rows(got)) == str(rows(want)) and got.columns == want.columns  # nan as text


def test_positions_take_whole_profiles_as_the_list(spark, monkeypatch):
    """the profiles' k-mers are neither spelled to be counted nor found by a regular expression, twice each before; several batches of places."""
    monkeypatch.setattr(peaks, "PLACES", 50)
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (31, 90, 90, 140, 30)]
    texts += [texts[1], texts[3][20:70] + "N" + texts[2]]
    reads = spark.createDataFrame([(rng.choice("tc"), (t := rng.choice(texts))[(a := rng.randrange(20)) : a + rng.randint(20, 90)]) for _ in range(60)] + [("t", None)], "arm string, seq string")
    data = [(i, t, [rng.randint(1, 9) for _ in t]) for i, t in enumerate(texts)] + [(98, None, [1]), (99, texts[0], None)]
    profiles = spark.createDataFrame(data, "profile_id bigint, seq string, base_counts array<bigint>")
    got = peaks.positions_of_reads(profiles, reads, 31, F.col("arm") == "t")
    assert "regexp_extract_all" not in got._jdf.queryExecution().executedPlan().toString()
    n = {x: Counter(w for a, s in rows(reads.where("seq is not null")) if a == x for w in kmers(s, 31) if "N" not in w) for x in "tc"}
    scale = 0.99 * n["t"].total() / n["c"].total()
    for i, text, used in data[:-2]:
        made = {r.pos: (r.treat, r.ctrl) for r in got.where(F.col("profile_id") == i).collect()}
        each = []
        for at, w in enumerate(kmers(text, 31)):
            t, c, u = n["t"][w], n["c"][w] * scale, min(used[at : at + 31])
            f = u / (t - c) + 0.01 if t > c else float("inf")
            each.append((t * f, c * f))
        want = {p: tuple(max((e[s] for e in each[max(0, p - 30) : p + 1] if e[s] == e[s]), default=None) if all(e[s] == e[s] for e in each[max(0, p - 30) : p + 1]) else float("nan") for s in (0, 1)) for p in range(len(text) if each else 0)}
        assert set(made) == set(want)
        assert all(str(x) == str(y) or x == pytest.approx(y) for p in want for x, y in zip(made[p], want[p], strict=True)), i


def test_ranges_are_dealt_by_the_size_of_the_input(spark):
    """more input makes more tasks, not larger ones; before, adaptive execution gathered all of this in one."""
    df = spark.createDataFrame([(1, 5, 7), (1, 5, 9), (1, 9, 10), (1, 11, 12), (1, 5, 6), (2, 5, 5)], "k int, lo int, hi int")
    few, many = (windows.merged_ranges(df.repartition(n), "k", "lo", "hi") for n in (1, 6))
    assert rows(few) == rows(many) == [(1, 5, 10), (1, 11, 12), (2, 5, 5)]
    assert many.rdd.getNumPartitions() == 6 * few.rdd.getNumPartitions() > 6


def test_many_components_are_mapped_in_few_batches(spark):
    """Most components have one sequence: no call of Python, and no frame, is made for each."""
    rng = random.Random(8)
    by = {c: [("".join(rng.choices("AC", k=rng.randint(1, 9))), rng.randint(1, 9)) for _ in range(rng.choice([1, 1, 1, 2, 7]))] for c in range(400)}
    made = mapping.exact_profiles(spark.createDataFrame([(c, s, n) for c, x in by.items() for s, n in x], "comp_id long, seq string, cnt long"))
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    want = [(c, i, s, n) for c, x in by.items() for i, (s, n) in enumerate(mapping.map_longest_first(x))]
    assert sorted((r.comp_id, r.profile_id, r.seq, r.base_counts) for r in made.collect()) == want


def test_many_components_are_peeled_in_few_batches(spark):
    """Every fourth vertex is alone, the others are forks of three: peeled as each is by itself, and dealt over the cores."""
    v, e = [], []
    for c in range(0, 400, 4):
        v += [(c + 1, "AACCGT", [9, 8, 9], c + 1), (c + 2, "CGTAGG", [5, 5, 4], c + 1), (c + 3, "CGTTGG", [3, 1, 3], c + 1), (c + 4, "GATCCA", [2, 0, 1], None)]
        e += [(c + 1, c + 2), (c + 1, c + 3)]
    vertices = spark.createDataFrame(v, "vid long, seq string, counts array<int>, comp_id long")
    edges = spark.createDataFrame(e, "src long, dst long")
    fork = sorted(assembly.assemble(bubbles.load(4, [(i, s, n, [b for a, b in e if a == i]) for i, s, n, _ in v[:3]])))
    for singles, alone in ((False, [("GATCCA", 2)]), (True, sorted(assembly.peel_alone("GATCCA", [2, 0, 1], 4)))):
        made = assembly.assemble_components(vertices, edges, 4, peel_singles=singles)
        assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
        want = [(c + i, *x) for c in range(0, 400, 4) for i, found in ((1, fork), (4, alone)) for x in found]
        assert sorted((r.comp_id, r.seq, r.cnt) for r in made.collect()) == want


def test_rounds_of_ranking_are_those_of_the_longest_chain(spark, monkeypatch):
    """Rings among many short chains: each node's head and distance, in rounds of the logarithm of either's length and not of their number."""
    from peakmill import runtime

    lines = [list(range(i * 100, i * 100 + n)) for i, n in enumerate([2, 3, 4, 9, 5] * 60)]
    rings = [[90_000 + 50 * i + (7 * j) % n for j in range(n)] for i, n in enumerate([2, 3, 5, 11, 40])]
    hook = [(a, b) for x in lines for a, b in zip(x[:-1], x[1:])] + [(a, b) for x in rings for a, b in zip(x, [*x[1:], x[0]])]
    random.Random(4).shuffle(hook)
    written = []
    real = runtime.scratch_path
    monkeypatch.setattr(runtime, "scratch_path", lambda spark_, name: written.append(name) or real(spark_, name))
    got = sorted((r.id, r.head, r.dist, r.ring) for r in graph._ranked(spark.createDataFrame(hook, "src long, dst long"), 1).collect())
    want = [(v, x[0], i, False) for x in lines for i, v in enumerate(x)]
    for x in rings:
        at = x.index(min(x))
        want += [(v, min(x), i, True) for i, v in enumerate(x[at:] + x[:at])]
    assert got == sorted(want)
    assert written.count("chains") <= 6 and written.count("rings") <= 11


def test_reads_of_odd_texts(spark, tmp_path, monkeypatch):
    """Nulls, texts without letters, letters beyond a-z, and batches that are cut within: as the SQL has them; no text goes through a regular expression."""
    import duckdb

    from peakmill.plans import inputs

    texts = [None, "", "12 34\n", "Straße à la carte", "zZaA", "日本語 ok", "\x00b\x00", "word " * 50, None, "Ünï"] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"WITH {inputs.READS_SQL} SELECT read_id, arm, replicate, coalesce(seq, '') FROM reads").fetchall()
    made = inputs.reads(spark, str(tmp_path))
    assert "regexp_replace" not in made._jdf.queryExecution().executedPlan().toString()
    assert rows(made) == sorted(want)
    monkeypatch.setattr(codes, "PIECE", 40)
    ids, text = pa.array(range(len(texts))), pa.array(["" if t is None else t for t in texts])
    whole = pa.RecordBatch.from_arrays([ids, text], names=["id", "seq"])
    parts = list(codes.translated(iter([whole.slice(3), whole.slice(0, 3), whole.slice(0, 0)]), inputs._BASE_OF, whole.schema))
    assert len(parts) > 5
    assert sorted((r["id"], r["seq"]) for b in parts for r in b.to_pylist()) == sorted((r[0], r[3]) for r in want)
    nulls = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([""])], names=["id", "seq"])
    assert [b.to_pylist() for b in codes.translated(iter([nulls]), inputs._BASE_OF, whole.schema)] == [[{"id": 1, "seq": ""}]]
