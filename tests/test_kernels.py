from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakmill.functions import kernels as N
from peakmill.functions.frames import whole_groups

DNA = st.text("ACGT", max_size=12)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(DNA, DNA)
def test_infix_distance_is_the_nearest_substring(q, t):
    d, a, b = N.infix_distance(q, t)
    assert d == min(edits(q, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
    assert edits(q, t[a : b + 1]) == d
    assert N.infix_distance(q, t, d - 1)[0] == -1 if d else True


@settings(max_examples=150, deadline=None)
@given(DNA, DNA)
def test_global_alignment(a, b):
    d, ops = N.global_alignment(a, b)
    assert d == edits(a, b) == sum(o != "=" for o in ops)
    x, marks, y = N.render_alignment(a, b, ops)
    assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(marks) == len(y)


def test_rank_test():
    assert N.mann_whitney_greater([12, 14, 15], [1, 2, 3]) == pytest.approx((9, 0.0404278), abs=1e-6)
    assert N.mann_whitney_greater([12, 12, 15], [12, 3, 3]) == pytest.approx((8, 0.0786496), abs=1e-6)
    assert N.mann_whitney_greater([5, 5], [5, 5])[1] == 1
    assert N.mann_whitney_greater([], [1])[1] == 1


def test_assignment_is_cheapest():
    rng = random.Random(5)
    for _ in range(100):
        n = rng.randint(1, 5)
        c = np.array([[rng.random() for _ in range(rng.randint(n, n) + 1)] for _ in range(n)])
        got = sum(c[i, j] for i, j in enumerate(N.assignment(c)))
        assert got == pytest.approx(min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n + 1), n)))


def test_hidden_states_follow_a_step():
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(2, 1, (50, 2)), rng.normal([20, 2], 1, (50, 2)), rng.normal(2, 1, (50, 2))])
    s = N.gaussian_hmm(y, 2)
    assert (s[:50] == s[0]).all() and (s[50:100] == 1 - s[0]).all() and (s[100:] == s[0]).all()
    assert (N.gaussian_hmm(y, 2) == s).all()
    assert N.gaussian_hmm(y[:1], 2) is None


def test_peaks_of_a_curve():
    x = np.array([0, 1, 5, 1, 0, 2, 2, 2, 0, 9, 0], float)
    assert N.find_peaks(x, 1) == [2, 6, 9]
    assert N.find_peaks(x, 4) == [2, 9]
    assert N.merge_ranges([(5, 7), (0, 2), (2, 3)]) == [(0, 3), (5, 7)]
    assert N.rolling_mean(np.arange(5), 2).tolist() == [0.5, 1.5, 2.5, 3.5]


def test_strong_components():
    assert sorted(N.strong_components([1, 2, 3, 4], {1: [2], 2: [3], 3: [1], 4: [1]})) == [[1, 2, 3], [4]]


def test_complete_linkage():
    d = np.abs(np.subtract.outer([0, 1, 10, 11, 12.0], [0, 1, 10, 11, 12.0]))
    labels = N.complete_linkage(d, 2.5)
    assert labels[0] == labels[1] != labels[2] == labels[3] == labels[4]


def test_error_function_and_p_as_columns(spark):
    import math
    import random

    from pyspark.sql import functions as F

    from peakmill.functions.normal import erfc, rank_test_p

    xs = [x / 50 for x in range(-600, 600)]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("y")).collect():
        assert math.isclose(r.y, math.erfc(r.x), rel_tol=1e-11, abs_tol=1e-300)
    rng = random.Random(2)
    from peakmill.functions.kernels import mann_whitney_greater
    from peakmill.operators import windows

    rows = [(g, rng.random() < 0.4, float(rng.randint(0, 9 * g + 1))) for g in range(6) for _ in range(60)]
    tests = windows.u_statistic(spark.createDataFrame(rows, "g int, f boolean, v double"), ["g"], "f", "v")
    for r in tests.withColumn("p", rank_test_p(F.col("u"), F.col("n1"), F.col("n2"), F.col("tie"))).collect():
        u, p = mann_whitney_greater([v for g, f, v in rows if g == r.g and f], [v for g, f, v in rows if g == r.g and not f])
        assert (r.u, round(r.p, 12)) == (u, round(p, 12))


def test_models_fitted_together_are_those_of_each_alone():
    rng = np.random.default_rng(3)
    ys = [np.stack([rng.poisson(4 + 25 * (np.arange(n) // 30 % 2)), rng.poisson(5, n)], 1).astype(float) for n in (200, 7, 90, 200, 3)]
    ys += [np.zeros((40, 2)), np.full((5, 2), np.nan)]
    alone = [N.gaussian_hmm(y, 4) for y in ys]
    for a, b in zip(alone, N.gaussian_hmms(ys, 4), strict=True):
        assert (a is None) == (b is None)
        assert a is None or a.tolist() == b.tolist()
    assert alone[4] is None and alone[6] is None
    # the means of this one are far apart, so its states are the stretches that were drawn
    far = np.stack([100.0 * (np.arange(90) // 30 % 2) + np.arange(90) % 3, np.arange(90) % 3], 1)
    low, high = (set(N.gaussian_hmms([far, ys[0]], 2)[0][a:b].tolist()) for a, b in ((0, 30), (30, 60)))
    assert len(low) == len(high) == 1 and low != high


def test_groups_come_whole_however_frames_are_cut():
    keys = [1, 1, 1, 2, 3, 3, 3, 3, 3, None]
    rows = pd.DataFrame({"k": pd.Series(keys, dtype="Int64"), "x": range(10)})
    for cut in (1, 2, 3, 7, 10):
        for rows_ in (1, 3, 100):
            made = [g for groups in whole_groups((rows.iloc[i : i + cut] for i in range(0, 10, cut)), "k", rows_) for g in groups]
            assert [g["x"].tolist() for g in made] == [[0, 1, 2], [3], [4, 5, 6, 7, 8], [9]]
    assert list(whole_groups(iter([rows.iloc[:0]]), "k", 3)) == []
