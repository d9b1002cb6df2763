"""Bit-parallel distances and sparse linkage against the plain ways."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakmill.functions import distances, kernels

short = st.text("ACG", max_size=14)
wide = st.text(st.sampled_from("Aé漢😀 "), max_size=200)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(short, wide), st.one_of(short, wide), st.integers(0, 9)), max_size=8))
def test_distances_of_a_batch_are_those_of_each_pair(pairs):
    q, t, b = ([x[i] for x in pairs] for i in range(3))
    for bounds in (None, b):
        found = list(zip(*(x.tolist() for x in distances.infix_distances(q, t, bounds)), strict=True))
        assert found == [kernels.infix_distance(x, y, None if bounds is None else z) for x, y, z in pairs]


@pytest.mark.parametrize("size", [1, 63, 64, 65, 127, 128, 129, 300])
def test_distances_at_the_ends_of_words(size, monkeypatch):
    rng = random.Random(size)
    text = lambda n: "".join(rng.choices("ACGT", k=n))
    q = [text(size) for _ in range(40)]
    t = [text(rng.randint(0, 50)) + "".join(c for c in s if rng.random() > 0.1) + text(rng.randint(0, 50)) for s in q]
    want = [kernels.infix_distance(a, b) for a, b in zip(q, t, strict=True)]
    for cells in (1 << 21, 64):  # one batch, or one pair each
        monkeypatch.setattr(distances, "CELLS", cells)
        assert list(zip(*(x.tolist() for x in distances.infix_distances(q, t)), strict=True)) == want


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9).flatmap(lambda n: st.lists(st.text("AC", min_size=n, max_size=n), max_size=14, unique=True)), st.integers(0, 6))
def test_sparse_linkage_is_the_dense_one(seqs, threshold):
    far = np.array([[sum(a != b for a, b in zip(s, t, strict=True)) for t in seqs] for s in seqs]).reshape(len(seqs), len(seqs))
    near = distances.near_pairs(seqs, threshold - 1)
    assert sorted(near) == [(i, j, far[i, j]) for i in range(len(seqs)) for j in range(i + 1, len(seqs)) if far[i, j] < threshold]
    label = distances.sparse_linkage(near, threshold)
    assert [label.get(i, i) for i in range(len(seqs))] == kernels.complete_linkage(far, threshold)


def test_linkage_of_nothing_and_of_far_pairs():
    assert distances.sparse_linkage([], 2) == {}
    assert distances.sparse_linkage([(3, 1, 5.0)], 2) == {1: 1, 3: 3}
