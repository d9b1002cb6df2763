"""Edit distances of whole batches, and clusters from near pairs only; called once an Arrow batch or a group."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

import numpy as np

#: Cells (letters by words by pairs) that one batch of bit vectors holds.
CELLS = 1 << 21
_ONE, _TOP = np.uint64(1), np.uint64(63)


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts one after another, where each begins, and their lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size


def _scan(query: np.ndarray, words: int, columns: np.ndarray, anchored: bool, letters: int) -> Iterable[np.ndarray]:
    """Distances of all queries after each column of targets, from bit vectors of 64 query letters each.

    query(pair, place) and columns(column, pair) hold letter numbers; -1 is past
    a query's end, ``letters`` a letter that is in no query. A vector's bits say
    where the distance rises or falls by one from a query place to the next;
    what happens at a word's last bit goes into the pair's next word. anchored:
    targets count from their first letter, else from wherever is nearest.
    """
    n = len(query)
    size = (query >= 0).sum(1)
    # where each letter is in each query
    held = np.zeros((words, letters + 1, n), np.uint64)
    pair, place = np.nonzero(query >= 0)
    np.bitwise_or.at(held, (place // 64, query[pair, place], pair), _ONE << (place % 64).astype(np.uint64))
    last = (size - 1).astype(np.uint64) % np.uint64(64)
    up = np.full((words, n), ~np.uint64(0))
    down = np.zeros((words, n), np.uint64)
    score = size.copy()
    each = np.arange(n)
    first = np.full(n, anchored, np.uint64)
    for letter in columns:
        rise, fall = first, np.zeros(n, np.uint64)
        for w in range(words):
            p, m = up[w], down[w]
            equal = held[w, letter, each]
            vertical = equal | m
            equal |= fall
            horizontal = (((equal & p) + p) ^ p) | equal
            plus, minus = m | ~(horizontal | p), p & horizontal
            out = last if w == words - 1 else _TOP
            rising, falling = (plus >> out) & _ONE, (minus >> out) & _ONE
            plus, minus = (plus << _ONE) | rise, (minus << _ONE) | fall
            up[w], down[w] = minus | ~(vertical | plus), plus & vertical
            rise, fall = rising, falling
        score = score + rise.astype(np.int64) - fall.astype(np.int64)
        yield score


def _spread(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, fill: int, turned: bool = False) -> np.ndarray:
    """A row a text of its codes, or of them from the last to the first, filled up to the width."""
    at = np.arange(width)[None, :]
    inside = at < size[:, None]
    place = begin[:, None] + (size[:, None] - 1 - at if turned else at)
    return np.where(inside, codes[np.where(inside, place, 0)] if len(codes) else fill, fill)


def infix_distances(queries: Sequence[str], targets: Sequence[str], bounds: Sequence[int] | int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edit distance of each query to the nearest substring of its target, with that substring's first and last place.

    (-1, -1, -1) above a pair's bound. The end is the smallest that is nearest,
    the start the largest for that end. Pairs of like length go together, as
    many as CELLS allows: a column of their targets costs a few operations on
    vectors of all these pairs, whatever the queries' letters; the start is
    found by the same scan backwards from the end.
    """
    n = len(queries)
    distance, start, end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if not n:
        return distance, start, end
    limit = np.full(n, np.iinfo(np.int64).max) if bounds is None else np.broadcast_to(np.asarray(bounds, np.int64), n)
    q, q_at, q_size = _codes(queries)
    t, t_at, t_size = _codes(targets)
    alphabet = np.unique(q)
    q = np.searchsorted(alphabet, q)
    place = np.searchsorted(alphabet, t)
    t = np.where(alphabet[np.minimum(place, len(alphabet) - 1)] == t, place, len(alphabet)) if len(alphabet) else place
    words = -(-q_size // 64)
    order = np.lexsort((t_size, words))
    order = order[words[order] > 0]  # a query without letters is nearest to nothing, at no cost
    lo = 0
    while lo < len(order):
        w = int(words[order[lo]])
        same = int(np.searchsorted(words[order], w, side="right"))
        hi = min(same, lo + max(1, CELLS // (w * (len(alphabet) + 1))))
        # targets are sorted within the words, so a batch is as wide as its last
        while hi - lo > 1 and (hi - lo) * int(t_size[order[hi - 1]]) > 4 * CELLS:
            hi = lo + (hi - lo) // 2
        pick = order[lo:hi]
        lo = hi
        rows = _spread(q, q_at[pick], q_size[pick], w * 64, -1)
        wide = _spread(t, t_at[pick], t_size[pick], int(t_size[pick].max()), len(alphabet)).T
        best, at = q_size[pick].copy(), np.full(len(pick), -1, np.int64)
        for j, score in enumerate(_scan(rows, w, wide, False, len(alphabet))):
            nearer = (score < best) & (j < t_size[pick])
            best, at = np.where(nearer, score, best), np.where(nearer, j, at)
        near = best <= limit[pick]
        distance[pick], end[pick] = np.where(near, best, -1), np.where(near, at, -1)
        start[pick] = np.where(near, 0, -1)
        again = np.flatnonzero(near & (at >= 0))
        if len(again):
            some, d, e = pick[again], best[again], at[again]
            reach = np.minimum(e + 1, q_size[some] + d)
            rows = _spread(q, q_at[some], q_size[some], w * 64, -1, turned=True)
            back = _spread(t, t_at[some] + e + 1 - reach, reach, int(reach.max()), len(alphabet), turned=True).T
            taken = np.full(len(some), -1, np.int64)
            for j, score in enumerate(_scan(rows, w, back, True, len(alphabet))):
                taken = np.where((taken < 0) & (score == d) & (j < reach), j + 1, taken)
            start[some] = e + 1 - taken
    return distance, start, end


def near_pairs(seqs: Sequence[str], most: int) -> list[tuple[int, int, int]]:
    """(i, j, differing places), i < j, of the different equally long seqs with ``most`` such places or fewer.

    Of most + 1 blocks such a pair has one in common, so only these meet.
    """
    n = len(seqs)
    if n < 2 or most < 0:
        return []
    size = len(seqs[0])
    x = _codes(seqs)[0].reshape(n, size)
    cuts = [size * b // (most + 1) for b in range(most + 2)]
    found: dict[tuple[int, int], int] = {}
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        alike: dict[str, list[int]] = {}
        for i, s in enumerate(seqs):
            alike.setdefault(s[a:b], []).append(i)
        for members in alike.values():
            m = np.asarray(members)
            for nth in range(len(m) - 1):
                far = (x[m[nth + 1 :]] != x[m[nth]]).sum(1)
                near = np.flatnonzero(far <= most)
                found.update(((int(m[nth]), int(m[nth + 1 + k])), int(far[k])) for k in near)
    return [(i, j, d) for (i, j), d in found.items()]


def sparse_linkage(pairs: Iterable[tuple[int, int, float]], threshold: float) -> dict[int, int]:
    """Cluster, its smallest member, of everything in the pairs (i, j, distance): complete linkage.

    Pairs that are not given are beyond the threshold, so memory is that of the
    given ones. The nearest two clusters merge, of equally near ones those with
    the smallest members, while their farthest members are nearer than the
    threshold.
    """
    far: dict[int, dict[int, float]] = {}
    for i, j, d in pairs:
        far.setdefault(i, {})
        far.setdefault(j, {})
        if i != j and d < threshold:
            far[i][j] = far[j][i] = d
    label = {i: i for i in far}
    heap = [(d, i, j) for i, row in far.items() for j, d in row.items() if i < j]
    heapq.heapify(heap)
    while heap:
        d, a, b = heapq.heappop(heap)
        # of clusters that have merged since, or are farther by now
        if a not in far or far[a].get(b) != d:
            continue
        gone, mine = far.pop(b), far[a]
        del mine[b]
        label[b] = a
        for other in gone:
            if other != a:
                far[other].pop(b)
        for other in list(mine):
            if other not in gone:
                del mine[other], far[other][a]
            elif gone[other] > mine[other]:
                mine[other] = far[other][a] = gone[other]
                heapq.heappush(heap, (gone[other], min(a, other), max(a, other)))

    for i in sorted(label):
        label[i] = label[label[i]]  # a cluster's smallest member is settled before the others
    return label
