"""NumPy kernels for what DataFrame operators cannot express; called once a group or an Arrow batch."""

from __future__ import annotations

import math
from collections.abc import Hashable, Iterable, Sequence

import numpy as np


# -- alignment --
def infix_distance(query: str, target: str, bound: int | None = None) -> tuple[int, int, int]:
    """Edit distance of query to its nearest substring of target, with that substring's first and last place.

    (-1, -1, -1) above the bound. The end is the smallest that is nearest, the
    start the largest for that end.
    """
    n, m = len(query), len(target)
    if not n:
        return 0, 0, -1
    if not m:
        return (n, 0, -1) if bound is None or n <= bound else (-1, -1, -1)
    t = np.frombuffer(target.encode("utf-32-le"), np.uint32)
    row, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    ramp = np.arange(m + 1)
    for i, ch in enumerate(query, 1):
        diag = row[:-1] + (t != ord(ch))
        up = row[1:] + 1
        best = np.empty(m + 1, np.int64)
        best[0] = i
        best[1:] = np.minimum(diag, up)
        origin = np.empty(m + 1, np.int64)
        origin[0] = 0
        origin[1:] = np.where(diag < up, start[:-1], np.where(up < diag, start[1:], np.maximum(start[:-1], start[1:])))
        # gaps in the query: running minimum along the row; a later origin wins ties
        key = (best - ramp) * (m + 2) - origin
        low = np.minimum.accumulate(key)
        took = np.maximum.accumulate(np.where(key == low, ramp, 0))
        row, start = best[took] + ramp - took, origin[took]
        if bound is not None and row.min() > bound:
            return -1, -1, -1
    end = int(row.argmin())
    d = int(row[end])
    if bound is not None and d > bound:
        return -1, -1, -1
    return d, int(start[end]), end - 1


def global_alignment(a: str, b: str) -> tuple[int, str]:
    """Edit distance and operations from a to b: ``=`` equal, ``X`` other, ``D`` only in a, ``I`` only in b."""
    n, m = len(a), len(b)
    d = np.zeros((n + 1, m + 1), np.int64)
    d[0], d[:, 0] = np.arange(m + 1), np.arange(n + 1)
    other = np.frombuffer(a.encode("utf-32-le"), np.uint32)[:, None] != np.frombuffer(b.encode("utf-32-le"), np.uint32)[None, :]
    ramp = np.arange(m + 1)
    for i in range(1, n + 1):
        d[i, 1:] = np.minimum(d[i - 1, :-1] + other[i - 1], d[i - 1, 1:] + 1)
        d[i] = np.minimum.accumulate(d[i] - ramp) + ramp
    ops, i, j = [], n, m
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + other[i - 1, j - 1]:
            ops.append("X" if other[i - 1, j - 1] else "=")
            i, j = i - 1, j - 1
        elif i and d[i, j] == d[i - 1, j] + 1:
            ops.append("D")
            i -= 1
        else:
            ops.append("I")
            j -= 1
    return int(d[n, m]), "".join(reversed(ops))


def render_alignment(a: str, b: str, ops: str) -> tuple[str, str, str]:
    """Gapped a, marks (``|`` equal, ``.`` other, space gap), gapped b."""
    x, marks, y, i, j = [], [], [], 0, 0
    for op in ops:
        x.append("-" if op == "I" else a[i])
        y.append("-" if op == "D" else b[j])
        marks.append({"=": "|", "X": "."}.get(op, " "))
        i += op != "I"
        j += op != "D"
    return "".join(x), "".join(marks), "".join(y)


# -- rank test --
def mann_whitney_greater(x: Sequence[float], y: Sequence[float]) -> tuple[float, float]:
    """(U, p) that x tends to be larger; normal approximation with tie and continuity corrections; p 1 if all are equal."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n1, n2 = len(x), len(y)
    if not n1 or not n2:
        return 0.0, 1.0
    values, inverse, count = np.unique(np.concatenate([x, y]), return_inverse=True, return_counts=True)
    rank = np.cumsum(count) - (count - 1) / 2
    u = float(rank[inverse][:n1].sum() - n1 * (n1 + 1) / 2)
    n = n1 + n2
    tie = 1 - float((count.astype(float) ** 3 - count).sum()) / (n**3 - n)
    if tie <= 0:
        return u, 1.0
    z = (u - n1 * n2 / 2 - 0.5) / math.sqrt(tie * n1 * n2 * (n + 1) / 12)
    return u, 0.5 * math.erfc(z / math.sqrt(2))


# -- hidden Markov model --
#: Places, with those that pad shorter profiles, which one batch of models takes at most; a profile that is longer is a batch.
HMM_PLACES = 1 << 17


def gaussian_hmm(y: np.ndarray, states: int, rounds: int = 100, tolerance: float = 1e-2) -> np.ndarray | None:
    """Most likely states of a Gaussian model with diagonal covariance fitted by EM; None if a state dies out.

    The start is the same every time: means at quantiles of the first column.
    """
    return gaussian_hmms([y], states, rounds, tolerance)[0]


def gaussian_hmms(profiles: Sequence[np.ndarray], states: int, rounds: int = 100, tolerance: float = 1e-2) -> list[np.ndarray | None]:
    """gaussian_hmm() of each profile. Profiles of like length are fitted together, place by place, each by itself."""
    ys = [np.asarray(y, float) for y in profiles]
    found: list[np.ndarray | None] = [None] * len(ys)
    fit = [i for i in sorted(range(len(ys)), key=lambda i: -len(ys[i])) if len(ys[i]) >= max(states, 1) and np.isfinite(ys[i]).all()]
    while fit:
        n = max(1, HMM_PLACES // len(ys[fit[0]]))
        for i, path in zip(fit[:n], _fitted([ys[i] for i in fit[:n]], states, rounds, tolerance), strict=True):
            found[i] = path
        fit = fit[n:]
    return found


def _fitted(ys: list[np.ndarray], states: int, rounds: int, tolerance: float) -> list[np.ndarray | None]:
    """Profiles of falling length; arrays have the profile last, so that a place of all profiles that reach it is one stretch."""
    size = np.array([len(y) for y in ys])
    longest, many, wide = size[0], len(ys), ys[0].shape[1]
    z, mean, var = np.zeros((longest, wide, many)), np.empty((states, wide, many)), np.empty((states, wide, many))
    for g, y in enumerate(ys):
        u = (y - y.mean(0)) / np.maximum(y.std(0), 1e-9)
        at = np.argsort(u[:, 0], kind="stable")[((np.arange(states) + 0.5) / states * len(u)).astype(int)]
        z[: len(u), :, g] = u
        mean[:, :, g] = u[at] + 1e-3 * np.arange(states)[:, None]
        var[:, :, g] = np.maximum(u.var(0), 1e-3)
    first, move = np.full((states, many), 1 / states), np.full((states, states, many), 0.1 / max(states - 1, 1))
    move[np.arange(states), np.arange(states)] = 0.9
    last = np.full(many, -np.inf)
    alive = np.ones(many, bool)
    log_bs, firsts, moves = np.zeros((longest, states, many)), first.copy(), move.copy()
    who = np.arange(many)  # the profiles that are still fitted
    for left in range(rounds, 0, -1):
        n, m = size[who], len(who)
        reach = np.searchsorted(-n, -np.arange(n[0]), side="left")  # profiles longer than each place
        inside = np.arange(n[0])[:, None] < n
        log_b = np.zeros((n[0], states, m))
        for d in range(wide):
            log_b += (z[:, None, d] - mean[:, d]) ** 2 / var[:, d]
        log_b = -0.5 * (log_b + np.log(var).sum(1))
        top = log_b.max(1)
        b = np.exp(log_b - top[:, None])
        a, c = np.zeros_like(b), np.ones((n[0], m))
        dead = np.zeros(m, bool)
        for t in range(n[0]):
            r = reach[t]
            now = (first if not t else np.einsum("sg,skg->kg", a[t - 1, :, :r], move[:, :, :r])) * b[t, :, :r]
            total = now.sum(0)
            if not total.all():
                dead[:r] |= total <= 0
                total[total <= 0] = 1
            c[t, :r] = total
            a[t, :, :r] = now / total
        back, ahead = np.ones_like(b), np.zeros_like(b)
        for t in range(n[0] - 2, -1, -1):
            r = reach[t + 1]
            ahead[t + 1, :, :r] = b[t + 1, :, :r] * back[t + 1, :, :r] / c[t + 1, :r]
            back[t, :, :r] = np.einsum("skg,kg->sg", move[:, :, :r], ahead[t + 1, :, :r])
        gamma = a * back
        gamma /= np.where(inside, gamma.sum(1), 1)[:, None]
        xi = move * np.einsum("tsg,tkg->skg", a[:-1], ahead[1:])
        weight, gone = gamma.sum(0), xi.sum(1)
        dead |= (weight < 1e-6).any(0) | (gone <= 0).any(0) | ~np.isfinite(weight).all(0)
        weight[:, dead], gone[:, dead] = 1, 1
        first, move = gamma[0], xi / gone[:, None]
        mean = np.einsum("tsg,tdg->sdg", gamma, z) / weight[:, None]
        var = np.maximum(np.einsum("tsg,tdg->sdg", gamma, z**2) / weight[:, None] - mean**2, 1e-3)
        likely = np.where(inside, np.log(c) + top, 0).sum(0)
        done = (likely - last < tolerance) | dead
        if left == 1:
            done[:] = True
        alive[who[dead]] = False
        ended = who[done]
        log_bs[: n[0], :, ended], firsts[:, ended], moves[:, :, ended] = log_b[:, :, done], first[:, done], move[:, :, done]
        if done.any():
            who, last = who[~done], likely[~done]
            if not len(who):
                break
            z = z[: size[who[0]]][:, :, ~done]
            first, move, mean, var = first[:, ~done], move[:, :, ~done], mean[:, :, ~done], var[:, :, ~done]
        else:
            last = likely
    return [p if ok else None for p, ok in zip(_likeliest(log_bs, firsts, moves, size), alive, strict=True)]


def _likeliest(log_b: np.ndarray, first: np.ndarray, move: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The most likely states of profiles of falling length."""
    longest, states, many = log_b.shape
    with np.errstate(divide="ignore", invalid="ignore"):
        log_move, score = np.log(move), np.log(first) + log_b[0]
    came = np.zeros((longest, states, many), np.int16)
    for t in range(1, longest):
        r = int(np.searchsorted(-size, -t, side="left"))
        step = score[:, None, :r] + log_move[:, :, :r]
        came[t, :, :r] = step.argmax(0)
        score[:, :r] = step.max(0) + log_b[t, :, :r]
    path = np.zeros((longest, many), np.int64)
    path[size - 1, np.arange(many)] = score.argmax(0)
    for t in range(longest - 1, 0, -1):
        r = int(np.searchsorted(-size, -t, side="left"))
        path[t - 1, :r] = came[t, path[t, :r], np.arange(r)]
    return [path[:n, g] for g, n in enumerate(size)]


# -- peaks of a curve --
def find_peaks(x: np.ndarray, prominence: float) -> list[int]:
    """Places of local maxima (the middle of a plateau) whose prominence suffices."""
    x = np.asarray(x, float)
    out, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                p = (i + j) // 2
                higher = np.flatnonzero(x[:p] > x[p])
                left = x[(higher[-1] if len(higher) else 0) : p + 1].min()
                higher = np.flatnonzero(x[p + 1 :] > x[p])
                right = x[p : (p + 1 + higher[0] if len(higher) else n)].min()
                if x[p] - max(left, right) >= prominence:
                    out.append(p)
            i = j
        i += 1
    return out


def peak_ranges(x: np.ndarray, prominence: float, window: int) -> list[tuple[int, int]]:
    """Ranges around prominent peaks, window each way but not past the neighbouring valleys; overlapping ones merge."""
    x = np.asarray(x, float)
    valleys = find_peaks(-x, prominence)
    found = []
    for p in find_peaks(x, prominence):
        left = max([v for v in valleys if v < p], default=0)
        right = min([v for v in valleys if v > p], default=len(x))
        found.append((max(p - window, left, 0), min(p + window, right, len(x))))
    return merge_ranges(found)


def merge_ranges(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def rolling_mean(x: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(np.asarray(x, float))])
    return (total[width:] - total[:-width]) / width if 0 < width <= len(x) else np.zeros(0)


# -- graphs --
def strong_components(nodes: Iterable[Hashable], out: dict) -> list[list]:
    """Strongly connected components, in reverse topological order; no recursion."""
    index: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    found = []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(out.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    found.append(sorted(part))
    return found


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in a cheapest one-to-one assignment (rows <= columns), by shortest augmenting paths."""
    cost = np.asarray(cost, float)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        dist, seen, before = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, np.int64)
        while True:
            seen[j0] = True
            now = cost[row_of[j0] - 1] - u[row_of[j0]] - v[1:]
            better = ~seen[1:] & (now < dist[1:])
            dist[1:][better] = now[better]
            before[1:][better] = j0
            j1 = int(np.where(seen[1:], np.inf, dist[1:]).argmin()) + 1
            step = dist[j1]
            u[row_of[seen]] += step
            v[seen] -= step
            dist[~seen] -= step
            j0 = j1
            if not row_of[j0]:
                break
        while j0:
            row_of[j0] = row_of[before[j0]]
            j0 = int(before[j0])
    out = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def complete_linkage(distance: np.ndarray, threshold: float) -> list[int]:
    """Cluster labels: the two nearest clusters merge while their farthest members are nearer than the threshold."""
    d = np.asarray(distance, float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    label = list(range(n))
    alive = list(range(n))
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(sub.argmin()), len(alive))
        if not sub[i, j] < threshold:
            break
        a, b = sorted((alive[i], alive[j]))
        d[a] = np.maximum(d[a], d[b])
        d[:, a] = d[a]
        d[a, a] = np.inf
        alive.remove(b)
        label = [a if x == b else x for x in label]
    return label
