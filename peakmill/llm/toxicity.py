"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Units are a text's distinct words, words freed of marks inside them, and runs
of single-character words read as one word ("i d i o t"). Two units are compared
by the gap-weighted subsequence kernel: ordered character triples within a
window of SPAN characters, each weighing DECAY to the power of the stretch it
spans, normalised, to the power SHARPNESS. Inserted characters and gaps only lengthen the stretch. A text's
likeness to a landmark is that of its units taken together (noisy or), and the
Nyström map turns the likenesses to all landmarks into features of a linear
squared-hinge SVM whose margin is calibrated to a probability.

The classifier is fitted on at most FIT_ROWS labelled documents (the ones with
the smallest hashes of their doc_id); whole texts are scored.

Defined results: null or empty text has no unit and gets the score of a text
that is unlike every landmark. A unit of fewer than three characters holds no
triple and is like nothing; one of more than LONG characters is taken as
overlapping windows of LONG. Without labels of both kinds the score is the
share of label 1 (0 with no labels). Rows with a null label or doc_id are not
learned from; of several texts with one labelled doc_id the first in order is,
and of several labels the larger. Equal rows are scored alike. Extra columns are
ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakmill.runtime import materialize

FIT_ROWS = 12_000
LANDMARKS = 64
#: Candidates for landmarks, those words that carry most.
TRIED = 512
#: Standard deviations by which a landmark and the words like it must stand out.
LEAST_GAIN = 5.5
DECAY = 0.7
SPAN = 7
SHARPNESS = 3
#: Kernel values below this count as none.
NEAR = 1e-4
LONG = 64
CACHE = 200_000
ROWS = 512
EDGE = ".,;:!?\"'()[]{}<>*#|&%$-_/\\~`"
THRESHOLD = 0.3


def windows(unit: str) -> list[str]:
    """The unit, or if it is long, windows of LONG characters of which each shares half with the next."""
    if len(unit) <= LONG:
        return [unit] if len(unit) >= 3 else []
    return [unit[at : at + LONG] for at in range(0, len(unit) - LONG // 2, LONG // 2)]


def units(text: str) -> set[str]:
    """Distinct lower-case words without edge punctuation, and joined runs of three or more single characters.

    Characters of a run are freed of edge marks as well ("i. d. i. o. t."), and words of marks alone don't end it.
    """
    words = text.lower().split()
    bare = {w: w.strip(EDGE) for w in set(words)}
    out = set(bare.values())
    out |= {"".join(filter(str.isalnum, w)) for w in out if not w.isalnum()}
    single = {w for w, b in bare.items() if len(b) == 1}
    if single:
        if "" in out:
            words = [w for w in words if bare[w]]
        # places of single characters; three or more in a row are a word
        at = [i for i, w in enumerate(words) if w in single]
        first = 0
        for j in range(1, len(at) + 1):
            if j == len(at) or at[j] != at[j - 1] + 1:
                if j - first >= 3:
                    out.add("".join(bare[words[i]] for i in at[first:j]))
                first = j
    return {w for unit in out for w in windows(unit)}


@lru_cache(LONG + 1)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all ordered triples within SPAN in a unit of n characters (LONG at most), and their weights."""
    at = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    at_ = np.array(at, np.int64).reshape(-1, 3)
    return at_, DECAY ** (at_[:, 2] - at_[:, 0] + 1.0)


def grouped(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Indices of words of equal length, and their code points."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, index in by.items():
        step = max(1, 400_000 // (n * SPAN * SPAN // 2 + 1))
        for at in range(0, len(index), step):
            part = index[at : at + step]
            flat = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield part, flat.reshape(len(part), n).astype(np.int64)


def triple_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the triples [word, triple] of words of one length, and the triples' weights."""
    at, weight = _triples(codes.shape[1])
    return (codes[:, at[:, 0]] << 42) | (codes[:, at[:, 1]] << 21) | codes[:, at[:, 2]], weight


def bloom_at(key: np.ndarray) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def triple_features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length: sorted triple codes a word, their weights, and the words' norms."""
    key, weight = triple_keys(codes)
    order = np.argsort(key, axis=1)
    key = np.take_along_axis(key, order, 1)
    w = weight[order]
    # the weights of one triple met several times add up
    new = np.ones(key.shape, bool)
    new[:, 1:] = key[:, 1:] != key[:, :-1]
    start = np.flatnonzero(new.ravel())
    total = np.add.reduceat(w.ravel(), start)
    row = start // key.shape[1]
    norm = np.sqrt(np.bincount(row, total**2, minlength=len(codes)))
    return key, w, norm


class Landmarks:
    """Landmark words as a sparse table: triple to the landmarks that hold it."""

    def __init__(self, words: list[str]):
        self.words = words
        table: dict[int, dict[int, float]] = {}
        for i, w in enumerate(words):
            for _, codes in grouped([w]):
                key, weight, norm = triple_features(codes)
                for k, v in zip(key[0].tolist(), weight[0].tolist(), strict=True):
                    row = table.setdefault(k, {})
                    row[i] = row.get(i, 0.0) + v / norm[0]
        self.key = np.array(sorted(table), np.int64)
        self.bloom = np.zeros(1 << 16, bool)
        self.bloom[bloom_at(self.key)] = True
        rows = [sorted(table[k].items()) for k in self.key.tolist()]
        self.start = np.cumsum([0, *map(len, rows)])
        self.owner = np.array([i for r in rows for i, _ in r], np.int64)
        self.weight = np.array([v for r in rows for _, v in r])

    def kernel(self, words: list[str]) -> np.ndarray:
        """[word, landmark] kernel values, 0 to 1; values under NEAR may be given as 0.

        A word's norm is at least that of its triples taken apart, so most
        words are ruled out before their triples need to be put together.
        """
        out = np.zeros((len(words), len(self.words)), np.float32)
        if not len(self.key):
            return out
        least = NEAR ** (1 / SHARPNESS)
        for index, codes in grouped(words):
            key, weight = triple_keys(codes)
            row, col = np.nonzero(self.bloom[bloom_at(key)])
            seen = key[row, col]
            at = np.minimum(np.searchsorted(self.key, seen), len(self.key) - 1)
            ok = self.key[at] == seen
            row, col, at = row[ok], col[ok], at[ok]
            if not len(row):
                continue
            # a triple is in one or two landmarks: sum its parts by word and landmark
            many = self.start[at + 1] - self.start[at]
            part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[at], many)
            cell = np.repeat(row, many) * len(self.words) + self.owner[part]
            dot = np.bincount(cell, np.repeat(weight[col], many) * self.weight[part], minlength=len(index) * len(self.words))
            dot = dot.reshape(len(index), len(self.words))
            who = np.flatnonzero(dot.max(1) > least * np.sqrt((weight**2).sum()))
            if len(who):
                norm = triple_features(codes[who])[2]
                out[np.array(index)[who]] = dot[who] / norm[:, None]
        return np.minimum(out, 1) ** SHARPNESS


@dataclass
class Model:
    """Landmarks, Nyström map, weights and calibration; a constant score where there was nothing to learn."""

    landmarks: Landmarks | None = None
    root: np.ndarray | None = None
    weights: np.ndarray | None = None
    slope: float = 0.0
    shift: float = 0.0
    constant: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


_held: dict[str, tuple[dict[str, int], np.ndarray, int]] = {}


def likenesses(landmarks: Landmarks, key: str, texts: list[str | None]) -> np.ndarray:
    """[text, landmark]: 1 minus the product over units of 1 minus the kernel."""
    if key not in _held:
        _held.clear()
        # row 0 stays zero: what is like no landmark
        _held[key] = ({}, np.zeros((1024, len(landmarks.words)), np.float32), 1)
    place, rows, used = _held[key]
    found = [units(t) if t else set() for t in texts]
    new = list(set().union(*found).difference(place)) if found else []
    if len(place) + len(new) > CACHE:
        place.clear()
        used = 1
        new = list(set().union(*found))
    if new:
        k = landmarks.kernel(new)
        near = k.max(1) > NEAR
        need = used + int(near.sum())
        if need > len(rows):
            rows = np.concatenate([rows, np.zeros((need, rows.shape[1]), np.float32)])
        place.update(zip(new, np.where(near, used + np.cumsum(near) - 1, 0).tolist(), strict=True))
        rows[used:need] = np.log1p(-np.minimum(k[near], 0.999))
        _held[key] = (place, rows, need)
    out = np.zeros((len(texts), rows.shape[1]))
    for i, u in enumerate(found):
        at = [r for r in map(place.__getitem__, u) if r]
        if at:
            out[i] = rows[at].sum(0)
    return 1 - np.exp(out)


def choose_landmarks(words: list[str], gain: np.ndarray, count: int) -> list[str]:
    """Greedy cover: each next landmark is the word whose likeness carries most of the gain not yet covered.

    A family of like words counts together. Words are compared a hundred at a
    time; the TRIED words that carry most are the candidates.
    """
    if not words:
        return []
    carried = np.zeros(len(words))
    for at in range(0, len(words), 100):
        carried[at : at + 100] = gain @ Landmarks(words[at : at + 100]).kernel(words)
    tried = np.argsort(-carried, kind="stable")[:TRIED]
    k = np.concatenate([Landmarks([words[i] for i in tried[at : at + 100]]).kernel(words) for at in range(0, len(tried), 100)], 1)
    left = gain.astype(float)
    chosen: list[int] = []
    for _ in range(min(count, len(tried))):
        value = left @ k
        value[chosen] = -1
        best = int(value.argmax())
        if value[best] < LEAST_GAIN:
            break
        chosen.append(best)
        left *= 1 - k[:, best]
    return [words[tried[i]] for i in chosen]


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Squared-hinge linear SVM by Newton steps; the last weight is the bias. Label 1 weighs up to its share."""
    x = np.append(x, np.ones((len(x), 1)), 1)
    sign = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) / len(y)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-9
    for _ in range(rounds):
        on = sign * (x @ w) < 1
        a = x[on] * cost[on, None]
        new = np.linalg.solve(np.diag(penalty) + a.T @ x[on], a.T @ sign[on])
        if np.abs(new - w).max() < 1e-9:
            break
        w = 0.5 * w + 0.5 * new if np.abs(new - w).max() > 10 else new
    return w


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins, by damped Newton steps."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * margin**2).sum(), (r * margin).sum()], [(r * margin).sum(), r.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def held_out(docs: DataFrame) -> DataFrame:
    """docs with held_out: crc32 of the doc_id's text leaves 2 when divided by 4 (a null doc_id counts as empty text)."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """From at most fit_rows rows of labels(doc_id, toxic) that are not held out, and their texts."""
    known = held_out(labels.select("doc_id", "toxic")).where("not held_out and toxic is not null and doc_id is not null")
    picked = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    # at most fit_rows ids
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = materialize(sample.select("text", "toxic"), "toxic")
    n, ones = sample.agg(F.count("toxic"), F.coalesce(F.sum("toxic"), F.lit(0))).collect()[0]
    if not n or not ones or ones == n:
        return Model(constant=float(ones / n) if n else 0.0)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                found = [sorted(units(t)) for t in part.column("text").to_pylist()]
                toxic = np.repeat(part.column("toxic").to_numpy(), [len(u) for u in found])
                yield pa.RecordBatch.from_arrays([pa.array([w for u in found for w in u], pa.string()), pa.array(toxic, pa.int32())], ["word", "toxic"])

    # gain of a word: by how many standard deviations label 1 is more frequent among its texts than overall
    share = ones / n
    counts = sample.select("text", "toxic").mapInArrow(explode, "word string, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("k"), F.count("toxic").alias("c")
    )
    gain = (F.col("k") - share * F.col("c")) / F.sqrt(F.col("c") * share * (1 - share))
    top = counts.where("k > 1").withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN / 2).orderBy(F.desc("gain"), "word").collect()  # words of at most fit_rows texts
    words = choose_landmarks([r["word"] for r in top], np.array([r["gain"] for r in top]), LANDMARKS)
    if not words:
        return Model(constant=share)
    landmarks, key = Landmarks(words), uuid.uuid4().hex
    held = docs.sparkSession.sparkContext.broadcast((landmarks, key))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x = likenesses(*held.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.select("toxic", "text").mapInArrow(featurise, "toxic int, x array<double>").toArrow()  # at most fit_rows
    x = np.stack(rows.column("x").combine_chunks().values.to_numpy().reshape(-1, len(words)))
    y = rows.column("toxic").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    k = landmarks.kernel(words).astype(float)
    value, vector = np.linalg.eigh((k + k.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 0.05)) @ vector.T
    weights = fit_svm(x @ root, y)
    margin = np.append(x @ root, np.ones((len(x), 1)), 1) @ weights
    slope, shift = calibrate(margin, y)
    return Model(landmarks, root, weights, slope, shift)


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    if model.landmarks is None:
        return np.full(len(texts), model.constant)
    x = likenesses(model.landmarks, model.key, texts) @ model.root
    margin = x @ model.weights[:-1] + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text); scores see the text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                s = score_texts(held.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return held_out(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )
