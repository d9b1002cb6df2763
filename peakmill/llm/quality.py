"""Quality rules as weak supervision.

Every rule votes good (+1), bad (-1) or abstains (0) on a text. Expectation
maximisation over the counts of vote patterns estimates how each rule votes on
good and on bad texts, without labels; a text's verdict is the posterior
probability that it is good given all its votes.

Statistics cover all texts: the only thing gathered is a count for each
distinct vote pattern, at most 3 ** len(RULES) rows whatever the input's size.

Null text counts as a text without words. Any further columns pass through
``filter_quality`` untouched; work columns are never added to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakmill.llm.words import U, Texts, chain, filtered, mix, slices
from peakmill.runtime import materialize

SYMBOLS = b"#*$%&|<>"
#: name: (feature, good from, good to, bad below, bad above, words needed to vote)
RULES: dict[str, tuple[str, float, float, float, float, int]] = {
    "length": ("n_words", 40, np.inf, 10, np.inf, 0),
    "symbols": ("symbols_per_word", 0, 0.05, -1, 0.2, 5),
    "capitals": ("capital_share", 0, 0.3, -1, 0.6, 5),
    "repeats": ("repeat_share", 0, 0.1, -1, 0.2, 10),
    "lines": ("dup_line_share", 0, 0.1, -1, 0.3, 10),
    "word_size": ("mean_word", 3, 9, 2.2, 14, 5),
    "shouting": ("bangs_per_word", 0, 0.05, -1, 0.3, 5),
    "variety": ("distinct_share", 0.4, 1.01, 0.2, 2, 50),
    "marked": ("marked_share", 0, 0.1, -1, 0.3, 5),
    "letters": ("letter_share", 0.85, 1, 0.75, 2, 5),
    "sentences": ("stop_share", 0.01, 0.4, 0.004, 0.6, 60),
}
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def features(t: Texts) -> dict[str, np.ndarray]:
    """Per text: the base counts and the shares that the rules look at."""
    b = t.buf
    n_words = np.diff(t.first)
    inside = np.zeros(len(b) + 1, np.int8)
    inside[t.start] += 1
    inside[t.end[t.end < len(b) + 1]] -= 1
    inside = np.cumsum(inside[:-1]).astype(bool)
    lead = (b & 0xC0) != 0x80
    word_chars = t.sums(inside & lead)
    upper = t.sums((b >= 65) & (b <= 90))
    lower = t.sums((b >= 97) & (b <= 122))
    h = t.word_hashes(False)

    # repeated 5-word windows
    at = np.arange(max(len(h) - 4, 0))
    at = at[t.doc[at] == t.doc[at + 4]] if len(at) else at
    win = chain(h, at, 5)
    key = mix(win + t.doc[at].astype(U) * U(0x9E3779B97F4A7C15)) if len(at) else win
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[inverse] >= 2] if len(at) else at
    cover = np.zeros(len(h) + 6, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    covered = np.cumsum(cover)[: len(h)] > 0
    n_repeat = np.bincount(t.doc[covered], minlength=t.n) if len(h) else np.zeros(t.n, np.int64)
    seen = mix(h + t.doc.astype(U) * U(0x9E3779B97F4A7C15)) if len(h) else h
    _, once = np.unique(seen, return_index=True)
    n_distinct = np.bincount(t.doc[once], minlength=t.n) if len(h) else np.zeros(t.n, np.int64)

    # lines: cut at \n and at the texts' ends
    nl = np.flatnonzero(b == 10)
    full = t.off[:-1] < t.off[1:]
    start = np.unique(np.concatenate([t.off[:-1][full], nl + 1]))
    start = start[start < len(b)]
    doc = np.searchsorted(t.off, start, "right") - 1
    stop = t.off[doc + 1] if len(start) else start
    nxt = np.searchsorted(nl, start)
    end = np.minimum(np.append(nl, len(b))[nxt], stop) if len(start) else start
    has = np.searchsorted(t.start, end) > np.searchsorted(t.start, start)
    start, end, doc = start[has], end[has], doc[has]
    line = Texts.hashes(b, start, end) if len(start) else np.zeros(0, U)
    lkey = mix(line + doc.astype(U) * U(0x9E3779B97F4A7C15)) if len(line) else line
    n_lines = np.bincount(doc, minlength=t.n)
    _, first = np.unique(lkey, return_index=True)
    n_dup = n_lines - np.bincount(doc[first], minlength=t.n)

    stops = np.bincount(t.doc[_STOP[b[t.end - 1]]], minlength=t.n) if len(h) else np.zeros(t.n, np.int64)
    # words that hold a symbol or no letter or digit; bytes beyond ASCII count as letters
    letter = ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)
    digit = (b >= 48) & (b <= 57)
    n_marks, n_alnum = np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64)
    np.cumsum(_SYMBOL[b], out=n_marks[1:])
    np.cumsum(letter | digit, out=n_alnum[1:])
    odd = (n_marks[t.end] > n_marks[t.start]) | (n_alnum[t.end] == n_alnum[t.start])
    n_marked = np.bincount(t.doc[odd], minlength=t.n) if len(h) else np.zeros(t.n, np.int64)
    w = np.maximum(n_words, 1)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": t.sums(_SYMBOL[b]),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "symbols_per_word": t.sums(_SYMBOL[b]) / w,
        "capital_share": upper / np.maximum(upper + lower, 1),
        "repeat_share": n_repeat / w,
        "dup_line_share": n_dup / np.maximum(n_lines, 1),
        "mean_word": word_chars / w,
        "bangs_per_word": t.sums(b == 33) / w,
        "distinct_share": n_distinct / w,
        "stop_share": stops / w,
        "marked_share": n_marked / w,
        "letter_share": t.sums(letter & inside & lead) / np.maximum(word_chars, 1),
    }


def votes(f: dict[str, np.ndarray]) -> np.ndarray:
    """The vote pattern of each text: one base-3 digit a rule (0 abstain, 1 bad, 2 good)."""
    code = np.zeros(len(f["n_words"]), np.int64)
    for name, lo, hi, below, above, need in RULES.values():
        x = f[name]
        v = np.where((x >= lo) & (x <= hi), 2, np.where((x < below) | (x > above), 1, 0))
        code = code * 3 + np.where(f["n_words"] >= need, v, 0)
    return code


def digits(codes: np.ndarray) -> np.ndarray:
    n = len(RULES)
    return (codes[:, None] // 3 ** np.arange(n - 1, -1, -1)) % 3


def base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def fit_em(
    codes: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.85, strength: float = 0.1
) -> dict[int, float]:
    """Posterior of good for each vote pattern, by maximum-a-posteriori EM.

    Per rule two rates are estimated: how often it votes bad on bad texts and
    on good ones, among texts on which it votes at all; an abstention says
    nothing. Rules only vote bad beyond a wide margin, so the rates' priors
    (0.4 on bad texts, 0.02 on good ones, weighing ``strength`` of all texts)
    keep the two classes from trading places.
    """
    if not len(codes):
        return {}
    v = digits(codes)
    bad, good = (v == 1).astype(float), (v == 2).astype(float)
    total = counts.sum()
    start = np.array([[0.4], [0.02]])
    rate = np.tile(start, (1, v.shape[1]))  # [class, rule], class 1 is good
    pi, post = prior, np.full(len(codes), prior)
    for _ in range(rounds):
        like = [bad @ np.log(rate[c]) + good @ np.log1p(-rate[c]) for c in (0, 1)]
        odds = like[0] - like[1] + np.log((1 - pi) / pi)
        new = 1 / (1 + np.exp(np.clip(odds, -700, 700)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
        weight = np.stack([counts * (1 - post), counts * post])
        extra = strength * total * np.array([[1 - prior], [prior]])
        rate = (weight @ bad + extra * start) / (weight @ (bad + good) + extra)
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        pi = (counts @ post + strength * total * prior) / (total * (1 + strength))
    return dict(zip(codes.tolist(), post.tolist(), strict=True))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, t in slices(batch.column("text")):
            f = features(t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo)]
                + [pa.array(f[c].astype(np.int64)) for c in BASE_COLUMNS]
                + [pa.array(base_failed(f)), pa.array(votes(f))],
                ["doc_id", *BASE_COLUMNS, "base_failed", "votes"],
            )


def quality_features(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed and votes for every row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in BASE_COLUMNS)}, base_failed boolean, votes bigint"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_score, schema)


def learn_posteriors(scored: DataFrame) -> dict[int, float]:
    """EM over all rows of quality_features(); at most 3 ** len(RULES) rows reach the driver."""
    seen = scored.groupBy("votes").count().orderBy("votes").collect()
    return fit_em(np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], float))


def quality_verdicts(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """quality_features() plus posterior and kept; the texts are read once."""
    spark = docs.sparkSession
    scored = materialize(quality_features(docs), "quality")
    post = learn_posteriors(scored)
    table = spark.createDataFrame([(k, float(v)) for k, v in post.items()], "votes bigint, posterior double")
    return (
        scored.join(F.broadcast(table), "votes", "left")  # at most 3 ** len(RULES) rows
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
        .select("doc_id", *BASE_COLUMNS, "base_failed", "kept", "posterior", "votes")
    )


def filter_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, all their columns as they are.

    Two passes over the texts, no shuffle of them: the first counts vote
    patterns, the second applies the posteriors.
    """
    post = learn_posteriors(quality_features(docs))
    good = np.array(sorted(k for k, v in post.items() if v >= threshold), np.int64)

    def keep(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, _, t in slices(texts):
            f = features(t)
            yield np.isin(votes(f), good) & ~base_failed(f)

    return filtered(docs, keep)
