"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a fixed public one. For every language a probability of each
piece is learned; a text's likelihood sums, by a forward algorithm, over all
ways to cut each of its words into pieces. Pieces never cross white space, so a
text's likelihood is the product over its words, and each distinct word is
scored once while it stays in a worker's bounded cache. Words of more than
SCORE_WORD characters are scored in parts of that many.

Learning gathers expected piece counts (forward-backward under a rank prior)
from every training row; what reaches the driver is one number for each
language and piece, whatever the number of rows. Both passes are rescaled as
they go, so that long runs of characters that no piece knows don't vanish.

Defined results: null text or text without a letter is ``und`` with score 0,
and so is every text when there is nothing to learn from. Scores are finite
and lie in 0 to 1 for any text. Ties go to the
language that sorts first. Rows with null lang are not learned from; equal rows
count each. Texts of any length are scored whole; an empty table gives an empty
one. Extra columns are ignored (and kept by ``filter_language``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakmill.llm.words import Slots, Texts, chunks, filtered, mix

U = np.uint64
LETTER = re.compile(r"[^\W\d_]")
MARK = "▁"
#: Bytes of word scores that a worker keeps.
CACHE_BYTES = 1 << 24
SLOT_BITS = 19
#: Words counted before their expected pieces are worked out.
TALLY = 200_000
GROUP = 4096
#: Numbers in one array of the forward algorithm, about.
CELLS = 1 << 19
ROWS = 512
#: Bytes of text that are looked up together.
CHUNK = 1 << 19
#: Longer words are learned from, and scored, in parts.
LEARN_WORD, SCORE_WORD = 64, 512
_MUL = U(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model by id; control and byte pieces are empty strings, 0 is unknown."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        "" if i == sp.unk_id() or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i) else sp.id_to_piece(i)
        for i in range(sp.get_piece_size())
    ]


def codes_of(words: list[str], width: int) -> np.ndarray:
    """Code points, one row a word, padded with 0."""
    out = np.zeros((len(words), width), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


class Lattice:
    """Finds the vocabulary's pieces at all places of many words at once."""

    BITS = 20

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        found: dict[int, int] = {}
        for i, p in enumerate(pieces):
            if p:
                h = 0
                for ch in p:
                    h = (h * int(_MUL) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
                found.setdefault(h, i)
        self.hash = np.array(sorted(found), U)
        self.id = np.array([found[int(h)] for h in self.hash], np.int64)
        # a slot by the hash's bits: where its piece stands in self.hash, -1 for none, -2 for several
        slot = self.slot_of(self.hash)
        self.slot = np.full(1 << self.BITS, -1, np.int32)
        self.slot[slot] = np.arange(len(slot))
        self.slot[np.bincount(slot, minlength=1 << self.BITS) > 1] = -2

    def slot_of(self, h: np.ndarray) -> np.ndarray:
        return ((h * U(0xD6E8FEB86659FD93)) >> U(64 - self.BITS)).astype(np.int64)

    def arcs(self, codes: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """For each end position: (start, words, piece ids) of the pieces that end there, by start.

        codes: [position, word]. A character that is no piece is the unknown piece 0.
        """
        h: list[np.ndarray] = []
        for end in range(1, len(codes) + 1):
            c = codes[end - 1].astype(U) + U(1)
            h = [c, *(x * _MUL + c for x in h[: self.longest - 1])]
            out = []
            for j, x in enumerate(h):
                at = self.slot[self.slot_of(x)]
                rows = np.flatnonzero(at != -1)
                seen, at = x[rows], at[rows]
                several = np.flatnonzero(at == -2)
                if len(several):
                    at[several] = np.minimum(np.searchsorted(self.hash, seen[several]), len(self.hash) - 1)
                ok = self.hash[at] == seen
                rows, ids = rows[ok], self.id[at[ok]]
                if j == 0 and len(rows) < len(x):
                    every = np.zeros(len(x), np.int64)
                    every[rows] = ids
                    rows, ids = np.arange(len(x)), every
                if len(rows):
                    out.append((end - 1 - j, rows, ids))
            yield end, out


def in_groups(words: list[str], wide: int = 1) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(numbers of the words, their lengths, codes [position, word]) in groups of like length, of bounded size.

    wide: numbers held for each position of a word.
    """
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        width = len(words[order[min(at + GROUP, len(order)) - 1]])
        take = max(1, min(GROUP, CELLS // max(1, width * wide)))
        group = order[at : at + take]
        at += take
        size = np.fromiter((len(words[i]) for i in group), np.int64, len(group))
        yield group, size, np.ascontiguousarray(codes_of([words[i] for i in group], int(size.max())).T)


def in_parts(words: list[str], longest: int) -> tuple[list[str], np.ndarray]:
    """The words, those of more than ``longest`` characters cut, and the number of the word that each part is of."""
    if all(len(w) <= longest for w in words):
        return words, np.arange(len(words))
    parts = [(i, w[at : at + longest]) for i, w in enumerate(words) for at in range(0, max(len(w), 1), longest)]
    return [p for _, p in parts], np.array([i for i, _ in parts])


def scored(lattice: Lattice, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probabilities [word, language] over all segmentations.

    prob: [piece, language], with a last row of zeros.
    """
    parts, of = in_parts(words, SCORE_WORD)
    k = prob.shape[1]
    out = np.zeros((len(words), k))
    for group, size, codes in in_groups(parts, k):
        width, n = codes.shape
        ahead = np.zeros((width + 1, n, k))
        ahead[0] = 1
        scale, final = np.zeros((n, k)), np.zeros((n, k))
        for end, found in lattice.arcs(codes):
            now = ahead[end]
            for start, on, ids in found:
                now[on] += ahead[start][on] * prob[ids]
            done = np.flatnonzero(size == end)
            if len(done):
                final[done] = np.log(now[done]) + scale[done]
            if width > 16 and end % 8 == 0:
                scale += np.log(rescale(ahead[max(0, end + 1 - lattice.longest) : end + 1]))
        np.add.at(out, of[group], final)
    return out


def rescale(window: np.ndarray) -> np.ndarray:
    """Divide a window of positions by its maximum for each word; returns that."""
    most = window.max(0)
    most[most <= 0] = 1
    window /= most
    return most


def expected_counts(lattice: Lattice, prior: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Each piece's expected count over all segmentations of the words, times the words' weights."""
    out = np.zeros(lattice.size + 1)
    for group, size, codes in in_groups(words):
        width, n = codes.shape
        arcs = list(lattice.arcs(codes))
        every = np.arange(n)
        a, log_a = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        a[0] = 1
        for end, found in arcs:
            log_a[end] = log_a[end - 1]
            for start, on, ids in found:
                a[end, on] += a[start, on] * prior[ids]
            if end % 8 == 0:
                window = slice(max(0, end + 1 - lattice.longest), end + 1)
                log_a[window] += np.log(rescale(a[window]))
        whole, log_whole = a[size, every], log_a[size, every]
        # relative to the whole word's probability; past a word's end nothing counts
        log_a = np.where(np.arange(width + 1)[:, None] <= size, log_a - log_whole, 0)
        b, log_b = np.zeros((width + 1, n)), np.zeros(n)
        b[size, every] = weights[group] / whole
        for end, found in reversed(arcs):
            for start, on, ids in found:
                arc = prior[ids] * b[end, on]
                b[start, on] += arc
                out += np.bincount(ids, a[start, on] * arc * np.exp(log_a[start, on] + log_b[on]), minlength=len(out))
            if end % 8 == 0:
                log_b += np.log(rescale(b[max(0, end - lattice.longest) : end]))
    return out[:-1]


def lowered(texts: pa.Array, which: np.ndarray | None = None) -> pa.Array:
    """Lower-case texts, those that ``which`` leaves out empty."""
    values = texts.to_pylist()
    return pa.array([t.lower() if t and (which is None or which[i]) else "" for i, t in enumerate(values)], pa.large_string())


def spelled(t: Texts, which: np.ndarray) -> list[str]:
    """The words of that number; a word may hold white space beyond ASCII."""
    raw = t.buf.tobytes()
    return [raw[a:b].decode() for a, b in zip(t.start[which].tolist(), t.end[which].tolist(), strict=True)]


def rank_prior(size: int) -> np.ndarray:
    """Pieces by id are ordered by how early they were merged; 1 / (rank + 50), summing to 1, then a zero."""
    p = 1 / (np.arange(size) + 50.0)
    p[0] = 1e-7
    return np.append(p / p.sum(), 0)


class Model:
    """Piece probabilities of each language, sent to workers as arrays."""

    def __init__(self, pieces: list[str], langs: list[str], counts: np.ndarray, smooth: float = 1.0):
        self.key = uuid.uuid4().hex
        self.pieces, self.langs = pieces, langs
        background = counts.sum(0) + 0.1
        background /= background.sum()
        background[0] = max(background[0], 1e-6)
        # one text's worth of the background keeps every piece possible everywhere
        total = counts.sum(1, keepdims=True)
        prob = (counts + smooth * len(pieces) * 0.05 * background) / (total + smooth * len(pieces) * 0.05)
        prob[:, 0] = 1e-6
        self.prob = np.append(prob.T, np.zeros((1, len(langs))), 0)


class Cache:
    """A worker's scores of words, in bounded memory."""

    def __init__(self, model: Model):
        self.lattice, self.prob = Lattice(model.pieces), model.prob
        self.slots = Slots(SLOT_BITS)
        self.rows = np.zeros((min(1 << SLOT_BITS, max(1024, CACHE_BYTES // (8 * len(model.langs)))), len(model.langs)))
        self.used = 0

    def scores(self, t: Texts) -> np.ndarray:
        """[word, language]"""
        h = t.word_hashes(False)
        at, miss, new, back = self.slots.look(h)
        values = self.rows[at]
        if len(new):
            parts = [[MARK + x for x in w.split()] for w in spelled(t, new)]
            of = np.repeat(np.arange(len(new)), [len(x) for x in parts])
            made = np.zeros((len(new), values.shape[1]))
            np.add.at(made, of, scored(self.lattice, self.prob, [x for p in parts for x in p]))
            values[miss] = made[back]
            if self.used + len(new) > len(self.rows):
                self.slots.clear()
                self.used = 0
            if len(new) <= len(self.rows):
                self.rows[self.used : self.used + len(new)] = made
                self.slots.put(h[new], np.arange(self.used, self.used + len(new)))
                self.used += len(new)
        return values


_held: dict[str, Cache] = {}


def predict(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and posterior of each text."""
    known = np.array([t is not None and bool(model.langs) and bool(LETTER.search(t)) for t in texts.to_pylist()], bool)
    if model.key not in _held:
        _held.clear()
        if model.langs:
            _held[model.key] = Cache(model)
    total = np.zeros((len(texts), max(1, len(model.langs))))
    if known.any():
        for i, t in chunks(lowered(texts, known), CHUNK):
            if len(t.start):
                some = np.flatnonzero(t.first[1:] > t.first[:-1])
                total[i + some] += np.add.reduceat(_held[model.key].scores(t), t.first[some], axis=0)
    best = total.argmax(1)
    score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    langs = [model.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
    return langs, np.where(known, score, 0.0).tolist()


def learn(training: DataFrame, pieces: list[str]) -> Model:
    """From all rows of training(text, lang) with neither null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, prior = Lattice(pieces), rank_prior(len(pieces))
        langs: dict[str, int] = {}
        slots = Slots(SLOT_BITS)
        words: list[str] = []
        owner: list[np.ndarray] = []
        count = np.zeros(TALLY * 2)

        def flush() -> Iterator[pa.RecordBatch]:
            of, names = np.concatenate(owner), list(langs)
            order = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[order], np.arange(len(names) + 1))
            for i, x in enumerate(names):
                own = order[bounds[i] : bounds[i + 1]]
                parts = [(p, n) for n in own.tolist() for w in words[n].split() for p in in_parts([MARK + w], LEARN_WORD)[0]]
                if parts:
                    c = expected_counts(lattice, prior, [p for p, _ in parts], count[[n for _, n in parts]])
                    on = np.flatnonzero(c)
                    yield pa.RecordBatch.from_arrays([pa.array([x] * len(on), pa.string()), pa.array(on, pa.int32()), pa.array(c[on])], ["lang", "piece", "c"])
            slots.clear()
            langs.clear()
            words.clear()
            owner.clear()
            count[:] = 0

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                b = batch.slice(lo, ROWS)
                names = b.column("lang").to_pylist()
                for i, t in chunks(lowered(b.column("text")), CHUNK):
                    of_text = np.array([langs.setdefault(x, len(langs)) for x in names[i : i + t.n]])
                    # a word counts by language
                    of = of_text[t.doc]
                    h = mix(t.word_hashes(False) + U(1) + of.astype(U))
                    at, miss, new, back = slots.look(h)
                    at[miss] = len(words) + back
                    if len(new):
                        slots.put(h[new], np.arange(len(words), len(words) + len(new)))
                        words += spelled(t, new)
                        owner.append(of[new])
                    if len(words) > len(count):
                        count = np.concatenate([count, np.zeros(len(words))])
                    count[: len(words)] += np.bincount(at, minlength=len(words))
                    if len(words) > TALLY:
                        yield from flush()
        if words:
            yield from flush()

    rows = (
        training.select("text", F.col("lang").cast("string").alias("lang"))
        .where("text is not null and lang is not null")
        .mapInArrow(run, "lang string, piece int, c double")
        .groupBy("lang", "piece")
        .agg(F.sum("c").alias("c"))
        .toPandas()  # a row for each language and piece seen in it
    )
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), len(pieces)))
    counts[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), rows["piece"].to_numpy(np.int64)] = rows["c"].round(4)
    if not np.isfinite(counts).all():
        raise ArithmeticError("expected counts of pieces are not finite")
    return Model(pieces, langs, counts)


def held_out(docs: DataFrame) -> DataFrame:
    """docs with held_out: crc32 of the doc_id's text is divisible by 5 (a null doc_id counts as empty text)."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0)


def train(docs: DataFrame, vocab_path: str) -> Model:
    """From the rows of docs(doc_id, text, lang) that are not held out."""
    return learn(held_out(docs.select("doc_id", "text", "lang")).where("not held_out"), vocabulary(vocab_path))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text); predictions see the text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                langs, scores = predict(held.value, b.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return held_out(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def filter_language(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs with an identified language of at least that posterior; all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: pa.Array) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), ROWS):
            langs, scores = predict(held.value, texts.slice(at, ROWS))
            yield np.array([x != "und" and s >= least for x, s in zip(langs, scores, strict=True)], bool)

    return filtered(docs, keep)
