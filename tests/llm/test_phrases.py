"""Collocations, decontamination and fill-in-the-middle against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakmill.llm import collocations, decontaminate, infill

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- collocations --
def brute_counts(rows, most):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    return f, n


def brute_collocations(rows, most=3, least=10, top=2000, cover=50):
    f, n = brute_counts(rows, most)
    often = {k: a for k, a in f.items() if a >= least}
    over = defaultdict(int)
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                over[lang, p[i : i + m]] = max(over[lang, p[i : i + m]], a)
    by = defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) < 2 or 100 * over[lang, p] >= cover * a:
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        by[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in by.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


def prose(seed, n=60):
    rng = random.Random(seed)
    vocab = ["Der", "die", "über", "naïve", "x", "y", "z", "rot", "blau", "ab-c", "#", "\xa0"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += ["new", "york", "city"] if rng.random() < 0.1 else ["ice", "cream"] if rng.random() < 0.1 else [rng.choice(vocab)]
            if rng.random() < 0.15:
                words[-1] += rng.choice([".", ", ", "\n", "!?", "\t", "\r\n"])
        rows.append((" ".join(words), rng.choice(["en", "de", None, "und", ""])))
    return [*rows, (None, "en"), ("", None), ("x y z " * 700, "en"), *[("one and the same line", "fr")] * 12]


@pytest.mark.parametrize(("most", "shard"), [(3, 8 << 20), (3, 200), (4, 900), (2, 500)])
def test_collocations(spark, monkeypatch, most, shard):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    rows = prose(most)
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3), most, 10, 15)
    assert {tuple(r) for r in got.collect()} == brute_collocations(rows, most, 10, 15)


def test_collocations_of_odd_rows(odd, none):
    assert collocations.collocations(none).count() == 0
    want = brute_collocations([(r.text, r.lang) for r in odd.collect()], 3, 3)
    assert {tuple(r) for r in collocations.collocations(odd, least=3).collect()} == want


def test_suffix_array_and_intervals():
    rng = random.Random(4)
    for _ in range(60):
        rows = ["".join(rng.choice(["a ", "b ", "cc ", ". ", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        data = [r.encode() for r in rows if r]
        off = np.cumsum([0, *map(len, data)])
        shard = collocations.Shard(np.frombuffer(b"".join(data), np.uint8), off, pa.array(["en"] * len(data), pa.string()))
        seq, depth = shard.seq, rng.randint(1, 6)
        if not len(seq):
            continue
        order, lcp = collocations.suffix_array(seq, depth)
        cut = [tuple(seq[i : i + depth]) for i in order]
        padded = [x + (0,) * (depth - len(x)) for x in cut]
        assert padded == sorted(padded)
        f, _ = brute_counts([(r, "en") for r in rows], depth)
        got = {}
        for n, places, counts in collocations.interval_counts(shard, range(1, depth + 1)):
            for key, c in zip(collocations.phrases_at(shard, places, n).to_pylist(), counts.tolist(), strict=True):
                assert key not in got
                got[key] = c
        assert got == {" ".join(p) + "\t" + lang: c for (lang, p), c in f.items()}


# -- decontamination --
def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def brute_contaminated(docs, items):
    windows = defaultdict(set)
    for ident, text in items:
        w = words(text)
        m = min(len(w), 10)
        for i in range(len(w) - m + 1) if w else ():
            windows[tuple(w[i : i + m])].add(ident)
    out = Counter()
    for ident, text in docs:
        w, hit, named = words(text), set(), set()
        for m in range(1, 11):
            for i in range(len(w) - m + 1):
                if found := windows.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    named |= found
        names = ",".join(sorted(str(x) for x in named if x is not None))
        out[ident, len(w), len(hit), len({x for x in named if x is not None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)] += 1
    return out


def passages(seed):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "été", "x1", "Ä", *("w%d" % i for i in range(30))]
    text = lambda n: rng.choice([" ", ", ", "--"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 25]))) for i in range(25)] + [(3, text(12)), (None, text(15)), (77, None), (78, "!!"), (79, "the the the the the the the the the the the the")]
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 60))
        if rng.random() < 0.7:
            w = re.split(r"(?<=\W)", rng.choice(items)[1] or "")
            cut = rng.randint(0, 3)
            t = t + " " + "".join(w[cut : len(w) - rng.randint(0, 2)]) + " " + text(5)
        docs.append((i, t))
    return [*docs, (5, docs[5][1]), (5, docs[9][1]), (None, docs[7][1]), (None, docs[7][1]), (100, "the " * 5000), (101, None)], items


@pytest.mark.parametrize("small", [100_000, 0])
def test_decontamination(spark, monkeypatch, small):
    monkeypatch.setattr(decontaminate, "SMALL", small)
    docs, items = passages(small)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontaminate.contaminated(spark, d, b).collect()) == brute_contaminated(docs, items)


def test_decontamination_of_odd_rows(spark, odd, none):
    items = [(1, "and nobody minds it at all today the same text"), (2, "twice and nobody minds it at all"), (2, "LONG long")]
    b = spark.createDataFrame([(i, t, 1.0, "x") for i, t in items], "item_id long, text string, pos double, term string")
    got = Counter(tuple(r) for r in decontaminate.contaminated(spark, odd, b).collect())
    assert got == brute_contaminated([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], items)
    assert decontaminate.contaminated(spark, none, b).count() == 0
    assert {r.contaminated for r in decontaminate.contaminated(spark, odd, b.limit(0)).collect()} == {False}


def test_near_matches(spark):
    docs = [(1, "a b c d e f"), (2, "a b x c d y e f"), (3, "a b x x x c d e f"), (4, "f e d c b a"), (5, "z a b c d e x f z a b c d e f"), (6, "a b c")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, "a b c d e f")], "item_id long, text string")
    index = decontaminate.build_index(d)
    best = {}
    for slop in (0, 1, 2, 3):
        for r in decontaminate.near_matches(index, b, slop).collect():
            assert r.spread <= slop
            assert r.item_id == 9
            best.setdefault(slop, {}).setdefault(r.doc_id, []).append(r.spread)
    least = {s: {i: min(x) for i, x in v.items()} for s, v in best.items()}
    assert least == {0: {1: 0, 5: 0}, 1: {1: 0, 5: 0}, 2: {1: 0, 2: 2, 5: 0}, 3: {1: 0, 2: 2, 3: 3, 5: 0}}
    phrases = decontaminate.phrase_matches(index, b).collect()
    assert sorted((r.doc_id, r.length) for r in phrases) == [(1, 6), (5, 6)]


# -- fill in the middle --
def brute_infill(ident, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("block", "percent", "spm"), [(1 << 20, 100, 50), (7, 100, 50), (64, 60, 20)])
def test_infill(spark, monkeypatch, block, percent, spm):
    monkeypatch.setattr(infill, "BLOCK_BYTES", block)
    rng = random.Random(block)
    rows = [(i, "".join(rng.choice(["a", "\n", "<", "P", "S", ">", "é", "€", "😀", "\r"]) for _ in range(rng.randint(0, 50)))) for i in range(300)]
    rows += [(None, "x\ny"), (1, None), (1, ""), (2, "\n\n\n"), (3, "<<P>"), (4, "<P" + "\n>" * 3), (2**62, "last")]
    made = infill.transform(spark.createDataFrame(rows, "doc_id long, text string"), 7, percent, spm)
    back = infill.restored(F.col("output"), F.col("form"))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.withColumn("back", back).collect())
    assert got == Counter((i, *brute_infill(i, t, percent, spm), t or "") for i, t in rows)


def test_infill_of_odd_rows(odd, none):
    got = Counter((r.doc_id, r.form, r.restored_sha256) for r in infill.digests(odd).collect())
    want = Counter((r.doc_id, brute_infill(r.doc_id, r.text)[1], hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert got == want
    assert infill.digests(none).count() == 0


def test_sentinels_that_overlap():
    with pytest.raises(ValueError):
        infill.Sentinels("<P><", "<S>", "<M>")
    with pytest.raises(ValueError):
        infill.Sentinels("<P>", "<P>x", "<M>")
    assert infill.Automaton(("<PRE>", "<SUF>", "<MID>")).memory == 4
