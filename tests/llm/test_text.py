"""Quality rules, language identification, toxicity, URL rules, chat formatting."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from fractions import Fraction
from math import log

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from peakmill.llm import chat, langid, quality, queries, toxicity, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(win)
    cover = {j for i, x in enumerate(win) if often[x] > 1 for j in range(i, i + 5)}
    n = len(cover)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, n, len(w) < 10 or 100 * n > 20 * len(w)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_base_columns(request, which):
    df = request.getfixturevalue(which)
    want = Counter((r.doc_id, *base(r.text)) for r in df.collect())
    got = quality.quality_verdicts(df).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got)


def test_quality_finds_junk_and_keeps_the_rest(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [(labels[r.doc_id], r.kept, r.base_failed) for r in quality.quality_verdicts(spark.read.parquet(f"{d}/documents.parquet")).collect() if r.doc_id in labels]
    good = [kept for q, kept, failed in got if q == 1 and not failed]
    bad = [kept for q, kept, _ in got if q == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.35  # some labels are wrong on purpose


def test_filters_keep_columns(odd, none):
    for keep in (quality.filter_quality, lambda x: langid.filter_language(x, langid.train(x, PIECES))):
        assert keep(odd).columns == odd.columns
        assert keep(none).count() == 0
    assert quality.quality_verdicts(none).count() == 0


def test_language_forward_sum_is_exact():
    pieces = langid.vocabulary(PIECES)
    model = langid.Model(pieces, ["a", "b"], np.random.default_rng(0).random((2, len(pieces))) * 100)
    place = {p: i for i, p in enumerate(pieces) if p}

    def brute(word, k):
        total = [Fraction(1)] + [Fraction(0)] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                at = place.get(word[i:j], 0 if j == i + 1 else None)
                if at is not None:
                    total[j] += total[i] * Fraction(model.prob[at, k])
        return log(total[-1].numerator) - log(total[-1].denominator)

    words = ["▁the", "▁reading", "▁x", "▁übergröße", "▁中文字", "▁" + "abcdefgh" * 9]
    words += ["▁" + "\U0001f600" * 100, "▁" + "\ue000" * 40, ""]
    got = langid.scored(langid.Lattice(pieces), model.prob, words)
    assert all(got[i, k] == pytest.approx(brute(w, k)) for i, w in enumerate(words[:-1]) for k in (0, 1)) and not got[-1].any()
    long = "ab\ue000c" * 3000
    parts = [long[i : i + langid.SCORE_WORD] for i in range(0, len(long), langid.SCORE_WORD)]
    got = langid.scored(langid.Lattice(pieces), model.prob, ["x", long, *parts])
    assert np.allclose(got[1], got[2:].sum(0)) and np.isfinite(got).all()


def test_language_expected_counts_are_exact():
    pieces = langid.vocabulary(PIECES)
    place = {p: i for i, p in enumerate(pieces) if p}
    prior = langid.rank_prior(len(pieces))

    def brute(word):
        ahead, behind = [[Fraction(0)] * len(word) + [Fraction(0)] for _ in range(2)]
        ahead[0] = behind[-1] = Fraction(1)
        arcs = [(i, j, place.get(word[i:j], 0 if j == i + 1 else None)) for j in range(1, len(word) + 1) for i in range(j)]
        arcs = [(i, j, p) for i, j, p in arcs if p is not None]
        for i, j, p in arcs:
            ahead[j] += ahead[i] * Fraction(prior[p])
        for i, j, p in sorted(arcs, key=lambda x: -x[0]):
            behind[i] += Fraction(prior[p]) * behind[j]
        out = Counter()
        for i, j, p in arcs:
            out[p] += ahead[i] * Fraction(prior[p]) * behind[j] / ahead[-1]
        return out

    words = ["▁the", "▁reading", "▁x", "▁übergröße", "▁" + "\U0001f600" * 20, "▁" + "\ue000" * 63, "ab\ue000" * 15, "a"]
    weights = np.array([3.0, 1, 2, 1, 4, 1, 2, 1])
    want = Counter()
    for w, n in zip(words, weights, strict=True):
        for p, c in brute(w).items():
            want[p] += float(c) * n
    got = langid.expected_counts(langid.Lattice(pieces), prior, words, weights)
    assert np.isfinite(got).all() and {p: got[p] for p in np.flatnonzero(got > 1e-12).tolist()} == pytest.approx({p: c for p, c in want.items() if c > 1e-12}, abs=1e-9)


@pytest.mark.parametrize("odd_text", ["\U0001f600" * 45, "\ue000" * 40, "x" + "\ue000" * 5000, "\U00012000" * 64, "a\x85b\u3000c"])
def test_unknown_runs_leave_the_model_sound(spark, odd_text):
    rows = [(i, "the cat sat on the mat and the dog ran", "en") for i in range(20)] + [(20 + i, "der Hund lief und die Katze schlief auf der Matte", "de") for i in range(20)]
    docs = spark.createDataFrame([*rows, (101, odd_text, "de"), (105, odd_text + " " + "y" * 20_000, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs, PIECES)).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == lang for i, _, lang in rows)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs, langid.train(docs, PIECES)).collect()
    out = [r for r in got if r.held_out]
    assert len(got) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(odd, none):
    model = langid.train(odd, PIECES)
    got = langid.identify(odd, model).collect()
    assert len(got) == 11
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3))
    empty = langid.train(none, PIECES)
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_subsequence_kernel_tolerates_gaps():
    k = toxicity.Landmarks(["idiot"]).kernel(["idiot", "idiioot", "iddiot", "ration", "ab"])[:, 0]
    assert k[0] == pytest.approx(1) and k[1] > 0.3 and k[2] > 0.3 and k[3] < 0.05 and k[4] == 0
    u = toxicity.units("You are an i d i o t, such an i.d.i.o.t!")
    assert "idiot" in u

    def brute(s, t):
        def feats(w):
            f = Counter()
            for i in range(len(w)):
                for a in range(i + 1, min(len(w), i + toxicity.SPAN)):
                    for b in range(a + 1, min(len(w), i + toxicity.SPAN)):
                        f[w[i] + w[a] + w[b]] += toxicity.DECAY ** (b - i + 1)
            return f

        x, y = feats(s), feats(t)
        norm = sum(v * v for v in x.values()) * sum(v * v for v in y.values())
        return (sum(x[c] * y[c] for c in x) / norm**0.5) ** toxicity.SHARPNESS

    words = ["banana", "bandana", "cabana", "aaaa"]
    got = toxicity.Landmarks(words).kernel(words)
    assert np.allclose(got, [[brute(a, b) for b in words] for a in words], atol=2e-4)


@pytest.mark.parametrize("text", ["i d i o t.", "i. d. i. o. t.", "i, d, i, o, t", "You are an i d i o t.", 'such an "i d i o t"!', "(i) - d - i - o - t", "an i d i o t"])
def test_spaced_words_with_marks(text):
    assert "idiot" in toxicity.units(text)


def test_no_spaced_word_across_words_or_of_marks():
    assert toxicity.units("- - - a b. then c, d") == {"then"}


def test_long_words_come_in_windows():
    long = "q" * 70 + "idiot" + "z" * 300_000
    made = toxicity.units(long)
    assert max(map(len, made)) == toxicity.LONG and any("idiot" in w for w in made)
    landmarks = toxicity.Landmarks(["idiot"])
    x = toxicity.likenesses(landmarks, "test", [long, "x" * 5_000_000, "an idiot", None, ""])
    assert x[2, 0] > 0.99 and not x[[1, 3, 4]].any() and 0 <= x[0, 0] < 0.1


def test_cache_turnover_changes_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("idotsu"), rng.integers(1, 8))) for _ in range(20)) for _ in range(60)]
    landmarks = toxicity.Landmarks(["idiot", "stout"])
    whole = toxicity.likenesses(landmarks, "whole", texts)
    monkeypatch.setattr(toxicity, "CACHE", 30)
    assert np.allclose(np.concatenate([toxicity.likenesses(landmarks, "few", texts[i : i + 3]) for i in range(0, 60, 3)]), whole)


def test_svm_against_a_plain_minimiser():
    rng = np.random.default_rng(7)
    y = (rng.random(300) < 0.2).astype(float)
    x = rng.normal(0, 1, (300, 3)) + y[:, None] * [1.5, 0, -0.5]
    w = toxicity.fit_svm(x, y)
    sign, cost = np.where(y > 0, 1.0, -1.0), np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)

    def loss(w):
        return (cost * np.maximum(0, 1 - sign * (x @ w[:3] + w[3])) ** 2).sum() + 1e-3 * (w[:3] ** 2).sum()

    step = [loss(w + d * e) for e in np.eye(4) for d in (-1e-3, 1e-3)]
    assert loss(w) <= min(step) + 1e-9
    margin = x @ w[:3] + w[3]
    slope, shift = toxicity.calibrate(margin, y)
    p = 1 / (1 + np.exp(-(slope * margin + shift)))
    assert slope > 0 and abs(p.mean() - y.mean()) < 0.02


def test_repeated_doc_ids_are_learned_from_once(spark):
    rows = [(i % 50, f"text {i % 50} " + ("you idiot" if i % 5 == 0 else "fine words here")) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(50)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 500 and all((r.predicted == 1) == (r.doc_id % 5 == 0) for r in got)


def test_sixty_unlike_insults_are_all_landmarks():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9, replace=False)) for _ in range(60)]
    assert set(toxicity.choose_landmarks(words, np.full(60, 9.0), toxicity.LANDMARKS)) == set(words)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    a = [r.score for r in got if r.held_out and truth.get(r.doc_id) == 1]
    b = [r.score for r in got if r.held_out and truth.get(r.doc_id) == 0]
    assert np.mean([(x > y) + (x == y) / 2 for x in a for y in b]) > 0.8  # a fifth of the labels are wrong here
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (7, 0), (8, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.train(odd, labels)).count() == 11
    assert {r.score for r in toxicity.score(odd, toxicity.train(odd, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_url_rules(spark):
    urls = [
        (1, "http://spam1.x.com/q"), (2, None), (3, "HTTP://A.Org/Es/1"), (4, "nope"), (5, "x://Example.ORG/en/12?x"), (6, "http://ok1.x.com/"),
        (7, "a://b://c/d"), (8, "http://b.com/fr/1"), (9, "http://xorg/"), (10, "h://x.example.org/es/"), (10, "h://x.example.org/es/"),
    ]
    pages = spark.createDataFrame([(*u, "clash", "clash") for u in urls], "page_id long, url string, host string, rule string")
    seen = [(f"http://spam{i % 3}.x.com/a/{i}?buy=1", 1) for i in range(90)] + [(f"http://ok{i % 3}.x.com/a/{i}?buy=1", 0) for i in range(90)]
    labels = spark.createDataFrame([*seen, (None, 1), ("http://u/", None)], "url string, bad int")
    rules = url_rules.mine(labels)
    assert {tuple(r.antecedent) for r in rules.collect()} >= {("host=spam0.x.com",)}
    assert all(r.confidence >= 0.5 for r in rules.collect())
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, queries.URL_RULES, rules).collect()), key=str)
    assert got == sorted(
        [
            (1, "spam1.x.com", "/q", None, "block"), (2, "", "", None, "allow"), (3, "a.org", "/Es/1", "org/", "allow"), (4, "", "", None, "allow"),
            (5, "example.org", "/en/12", "example.org/en/1", "block"), (6, "ok1.x.com", "/", None, "allow"), (7, "b:", "//c/d", None, "allow"),
            (8, "b.com", "/fr/1", "com/fr/", "allow"), (9, "xorg", "/", None, "allow"), (10, "x.example.org", "/es/", "example.org/es/", "block"),
            (10, "x.example.org", "/es/", "example.org/es/", "block"),
        ],
        key=str,
    )
    nothing = url_rules.mine(labels.limit(0))
    assert url_rules.judge(pages, queries.URL_RULES, nothing).where("mined_rule is not null").count() == 0
    assert url_rules.judge(pages.limit(0), queries.URL_RULES, rules).count() == 0


def test_mined_rules_against_brute_force(spark):
    from itertools import combinations

    rng = np.random.default_rng(9)
    hosts = ["m.casino-win.example.com", "casino-5.org", "news.example.com", "win-big.net", "a.b.shop.de"]
    urls = {}
    for i in range(240):
        h = hosts[rng.integers(len(hosts))]
        url = f"http://{h}/{rng.choice(['buy', 'read'])}/{i}" + rng.choice(["", "?ref=1", "#x"])
        urls[url] = int(("casino" in h and rng.random() < 0.9) or ("buy" in url and "win" in h and rng.random() < 0.7) or rng.random() < 0.05)
    df = spark.createDataFrame([*urls.items(), (None, 1), ("http://u/", None), *list(urls.items())[:20]], "url string, bad int")
    found = {r.url: frozenset(r.t) for r in df.where("url is not null").select("url", url_rules.tokens(F.col("url")).alias("t")).distinct().collect()}
    assert found[next(u for u in urls if "m.casino-win" in u)] >= {"host=m.casino-win.example.com", "domain=example.com", "label=m", "label=casino-win", "word=casino", "word=win"}
    freq, both = Counter(), Counter()
    for u, bad in urls.items():
        t = sorted(found[u])
        for k in range(1, len(t) + 1):
            for c in combinations(t, k):
                freq[c] += 1
                both[c] += bad
    n, bad = len(urls), sum(urls.values())
    rules = {c: both[c] / freq[c] for c in freq if both[c] >= 20 and both[c] / freq[c] >= max(0.5, 1.2 * bad / n)}
    want = {c: x for c, x in rules.items() if not any(rules.get(c[:i] + c[i + 1 :], 0) >= x for i in range(len(c)))}
    got = {tuple(r.antecedent): r for r in url_rules.mine(df).collect()}
    assert set(got) == set(want) and ("word=casino",) in want
    for c, r in got.items():
        assert r.confidence == pytest.approx(want[c]) and r.support == pytest.approx(both[c] / n)
        assert r.key in c and freq[(r.key,)] == min(freq[(t,)] for t in c)
    judged = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), {}, url_rules.mine(df)).collect()
    for r, u in zip(sorted(judged), urls, strict=True):
        fits = [c for c in want if set(c) <= found[u]]
        assert (r.verdict == "block") == bool(fits)
        if fits:
            assert want[tuple(r.mined_rule.split(" "))] == max(want[c] for c in fits)


def test_shared_template_of_many_segments(spark):
    """Thirty segments that all bad URLs share are thirty rules, not 2**30 itemsets."""
    template = "/".join(f"part-{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(30))
    rows = [(f"http://h{'abc'[i % 3]}.org/{template}/{'q' * (i + 1)}", 1) for i in range(40)] + [(f"http://h{'abc'[i % 3]}.org/other/{'q' * (i + 1)}", 0) for i in range(60)]
    got = url_rules.mine(spark.createDataFrame(rows, "url string, bad int")).collect()
    assert {tuple(r.antecedent) for r in got} >= {(f"segment=part-{chr(97 + i % 26)}{'x' * (i // 26)}",) for i in range(30)}
    assert all(len(r.antecedent) == 1 and r.confidence == 1 for r in got if "part-" in r.rule)


def test_long_and_odd_urls(spark):
    urls = ["http://x.org/" + "a/" * 50_000, "http://" + "s-" * 20_000 + ".com/p?" + "q&" * 20_000, "://", "http://", "http://-.-/", "a" * 100_000, ""]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, None])], "page_id long, url string")
    labels = spark.createDataFrame([(u, i % 2) for i, u in enumerate(urls)], "url string, bad int")
    got = url_rules.judge(pages, queries.URL_RULES, url_rules.mine(labels, min_count=1)).collect()
    assert len(got) == 8 and {r.page_id: r.host for r in got}[0] == "x.org" and all(r.verdict in ("allow", "block") for r in got)


def test_chat_round_trip(spark):
    c = "<|im_end|><|im_start|>assistant ok"
    turns = [
        (-1, 0, "user", c), (-1, 1, "assistant", c), (-2, 0, "assistant", "<\\|a <\\\\| <| <\\ | \\ <"), (-2, 1, "user", None), (-2, 2, "assistant", ""),
        (-3, 0, "assistant", "😀é中\n\n  x "), (-3, 1, "assistant", " \nq"), (-3, 2, None, "<|endoftext|>"), (None, None, "assistant", "x"), (7, 1, "a<", "b"), (7, 1, "a<", "b"),
        (8, 0, "assistant", "long <| " * 20_000),
    ]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    made = chat.format_conversations(df, BYTES)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    by = {}
    for i, t, r, x in turns:
        by.setdefault(i, []).append((t, r or "", x or ""))
    for i, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[i]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for _, a, b in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert all("<|" not in t.replace("<|im_start|>", "").replace("<|im_sep|>", "").replace("<|im_end|>", "") for t in [r.formatted for r in made.collect()])
    assert sorted(map(str, chat.formatted_digests(df, BYTES).collect())) == sorted(map(str, chat.digests(made).collect()))
    assert chat.digests(chat.format_conversations(df.limit(0), BYTES)).count() == chat.formatted_digests(df.limit(0), BYTES).count() == 0


def test_ids_and_offsets_are_those_of_another_library():
    from tokenizers import AddedToken, Tokenizer, processors

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    tok.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (chat.START, chat.SEP, chat.END)])
    rng = np.random.default_rng(3)
    letters = ["a", "B", " ", "\n", "é", "中", "😀", "<", "\\", "|", "'s", "0", chat.START, chat.SEP, chat.END, "\u0301", "  "]
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(0, 80, 200)] + ["x" * 3000 + " " * 5000]
    texts += [f"a{gap}{after}" for gap in (" " * 10_000, "\n \t" * 5000, " " * 9_999 + "\n") for after in ("", "b", ".", chat.END + " ", "\x1f")]
    for text in texts:
        ids, offsets = chat.encode(BYTES, text)
        e = tok.encode(text, add_special_tokens=False)
        assert ids.tolist() == e.ids and offsets.tolist() == [list(o) for o in e.offsets]


def test_em_against_plain_loops():
    """Posteriors of vote patterns by the same model, worked out text by text."""
    rng = np.random.default_rng(8)
    n = len(quality.RULES)
    weight = 3 ** np.arange(n - 1, -1, -1)
    texts = []
    for _ in range(400):
        junk = rng.random() < 0.2
        texts.append([0 if rng.random() < 0.3 else 1 if rng.random() < (0.5 if junk else 0.03) else 2 for _ in range(n)])
    prior, strength = 0.85, 0.1
    pi, rate, post = prior, [[0.4] * n, [0.02] * n], [prior] * len(texts)
    for _ in range(200):
        new = []
        for t in texts:
            like = [1 - pi, pi]
            for r, v in enumerate(t):
                for c in (0, 1):
                    like[c] *= {0: 1, 1: rate[c][r], 2: 1 - rate[c][r]}[v]
            new.append(like[1] / sum(like))
        done = max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9
        post = new
        if done:
            break
        for c in (0, 1):
            own = [p if c else 1 - p for p in post]
            extra = strength * len(texts) * (prior if c else 1 - prior)
            for r in range(n):
                bad = sum(w for w, t in zip(own, texts, strict=True) if t[r] == 1)
                votes = sum(w for w, t in zip(own, texts, strict=True) if t[r])
                rate[c][r] = min(1 - 1e-6, max(1e-6, (bad + extra * (0.4, 0.02)[c]) / (votes + extra)))
        pi = (sum(post) + strength * len(texts) * prior) / (len(texts) * (1 + strength))
    codes = [int(weight @ t) for t in texts]
    seen = Counter(codes)
    got = quality.fit_em(np.array(sorted(seen)), np.array([seen[c] for c in sorted(seen)], float))
    assert all(got[c] == pytest.approx(p, abs=1e-6) for c, p in zip(codes, post, strict=True))
