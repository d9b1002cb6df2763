"""Jaccard join, fingerprints, sharding, mixing, packing, pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from peakmill.llm import fingerprint, jaccard, mixing, packing, shards
from peakmill.runtime import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return {(i, len(s), find(i)) for i, s in sets}


def near_copies(seed, groups=6, copies=25, words=70):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    rows = []
    for _ in range(groups):
        first = [rng.choice(vocab) for _ in range(words)]
        for _ in range(copies):
            w = list(first)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w[rng.randint(0, 3) :])))
    return rows


@pytest.mark.parametrize(("k", "percent", "hot", "frequent", "block"), [(3, 90, 128, 1000, 2048), (5, 80, 6, 10, 8), (3, 90, 4, 5, 4)])
def test_components_are_exact(spark, monkeypatch, k, percent, hot, frequent, block):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(k + percent)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
    assert {tuple(r) for r in got.collect()} == brute_components(rows, k, percent)


def test_components_beyond_the_filter(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FILTERED", 3)
    rows = near_copies(5)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert {tuple(r) for r in got.collect()} == brute_components(rows, 3, 90)


def test_components_of_odd_rows(odd, none):
    got = Counter(tuple(r) for r in jaccard.jaccard_components(odd, 3, 90).collect())
    assert got[(1, 0, 1)] == got[(2, 0, 2)] == got[(4, 1, 4)] == 1
    assert got[(5, 11, 5)] == 1 and got[(6, 11, 5)] == 2
    assert sum(got.values()) == 11
    assert jaccard.jaccard_components(none, 3, 90).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 2 3 4 5 7 8 9 None".split())


def test_keep_one_judges_rows_by_their_text(spark):
    text = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    rows = [
        (3, text("a"), "stays"), (7, text("a") + " end", "goes"), (7, text("b"), "stays"), (9, text("b"), "goes"),
        (None, text("a"), "goes"), (None, text("c"), "one"), (None, text("c"), "one"), (None, text("c") + " end", "one"),
        (None, text("d"), "alone"), (None, "", "empty"), (None, None, "empty"), (4, text("e"), "stays"), (4, text("e"), "stays"),
    ]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, what string"))
    assert kept.columns == ["doc_id", "text", "what"]
    got = Counter((r.doc_id, r.what) for r in kept.collect())
    assert got == {(3, "stays"): 1, (7, "stays"): 1, (4, "stays"): 2, (None, "one"): 1, (None, "alone"): 1, (None, "empty"): 2}


def test_fingerprints_against_brute_force(spark, docs):
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    rows = sorted(docs.select("doc_id", "text").collect())
    cut = lambda t: shingles(t.lower(), 5)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    off = []
    for i, r in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)].text
        m = len(r.text) // 2
        edited = r.text[: len(r.text) - m] + nxt[:m]
        o = got[r.doc_id]
        assert (o.n_chars, o.edited_sha256) == (len(r.text), hashlib.sha256(edited.encode()).hexdigest())
        off += [o.near_edited - like(cut(r.text), cut(edited)), o.near_next - like(cut(r.text), cut(nxt))]
    assert np.abs(off).mean() < 0.03 and abs(np.mean(off)) < 0.01
    by = defaultdict(set)
    for r in rows:
        by[r.text].add(got[r.doc_id].fingerprint)
    assert all(len(x) == 1 for x in by.values())


def test_fingerprints_of_parts_merge(spark):
    rng = random.Random(4)
    w = [str(rng.randint(0, 10**6)) for _ in range(3000)]
    df = spark.createDataFrame([(" ".join(w[:1500]), " ".join(w[1496:]), " ".join(w), " ".join(w[100:300]))], "a string, b string, ab string, part string")
    s = {c: fingerprint.sketch(F.col(c)) for c in df.columns}
    r = df.select(
        fingerprint.merge(s["a"], s["b"]).alias("m"), s["ab"].alias("w"), fingerprint.containment(s["part"], s["ab"]).alias("c"), fingerprint.containment(s["ab"], s["part"]).alias("d")
    ).collect()[0]
    assert r.m == r.w and r.c == 1.0 and 0.02 < r.d < 0.12


def test_fingerprints_of_odd_rows(odd, none):
    got = fingerprint.edited_fingerprints(odd).collect()
    assert len(got) == 11
    r = {x.doc_id: x for x in got}
    assert r[1].fingerprint == "" and r[1].near_edited == 1.0 and r[1].near_next == 1.0
    assert r[5].fingerprint == r[6].fingerprint and r[5].near_next == 1.0
    assert fingerprint.edited_fingerprints(none).count() == 0
    assert fingerprint.edited_fingerprints(odd.where("doc_id = 7")).collect()[0].near_next == 1.0


@pytest.mark.parametrize("lengths", [(1500, 1500, 0), (30, 34, 4), (20, 60, 4), (5, 5, 0), (3, 200, 0), (0, 40, 0)])
@pytest.mark.parametrize("scale", [4, 64])
def test_fingerprints_merge_exactly_at_any_length(spark, lengths, scale):
    rng = random.Random(sum(lengths))
    a, b, common = ([str(rng.randint(0, 10**9)) for _ in range(n)] for n in lengths)
    texts = [" ".join(a + common), " ".join(common + b), " ".join(a + common + b)]
    df = spark.createDataFrame([texts], "a string, b string, ab string")
    s = {c: F.expr(c) for c in df.columns}
    r = df.select(*[fingerprint.shingle_hashes(s[c]).alias(c) for c in s], fingerprint.merge(fingerprint.sketch(s["a"], scale), fingerprint.sketch(s["b"], scale), scale).alias("m")).collect()[0]
    both = sorted({*r.a, *r.b})
    assert r.m == [h for i, h in enumerate(both) if i < fingerprint.FLOOR or h < fingerprint.RANGE // scale]


@pytest.mark.parametrize("run", [1, 2, 1024])
def test_neighbours(spark, monkeypatch, run):
    monkeypatch.setattr(fingerprint, "RUN", run)
    rng = random.Random(5)
    ids = sorted({3, 511, 512, 9_000, 600_000, 5_000_000, -7, 2**62, -(2**62), *(rng.randint(-(2**63), 2**63 - 1) for _ in range(40)), *range(100, 130)})
    for rows, kind in (([(i, f"t{i}") for i in ids], "long"), (sorted((f"id '{i}\"\\", f"t{i}") for i in ids), "string")):
        got = fingerprint.with_next(spark.createDataFrame(rng.sample(rows, len(rows)), f"doc_id {kind}, text string")).collect()
        assert {r.doc_id: r.next_text for r in got} == {a[0]: b[1] for a, b in zip(rows, rows[1:] + rows[:1], strict=True)}
    # many rows of one doc_id, or of none, make one ring with the others
    rows = [(7, f"a{i}") for i in range(30)] + [(None, f"b{i}") for i in range(30)] + [(1, "first"), (9, "mid")]
    after = {r.text: r.next_text for r in fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ring, at = [], "first"
    while at not in ring:
        ring.append(at)
        at = after[at]
    assert sorted(ring) == sorted(t for _, t in rows) and [t[0] for t in ring] == [*"f" + "a" * 30 + "m" + "b" * 30]


def test_shards(spark, odd, none):
    store = shards.ShardStore(spark, scratch_path(spark, "t"), target_bytes=1 << 16)
    got = shards.shard_documents(odd, store).collect()
    want = Counter((r.doc_id, None if r.text is None else hashlib.md5(r.text.encode()).hexdigest()) for r in odd.collect())
    assert Counter((r.doc_id, r.text_md5) for r in got) == want
    before = store.version()
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(before - 1, [], "{}", 1)
    assert store.version() == before
    store.append(none)
    store.append(odd.limit(3))
    assert store.read().count() == 14 and store.read(before).count() == 11
    assert store.read().columns[: len(odd.columns)] == odd.columns
    empty = shards.ShardStore(spark, scratch_path(spark, "t"))
    assert shards.shard_documents(none, empty).count() == 0


def test_shards_keep_columns_of_any_name(spark, monkeypatch):
    names = ["doc_id", "text", "run_id", "folder", "part", "shard", "arrival", "row", "_metadata", "file_path", "a.b", "version"]
    rows = [tuple(f"{c}{i}" for c in names) for i in range(9)] + [(None,) * len(names)] * 2
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in names))
    store = shards.ShardStore(spark, scratch_path(spark, "t"))
    got = shards.shard_documents(df, store).collect()
    assert Counter((r.doc_id, r.text_md5) for r in got) == Counter((r[0], r[1] and hashlib.md5(r[1].encode()).hexdigest()) for r in rows)
    back = store.read()
    assert back.columns == [*names, "run_id_", "shard_"]
    assert Counter(tuple(r)[: len(names)] for r in back.collect()) == Counter(rows)


def test_vacuum_keeps_readers_and_appends_safe(spark):
    store = shards.ShardStore(spark, scratch_path(spark, "t"), fanout=3)
    for i in range(5):
        store.append(spark.range(i, i + 1))
    before = store.version()
    held = store.read(before)
    assert store.compact() == before + 1
    assert store.vacuum() == 0 and held.count() == 5  # the version before stays readable
    pending = f"{store.root}/data/pending"
    spark.range(3).write.parquet(pending)
    store.append(spark.range(9, 10))
    assert store.vacuum(versions=1) == 5
    assert store.read().count() == 6 and spark.read.parquet(pending).count() == 3  # an append's files before its commit
    with pytest.raises(Exception, match="(?i)exist|no such"):
        store.read(before).count()
    assert store.vacuum(versions=1, age=-5) == 1 and store.read().count() == 6


def brute_tier(runs, fanout, alike, widest):
    """The tier from the smallest run that starts one: all runs, up to widest, of at most alike times its size."""
    for low in sorted(runs, key=lambda r: (r.bytes, r.run_id)):
        near = sorted((r for r in runs if (r.bytes, r.run_id) >= (low.bytes, low.run_id) and r.bytes <= alike * max(low.bytes, 1)), key=lambda r: (r.bytes, r.run_id))
        if len(near) >= fanout:
            return near[:widest]
    return []


def test_tiers_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(200):
        store = shards.ShardStore(spark, "unused", fanout=rng.randint(2, 5), alike=rng.choice([1.0, 1.5, 2.0, 4.0]), widest=rng.choice([5, 6, 64]))
        runs = [shards.Run(i, str(i), 1, rng.choice([0, 1, 5, 100, rng.randint(1, 2000)]), 1) for i in range(rng.randint(0, 15))]
        assert store.due(runs) == brute_tier(runs, store.fanout, store.alike, store.widest)


def test_tiers(spark):
    store = shards.ShardStore(spark, "unused", fanout=3, alike=2.0)
    run = lambda i, size: shards.Run(i, str(i), 1, size, 1)
    assert [r.run_id for r in store.due([run(1, 100), run(2, 1000), run(3, 150), run(4, 120), run(5, 1900)])] == [1, 4, 3]
    assert store.due([run(1, 100), run(2, 1000), run(3, 150)]) == []


def test_mixing_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FLIGHT", 50)
    rng = random.Random(6)
    rows = [(i, rng.choice("aaaaab") + "x" if i % 17 else None, "w " * rng.randint(1, 40)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.allocate(df).collect()
    again = mixing.allocate(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {i: s for i, s, _ in rows}
    by = defaultdict(list)
    for r in got:
        assert r.size == len(rows[r.doc_id][2].split()) and r.taken <= 2 * r.size
        by[source[r.doc_id]].append(r)
    total = sum(r.size for r in got)
    sizes = {s: sum(r.size for r in x) for s, x in by.items()}
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, full = {}, set()
    while True:
        level = (1.5 * total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    want = {s: 2 * sizes[s] if s in full else level * weight[s] for s in order}
    for s, x in by.items():
        assert x[0].target == pytest.approx(want[s])
        assert sum(r.taken for r in x) == pytest.approx(want[s], rel=0.01)


def test_mixing_of_odd_rows(odd, none):
    got = mixing.allocate(odd).collect()
    assert len(got) == 11 and all(r.taken <= 2 * r.size for r in got)
    assert mixing.allocate(none).count() == 0
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(none).count() == 0


def test_mix_takes_what_was_allocated_without_unique_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FLIGHT", 50)
    rng = random.Random(8)
    ids = lambda i: None if i % 3 == 0 else i % 7
    rows = [(ids(i), rng.choice("aaab") if i % 17 else None, f"w{i} " + "w " * rng.randint(0, 40), "x") for i in range(900)]
    rows += [(None, "a", "the same row", None)] * 25
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, what string")
    target = {s: t for s, t in mixing.allocate(df).select("size", "source_size", "target").groupBy("source_size").agg({"target": "max"}).collect()}
    words = lambda rs: Counter({s: sum(len(r[2].split()) for r in rs if r[1] == s) for s in ("a", "b", None)})
    had, got = words(rows), mixing.mix(df).collect()
    for s, n in words(got).items():
        assert n == pytest.approx(target[had[s]], rel=0.01)
    assert set(map(tuple, got)) <= set(rows) and max(Counter(map(tuple, got)).values()) <= 50
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["n_", "t_", "i_", "s", "row", "row_key", "taken", "rows", "some", "nth", "digest", "size", "p", "unit", "rate", "target", "a.b", "copies"]
    rows = [(i, f"w{i} w", "ab"[i % 2], *(f"{c}{i}" for c in names)) for i in range(60)] + [(None, "same", "a", *names)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    got = mixing.mix(df)
    assert got.columns == df.columns and set(map(tuple, got.collect())) <= set(rows)
    copies = mixing.allocate(df).agg({"copies": "sum"}).collect()[0][0]
    assert abs(got.count() - copies) <= 2


def test_rows_of_one_id_fly_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FLIGHT", 50)
    seen = []
    made = mixing.flight

    def spy(*how):
        seen.append(how)
        return made(*how)

    monkeypatch.setattr(mixing, "flight", spy)
    df = spark.createDataFrame([(None, "a" if i % 3 else "b", f"text {i} " + "w " * (i % 40)) for i in range(2000)], "doc_id long, source string, text string")
    units = mixing.words_of(df).select(F.xxhash64(F.lit(""), "digest", F.lit(7)).alias("unit"))
    groups = Counter(r.unit % 40 for r in units.collect())
    assert len(groups) == 40 and max(groups.values()) < 100
    got = mixing.allocate(df).collect()
    assert len(got) == 2000 and sum(how[2] for how in seen) == 1


def test_flight_moves_along_the_null_space_to_brute_force_bounds():
    """Every step of three documents leaves both totals as they are and decides one; over many draws each is taken as often as its probability says."""
    size, p = np.array([3, 10, 4, 7, 1, 20, 6, 6]), np.array([0.2, 0.5, 0.7, 0.4, 0.9, 0.3, 0.5, 0.5])
    total = np.zeros(len(p))
    for seed in range(4000):
        out = mixing.fly(p, size, np.random.default_rng(seed))
        assert out.sum() == pytest.approx(p.sum()) and out @ size == pytest.approx(p @ size)
        assert ((out < 1e-9) | (out > 1 - 1e-9)).sum() >= len(p) - 2
        total += out
    assert np.abs(total / 4000 - p).max() < 0.04  # a flight is fair


def test_landing_is_the_nearest_choice():
    rng = np.random.default_rng(2)
    for _ in range(20):
        size, p = rng.integers(1, 50, 8), rng.random(8)
        out = mixing.land(p, size)
        cost = lambda x: abs(x @ size - p @ size) + abs(x.sum() - p.sum()) * max(1.0, size.mean() / 100)
        every = [np.array([(n >> i) & 1 for i in range(8)]) for n in range(256)]
        assert cost(out) == pytest.approx(min(map(cost, every)))


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 100, 400), np.full(400, 0.37)
    out = mixing.fly(p, size, rng)
    assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and (out * size).sum() == pytest.approx((p * size).sum(), rel=1e-9)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2


def test_packing_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    for df in (docs, odd):
        got = packing.pack(df, PATH).collect()
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
            for j, at in enumerate(range(0, len(ids), 2048)):
                part = np.array(ids[at : at + 2048], "<u4")
                want[(r.doc_id, j, at, len(part), zlib.crc32(part.tobytes()))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for x in by.values():
            x.sort()
            assert [a for a, _ in x] == list(np.cumsum([0, *(n for _, n in x[:-1])])) and sum(n for _, n in x) <= 2048
        assert len(by) <= -(-sum(r.length for r in got) // 2048) * 1.05 + 1
    assert packing.pack(odd.limit(0), PATH).count() == 0


def test_plan_fills_like_best_fit():
    rng = random.Random(2)
    for _ in range(30):
        counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(12)}
        slots, opened = packing.plan(counts, 100)
        assert {n: sum(s[2] for s in slots if s[0] == n) for n in counts} == counts
        used = defaultdict(list)
        for n, _, m, first, off in slots.tolist():
            for i in range(m):
                used[first + i].append((off, n))
        for x in used.values():
            x.sort()
            assert [a for a, _ in x] == list(np.cumsum([0, *(n for _, n in x[:-1])])) and sum(n for _, n in x) <= 100
        room: list[int] = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fit = min((r for r in room if r >= n), default=None)
                if fit is None:
                    room.append(100 - n)
                else:
                    room[room.index(fit)] -= n
        assert len(used) == opened <= len(room)


def test_words_are_encoded_as_in_whole_texts():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    texts = ["á ́b  c\t d'S I'LL 12 3x <|endoftext|> ΟΔΟΣ ΟΣ. İx ẞ\x1cz\x85w", "", "  \n ", "don't it's x' y''s .. ,a a,,b, Ⅷ ª 한국어 Z_ ½ é, word<|endoftext|>,", None]
    for text, ids in zip(texts, packing.encode_texts(PATH, pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text or "", add_special_tokens=False).ids


def test_pipeline_stages(spark, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter(r.doc_id for r in kept.select("doc_id").collect())
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns
        after = Counter(r.doc_id for r in kept.select("doc_id").collect())
        assert set(after) <= set(before)
        if name != "source_mixing":
            assert all(after[i] <= before[i] for i in after)
        else:
            assert max(after.values()) == 2
        if name == "ngram_jaccard_join":
            comp = {i: c for i, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in before], 5, 80)}
            assert set(after) == {i for i in before if comp[i] == i}


def written(spark, df):
    path = scratch_path(spark, "pipeline-input")
    df.write.parquet(f"{path}/documents.parquet")
    return path


def test_pipeline_run_packs_what_the_stages_keep(spark, docs):
    from tokenizers import Tokenizer

    path = written(spark, docs)
    got = corpus_pipeline.run(spark, path).collect()
    kept = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, path)
    tok = Tokenizer.from_file(PATH)
    want = Counter()
    for r in kept.collect():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 0]
        for j, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[(r.doc_id, j, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want and want


def test_pipeline_run_on_odd_and_empty_tables(spark, odd, none):
    got = corpus_pipeline.run(spark, written(spark, odd)).collect()
    assert {r.doc_id for r in got} <= {4, 5, 6, 7, 8, 9, None}
    assert corpus_pipeline.run(spark, written(spark, none)).count() == 0
    names = ["n", "p", "unit", "row", "size", "digest", "bit", "sig", "lot", "rank", "taken", "component", "a.b", "word"]
    text = lambda i: " ".join(f"the word{(i * 7 + j) % 50} and more of that number{j}" for j in range(20))
    rows = [(i if i % 4 else None, text(i // 2), "en" if i % 2 else "de", "ab"[i % 2], 9, *(f"{c}{i}" for c in names)) for i in range(60)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    kept = clash
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == clash.columns
    assert set(map(tuple, kept.collect())) <= set(rows)
    assert corpus_pipeline.run(spark, written(spark, clash)).columns[:2] == ["doc_id", "piece"]


def test_pipeline_leaves_no_scratch_but_its_result(spark, docs):
    import os

    from peakmill.runtime import shared_dir

    here = f"{shared_dir(spark)}/peakmill"
    path = written(spark, docs.limit(60))
    before = set(os.listdir(here))
    corpus_pipeline.run(spark, path).count()
    assert [n.split("-")[0] for n in set(os.listdir(here)) - before] == ["best_fit_packing"]


def test_sets_are_dealt_once(spark):
    """Whole sets are shuffled by class once: a join of pairs with them moves the pairs alone; before, each join moved all sets again."""
    docs = spark.createDataFrame([(i, f"a b c d e f g {i}") for i in range(9)], "doc_id long, text string")
    sets = jaccard.dealt_sets(docs, docs.select(F.col("doc_id").alias("rep")), 3)
    assert sets.count() == 9
    a, b = sets.select("sig", "n").limit(2).collect()
    links = jaccard.verified_pairs(spark.createDataFrame([(*a, *b)], "a_sig long, a_n long, b_sig long, b_n long"), sets, 51)
    assert links.count() == 1 and links.collect()
    final = links._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("Exchange hashpartitioning(" in x and "ENSURE_REQUIREMENTS" in x for x in final.splitlines()) == 2, final


def test_index_entries_carry_a_short_sketch(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id bigint, text string")
    made = jaccard.index(docs, 3, 90, np.zeros(1 << jaccard.BUCKET_BITS, np.uint8), 255)
    assert made.columns == [*jaccard.LEAD, "s0", "s1"]
    assert {r.n for r in made.collect()} == {3}


def test_index_entries_are_packed_by_lot():
    """an entry takes 17 bytes in however many lots a document's keys lie; as rows it took 40 once they lay apart."""
    rng = np.random.default_rng(3)
    for n in (900, 70_000):
        whole = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        rank = np.zeros(1 << jaccard.BUCKET_BITS, np.uint8)
        keys, flags = jaccard.index_keys(whole, rank, 255, 80)
        cols = [keys.astype(np.int64), np.full(len(keys), len(whole)), np.full(len(keys), jaccard.signature(whole)), flags | jaccard.HEAVY]
        entries = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], jaccard.LEAD)
        made = jaccard.packed(entries, 4_800)
        assert sum(len(x) for c in jaccard.LEAD for x in made[c].to_pylist()) == len(keys) * (17 if n < 1 << 16 else 23)
        assert made.num_rows == len(set(made["lot"].to_pylist()))
        got = [c.to_numpy() for c in jaccard.unpacked(made).columns]
        order = np.argsort(cols[0] & (1 << 48) - 1)
        assert (got[0][np.argsort(got[0])] == (cols[0] & (1 << 48) - 1)[order]).all()
        assert all((a == b[0]).all() for a, b in zip(got[1:], cols[1:], strict=True))


def test_frequencies_are_added_up_by_slices(spark, docs):
    """counters travel 4,096 a row; before, each was a row of its own."""
    found = jaccard.classes(docs.repartition(3), 3).cache()
    sets = {s.tobytes(): s for b in docs.toArrow().to_batches() for _, s in jaccard._sets(b, 3)}
    parts = found.where("bucket is not null").groupBy("bucket").count().collect()
    assert len(parts) == (1 << jaccard.BUCKET_BITS) // jaccard.SLICE and max(r["count"] for r in parts) <= 3
    total = np.zeros(1 << jaccard.BUCKET_BITS)
    for r in found.where("bucket is not null").collect():
        total[r.bucket : r.bucket + jaccard.SLICE] += np.frombuffer(r.cnt, np.int32)
    least = np.zeros(1 << jaccard.BUCKET_BITS)
    for s in sets.values():
        np.add.at(least, (s >> np.uint64(64 - jaccard.BUCKET_BITS)).astype(np.int64), 1)
    assert (total >= least).all() and (total <= 3 * least).all()  # copies in several parts count in each
    rank, _ = jaccard.frequency_classes(found)
    assert (rank == np.minimum(255, np.rint(8 * np.log2(1 + total)))).all()
