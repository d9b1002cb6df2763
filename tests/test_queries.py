"""Every registered query of the reference's operators against its SQL."""

from __future__ import annotations

import pytest

from peakmill.plans import planted, registry, whole  # noqa: F401  (they register their queries)
from peakmill.plans.inputs import corrected_sql
from tests.planted import FIXTURES


def normal(df):
    df = df[sorted(df.columns)]
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, small, oracle, name):
    got = normal(registry.QUERIES[name](spark, small).toPandas())
    want = normal(oracle.sql(registry.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)


@pytest.mark.parametrize("name", ["hmm_segments", "cluster_sequences", "prominence_peaks", "replicate_match", "gapped_profiles"])
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry_imports_without_the_corpus_parts():
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['corpus_pipeline'] = sys.modules['peakmill.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())"
    )
    assert subprocess.run([sys.executable, "-c", code], timeout=120).returncode == 0


def test_graph_and_lookups_cover_all_corrected_kmers(spark, small, oracle, monkeypatch):
    """The graph holds every k-mer of the minimal summed count; all others are looked up, none is both."""
    rows = oracle.sql(f"WITH {corrected_sql(whole.LONG)} SELECT kmer, sum(cnt) AS cnt FROM corrected WHERE cnt > 0 GROUP BY kmer").fetchall()
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    vertices, _ = whole.long_graph(spark, small)
    seqs = [r["seq"] for r in vertices.select("seq").collect()]
    held = {s[i : i + whole.LONG] for t in seqs for s in (t, turned(t)) for i in range(len(s) - whole.LONG + 1)}
    high = {k for k, c in rows if c >= whole.LEAST}
    assert held == high | {turned(k) for k in high}

    seen = {}
    # the profiles don't matter here
    none = spark.createDataFrame([], "profile_id bigint, seq string, base_counts array<bigint>")
    monkeypatch.setattr(whole, "profiles_of", lambda *_: none)
    real = whole.mapping.gapped_hits
    monkeypatch.setattr(whole.mapping, "gapped_hits", lambda q, *a: seen.update({r["query"]: r["cnt"] for r in q.collect()}) or real(q, *a))
    registry.QUERIES["approximate_hits"](spark, small)
    assert seen == {k: c for k, c in rows if c < whole.LEAST}


@pytest.mark.parametrize("name", ["cycles", "exact_profiles", "approximate_hits", "position_vectors", "called_peaks", "bubbles", "gapped_hits"])
def test_graph_queries_end(spark, small, name):
    registry.QUERIES[name](spark, small).count()


@pytest.mark.parametrize("name", sorted(FIXTURES))
def test_planted(spark, small, oracle, name):
    f, sql = FIXTURES[name]
    got, want = normal(f(spark, small).toPandas()), normal(oracle.sql(sql).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)
