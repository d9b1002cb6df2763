"""Small planted inputs of graph and grouped operators, each with the rows that follow by hand, as SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from peakmill.functions import kernels
from peakmill.functions import sequence as S
from peakmill.operators import assembly, bubbles, graph, mapping, peaks, replicates
from peakmill.runtime import scratch_path
from peakmill.sources import writers
from peakmill.plans.planted import count_text

FIXTURES: dict = {}


def fixture(name: str, sql: str):
    def put(f):
        FIXTURES[name] = (f, sql)
        return f

    return put


def rows(**typed: list) -> str:
    """SQL for a list of rows, given column by column."""
    lines = zip(*typed.values(), strict=True)
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS {'BIGINT' if isinstance(v, int) else 'DOUBLE'})"
    body = ", ".join("(" + ", ".join(map(show, line)) + ")" for line in lines)
    return f"SELECT * FROM (VALUES {body}) v({', '.join(typed)})"


@fixture(
    "scan_dot",
    rows(comp_id=[1, 1, 1, 2], value=['"1" [label="4", penwidth=2.00];', '"2" [label="3", penwidth=15.00];', '"1" -> "2";', '"3" [label="3", penwidth=0.50];']),
)
def scan_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "dot")
    v = spark.createDataFrame([(1, 1, "ACGT", [1, 3]), (1, 2, "CGT", [99]), (2, 3, "AAA", [1])], "comp_id int, vid long, seq string, counts array<int>")
    e = spark.createDataFrame([(1, 1, 2)], "comp_id int, src long, dst long")
    writers.dot(v.withColumn("counts", F.when(F.col("vid") == 3, F.array(F.lit(1), F.lit(0))).otherwise(F.col("counts"))), e, path, 1.0)
    return spark.read.text(path).select(F.col("comp_id").cast("bigint").alias("comp_id"), "value")


@fixture("split_edges", rows(src=["TAC", "CCA"], dst=["ACG", "ACG"], counts=["9", "5,6"]))
def split_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX9 with one more vertex whose last k-mer survives: edges in and out of split vertices, by spelling."""
    v = spark.createDataFrame([(7, "ACGTACC", [5, 1, 6, 7, 0]), (8, "CCA", [9]), (9, "TAC", [9]), (10, "GGCCA", [1, 5, 6])], "vid long, seq string, counts array<int>")
    e = spark.createDataFrame([(9, 7), (7, 8), (10, 7), (9, 10)], "src long, dst long")
    made, kept = graph.split_low(v, e, 2, 3)
    name = lambda c, s: made.select(F.col("vid").alias(c), F.col("seq").alias(s), "counts")
    found = kept.join(name("src", "a"), "src").join(name("dst", "b").drop("counts"), "dst")
    return found.select(F.right("a", F.lit(3)).alias("src"), F.col("b").alias("dst"), count_text().alias("counts"))


@fixture("split_compat", rows(src=["TAC"], dst=["ACG"]))
def split_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, in the older way: edges out of a vertex with several runs are lost."""
    v = spark.createDataFrame([(7, "ACGTACC", [5, 1, 6, 7, 3]), (8, "CCA", [9]), (9, "TAC", [9])], "vid long, seq string, counts array<int>")
    e = spark.createDataFrame([(9, 7), (7, 8)], "src long, dst long")
    made, kept = graph.split_low(v, e, 2, 3, compat=True)
    name = lambda c, s: made.select(F.col("vid").alias(c), F.col("seq").alias(s))
    return kept.join(name("src", "a"), "src").join(name("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


@fixture("rank_test", rows(case_id=[1, 2, 3, 4], u=[9.0, 8.0, 2.0, 0.0], p=[0.0404278, 0.0786496, 1.0, 1.0]))
def rank_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX14 to FX16, and an empty sample."""
    cases = [(1, [12.0, 14.0, 15.0], [1.0, 2.0, 3.0]), (2, [12.0, 12.0, 15.0], [12.0, 3.0, 3.0]), (3, [5.0, 5.0], [5.0, 5.0]), (4, [], [1.0])]

    def run(frames):
        for f in frames:
            found = [kernels.mann_whitney_greater(x, y) for x, y in zip(f["x"], f["y"], strict=True)]
            yield f[["case_id"]].assign(u=[u for u, _ in found], p=[round(p, 7) for _, p in found])

    return spark.createDataFrame(cases, "case_id long, x array<double>, y array<double>").mapInPandas(run, "case_id long, u double, p double")


@fixture("unitig_fixture", rows(seq=["AAACC", "ACCG", "ACCT", "AGGT", "CGGT", "GGTTT"], links=["ACCG,ACCT", "", "", "GGTTT", "GGTTT", ""]))
def unitig_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fork, k = 4: one way in, two ways on, and the same from the other strand."""
    kmers_ = spark.createDataFrame([("AAAC",), ("AACC",), ("ACCG",), ("ACCT",)], "kmer string")
    v, e = graph.unitigs(kmers_)
    nexts = e.join(v.select(F.col("vid").alias("dst"), F.col("seq").alias("to")), "dst").groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("to")), ",").alias("links"))
    return v.join(nexts.withColumnRenamed("src", "vid"), "vid", "left").select("seq", F.coalesce("links", F.lit("")).alias("links"))


def bubble_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Two bubbles of one letter in a row, the second with equal counts at its middle, and a single vertex."""
    v = [
        (1, "AACCGT", [9, 9, 9], 1), (2, "CGTAGGAT", [9] * 5, 1), (3, "CGTTGGAT", [1] * 5, 1), (4, "GATCCA", [9, 9, 9], 1),
        (5, "CCAAGGCT", [7] * 5, 1), (6, "CCATGGCT", [2] * 5, 1), (7, "GCTTAC", [9, 9, 9], 1), (8, "TTTTT", [4, 4], 8),
    ]
    e = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7)]
    return spark.createDataFrame(v, "vid long, seq string, counts array<int>, comp_id long"), spark.createDataFrame(e, "src long, dst long")


@fixture("bubble_vertices", rows(vid=[1, 2, 4, 5, 7, 8], counts=["9,9,9", "10,10,10,10,10", "9,9,9", "9,9,9,9,9", "9,9,9", "4,4"]))
def bubble_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, _, _ = bubbles.split_result(bubbles.correct_components(*bubble_graph(spark), 4, 10))
    return left.select("vid", count_text().alias("counts"))


@fixture("bubble_edges", rows(src=[1, 2, 4, 5], dst=[2, 4, 5, 7]))
def bubble_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bubbles.split_result(bubbles.correct_components(*bubble_graph(spark), 4, 10))[1].select("src", "dst")


@fixture("bubble_archive", rows(kind=["count included"] * 2, archived_seq=["AACCGTTGGATCCA", "GATCCATGGCTTAC"], mapped_to_seq=["AACCGTAGGATCCA", "GATCCAAGGCTTAC"], counts=["1,1,1,1,1", "2,2,2,2,2"], edit_distance=[1, 1]))
def bubble_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants are archived as the whole way from where the two ways part to where they meet."""
    archived = bubbles.split_result(bubbles.correct_components(*bubble_graph(spark), 4, 10))[2]
    return archived.select("kind", "archived_seq", "mapped_to_seq", count_text().alias("counts"), "edit_distance")


def ring_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    v = [(i, "ACG", [1], 1) for i in range(1, 8)] + [(20, "ACG", [1], 20), (21, "ACG", [1], 20)]
    e = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (6, 7), (20, 21)]
    return spark.createDataFrame(v, "vid long, seq string, counts array<int>, comp_id long"), spark.createDataFrame(e, "src long, dst long")


_RING_EDGES = "e(src, dst) AS (VALUES (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (6, 7), (20, 21))"


@fixture(
    "planted_cycles",
    f"""WITH RECURSIVE {_RING_EDGES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
    twin AS (SELECT a.src AS v, min(a.dst) AS root FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)
    SELECT CAST(1 AS BIGINT) AS comp_id, count(*) AS cycle_size FROM twin GROUP BY root HAVING count(*) > 1""",
)
def planted_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.cycle_report(*ring_graph(spark))


@fixture("assembled_path", rows(comp_id=[1, 9], seq=["ACGTA", "TTTTT"], cnt=[4, 6]))
def assembled_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX12, and a single vertex, which gives its first count."""
    v = spark.createDataFrame([(1, "ACGT", [4, 4], 1), (2, "GTA", [4], 1), (9, "TTTTT", [6, 5, 6], None)], "vid long, seq string, counts array<int>, comp_id long")
    return assembly.assemble_components(v, spark.createDataFrame([(1, 2)], "src long, dst long"), 3)


@fixture("peeled_vertex", rows(seq=["ACGTA", "ACG", "GTA"], cnt=[1, 2, 1]))
def peeled_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX11: a vertex whose one neighbour is itself."""
    v = spark.createDataFrame([(1, "ACGTA", [3, 1, 2], 1)], "vid long, seq string, counts array<int>, comp_id long")
    return assembly.assemble_components(v, spark.createDataFrame([], "src long, dst long"), 3).select("seq", "cnt")


_TANGLE = [("ACGT", 5), ("CGTA", 3), ("GTAC", 3), ("TACG", 2), ("CGTC", 4), ("GTCA", 4), ("TCAA", 6)]


@fixture("assembly_totals", rows(kmer=[x for x, _ in _TANGLE], cnt=[n for _, n in _TANGLE]))
def assembly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring with a way out, k = 4: the k-mers of the assembled sequences, times their counts, are those that went in."""
    at = {x: i for i, (x, _) in enumerate(_TANGLE, 1)}
    v = spark.createDataFrame([(at[x], x, [n], 1) for x, n in _TANGLE], "vid long, seq string, counts array<int>, comp_id long")
    e = spark.createDataFrame([(at[a], at[b]) for a in at for b in at if a[1:] == b[:-1] and a != b], "src long, dst long")
    made = assembly.assemble_components(v, e, 4)
    return made.select(F.explode(S.kmers(F.col("seq"), 4)).alias("kmer"), "cnt").groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


@fixture("mapped_fixture", rows(seq=["AAACCC", "GGG", "TT"], counts=["14,14,14,17,16,13", "2,2,2", "1,1"]))
def mapped_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX10 in one component; a sequence of another stays apart."""
    made = [(1, "AAACCC", 10), (1, "AAAC", 4), (1, "GGG", 2), (1, "CC", 6), (2, "TT", 1)]
    return mapping.exact_profiles(spark.createDataFrame(made, "comp_id long, seq string, cnt long")).select("seq", count_text("base_counts").alias("counts"))


@fixture("hit_fixture", rows(counts=["8,8,8,5,5,5,5,5"]))
def hit_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX13: a query that hangs over its profile's first base."""
    profiles = spark.createDataFrame([(5, "ACGTACGT", [5] * 8)], "profile_id long, seq string, base_counts array<bigint>")
    hits = spark.createDataFrame([("q", 5, 2, 1)], "query string, target long, qstart int, sstart int")
    return mapping.add_hits(profiles, hits, spark.createDataFrame([("q", 3)], "query string, cnt long"), 4).select(count_text("base_counts").alias("counts"))


@fixture("cluster_fixture", rows(seq=["AAAA", "AAAT", "TTTA", "TTTT", "GG"], cluster=[0, 0, 2, 2, 0]))
def cluster_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete linkage below two differing places, within each length."""
    made = spark.createDataFrame([(s, 1) for s in ("TTTT", "AAAT", "AAAA", "TTTA", "GG")], "seq string, cnt long")
    return mapping.cluster_sequences(made, 2.0).select("seq", F.col("cluster").cast("bigint").alias("cluster"))


@fixture("nearest_fixture", rows(query=["ACGTTCGT", "CGTA"], profile_id=[5, 5], start=[0, 1], end=[7, 4], distance=[1, 0], mean=[5.0, 5.0]).replace("start", '"start"').replace("end,", '"end",'))
def nearest_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries within one edit of a part of a profile; one that lies nowhere near."""
    profiles = spark.createDataFrame([(5, "ACGTACGT", [5] * 8), (6, "GGGGGGGG", [9] * 8)], "profile_id long, seq string, base_counts array<bigint>")
    q = spark.createDataFrame([("ACGTTCGT", 4), ("CGTA", 2), ("TTTTTT", 1)], "query string, cnt long")
    return mapping.nearest_profiles(q, profiles, 1).select("query", "profile_id", "start", "end", "distance", "mean")


@fixture("hit_search", rows(query=["CGTACG", "CGTACC"], target=[5, 5], pident=[100.0, 100.0], length=[6, 5], sstart=[2, 2]))
def hit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of six letters of which five must be equal; the last one's differing end is not part of its hit."""
    profiles = spark.createDataFrame([(5, "ACGTACGT"), (6, "GGGGGGGG")], "profile_id long, seq string")
    q = spark.createDataFrame([("CGTACG",), ("CGTACC",), ("TTTTTT",)], "query string")
    return mapping.approximate_hits(q, profiles, 6, 83.0).select("query", "target", "pident", "length", "sstart")


@fixture("position_fixture", rows(pos=[0, 1, 2, 3], treat=[2.04, 2.04, 2.04, 2.02], ctrl=[0.0, 0.0, 0.0, 0.0]))
def position_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of two k-mers that takes half of one's count and all of the other's; nothing in the control."""
    profiles = spark.createDataFrame([(1, "ACGT", [2, 2, 2, 2])], "profile_id long, seq string, base_counts array<int>")
    treat = spark.createDataFrame([("ACG", 4), ("CGT", 2)], "kmer string, cnt long")
    made = peaks.position_vectors(profiles, treat, treat.limit(0), 3)
    return made.select(F.col("pos").cast("bigint").alias("pos"), F.round("treat", 6).alias("treat"), F.round("ctrl", 6).alias("ctrl"))


@fixture("curve_peaks", rows(a=[1, 22], b=[9, 30]))
def curve_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hills, four places around their tops or as far as the valley; a ripple on the second is not prominent."""
    curve = [0, 1, 3, 6, 9, 12, 9, 6, 3, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 4, 8, 11, 10, 12, 8, 4, 1, 0, 0, 0]

    def run(frames):
        for f in frames:
            found = kernels.peak_ranges(f["y"].iloc[0], 5.0, 4) if len(f) else []
            yield f.iloc[:0][[]].reindex(range(len(found))).assign(a=[a for a, _ in found], b=[b for _, b in found])

    made = spark.createDataFrame([([float(x) for x in curve],)], "y array<double>").mapInPandas(run, "a bigint, b bigint")
    return made.select("a", "b")


@fixture("planted_peak", rows(profile_id=[1], peak_i=[0], start=[30], end=[60], size=[30]).replace("start", '"start"').replace("end,", '"end",'))
def planted_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of treatment amid background is called whole; its mirror in the control is not."""
    y = [1.0] * 30 + [40.0] * 30 + [1.0] * 30
    positions = [(1, i, x + i % 3 * 0.1, 1.0 + i % 3 * 0.1) for i, x in enumerate(y)] + [(2, i, 1.0 + i % 3 * 0.1, x + i % 3 * 0.1) for i, x in enumerate(y)]
    profiles = spark.createDataFrame([(1, "ACG" * 30), (2, "TGA" * 30)], "profile_id long, seq string")
    made = peaks.call_peaks(spark.createDataFrame(positions, "profile_id long, pos int, treat double, ctrl double"), profiles, 10, 0.05, 2)
    return made.select("profile_id", "peak_i", "start", "end", F.length("seq").cast("bigint").alias("size"))


@fixture("planted_states", rows(profile_id=[1, 1, 1, 2], start=[0, 30, 60, 0], end=[30, 60, 90, 12], median=[1.1, 40.1, 1.1, 3.0]).replace("start", '"start"').replace("end,", '"end",'))
def planted_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states; a profile below 1.75 k is one segment."""
    y = [1.0] * 30 + [40.0] * 30 + [1.0] * 30
    positions = [(1, i, x + i % 3 * 0.1, 0.0) for i, x in enumerate(y)] + [(2, i, 3.0, 0.0) for i in range(12)]
    made = peaks.segment_profiles(spark.createDataFrame(positions, "profile_id long, pos int, treat double, ctrl double"), 10, 2)
    return made.select("profile_id", "start", "end", F.round("median", 4).alias("median"))


@fixture("replicate_fixture", rows(seq=["TTACGTACGTACGG"], pvalue=[0.03], variants=[0]))
def replicate_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX17, with a peak of the first replicate that nothing supports."""
    a = spark.createDataFrame([("TTACGTACGTACGG", 0.01), ("GGGGGGGGGGGGGG", 0.02)], "seq string, pvalue double")
    b = spark.createDataFrame([("ACGTACGTAC", 0.03)], "seq string, pvalue double")
    return replicates.reconcile([a, b]).select("seq", "pvalue", F.size("variants").cast("bigint").alias("variants"))


@fixture("tournament_fixture", rows(seq=["TTACGTACGTACGG"], pvalue=[0.04], members=["0:2:12,1:0:10,2:0:12"]))
def tournament_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three replicates, in pairs; each peak says which peaks it came from, and where in them."""
    a = spark.createDataFrame([("TTACGTACGTACGG", 0.01), ("GGGGGGGGGGGGGG", 0.02)], "seq string, pvalue double")
    b = spark.createDataFrame([("ACGTACGTAC", 0.03)], "seq string, pvalue double")
    c = spark.createDataFrame([("TACGTACGTACG", 0.04)], "seq string, pvalue double")
    made = replicates.tournament([a, b, c])
    of = F.transform("sources", lambda x: F.concat_ws(":", x["replicate"], x["start"], x["end"]))
    return made.select("seq", "pvalue", F.array_join(of, ",").alias("members"))
