"""Registered queries of scans, sinks and operators that the tables exercise too little, beside their SQL.

Scans and sinks are checked by writing a table's rows and reading them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakmill.functions import distances, kernels
from peakmill.functions import sequence as S
from peakmill.operators import counts, graph, mapping, peaks, replicates, windows
from peakmill.plans.inputs import CORRECTED_SQL, K, READS_SQL, reads
from peakmill.plans.registry import _BENCH, _VERT, corrected, passages, query, vertices
from peakmill.runtime import materialize, scratch_path, table
from peakmill.sources import readers, writers


def count_text(c: str = "counts") -> F.Column:
    return S.counts_to_text(F.col(c))


# -- scans and sinks --
_SHAPE = "CAST(length(seq) AS BIGINT) AS size, md5(seq) AS digest"


def shape(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.length("seq").cast("bigint").alias("size"), F.md5("seq").alias("digest"))


@query("scan_fasta", f"WITH {READS_SQL} SELECT CAST(read_id AS VARCHAR) AS read_id, read_id || ' a>b ' || arm AS header, {_SHAPE} FROM reads")
def scan_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads as records of lines of seventy letters, written and read back; headers hold a ``>``."""
    path = scratch_path(spark, "scan") + ".fasta"
    header = F.concat(F.col("read_id").cast("string"), F.lit(" a>b "), F.col("arm"))
    folded = F.regexp_replace("seq", "(.{70})", "$1\n")
    reads(spark, sf_dir).select(writers.fasta_lines(header, folded)).write.text(path)
    return shape(readers.reads(spark, path), "read_id", "header")


@query("scan_fastq", f"WITH {READS_SQL} SELECT CAST(read_id AS VARCHAR) AS read_id, {_SHAPE} FROM reads WHERE seq <> ''")
def scan_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reads as gzip records with qualities that look like headers, written and read back."""
    path = scratch_path(spark, "scan") + ".fastq.gz"
    record = F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit(" x")), "seq", F.lit("+"), F.concat(F.lit("@"), F.expr("repeat('I', length(seq) - 1)")))
    reads(spark, sf_dir).where("seq <> ''").select(record).write.option("compression", "gzip").text(path)
    return shape(readers.reads(spark, path), "read_id")


@query("scan_pooled", f"WITH {READS_SQL} SELECT replicate, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS bases FROM reads GROUP BY replicate")
def scan_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm's reads in a place of their own, read as one."""
    found = []
    for name in ("treatment", "control"):
        path = scratch_path(spark, name) + ".fa"
        reads(spark, sf_dir).where(F.col("arm") == name).select(writers.fasta_lines(F.col("replicate").cast("string"), F.col("seq"))).write.text(path)
        found.append(readers.reads(spark, path))
    pooled = readers.pooled(found)
    return pooled.groupBy(F.col("read_id").cast("int").alias("replicate")).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases"))


@query("scan_experiment", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS replicate, n_name AS treatment, 'region ' || n_regionkey AS control FROM nation")
def scan_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "experiment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("fastq"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("control"))
    n.orderBy("n_nationkey").coalesce(1).drop("n_nationkey").write.option("sep", "\t").option("header", True).csv(path)
    return readers.experiment(spark, path)


_GRAMS = f"g AS (SELECT substr(b, i, {K}) AS kmer, count(*) AS cnt FROM (SELECT {_BENCH} AS b FROM benchmark), unnest(range(1, CAST(length(b) AS BIGINT) - {K} + 2)) u(i) GROUP BY ALL)"


def passage_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_kmers(passages(spark, sf_dir), K)


@query("scan_kmer_counts", f"WITH {_GRAMS} SELECT kmer, cnt FROM g")
def scan_kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "counts")
    passage_kmers(spark, sf_dir).write.option("sep", " ").csv(path)
    return readers.kmer_counts(spark, path)


@query("scan_assembled", f"WITH {_GRAMS} SELECT kmer AS seq, CAST(cnt AS INTEGER) AS cnt FROM g")
def scan_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "assembled")
    writers.assembled(passage_kmers(spark, sf_dir).withColumnRenamed("kmer", "seq"), path)
    return readers.sequence_counts(spark, path)


@query("scan_low_kmers", f"WITH {_GRAMS} SELECT kmer, cnt, count(*) AS n FROM g GROUP BY ALL")
def scan_low_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are numbered as they come; the numbers are unique."""
    path = scratch_path(spark, "low")
    writers.low_kmers(passage_kmers(spark, sf_dir), path)
    parts = F.split("read_id", "_count_")
    back = readers.fasta(spark, path).select(F.col("seq").alias("kmer"), parts[1].cast("bigint").alias("cnt"), parts[0].alias("row"))
    return back.groupBy("kmer", "cnt").agg(F.countDistinct("row").alias("n"))


@query("scan_profiles", f"WITH {_VERT} SELECT seq, string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY pos) AS counts FROM vc GROUP BY vid, seq")
def scan_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "profiles")
    writers.profiles(vertices(spark, sf_dir).select("seq", F.col("counts").alias("base_counts")), path)
    return readers.profiles(spark, path).select("seq", count_text("base_counts").alias("counts"))


@query("scan_first_counts", f"WITH {_VERT} SELECT seq, CAST(cnt AS INTEGER) AS cnt FROM vc WHERE pos = 0")
def scan_first_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "profiles")
    writers.profiles(vertices(spark, sf_dir).select("seq", F.col("counts").alias("base_counts")), path)
    return readers.first_counts(spark, path)


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as vertices; suppliers that ship them, signed, as neighbours. Ids are raised by one: zero carries no sign."""
    line = table(spark, sf_dir, "lineitem")
    sign = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    edges = line.select(((F.col("l_partkey") + 1) * sign).alias("src"), (F.col("l_suppkey") + 1).alias("dst")).distinct()
    return graph.shifted_ids(vertices(spark, sf_dir)), edges


_PART_EDGES = "e AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN -l_partkey - 1 ELSE l_partkey + 1 END AS src, l_suppkey + 1 AS dst FROM lineitem)"


@query(
    "scan_unitigs",
    f"WITH {_VERT} SELECT vid + 1 AS vid, seq, string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY pos) AS counts, CAST(sum(cnt) AS BIGINT) AS kc, abs(round(avg(cnt), 1) - avg(cnt)) <= 0.0500001 AS km_fits FROM vc GROUP BY vid, seq",
)
def scan_unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "unitigs")
    v, e = part_graph(spark, sf_dir)
    writers.unitigs(v, e, path)
    back, _ = readers.graph(spark, path)
    fits = F.abs(F.col("km") - F.col("kc") / F.size("counts")) <= 0.0500001
    return back.select("vid", "seq", count_text().alias("counts"), "kc", fits.alias("km_fits"))


@query("scan_edges", f"WITH {_PART_EDGES} SELECT src, dst FROM e")
def scan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "unitigs")
    writers.unitigs(*part_graph(spark, sf_dir), path)
    return readers.graph(spark, path)[1].select("src", "dst")


@query("scan_components", "SELECT coalesce(o_custkey, -1) AS comp_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM (SELECT CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 50 END AS o_custkey, o_orderkey FROM orders) GROUP BY ALL")
def scan_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder a component, one for all single vertices; the folder's name comes back as a column."""
    path = scratch_path(spark, "components")
    comp = F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 50)
    writers.components(table(spark, sf_dir, "orders").select(comp.alias("comp_id"), F.col("o_orderkey").alias("vid")), path)
    return spark.read.parquet(path).groupBy(F.col("comp_id").cast("bigint").alias("comp_id")).agg(F.count("*").alias("n"), F.sum("vid").alias("total"))


_ALL_HITS = "SELECT 'q' || l_orderkey AS query, l_partkey AS target, 100 - 50 * l_discount AS pident, CAST(l_quantity AS INTEGER) AS length, l_linenumber AS mismatch, 0 AS gapopen, 1 AS qstart, CAST(l_quantity AS INTEGER) AS qend, CAST(l_suppkey % 7 AS INTEGER) AS sstart, CAST(l_suppkey % 7 + l_quantity AS INTEGER) AS send, l_tax AS evalue, l_extendedprice AS bitscore FROM lineitem"


@query("scan_hits", _ALL_HITS)
def scan_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "hits")
    n = F.col("l_quantity").cast("int")
    at = (F.col("l_suppkey") % 7).cast("int")
    made = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("query"), F.col("l_partkey").alias("target"), (100 - 50 * F.col("l_discount")).alias("pident"), n.alias("length"),
        F.col("l_linenumber").alias("mismatch"), F.lit(0).alias("gapopen"), F.lit(1).alias("qstart"), n.alias("qend"), at.alias("sstart"), (at + n).alias("send"),
        F.col("l_tax").alias("evalue"), F.col("l_extendedprice").alias("bitscore"),
    )
    made.write.option("sep", "\t").csv(path)
    return readers.hits(spark, path).unionByName(readers.hits(spark, _empty(spark)))


def _empty(spark: SparkSession) -> str:
    """A place that holds an empty file."""
    path = scratch_path(spark, "empty")
    spark.createDataFrame([], "x string").write.text(path)
    return path


_LABEL = """CASE WHEN p < 1e-7 THEN '<1e-07' WHEN round(p * 1e7) < 1000 THEN regexp_replace(printf('%.2e', round(p, 7)), '(\\.[1-9]*[1-9])?\\.?0*e', '\\1e')
ELSE regexp_replace(printf('%.7f', round(p, 7)), '(\\.[0-9]+?)0+$', '\\1') END"""
_PVALUES = "v AS (SELECT event_id, value * value / 1e7 / (1 + event_id % 1000) AS p FROM events)"


def event_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("value") * F.col("value") / 1e7 / (1 + F.col("event_id") % 1000)
    return table(spark, sf_dir, "events").select("event_id", p.alias("pvalue"))


@query("pvalue_digits", f"WITH {_PVALUES} SELECT event_id, {_LABEL} AS label FROM v")
def pvalue_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole label, to the seventh decimal."""
    return event_pvalues(spark, sf_dir).select("event_id", S.pvalue_label(F.col("pvalue")).alias("label"))


@query("scan_peaks", f"WITH {_PVALUES} SELECT event_id, greatest(round(p, 7), 1e-7) AS pvalue, 'ACGT' AS seq FROM v")
def scan_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "peaks")
    writers.peaks(event_pvalues(spark, sf_dir).select(F.col("event_id").alias("profile_id"), F.lit(0).alias("peak_i"), F.lit("ACGT").alias("seq"), "pvalue"), path)
    return readers.peaks(spark, path).select(F.regexp_extract("read_id", "assembled_sq_([0-9]+)__peak_0__", 1).cast("bigint").alias("event_id"), F.round("pvalue", 7).alias("pvalue"), "seq")


@query(
    "scan_replicated",
    "SELECT CAST(n AS VARCHAR) || '_peak:' || n_regionkey || '_pval:0.25' AS header, s AS seq FROM (SELECT n_regionkey, n_name AS s, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS n FROM nation)",
)
def scan_replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as peaks: the first nation by name is the sequence, the others its variants."""
    path = scratch_path(spark, "replicated")
    names = F.array_sort(F.collect_list("n_name"))
    made = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("peak_i")).agg(names.alias("all"))
    writers.replicated(made.select("peak_i", F.lit(0.25).alias("pvalue"), F.col("all")[0].alias("seq"), F.expr("slice(all, 2, size(all))").alias("variants")), path)
    return readers.fasta(spark, path).select("header", "seq")


@query("scan_replaced", f"WITH {_VERT} SELECT 'count included' AS about, seq AS archived_sq, reverse(seq) AS mapped_to_sq, string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY pos) AS counts_from_total, '1' AS distance FROM vc GROUP BY vid, seq")
def scan_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "replaced")
    v = vertices(spark, sf_dir).select(F.lit("count included").alias("kind"), F.col("seq").alias("archived_seq"), F.reverse("seq").alias("mapped_to_seq"), "counts", F.lit(1).alias("edit_distance"))
    writers.replaced(v, path)
    return spark.read.option("sep", "\t").option("header", True).csv(path).withColumnRenamed("edit distance", "distance")


@query(
    "scan_base_profiles",
    "SELECT CAST(length(p_brand) AS INTEGER) AS size, CAST(i - 1 AS INTEGER) AS pos, substr(p_brand, i, 1) AS base, CAST(sum(p_size) AS BIGINT) AS weight FROM part, unnest(range(1, CAST(length(p_brand) AS BIGINT) + 1)) u(i) GROUP BY ALL",
)
def scan_base_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "profiles")
    brands = table(spark, sf_dir, "part").select(F.length("p_brand").alias("size"), F.col("p_brand").alias("seq"), F.col("p_size").cast("bigint").alias("cnt"))
    writers.base_profiles(mapping.base_profile(brands, "size"), path)
    return readers.base_profiles(spark, path)


@query("scan_overview", "SELECT p_partkey AS row_number, p_name AS sq, CAST(p_size AS VARCHAR) AS str_count, CAST(length(p_name) AS VARCHAR) AS length, p_type AS alignment FROM part")
def scan_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overview beside the alignments of its rows, joined by their number."""
    path = scratch_path(spark, "overview")
    p = table(spark, sf_dir, "part")
    mapping_rows = p.select("p_partkey", F.col("p_name").alias("sq"), F.col("p_size").alias("str_count"), F.length("p_name").alias("length"))
    writers.overview(replicates.overview_rows(mapping_rows, p.select("p_partkey", F.col("p_type").alias("alignment")), "p_partkey"), path)
    return spark.read.option("header", True).csv(path).withColumn("row_number", F.col("p_partkey").cast("bigint")).drop("p_partkey")


# -- projections, filters, functions --
@query(
    "edge_abundance",
    f"WITH {_VERT}, kept AS (SELECT vid + 1 AS vid FROM vc GROUP BY vc.vid HAVING sum(cnt) >= 40 AND max(cnt) >= 40), {_PART_EDGES} SELECT src, dst FROM e SEMI JOIN kept a ON a.vid = src SEMI JOIN kept b ON b.vid = dst",
)
def edge_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that the abundance filter of whole vertices leaves."""
    return graph.filter_simple(*part_graph(spark, sf_dir), 40)[1]


@query("signed_edges", f"WITH {_PART_EDGES} SELECT src, dst FROM e WHERE src < 0")
def signed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.same_sign(part_graph(spark, sf_dir)[1], -1)


@query("shifted_ids", "SELECT p_partkey + 1 AS vid, p_brand AS seq FROM part")
def shifted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shifted_ids(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vid"), F.col("p_brand").alias("seq")))


@query("long_profiles", "SELECT p_partkey AS profile_id FROM part WHERE length(p_name) >= 1.5 * 8")
def long_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("profile_id"), F.col("p_name").alias("seq"))
    every = peaks.long_enough(p, 8, 0.5)  # no fraction over one: nothing goes
    return peaks.long_enough(every, 8, 1.5).select("profile_id")


_CUT = f"{_VERT}, w AS (SELECT vid, pos, seq, cnt, p_size % 4 AS a, p_size % 4 + p_size % 9 AS z FROM vc JOIN part ON p_partkey = vid)"


def cut_vertices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = vertices(spark, sf_dir).select(F.col("vid").alias("profile_id"), "seq", "counts")
    a = F.col("p_size") % 4
    return v, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("profile_id"), F.lit(0).alias("peak_i"), a.alias("start"), (a + F.col("p_size") % 9).alias("end"))


@query(
    "captured_counts",
    f"WITH {_CUT} SELECT vid AS profile_id, any_value(substr(seq, CAST(a + 1 AS BIGINT), CAST(z - a AS BIGINT))) AS seq, CAST(min(cnt) AS INTEGER) AS cnt FROM w WHERE z - a > 2 AND z - a < 7 AND pos >= a AND pos < z GROUP BY vid",
)
def captured_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of profiles by range with their least count; too short and too long ones go."""
    found = peaks.captured(*cut_vertices(spark, sf_dir), min_size=2, max_size=7)
    return found.where("cnt is not null").select("profile_id", "seq", "cnt")


@query(
    "captured_means",
    f"WITH {_CUT} SELECT vid AS profile_id, round(avg(cnt), 6) AS mean FROM w WHERE z - a > 2 AND pos >= a AND pos < z GROUP BY vid",
)
def captured_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = peaks.captured(*cut_vertices(spark, sf_dir), min_size=2, how="mean")
    return found.where("cnt is not null").select("profile_id", F.round("cnt", 6).alias("mean"))


_ALIKE = "s AS (SELECT p_brand, p_type, CAST(sum(p_size % 5) AS BIGINT) AS cnt FROM part GROUP BY ALL)"


def by_brand(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("profile_id"), F.col("p_type").alias("seq")).agg(F.sum(F.col("p_size") % 5).cast("bigint").alias("cnt"))
    rows_ = made.select("profile_id", "seq", F.expr("transform(sequence(1, length(seq)), i -> cnt)").alias("counts"))
    return rows_, made.select("profile_id").distinct().select("profile_id", F.lit(0).alias("peak_i"), F.lit(0).alias("start"), F.lit(4).alias("end"))


@query("weighted_repeats", f"WITH {_ALIKE} SELECT p_brand AS profile_id, substr(p_type, 1, 4) AS seq, CAST(sum(cnt) AS BIGINT) AS copies FROM s WHERE cnt >= 1 GROUP BY ALL")
def weighted_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences repeated by their counts."""
    return peaks.weighted_output(*by_brand(spark, sf_dir), mode="meme").groupBy("profile_id", "seq").agg(F.count("*").alias("copies"))


@query("weighted_consensus", f"WITH {_ALIKE} SELECT p_brand AS profile_id, seq FROM (SELECT p_brand, substr(p_type, 1, 4) AS seq, row_number() OVER (PARTITION BY p_brand ORDER BY cnt DESC, substr(p_type, 1, 4) DESC) AS n FROM s) WHERE n = 1")
def weighted_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks.weighted_output(*by_brand(spark, sf_dir)).select("profile_id", "seq")


_NEAR = "n AS (SELECT l_orderkey AS query, l_partkey AS profile_id, l_linenumber AS s, l_quantity AS mean, CAST(7 + l_orderkey % 50 AS BIGINT) AS cnt FROM lineitem)"


def near_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query"), (7 + F.col("l_orderkey") % 50).cast("bigint").alias("cnt"), F.col("l_partkey").alias("profile_id"), F.col("l_linenumber").cast("bigint").alias("start"),
        (F.col("l_linenumber") + 5).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("distance"), F.col("l_quantity").alias("mean"),
    )


@query(
    "shared_contributions",
    f'WITH {_NEAR}, r AS (SELECT *, CAST(round_even(mean * cnt / sum(mean) OVER (PARTITION BY query), 0) AS BIGINT) AS add FROM n) SELECT profile_id, CAST(s AS BIGINT) AS "start", CAST(s + 5 AS BIGINT) AS "end", add FROM r WHERE add > 0',
)
def shared_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of queries shared among their nearest profiles; shares of nothing go."""
    return mapping.contributions(near_rows(spark, sf_dir))


@query(
    "largest_contribution",
    f'WITH {_NEAR} SELECT profile_id, CAST(s AS BIGINT) AS "start", CAST(s + 5 AS BIGINT) AS "end", cnt AS add FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY mean DESC, profile_id, s) AS nth FROM n) WHERE nth = 1',
)
def largest_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.contributions(near_rows(spark, sf_dir), "max")


@query("unwrapped_kmers", f"WITH {_VERT} SELECT vid, CAST(pos AS INTEGER) AS pos, kmer, CAST(cnt AS INTEGER) AS cnt, CASE WHEN pos + 1 = count(*) OVER (PARTITION BY vid) THEN -1 ELSE CAST(pos + 1 AS INTEGER) END AS next FROM (SELECT vc.vid, vc.pos, substr(seq, vc.pos + 1, 5) AS kmer, cnt FROM vc)")
def unwrapped_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices as chains of their k-mers."""
    nodes, edges = graph.unwrapped(vertices(spark, sf_dir), 5)
    return nodes.join(edges, ["vid", "pos"], "left").select("vid", "pos", "kmer", "cnt", F.coalesce("next", F.lit(-1)).alias("next"))


@query(
    "expanded_strands",
    f"WITH {_VERT}, a AS (SELECT vid, seq, string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY pos) AS counts, string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY pos DESC) AS turned FROM vc GROUP BY vid, seq) SELECT vid, seq, counts FROM a UNION ALL SELECT -vid, reverse(translate(seq, 'ACGT', 'TGCA')), turned FROM a",
)
def expanded_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.expand_strands(vertices(spark, sf_dir).select("vid", "seq", "counts")).select("vid", "seq", count_text().alias("counts"))


@query(
    "path_spelling",
    f"WITH p AS (SELECT {_BENCH} AS seq, item_id FROM benchmark) SELECT item_id, seq FROM p",
)
def path_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole passages cut into parts that overlap by seven letters, and put together again."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("seq") - 7), F.lit(8))
    parts = F.transform(starts, lambda i: F.substring("seq", i, F.lit(15)))
    return passages(spark, sf_dir).select("item_id", S.overlap_join(parts, 8).alias("seq"))


@query("hashed_names", "SELECT s_suppkey, substr(sha256(s_name || '|' || s_nationkey), 1, 8) AS name FROM supplier")
def hashed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.name_of(F.col("s_name"), F.col("s_nationkey").cast("string")).alias("name"))


@query("row_batches", "SELECT p_partkey // 64 AS batch, count(*) AS n FROM part GROUP BY 1")
def row_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(S.batches(F.col("p_partkey"), 64).alias("batch")).agg(F.count("*").alias("n"))


@query(
    "gapped_consensus",
    "SELECT a.n_nationkey AS a, b.n_nationkey AS b, string_agg(CASE WHEN substr(a.n_name, i, 1) = substr(b.n_name, i, 1) THEN substr(a.n_name, i, 1) ELSE '.' END, '' ORDER BY i) AS seq FROM nation a JOIN nation b ON length(a.n_name) = length(b.n_name) AND a.n_nationkey < b.n_nationkey, unnest(range(1, CAST(length(a.n_name) AS BIGINT) + 1)) u(i) GROUP BY ALL",
)
def gapped_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("size", F.length("n_name"))
    a = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "size")
    b = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "size")
    marks = F.array_join(F.transform(F.sequence(F.lit(1), F.length("x")), lambda i: F.when(F.substring("x", i, F.lit(1)) == F.substring("y", i, F.lit(1)), "|").otherwise(".")), "")
    return a.join(b, "size").where("a < b").select("a", "b", S.merge_match(F.col("x"), F.col("y"), marks).alias("seq"))


@query(
    "query_and_target",
    "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN length(a.n_name) < length(b.n_name) THEN a.n_name ELSE b.n_name END AS query, CASE WHEN length(a.n_name) < length(b.n_name) THEN b.n_name ELSE a.n_name END AS target, CASE WHEN length(a.n_name) < length(b.n_name) THEN 0 ELSE 1 END AS flag FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
)
def query_and_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "n_regionkey")
    b = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "n_regionkey")
    return a.join(b, "n_regionkey").withColumn("r", S.query_and_target(F.col("x"), F.col("y"))).select("a", "b", "r.query", "r.target", "r.flag")


@query(
    "sliding_hamming",
    """SELECT r_regionkey, n_nationkey, min(d) AS places FROM (SELECT r_regionkey, n_nationkey, i, CAST(len(list_filter(range(1, length(r_name) + 1), lambda j: substr(r_name, j, 1) <> substr(n_name, i + j - 1, 1))) AS INTEGER) AS d
    FROM region JOIN nation ON length(n_name) >= length(r_name), unnest(range(1, CAST(length(n_name) - length(r_name) AS BIGINT) + 2)) u(i)) GROUP BY ALL""",
)
def sliding_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "region").crossJoin(table(spark, sf_dir, "nation")).where("length(n_name) >= length(r_name)")  # 5 by 25 rows
    return pairs.select("r_regionkey", "n_nationkey", S.sliding_hamming(F.col("n_name"), F.col("r_name")).alias("places"))


@query(
    "infix_distances",
    "SELECT r_regionkey, n_nationkey, min(least(levenshtein(r_name, substr(n_name, i, j)), length(r_name))) AS distance FROM region, nation, unnest(range(1, 30)) u(i), unnest(range(1, 30)) v(j) WHERE i <= length(n_name) AND i + j - 1 <= length(n_name) GROUP BY ALL",
)
def infix_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of each region's name to its nearest part of each nation's."""

    def run(frames):
        for f in frames:
            f["distance"] = distances.infix_distances(f["r_name"].tolist(), f["n_name"].tolist())[0]
            yield f[["r_regionkey", "n_nationkey", "distance"]]

    pairs = table(spark, sf_dir, "region").crossJoin(table(spark, sf_dir, "nation"))  # 5 by 25 rows
    return pairs.select("r_regionkey", "n_nationkey", "r_name", "n_name").mapInPandas(run, "r_regionkey int, n_nationkey int, distance bigint")


@query(
    "alignments",
    "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS distance, a.n_name AS x, b.n_name AS y, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS steps FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
)
def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global alignments: as many steps as the distance, and both strings again without their gaps."""

    def run(frames):
        for f in frames:
            made = []
            for a, b, x, y in f[["a", "b", "x", "y"]].itertuples(index=False):
                d, ops = kernels.global_alignment(x, y)
                gx, marks, gy = kernels.render_alignment(x, y, ops)
                made.append((a, b, d, gx.replace("-", ""), gy.replace("-", ""), len(marks) - marks.count("|")))
            yield f.iloc[:0][["a", "b"]].reindex(range(len(made))).assign(**{c: [m[i] for m in made] for i, c in enumerate(["a", "b", "distance", "x", "y", "steps"])})

    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "n_regionkey")
    b = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", "x", "y").mapInPandas(run, "a int, b int, distance bigint, x string, y string, steps bigint")


@query(
    "significance_gate",
    "SELECT l_orderkey, l_linenumber % 3 AS segment, max(l_discount) FILTER (l_discount <= 0.1 / 2) AS pvalue FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_discount <= 0.1 / 2) >= 0.5 * count(*)",
)
def significance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts as p-values of pairs of samples: half of a segment's pairs must pass."""
    tests = table(spark, sf_dir, "lineitem").withColumn("segment", F.col("l_linenumber") % 3)
    return windows.significant(tests, ["l_orderkey", "segment"], "l_discount", 0.1, 2)


@query(
    "cumulative_offsets",
    "SELECT l_suppkey, l_orderkey, l_linenumber, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM lineitem",
)
def cumulative_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "lineitem").withColumn("size", F.col("l_quantity").cast("bigint"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]
    return windows.offsets(sized, ["l_suppkey"], order, "size").select("l_suppkey", "l_orderkey", "l_linenumber", "first")


# -- graphs --
@query("unitig_kmers", f"WITH {CORRECTED_SQL}, p AS MATERIALIZED (SELECT kmer FROM corrected GROUP BY kmer HAVING sum(cnt) >= 10), b AS (SELECT kmer FROM p UNION SELECT reverse(translate(kmer, 'ACGT', 'TGCA')) FROM p) SELECT kmer, 1 AS n FROM b")
def unitig_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-mers that the compacted graph spells, either way: each of the set's and of their complements, once."""
    common = corrected(spark, sf_dir).groupBy("kmer").agg(F.sum("cnt").alias("cnt")).where("cnt >= 10").select("kmer")
    v, _ = graph.unitigs(materialize(common, "common"))
    return v.select(F.explode(S.kmers(F.col("seq"), K)).alias("kmer")).groupBy("kmer").agg(F.count("*").cast("int").alias("n"))


# -- peaks --
