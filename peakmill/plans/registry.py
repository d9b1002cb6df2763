"""Every registered query over whole tables, beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakmill.functions import sequence as S
from peakmill.operators import counts, graph, mapping, peaks, replicates, windows
from peakmill.operators.components import components
from peakmill.plans.inputs import BASES, CORRECTED_SQL, K, KMERS_SQL, LETTERS, READS_SQL, arm, reads
from peakmill.runtime import materialize, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_kmers(reads(spark, sf_dir), K, "arm", "replicate")


def both_arms(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """(replicate, kmer, treat, ctrl)."""
    return counts.count_arms(reads(spark, sf_dir), k, F.col("arm") == "treatment", "replicate")


def corrected(spark: SparkSession, sf_dir: str, keep_zero: bool = False, k: int = K) -> DataFrame:
    return counts.corrected_arms(both_arms(spark, sf_dir, k), "replicate", keep_zero=keep_zero)


# -- counting --
@query("kmer_count", f"WITH {KMERS_SQL} SELECT arm, replicate, kmer, count(*) AS cnt FROM kmers GROUP BY ALL")
def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir)


@query(
    "kmer_count_canonical",
    f"WITH {KMERS_SQL} SELECT replicate, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS cnt FROM kmers GROUP BY ALL",
)
def kmer_count_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_kmers(reads(spark, sf_dir), K, "replicate", both_strands=True)


@query("kmer_distinct", f"WITH {KMERS_SQL} SELECT DISTINCT replicate, kmer FROM kmers")
def kmer_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.distinct_kmers(reads(spark, sf_dir), K, "replicate")


@query("control_scale", f"WITH {CORRECTED_SQL} SELECT replicate, round(scale, 6) AS scale FROM scale")
def control_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.arms_scale(both_arms(spark, sf_dir).where("treat > 0"), "replicate").select("replicate", F.round("scale", 6).alias("scale"))


@query("control_subtract", f"WITH {CORRECTED_SQL} SELECT replicate, kmer, cnt FROM corrected WHERE cnt > 0")
def control_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrected(spark, sf_dir)


@query("low_abundance", f"WITH {CORRECTED_SQL} SELECT replicate, kmer, cnt FROM corrected WHERE cnt > 0 AND cnt < 3")
def low_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.low_abundance(corrected(spark, sf_dir, keep_zero=True), 3)


@query("mapping_kmers", f"WITH {CORRECTED_SQL} SELECT replicate, kmer, cnt FROM corrected WHERE cnt >= 10")
def mapping_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.abundant(corrected(spark, sf_dir), 10)


@query(
    "present_kmers",
    f"WITH {CORRECTED_SQL} SELECT replicate, kmer, cnt FROM corrected WHERE cnt > 0 AND cnt < 3 UNION ALL SELECT replicate, kmer, cnt FROM corrected WHERE cnt >= 3",
)
def present_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = corrected(spark, sf_dir)
    return counts.present_kmers(counts.low_abundance(every, 3), counts.abundant(every, 3))


_BENCH = f"translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), '{LETTERS}', '{BASES}')"


@query(
    "counted_subset",
    f"""WITH {READS_SQL}, b AS (SELECT {_BENCH} AS seq FROM benchmark),
    keys AS (SELECT DISTINCT substr(seq, i, {K}) AS kmer FROM b, unnest(range(1, CAST(length(seq) AS BIGINT) - {K} + 2)) u(i)),
    k AS (SELECT substr(seq, i, {K}) AS kmer FROM reads, unnest(range(1, CAST(length(seq) AS BIGINT) - {K} + 2)) u(i)),
    n AS (SELECT kmer, count(*) AS cnt FROM k GROUP BY kmer)
    SELECT kmer, coalesce(cnt, 0) AS cnt FROM keys LEFT JOIN n USING (kmer)""",
)
def counted_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_listed(reads(spark, sf_dir), counts.distinct_kmers(passages(spark, sf_dir), K), K)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.translate(F.regexp_replace("text", "[^a-zA-Z]", ""), LETTERS, BASES)
    return table(spark, sf_dir, "benchmark").select("item_id", seq.alias("seq"))


@query(
    "min_abundance",
    f"WITH {KMERS_SQL} SELECT replicate, CAST(ceil(quantile_cont(CAST(cnt AS DOUBLE), 0.95)) AS BIGINT) AS min_abundance FROM t GROUP BY replicate",
)
def min_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = arm(counted(spark, sf_dir), "treatment").withColumn("km", F.col("cnt").cast("double"))
    return counts.minimal_abundance(t, 95.0, "replicate")


_OUTER = f"""{KMERS_SQL},
s AS (SELECT replicate, 0.99 * sum(treat) / sum(ctrl) AS scale FROM arms GROUP BY replicate),
r AS (SELECT replicate, kmer, treat, ctrl * scale AS ctrl, greatest(treat - ctrl * scale, 0) AS recon FROM arms JOIN s USING (replicate))"""


@query("counts_outer", f"WITH {KMERS_SQL} SELECT replicate, kmer, treat, ctrl FROM arms")
def counts_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_arms(spark, sf_dir)


@query("kmer_reconstruction", f"WITH {_OUTER} SELECT replicate, kmer, treat, round(ctrl, 4) AS ctrl, round(recon, 4) AS reconstruction FROM r")
def kmer_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = counts.reconstruction(counts_outer(spark, sf_dir), "replicate")
    return both.select("replicate", "kmer", "treat", F.round("ctrl", 4).alias("ctrl"), F.round("reconstruction", 4).alias("reconstruction"))


@query(
    "kmer_fraction",
    f"""WITH {_OUTER},
    f AS (SELECT replicate, kmer, CASE WHEN recon = 0 THEN 'Infinity'::DOUBLE ELSE treat / recon + 0.01 END AS frac, treat FROM r WHERE treat > 0)
    SELECT replicate, kmer, round(frac, 4) AS frac, round(treat * frac, 4) AS treat_frac FROM f""",
)
def kmer_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = materialize(both_arms(spark, sf_dir), "arms")
    both = counts.reconstruction(every, "replicate")
    used = every.where("treat > 0").select("replicate", "kmer", F.col("treat").alias("used"))
    parts = counts.kmer_fractions(used, both, ["replicate", "kmer"])
    return parts.select("replicate", "kmer", F.round("frac", 4).alias("frac"), F.round("treat_frac", 4).alias("treat_frac"))


@query(
    "missing_neighbours",
    f"""WITH {KMERS_SQL},
    p AS MATERIALIZED (SELECT DISTINCT {" + ".join(f"(strpos('ACGT', substr(kmer, {i + 1}, 1)) - 1) * {4 ** (K - 1 - i)}" for i in range(K))} AS code FROM t),
    n AS (SELECT (code * 4 + b) % {4 ** K} AS code FROM p, range(0, 4) r(b) UNION SELECT code // 4 + b * {4 ** (K - 1)} FROM p, range(0, 4) r(b))
    SELECT {" || ".join(f"substr('ACGT', CAST(code // {4 ** (K - 1 - i)} % 4 + 1 AS BIGINT), 1)" for i in range(K))} AS kmer FROM n ANTI JOIN p USING (code)""",
)
def missing_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = reads(spark, sf_dir).where("arm = 'treatment'")
    return counts.missing_neighbours(materialize(counts.distinct_kmers(t, K), "present"))


# -- sequences --
@query(
    "reverse_complements",
    f"""WITH {READS_SQL} SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS turned, reverse(translate(seq, 'ACGT', 'TCCA')) AS turned_compat, CAST(length(seq) AS BIGINT) AS size FROM reads""",
)
def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    return reads(spark, sf_dir).select(
        "read_id", S.reverse_complement(s).alias("turned"), S.reverse_complement(s, compat=True).alias("turned_compat"), F.length(s).cast("bigint").alias("size")
    )


@query(
    "signed_ids",
    "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN '+:' ELSE '-:' END || o_custkey AS code, CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE -o_custkey END AS vid FROM orders",
)
def signed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vid = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).otherwise(-F.col("o_custkey"))
    coded = table(spark, sf_dir, "orders").select("o_orderkey", S.encode_id(vid).alias("code"))
    return coded.withColumn("vid", S.decode_id(F.col("code")))


@query("pvalue_labels", "SELECT event_id, CASE WHEN value / 1e9 < 1e-7 THEN '<1e-07' ELSE 'larger' END AS label FROM events")
def pvalue_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = S.pvalue_label(F.col("value") / 1e9)
    return table(spark, sf_dir, "events").select("event_id", F.when(label == "<1e-07", label).otherwise("larger").alias("label"))


@query(
    "edit_distance_pairs",
    "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS distance, round(1 - 2.0 * levenshtein(a.n_name, b.n_name) / (length(a.n_name) + length(b.n_name)), 6) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
)
def edit_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "n_regionkey")
    b = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "n_regionkey")
    d = F.levenshtein("x", "y")
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", d.cast("bigint").alias("distance"), F.round(S.similarity(d, F.col("x"), F.col("y")), 6).alias("similarity"))


@query(
    "hamming_pairs",
    """SELECT a.n_nationkey AS a, b.n_nationkey AS b, len(list_filter(range(1, length(a.n_name) + 1), lambda i: substr(a.n_name, i, 1) <> substr(b.n_name, i, 1))) AS places, CAST(a.n_name <> b.n_name AS INTEGER) AS places_compat
    FROM nation a JOIN nation b ON length(a.n_name) = length(b.n_name) AND a.n_nationkey < b.n_nationkey""",
)
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("size", F.length("n_name"))
    a = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "size")
    b = n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "size")
    x, y = F.col("x"), F.col("y")
    return a.join(b, "size").where("a < b").select("a", "b", S.hamming(x, y).cast("bigint").alias("places"), S.hamming(x, y, compat=True).alias("places_compat"))


@query(
    "base_codes",
    "WITH b AS (SELECT o_custkey, list_sort(list_distinct(list(substr('ACGT', CAST(o_orderkey % 4 + 1 AS BIGINT), 1)))) AS l FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE array_to_string(l, '') WHEN 'AG' THEN 'R' WHEN 'CT' THEN 'Y' WHEN 'CG' THEN 'S' WHEN 'AT' THEN 'W' WHEN 'GT' THEN 'K' WHEN 'AC' THEN 'M' WHEN 'CGT' THEN 'B' WHEN 'AGT' THEN 'D' WHEN 'ACT' THEN 'H' WHEN 'ACG' THEN 'V' WHEN 'ACGT' THEN 'N' ELSE array_to_string(l, '') END AS code FROM b",
)
def base_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.substring(F.lit("ACGT"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1))
    sets = table(spark, sf_dir, "orders").select("o_custkey", base.alias("b")).groupBy("o_custkey").agg(F.collect_set("b").alias("s"))
    return sets.select("o_custkey", S.iupac(F.col("s")).alias("code"))


# -- positions and blocks --
_USER = "ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as profiles: users, places by time, whole values."""
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value", pos.cast("bigint").alias("pos"))


_EV = f"e AS (SELECT user_id, event_id, ts, event_type, value, {_USER} - 1 AS pos FROM events)"


@query(
    "window_min_counts",
    f"WITH {_EV}, m AS (SELECT user_id, pos - 2 AS pos, min(value) OVER (PARTITION BY user_id ORDER BY pos ROWS 2 PRECEDING) AS low FROM e) SELECT user_id, pos, round(low, 4) AS low FROM m WHERE pos >= 0",
)
def window_min_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = by_user(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("v"))
    return lists.select("user_id", F.posexplode(S.window_min(F.col("v"), 3)).alias("pos", "low")).select("user_id", F.col("pos").cast("bigint").alias("pos"), F.round("low", 4).alias("low"))


@query(
    "base_coverage",
    f"""WITH {_EV}, n AS (SELECT user_id, max(pos) AS n FROM e GROUP BY user_id),
    g AS (SELECT user_id, i AS pos FROM n, unnest(range(0, n + 5)) u(i))
    SELECT user_id, g.pos, round(max(e.value), 4) AS value FROM g JOIN e USING (user_id) WHERE e.pos BETWEEN g.pos - 4 AND g.pos GROUP BY ALL""",
)
def base_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.base_coverage(by_user(spark, sf_dir), "user_id", "pos", ["value"], 5).select("user_id", "pos", F.round("value", 4).alias("value"))


_BLOCKS = f"""{_EV}, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS ch FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
b AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY pos) - 1 AS block FROM c),
blocks AS (SELECT user_id, CAST(block AS BIGINT) AS block, any_value(event_type) AS event_type, CAST(min(pos) AS BIGINT) AS "start", CAST(max(pos) + 1 AS BIGINT) AS "end" FROM b GROUP BY user_id, block)"""


@query("run_blocks", f'WITH {_BLOCKS} SELECT user_id, block, event_type, "start", "end" FROM blocks')
def run_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.run_blocks(by_user(spark, sf_dir), "user_id", "pos", "event_type")
    return made.select("user_id", F.col("block").cast("bigint").alias("block"), "event_type", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query(
    "smooth_states",
    f"""WITH {_BLOCKS}, n AS (SELECT *, lag(event_type) OVER w AS a, lead(event_type) OVER w AS z FROM blocks WINDOW w AS (PARTITION BY user_id ORDER BY block))
    SELECT user_id, block, CASE WHEN "end" - "start" > 1 THEN event_type WHEN a IS NULL AND z IS NOT NULL THEN z WHEN z IS NULL AND a IS NOT NULL THEN a WHEN a = z THEN a ELSE event_type END AS event_type, "start", "end" FROM n""",
)
def smooth_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.smooth_blocks(run_blocks(spark, sf_dir), "user_id", "event_type", 1).select("user_id", "block", "event_type", "start", "end")


_RANGES = "r AS (SELECT l_suppkey, l_partkey AS lo, l_partkey + CAST(l_quantity AS BIGINT) AS hi FROM lineitem)"


@query(
    "merge_ranges",
    f"""WITH {_RANGES}, m AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY l_suppkey ORDER BY lo, hi) = 1 THEN 1 ELSE 0 END AS n FROM r),
    g AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM m)
    SELECT l_suppkey, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY l_suppkey, i""",
)
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("hi"))
    return windows.merged_ranges(rows, "l_suppkey", "lo", "hi").select("l_suppkey", "lo", "hi")


@query(
    "rolling_mean",
    f"WITH {_EV}, m AS (SELECT user_id, event_id, pos, avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS 4 PRECEDING) AS mean FROM e) SELECT user_id, event_id, round(mean, 4) AS mean FROM m WHERE pos >= 4",
)
def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolling_mean(by_user(spark, sf_dir), "user_id", ["pos"], "value", 5).select("user_id", "event_id", F.round("mean", 4).alias("mean"))


@query(
    "blurred_segments",
    f"""WITH {_EV}, s AS (SELECT user_id, pos, max(CAST(event_type = 'purchase' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS o FROM e),
    i AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM s WHERE o = 1)
    SELECT user_id, CAST(min(pos) AS BIGINT) AS "start", CAST(max(pos) + 1 AS BIGINT) AS "end" FROM i GROUP BY user_id, g""",
)
def blurred_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_user(spark, sf_dir).withColumn("covered", (F.col("event_type") == "purchase").cast("int"))
    made = windows.blurred_segments(rows, "user_id", "pos", "covered")
    return made.select("user_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


@query("segment_median", "SELECT user_id, event_type, round(median(value), 4) AS median FROM events GROUP BY ALL HAVING median(value) >= 10")
def segment_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.median_gate(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", 10).select("user_id", "event_type", F.round("median", 4).alias("median"))


@query(
    "mwu_u_statistic",
    """WITH r AS (SELECT event_type, user_id % 2 = 0 AS f, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY event_type, value) AS ties FROM events),
    a AS (SELECT event_type, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, coalesce(sum(rk) FILTER (f), 0) AS r, sum(ties * ties - 1) AS t FROM r GROUP BY event_type)
    SELECT event_type, n1, n2, r - n1 * (n1 + 1) / 2.0 AS u, round(1 - CAST(t AS DOUBLE) / (CAST(n1 + n2 AS DOUBLE) ** 3 - (n1 + n2)), 9) AS tie FROM a""",
)
def mwu_u_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "value", (F.col("user_id") % 2 == 0).alias("f"))
    return windows.u_statistic(rows, ["event_type"], "f", "value").select("event_type", "n1", "n2", "u", F.round("tie", 9).alias("tie"))


@query(
    "best_hit",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1",
)
def best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    order: list[Column] = [F.col("l_quantity").desc(), F.col("l_extendedprice").desc(), F.col("l_linenumber")]
    return windows.best_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "top_gates",
    "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3",
)
def top_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    order: list[Column] = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return windows.top_per_key(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order).select("l_suppkey", "l_orderkey", "l_linenumber")


_HITS = "h AS (SELECT l_orderkey AS query, l_partkey AS target, 100 - 50 * l_discount AS pident, CAST(l_quantity AS BIGINT) AS length, l_linenumber AS qstart, CAST(l_suppkey % 7 AS INTEGER) AS sstart FROM lineitem)"


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("target"), (100 - 50 * F.col("l_discount")).alias("pident"), F.col("l_quantity").cast("bigint").alias("length"), F.col("l_linenumber").alias("qstart"), (F.col("l_suppkey") % 7).cast("int").alias("sstart")
    )


@query("hit_filter", f"WITH {_HITS} SELECT query, target, qstart, length FROM h WHERE pident * length / 100 >= CAST(90.0 AS DOUBLE) / 100 * 30")
def hit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.passing_hits(line_hits(spark, sf_dir), 30, 90.0).select("query", "target", "qstart", "length")


@query(
    "hit_offsets",
    f"WITH {_HITS} SELECT query, qstart, CAST(greatest(sstart - qstart, 0) AS BIGINT) AS abs_sstart, CAST(30 - abs(least(sstart - qstart, 0)) AS BIGINT) AS used_length FROM h",
)
def hit_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_hits(spark, sf_dir).withColumn("o", S.hit_offsets(F.col("qstart"), F.col("sstart"), 30))
    return rows.select("query", "qstart", F.col("o.abs_sstart").cast("bigint").alias("abs_sstart"), F.col("o.used_length").cast("bigint").alias("used_length"))


@query(
    "add_counts",
    f"""WITH {_HITS}, o AS (SELECT target, greatest(sstart - qstart, 0) AS a, 6 - abs(least(sstart - qstart, 0)) AS n, length AS cnt FROM h),
    g AS (SELECT p_partkey AS profile_id, CAST(i AS BIGINT) AS pos, CAST(p_size AS BIGINT) AS base FROM part, unnest(range(0, 10)) u(i)),
    s AS (SELECT target, i AS pos, sum(cnt) AS add FROM o, unnest(range(CAST(a AS BIGINT), CAST(a + greatest(n, 0) AS BIGINT))) u(i) GROUP BY ALL)
    SELECT profile_id, g.pos, CAST(base + coalesce(add, 0) AS BIGINT) AS cnt FROM g LEFT JOIN s ON s.target = g.profile_id AND s.pos = g.pos""",
)
def add_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("profile_id"), F.lit("ACGTACGTAC").alias("seq"), F.array_repeat(F.col("p_size").cast("bigint"), 10).alias("base_counts"))
    rows = line_hits(spark, sf_dir).where("6 - abs(least(sstart - qstart, 0)) > 0").withColumn("id", F.struct("query", "qstart", "target", "sstart"))
    hits = rows.select(F.col("id").alias("query"), "target", "qstart", "sstart").distinct()
    made = mapping.add_hits(profiles, hits, rows.groupBy(F.col("id").alias("query")).agg(F.sum("length").alias("cnt")), 6)
    return made.select("profile_id", F.posexplode("base_counts").alias("pos", "cnt")).select("profile_id", F.col("pos").cast("bigint").alias("pos"), "cnt")


@query(
    "proportional_share",
    "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity * 1000 / sum(l_quantity) OVER (PARTITION BY l_orderkey), 0) AS BIGINT) AS share FROM lineitem",
)
def proportional_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("amount", F.lit(1000.0))
    return windows.proportional_share(rows, ["l_orderkey"], "l_quantity", "amount").select("l_orderkey", "l_linenumber", "share")


# -- mapping --
@query(
    "exact_containment",
    "SELECT item_id AS pattern_id, doc_id AS target_id, count(*) AS places FROM (SELECT item_id, doc_id, unnest(list_filter(range(1, length(d.text) + 1), lambda i: substr(d.text, i, length(b.text)) = b.text)) FROM benchmark b JOIN documents d ON contains(d.text, b.text)) GROUP BY ALL",
)
def exact_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("seq"))
    targets = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("target_id"), F.col("text").alias("seq")))
    return mapping.containment(patterns, targets).groupBy("pattern_id", "target_id").agg(F.count("start").alias("places"))


@query(
    "base_profile",
    "SELECT CAST(length(p_brand) AS INTEGER) AS size, CAST(i - 1 AS INTEGER) AS pos, substr(p_brand, i, 1) AS base, CAST(sum(p_size) AS BIGINT) AS weight FROM part, unnest(range(1, CAST(length(p_brand) AS BIGINT) + 1)) u(i) GROUP BY ALL",
)
def base_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.length("p_brand").alias("size"), F.col("p_brand").alias("seq"), F.col("p_size").cast("bigint").alias("cnt"))
    return mapping.base_profile(rows, "size")


_CONS = f"""{READS_SQL}, z AS (SELECT replicate, substr(seq, i, 1) AS base, i - 1 AS pos FROM reads, unnest(range(1, CAST(length(seq) AS BIGINT) + 1)) u(i)),
w AS (SELECT replicate, pos, base, count(*) AS weight FROM z GROUP BY ALL),
m AS (SELECT replicate, pos, base, row_number() OVER (PARTITION BY replicate, pos ORDER BY weight DESC, base) AS n FROM w)"""


@query("consensus", f"WITH {_CONS} SELECT replicate, string_agg(base, '' ORDER BY pos) AS seq FROM m WHERE n = 1 GROUP BY replicate")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).select("replicate", "seq", F.lit(1).cast("bigint").alias("cnt"))
    return mapping.consensus(mapping.base_profile(rows, "replicate"), "replicate")


@query("length_groups", "SELECT CAST(length(text) AS INTEGER) AS size, count(*) AS n, count(DISTINCT text) AS distinct_n FROM documents GROUP BY ALL")
def length_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.length_groups(table(spark, sf_dir, "documents"), "text")


@query("longest_reads", f"WITH {READS_SQL} SELECT read_id, CAST(length(seq) AS BIGINT) AS size FROM reads ORDER BY size DESC, read_id LIMIT 20")
def longest_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-20 report."""
    return reads(spark, sf_dir).select("read_id", F.length("seq").cast("bigint").alias("size")).orderBy(F.desc("size"), "read_id").limit(20)


# -- graphs --
_GRAPH = f"{CORRECTED_SQL}, p AS MATERIALIZED (SELECT DISTINCT kmer FROM corrected WHERE cnt >= 3)"


def graph_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(corrected(spark, sf_dir).where("cnt >= 3").select("kmer").distinct(), "kmers")


@query("debruijn_edges", f"WITH {_GRAPH} SELECT a.kmer AS src, b.kmer AS dst FROM p a JOIN p b ON substr(a.kmer, 2) = substr(b.kmer, 1, {K} - 1)")
def debruijn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.kmer_edges(graph_kmers(spark, sf_dir))


@query(
    "branching_vertices",
    f"WITH {_GRAPH} SELECT a.kmer AS vid, count(*) AS out_degree FROM p a JOIN p b ON substr(a.kmer, 2) = substr(b.kmer, 1, {K} - 1) GROUP BY a.kmer HAVING count(*) > 1",
)
def branching_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.branching(debruijn_edges(spark, sf_dir))


_ORDER_EDGES = "e AS (SELECT o_custkey % 500 AS src, o_orderkey % 500 AS dst, o_orderkey AS ord FROM orders)"


@query(
    "antiparallel",
    f"WITH {_ORDER_EDGES}, f AS (SELECT src, dst, ord, first_value(src) OVER w AS a, first_value(dst) OVER w AS b FROM e WHERE src <> dst WINDOW w AS (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ord, src, dst)) SELECT src, dst, ord FROM f WHERE src = a AND dst = b",
)
def antiparallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("src"), (F.col("o_orderkey") % 500).alias("dst"), F.col("o_orderkey").alias("ord"))
    return graph.without_antiparallel(rows, "ord")


@query(
    "edge_check",
    "WITH v AS (SELECT p_partkey AS vid, p_brand AS seq FROM part), e AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT src, dst FROM e JOIN v a ON a.vid = src JOIN v b ON b.vid = dst WHERE right(a.seq, 1) = right(b.seq, 1)",
)
def edge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.right("p_brand", F.lit(1))
    vertices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vid"), F.concat(last, F.col("p_brand")).alias("seq"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.checked_edges(vertices, edges, 2)


@query(
    "components",
    """WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
    SELECT node, min(seen) AS component FROM r GROUP BY node""",
)
def components_(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    a = table(spark, sf_dir, "supplier").select(name("s_suppkey", "s").alias("src"), name("s_nationkey", "n").alias("dst"))
    b = table(spark, sf_dir, "nation").select(name("n_nationkey", "n").alias("src"), name("n_regionkey", "r").alias("dst"))
    return components(a.unionByName(b))


_VERT = f"""v AS (SELECT p_partkey AS vid, translate(regexp_replace(p_name || p_type, '[^a-zA-Z]', '', 'g'), '{LETTERS}', '{BASES}') AS seq FROM part),
vk AS (SELECT vid, seq, i - 1 AS pos, substr(seq, i, 5) AS kmer FROM v, unnest(range(1, CAST(length(seq) AS BIGINT) - 3)) u(i)),
n AS (SELECT kmer, count(*) AS cnt FROM vk GROUP BY kmer), vc AS (SELECT vid, seq, pos, coalesce(cnt, 0) AS cnt FROM vk LEFT JOIN n USING (kmer))"""


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.translate(F.regexp_replace(F.concat("p_name", "p_type"), "[^a-zA-Z]", ""), LETTERS, BASES)
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vid"), seq.alias("seq"))
    return graph.linked_counts(v, counts.count_kmers(v, 5), 5)


@query("unitig_stats", f"WITH {_VERT} SELECT vid, CAST(sum(cnt) AS BIGINT) AS kc, round(avg(cnt), 6) AS km, string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY pos) AS counts FROM vc GROUP BY vid")
def unitig_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertices(spark, sf_dir).select("vid", "kc", F.round("km", 6).alias("km"), S.counts_to_text(F.col("counts")).alias("counts"))


_LEAST = 40


@query("abundance_simple", f"WITH {_VERT} SELECT vid FROM vc GROUP BY vid HAVING sum(cnt) >= {_LEAST} AND max(cnt) >= {_LEAST}")
def abundance_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "src bigint, dst bigint")
    return graph.filter_simple(vertices(spark, sf_dir), none, _LEAST)[0].select("vid")


@query(
    "unitig_split",
    f"""WITH {_VERT}, k AS (SELECT *, pos - row_number() OVER (PARTITION BY vid ORDER BY pos) AS g FROM vc WHERE cnt >= {_LEAST}),
    s AS (SELECT vid, min(pos) AS a, max(pos) AS b, any_value(seq) AS seq, string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY pos) AS counts FROM k GROUP BY vid, g)
    SELECT substr(seq, a + 1, b - a + 5) AS seq, counts, count(*) AS n FROM s GROUP BY ALL""",
)
def unitig_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "src bigint, dst bigint")
    made, _ = graph.split_low(vertices(spark, sf_dir).select("vid", "seq", "counts"), none, _LEAST, 5)
    return made.groupBy("seq", S.counts_to_text(F.col("counts")).alias("counts")).agg(F.count("*").alias("n"))


@query("coverage_stat", f"WITH {READS_SQL} SELECT CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(sum(length(seq) * replicate) AS BIGINT) AS explained, round(sum(length(seq) * replicate) / sum(length(seq)), 6) AS ratio FROM reads")
def coverage_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads(spark, sf_dir)
    return graph.coverage(r.select("seq", F.col("replicate").alias("cnt")), r).select("bases", "explained", F.round("ratio", 6).alias("ratio"))


@query("component_sizes", "WITH s AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey) SELECT size, count(*) AS components FROM s GROUP BY size")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_sizes(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("comp_id"), F.col("o_orderkey").alias("vid")))


@query(
    "forking_components",
    "WITH d AS (SELECT l_orderkey AS vid, count(*) AS d FROM lineitem GROUP BY 1) SELECT o_custkey AS comp_id, count(*) AS size, round(avg(CASE WHEN coalesce(d, 0) BETWEEN 2 AND 4 THEN 1 ELSE 0 END), 6) AS share FROM orders LEFT JOIN d ON vid = o_orderkey GROUP BY 1 HAVING count(*) >= 5 AND avg(CASE WHEN coalesce(d, 0) BETWEEN 2 AND 4 THEN 1 ELSE 0 END) >= 0.3",
)
def forking_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("comp_id"), F.col("o_orderkey").alias("vid"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("dst"))
    return graph.forking(labelled, edges, 5, 0.3).select("comp_id", "size", F.round("share", 6).alias("share"))


# -- iterative and grouped kernels: rows only --
#: k-mers of this summed count and above make the graph.
MIN_ABUNDANCE = 3


def summed(spark: SparkSession, sf_dir: str, k: int = K, least: int = 1, below: int | None = None) -> DataFrame:
    """(kmer, cnt): both replicates' corrected treatment together, from least on and below a count."""
    return counts.summed_corrected(reads(spark, sf_dir), k, F.col("arm") == "treatment", "replicate", least=least, below=below)


def graph_of(spark: SparkSession, sf_dir: str, k: int = K, least: int = MIN_ABUNDANCE) -> tuple[DataFrame, DataFrame]:
    """Unitigs of all k-mers of the minimal abundance in both replicates' corrected treatment, with counts and components."""
    v, e = graph.unitigs(summed(spark, sf_dir, k, least), counted=True)
    linked = v.select("vid", "seq", "counts")
    e = materialize(e, "edges")
    return materialize(graph.with_components(linked, e), "components"), e


@query("unitigs")
def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of(spark, sf_dir)[0]


@query(
    "infix_match",
    f"""WITH {READS_SQL},
    q AS (SELECT DISTINCT translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), '{LETTERS}', '{BASES}') AS query FROM benchmark),
    b AS (SELECT query, b * (length(query) // 3) AS o, least({mapping.SEED}, length(query) // 3) AS size FROM q, unnest(range(0, 3)) u(b) WHERE length(query) > 2),
    s AS MATERIALIZED (SELECT query, o, size, substr(query, o + 1, size) AS gram FROM b),
    g AS MATERIALIZED (SELECT read_id, size, i - 1 AS t, substr(seq, i, size) AS gram FROM reads, (SELECT DISTINCT size FROM s), unnest(range(1, CAST(length(seq) AS BIGINT) - size + 2)) u(i)),
    d AS MATERIALIZED (SELECT DISTINCT query, read_id, t - o AS off FROM s JOIN g USING (size, gram)),
    c AS MATERIALIZED (SELECT DISTINCT query, read_id, off + x AS a, length(query) + y AS n FROM d, unnest(range(-2, 3)) v(x), unnest(range(-2, 3)) w(y)),
    e AS (SELECT query, read_id, a, a + n - 1 AS z, levenshtein(query, substr(seq, a + 1, n)) AS distance FROM c JOIN reads USING (read_id) WHERE a >= 0 AND a + n <= length(seq)),
    m AS (SELECT query, read_id, a, z, distance FROM e WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY query, read_id ORDER BY distance, z, a DESC) = 1)
    SELECT query, CAST(1 AS BIGINT) AS cnt, read_id AS profile_id, CAST(a AS BIGINT) AS "start", CAST(z AS BIGINT) AS "end", CAST(distance AS BIGINT) AS distance, CAST(1 AS DOUBLE) AS mean
    FROM m QUALIFY distance = min(distance) OVER (PARTITION BY query)""",
)
def infix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries on whole reads, within two edits."""
    q = passages(spark, sf_dir).where("length(seq) > 2").select(F.col("seq").alias("query"), F.lit(1).cast("bigint").alias("cnt")).distinct()
    profiles = reads(spark, sf_dir).select(F.col("read_id").alias("profile_id"), "seq", F.array_repeat(F.lit(1), F.length("seq")).alias("base_counts"))
    return mapping.nearest_profiles(q, profiles, 2)


@query("hmm_segments")
def hmm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_user(spark, sf_dir).select(F.col("user_id").alias("profile_id"), "pos", F.col("value").alias("treat"), F.lit(0.0).alias("ctrl"))
    return peaks.segment_profiles(rows, 11)


@query("cluster_sequences")
def cluster_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("seq")).agg(F.count("*").alias("cnt"))
    return mapping.cluster_sequences(rows, 5.0)


@query("prominence_peaks")
def prominence_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_user(spark, sf_dir).select(F.col("user_id").alias("profile_id"), "pos", F.col("value").alias("treat"), F.lit(0.0).alias("ctrl"))
    profiles = rows.groupBy("profile_id").agg(F.repeat(F.lit("A"), F.count("pos").cast("int")).alias("seq"))
    return peaks.prominence_peaks(rows, profiles, 3, prominence=5.0, window=10)


@query("replicate_match")
def replicate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as one replicate's peaks, themselves cut by ten letters as the other's."""
    b = passages(spark, sf_dir).where("length(seq) > 30").select("seq", F.lit(0.01).alias("pvalue"))
    return replicates.reconcile([b, b.select(F.expr("substr(seq, 6, length(seq) - 10)").alias("seq"), "pvalue")])


@query("gapped_profiles")
def gapped_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types by brand, turned into bases: near-equal sequences of one brand share a profile."""
    seq = F.translate(F.regexp_replace("p_type", "[^a-zA-Z]", ""), LETTERS, BASES)
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("comp_id"), seq.alias("seq")).agg(F.count("*").alias("cnt"))
    return mapping.gapped_profiles(rows)


@query(
    "first_containment",
    """SELECT doc_id AS target_id, item_id AS pattern_id, CAST(instr(d.text, b.text) - 1 AS BIGINT) AS start FROM documents d JOIN benchmark b ON contains(d.text, b.text)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY instr(d.text, b.text), item_id) = 1""",
)
def first_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), F.col("text").alias("seq"))
    targets = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("target_id"), F.col("text").alias("seq")))
    return mapping.first_containment(patterns, targets).select("target_id", "pattern_id", F.col("start").cast("bigint").alias("start"))
