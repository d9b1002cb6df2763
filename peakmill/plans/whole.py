"""Registered queries of graphs of long k-mers, of mapping and of alignment, over whole tables.

The tables' words make one tangle of short k-mers; at LONG letters, as the
analysis is meant to be run, the graph splits into components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakmill.functions import normal
from peakmill.functions import sequence as S
from peakmill.functions.alignment import Scoring, banded_local
from peakmill.operators import assembly, bubbles, counts, graph, mapping, peaks, replicates, strong, windows
from peakmill.plans.inputs import BASES, LETTERS, READS_SQL, corrected_sql, kmers_sql, reads
from peakmill.plans.registry import graph_of, passages, query, summed
from peakmill.runtime import materialize, table

LONG = 31
#: k-mers of this summed corrected count and above make the graph; those below are looked up on its profiles.
LEAST = 2

_TURNED = "reverse(translate(kmer, 'ACGT', 'TGCA'))"
#: The graph's k-mers with their counts, both strands: a k-mer that is there both ways has the larger count.
_SET = f"""{corrected_sql(LONG)},
p AS MATERIALIZED (SELECT kmer, CAST(sum(cnt) AS BIGINT) AS cnt FROM corrected GROUP BY kmer HAVING sum(cnt) >= {LEAST}),
b AS MATERIALIZED (SELECT kmer, max(cnt) AS cnt FROM (SELECT kmer, cnt FROM p UNION ALL SELECT {_TURNED}, cnt FROM p) GROUP BY kmer)"""
_PASSAGE = f"translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), '{LETTERS}', '{BASES}')"


def long_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph_of(spark, sf_dir, LONG, LEAST)


@query("long_graph_kmers", f"WITH {_SET} SELECT kmer, cnt, 1 AS n FROM b")
def long_graph_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compacted graph spells, with its counts: every k-mer of the set and of its complements, once."""
    v, _ = long_graph(spark, sf_dir)
    each = v.select(F.explode(F.arrays_zip(S.kmers(F.col("seq"), LONG).alias("kmer"), F.col("counts").alias("cnt"))).alias("x"))
    return each.groupBy("x.kmer").agg(F.max("x.cnt").cast("bigint").alias("cnt"), F.count("*").cast("int").alias("n"))


@query("long_graph_links", f"WITH {_SET} SELECT x.kmer AS src, y.kmer AS dst FROM b x JOIN b y ON substr(x.kmer, 2) = substr(y.kmer, 1, {LONG} - 1)")
def long_graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps within vertices and edges between them: together every link of two k-mers of the set, once."""
    v, e = long_graph(spark, sf_dir)
    spelled = v.select("vid", S.kmers(F.col("seq"), LONG).alias("p"))
    inner = spelled.select(F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - 1).alias("src"), F.slice("p", F.lit(2), F.size("p")).alias("dst"))).alias("x")).select("x.src", "x.dst")
    tails = spelled.select(F.col("vid").alias("src"), F.element_at("p", -1).alias("a"))
    heads = spelled.select(F.col("vid").alias("dst"), F.get("p", F.lit(0)).alias("b"))
    return inner.unionByName(e.join(tails, "src").join(heads, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("bubbles")
def bubbles_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's vertices when its bubbles are resolved."""
    v, e = long_graph(spark, sf_dir)
    return bubbles.pop_bubbles(v, e, LONG)[0]


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(assembly.assemble_components(*long_graph(spark, sf_dir), LONG), "assembled")


@query("assemble")
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembled(spark, sf_dir)


@query("assembled_kmers", f"WITH {_SET} SELECT kmer, cnt FROM b")
def assembled_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by k-mer of all assembled sequences: peeling neither loses nor makes any."""
    made = assembly.assemble_components(*long_graph(spark, sf_dir), LONG, peel_singles=True)
    each = made.select(F.explode(S.kmers(F.col("seq"), LONG)).alias("kmer"), "cnt")
    return each.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


@query("cycles")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.cycle_report(*long_graph(spark, sf_dir))


def profiles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile_id, seq, base_counts) of all components."""
    made = mapping.exact_profiles(assembled(spark, sf_dir), "comp_id").where(F.length("seq") >= LONG)
    return materialize(made.select(F.xxhash64("comp_id", "profile_id", "seq").alias("profile_id"), "seq", "base_counts"), "profiles")


@query("exact_profiles")
def exact_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.exact_profiles(assembled(spark, sf_dir), "comp_id")


@query("approximate_hits")
def approximate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All k-mers below the graph's threshold on the profiles of those above, best hit each, with gaps."""
    low = materialize(summed(spark, sf_dir, LONG, below=LEAST).withColumnRenamed("kmer", "query"), "low")
    found = mapping.gapped_hits(low, profiles_of(spark, sf_dir), LONG // 3, 90.0)
    return mapping.best_hits(mapping.passing_hits(found, LONG, 90.0), "target", "sstart")


@query("position_vectors")
def position_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both samples' coverage of the profiles, by base."""
    return peaks.positions_of_reads(profiles_of(spark, sf_dir), reads(spark, sf_dir), LONG, F.col("arm") == "treatment")


@query("called_peaks")
def called_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant stretches of the profiles."""
    profiles = profiles_of(spark, sf_dir)
    positions = peaks.positions_of_reads(profiles, reads(spark, sf_dir), LONG, F.col("arm") == "treatment")
    return peaks.call_peaks(positions, profiles, LONG, 0.05)


# -- the same on passages of the benchmark, where SQL can follow --
_P = f"s AS (SELECT item_id, {_PASSAGE} AS seq FROM benchmark), u AS (SELECT min(item_id) AS item_id, seq FROM s WHERE length(seq) >= {3 * LONG} GROUP BY seq)"
_MIDDLE = "CAST(length(seq) // 2 AS BIGINT)"
_OTHER = f"translate(substr(seq, {_MIDDLE} + 1, 1), 'ACGT', 'CGTA')"


def distinct_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, seq) of different passages of three k-mers' length and more, under the smallest id."""
    return passages(spark, sf_dir).where(F.length("seq") >= 3 * LONG).groupBy("seq").agg(F.min("item_id").alias("item_id"))


@query(
    "passage_bubbles",
    f"""WITH {_P}, v AS (SELECT seq, substr(seq, 1, {_MIDDLE}) || {_OTHER} || substr(seq, {_MIDDLE} + 2) AS other, item_id % 5 + 2 AS n FROM u),
    a AS (SELECT seq, other, n FROM v UNION ALL SELECT reverse(translate(seq, 'ACGT', 'TGCA')), reverse(translate(other, 'ACGT', 'TGCA')), n FROM v)
    SELECT 'count included' AS kind, other AS archived_seq, seq AS mapped_to_seq, array_to_string(list_transform(range(0, {LONG}), lambda i: n), ',') AS counts, 1::BIGINT AS edit_distance FROM a""",
)
def passage_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage, twenty times, and itself with another letter in the middle, a few times: one bubble a strand.

    Each passage has a graph of its own, as some share k-mers.
    """
    p = distinct_passages(spark, sf_dir)
    middle = F.floor(F.length("seq") / 2).cast("int")
    other = F.concat(F.substring("seq", F.lit(1), middle), F.translate(F.substring("seq", middle + 1, F.lit(1)), "ACGT", "CGTA"), F.substring("seq", middle + 2, F.length("seq")))
    both = p.select("item_id", "seq", F.lit(20).cast("bigint").alias("n")).unionByName(p.select("item_id", other.alias("seq"), (F.col("item_id") % 5 + 2).alias("n")))
    each = both.select("item_id", F.posexplode(S.kmers(F.col("seq"), LONG)).alias("pos", "kmer"), "n")
    known = p.select("item_id", F.explode(S.kmers(F.col("seq"), LONG)).alias("kmer"), F.lit(True).alias("known")).distinct()
    # the changed passage gives only what the passage doesn't have
    held = each.join(known, ["item_id", "kmer"], "left").where((F.col("n") == 20) | F.col("known").isNull()).groupBy("item_id", "kmer").agg(F.max("n").alias("cnt"))
    held = materialize(held, "kmers")
    v, e = graph.unitigs(held, "item_id")
    turned = held.select("item_id", S.reverse_complement(F.col("kmer")).alias("kmer"), "cnt")
    counted = held.unionByName(turned).groupBy("item_id", "kmer").agg(F.max("cnt").alias("cnt"))
    linked = graph.linked_counts(v.select("item_id", "vid", "seq"), counted, LONG, "item_id")
    archived = bubbles.pop_bubbles(linked.select("vid", "seq", "counts"), e, LONG, 1 << 20)[2]
    return archived.select("kind", "archived_seq", "mapped_to_seq", S.counts_to_text(F.col("counts")).alias("counts"), "edit_distance")


@query(
    "passage_profiles",
    f"""WITH {_P}, c AS (SELECT item_id, seq, 5 + item_id % 3 AS n FROM u),
    parts AS (SELECT item_id, 0 AS a, length(seq) // 2 AS z, 3 AS n FROM c UNION ALL SELECT item_id, length(seq) // 3, length(seq), 2 FROM c UNION ALL SELECT item_id, length(seq) // 4, length(seq) - length(seq) // 4, 4 FROM c),
    g AS (SELECT item_id, seq, n, CAST(i AS BIGINT) AS pos FROM c, unnest(range(0, CAST(length(seq) AS BIGINT))) q(i))
    SELECT g.item_id, seq, pos, CAST(any_value(g.n) + coalesce(sum(parts.n) FILTER (pos >= a AND pos < z), 0) AS BIGINT) AS cnt FROM g JOIN parts USING (item_id) GROUP BY g.item_id, seq, pos""",
)
def passage_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and three parts of each, mapped exactly, longest first: a part's count goes onto its place in the whole."""
    p = distinct_passages(spark, sf_dir)
    n = F.length("seq")
    cut = lambda a, z, c: F.struct(F.substring("seq", a.cast("int") + 1, (z - a).cast("int")).alias("s"), F.lit(c).cast("bigint").alias("c"))
    zero, half, third, fourth = F.lit(0), F.floor(n / 2), F.floor(n / 3), F.floor(n / 4)
    whole = F.struct(F.col("seq").alias("s"), (5 + F.col("item_id") % 3).cast("bigint").alias("c"))
    rows = p.select("item_id", F.explode(F.array(whole, cut(zero, half, 3), cut(third, n, 2), cut(fourth, n - fourth, 4))).alias("x")).select("item_id", F.col("x.s").alias("seq"), F.col("x.c").alias("cnt"))
    made = mapping.exact_profiles(rows, "item_id")
    return made.select("item_id", "seq", F.posexplode("base_counts").alias("pos", "cnt")).select("item_id", "seq", F.col("pos").cast("bigint").alias("pos"), "cnt")


@query(
    "passage_positions",
    f"""WITH {kmers_sql(LONG)}, {_P},
    m AS (SELECT kmer, sum(treat) AS treat, sum(ctrl) AS ctrl FROM arms GROUP BY kmer),
    sc AS (SELECT 0.99 * sum(treat) / sum(ctrl) AS scale FROM m),
    r AS (SELECT kmer, treat, ctrl * scale AS ctrl, greatest(treat - ctrl * scale, 0) AS recon FROM m, sc),
    g AS (SELECT item_id, i - 1 AS pos, substr(seq, i, {LONG}) AS kmer, length(seq) AS size FROM u, unnest(range(1, CAST(length(seq) AS BIGINT) - {LONG} + 2)) q(i)),
    f AS (SELECT item_id, pos, size, coalesce(treat, 0) AS treat, coalesce(ctrl, 0) AS ctrl, CASE WHEN coalesce(recon, 0) = 0 THEN 'Infinity'::DOUBLE ELSE 7 / recon + 0.01 END AS frac FROM g LEFT JOIN r USING (kmer)),
    v AS (SELECT item_id, pos, size, treat, ctrl, frac FROM f WHERE treat > 0 AND frac < 'Infinity'::DOUBLE),
    z AS (SELECT item_id, pos + d AS pos, max(treat * frac) AS treat, max(ctrl * frac) AS ctrl FROM v, unnest(range(0, {LONG})) q(d) GROUP BY ALL)
    SELECT item_id AS profile_id, CAST(pos AS BIGINT) AS pos, round(treat, 4) AS treat, round(ctrl, 4) AS ctrl FROM z""",
)
def passage_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both samples' coverage of the passages by base, each base with a count of 7; bases of no finite share are left out."""
    p = distinct_passages(spark, sf_dir).select(F.col("item_id").alias("profile_id"), "seq", F.array_repeat(F.lit(7).cast("bigint"), F.length("seq")).alias("base_counts"))
    made = peaks.positions_of_reads(p, reads(spark, sf_dir), LONG, F.col("arm") == "treatment")
    finite = made.where("treat > 0 and treat < double('Infinity') and not isnan(treat)")
    return finite.select("profile_id", F.col("pos").cast("bigint").alias("pos"), F.round("treat", 4).alias("treat"), F.round("ctrl", 4).alias("ctrl"))


# -- strong components and longest paths --
_CUSTOMER_EDGES = """c AS (SELECT c_custkey AS k, c_nationkey AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n, count(*) OVER (PARTITION BY c_nationkey) AS m, c_acctbal AS b FROM customer),
e AS (SELECT x.k AS src, y.k AS dst FROM c x JOIN c y ON x.g = y.g AND y.n = (x.n * x.n + 3 * x.n + 1) % x.m UNION SELECT x.k, y.k FROM c x JOIN c y ON x.g = y.g AND y.n = (5 * x.n + x.k) % x.m WHERE x.b > 2000)"""


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = Window.partitionBy("c_nationkey")
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"), (F.row_number().over(nation.orderBy("c_custkey")) - 1).cast("bigint").alias("n"), F.count("*").over(nation).alias("m"), F.col("c_acctbal").alias("b")
    )
    n = F.col("n")
    one = c.select(F.col("k").alias("src"), "g", ((n * n + 3 * n + 1) % F.col("m")).alias("n"))
    two = c.where("b > 2000").select(F.col("k").alias("src"), "g", ((5 * n + F.col("k")) % F.col("m")).alias("n"))
    return one.unionByName(two).join(c.select("g", "n", F.col("k").alias("dst")), ["g", "n"]).select("src", "dst")


@query(
    "strong_components",
    f"""WITH RECURSIVE {_CUSTOMER_EDGES}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
    v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
    SELECT node, CAST(least(node, coalesce(min(x.b), node)) AS BIGINT) AS component FROM v LEFT JOIN (SELECT f.a, f.b FROM r f JOIN r g ON f.a = g.b AND f.b = g.a) x ON x.a = node GROUP BY node""",
)
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, each with one or two others of its nation by a rule on their ranks: tangles with ways in and out."""
    return strong.strong_components(customer_edges(spark, sf_dir))


def _line_levels(last: int) -> str:
    """Distances over the lines of orders, one number of line after the other."""
    node = "l_partkey * 8 + l_linenumber"
    sql = [
        f"l AS (SELECT l_orderkey, l_linenumber, {node} AS v FROM lineitem)",
        "e AS (SELECT DISTINCT a.v AS src, b.v AS dst FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)",
        "c AS (SELECT DISTINCT v, p_size AS cost FROM l JOIN part ON p_partkey = v // 8)",
        "d1 AS (SELECT v, CAST(0 AS BIGINT) AS dist FROM c WHERE v % 8 = 1)",
    ]
    for i in range(2, last + 1):
        sql.append(f"d{i} AS (SELECT c.v, CAST(coalesce(max(d.dist + c.cost), 0) AS BIGINT) AS dist FROM c LEFT JOIN e ON e.dst = c.v LEFT JOIN d{i - 1} d ON d.v = e.src WHERE c.v % 8 = {i} GROUP BY c.v)")
    every = " UNION ALL ".join(f"SELECT v, dist FROM d{i}" for i in range(1, last + 1))
    return f"WITH {', '.join(sql)}, d AS ({every}), k AS (SELECT e.dst AS v, string_agg(CAST(e.src AS VARCHAR), ',' ORDER BY y.cost DESC, e.src) AS before FROM e JOIN d a ON a.v = e.src JOIN d z ON z.v = e.dst JOIN c x ON x.v = e.dst JOIN c y ON y.v = e.src WHERE a.dist + x.cost = z.dist GROUP BY e.dst) SELECT d.v AS node, dist, coalesce(before, '') AS before FROM d LEFT JOIN k USING (v)"


@query("longest_chains", _line_levels(7))
def longest_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts at their places in orders, each followed by what stands on the next line: the longest chains by the parts' sizes, with all ties."""
    node = F.col("l_partkey") * 8 + F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", node.cast("bigint").alias("v"))
    nexts = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("v").alias("dst"))
    edges = lines.join(nexts, ["l_orderkey", "l_linenumber"]).select(F.col("v").alias("src"), "dst")
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").cast("bigint").alias("cost"))
    costs = lines.select("v").distinct().join(sizes, F.floor(F.col("v") / 8) == F.col("p")).select(F.col("v").alias("node"), "cost")
    return strong.longest_paths(costs, edges).select("node", "dist", F.array_join("before", ",").alias("before"))


# -- gapped alignment --
_PAIRS = """s AS (SELECT p_partkey AS id, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part),
w AS (SELECT id, a, b FROM s WHERE b IS NOT NULL)"""


@query(
    "local_alignments",
    f"""WITH RECURSIVE {_PAIRS},
    h(id, i, j, h) AS (
      SELECT id, 0, j, 0.0::DOUBLE FROM w, unnest(range(0, 80)) q(j) WHERE j <= length(b)
      UNION ALL
      SELECT id, i, j, greatest(g, coalesce(max(g + 2.5 * j) OVER (PARTITION BY id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 2.5 * j, 0)) FROM (
        SELECT id, i + 1 AS i, j, CASE WHEN j = 0 THEN 0 ELSE greatest(0, lag(h) OVER (PARTITION BY id ORDER BY j) + CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN 1 ELSE -2 END, h - 2.5) END AS g
        FROM h JOIN w USING (id) WHERE i < length(a)))
    SELECT id, max(h) AS score, round((1.28 * max(h) - ln(0.46)) / ln(2), 6) AS bitscore FROM h GROUP BY id""",
)
def local_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name and the next one's of its brand: the best local alignment with gaps, in a band that holds the whole table."""
    near = Window.partitionBy("p_brand").orderBy("p_partkey")
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.lead("p_name").over(near).alias("b")).where("b is not null")

    def run(frames):
        for f in frames:
            reach = int(max(f["a"].str.len().max(), f["b"].str.len().max())) if len(f) else 0
            r = banded_local(f["a"].tolist(), f["b"].tolist(), f["id"].to_numpy() * 0, reach)
            yield f[["id"]].assign(score=r["score"], bitscore=Scoring().bits(r["score"]).round(6))

    return pairs.mapInPandas(run, "id bigint, score double, bitscore double")


@query(
    "gapped_whole_hits",
    f"WITH {READS_SQL}, {_P} SELECT u.item_id, read_id, CAST(instr(reads.seq, u.seq) AS BIGINT) AS sstart, CAST(length(u.seq) AS BIGINT) AS length FROM u JOIN reads ON contains(reads.seq, u.seq)",
)
def gapped_whole_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages' gapped hits on all reads of which nothing is other: the first place of each that a read holds whole."""
    p = distinct_passages(spark, sf_dir)
    found = mapping.gapped_hits(p.select(F.col("seq").alias("query")), reads(spark, sf_dir).select(F.col("read_id").alias("profile_id"), "seq"), LONG)
    whole = found.where((F.col("pident") == 100) & (F.col("length") == F.length("query")))
    first = whole.groupBy("query", "target").agg(F.min("sstart").alias("sstart"))
    return first.join(p.withColumnRenamed("seq", "query"), "query").select("item_id", F.col("target").alias("read_id"), "sstart", F.length("query").cast("bigint").alias("length"))


@query("gapped_hits")
def gapped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages on all reads, with gaps, expect values and bit scores: the best hit of each passage."""
    p = distinct_passages(spark, sf_dir)
    found = mapping.gapped_hits(p.select(F.col("seq").alias("query")), reads(spark, sf_dir).select(F.col("read_id").alias("profile_id"), "seq"), LONG // 2)
    return windows.best_per_key(found, ["query"], [F.desc("bitscore"), F.col("target"), F.col("sstart")])


@query(
    "near_windows",
    f"""WITH {_P}, w AS (SELECT DISTINCT substr(seq, i, {LONG}) AS seq FROM u, unnest(range(1, CAST(length(seq) AS BIGINT) - {LONG} + 2)) q(i))
    SELECT a.seq, b.seq AS other, CAST(hamming(a.seq, b.seq) AS INTEGER) AS distance FROM w a JOIN w b ON a.seq < b.seq AND hamming(a.seq, b.seq) <= 8""",
)
def near_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the passages' windows with at most 8 differing places, those that linkage starts from."""
    w = distinct_passages(spark, sf_dir).select(F.explode(S.kmers(F.col("seq"), LONG)).alias("seq"))
    numbers = materialize(mapping.numbered_by_length(w, "size"), "numbered")
    a, b = numbers.select("nth", "seq"), numbers.select(F.col("nth").alias("other"), F.col("seq").alias("other_seq"))
    return mapping.near_sequences(numbers, 8, "size").join(a, "nth").join(b, "other").select("seq", F.col("other_seq").alias("other"), "distance")


@query("window_clusters", f"WITH {_P} SELECT substr(seq, i, {LONG}) AS seq, count(*) AS n, true AS within FROM u, unnest(range(1, CAST(length(seq) AS BIGINT) - {LONG} + 2)) q(i) GROUP BY 1")
def window_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages' windows, clustered: each is in one cluster, whose first is one of those that near it."""
    w = distinct_passages(spark, sf_dir).select(F.explode(S.kmers(F.col("seq"), LONG)).alias("seq")).groupBy("seq").agg(F.count("*").alias("cnt"))
    made = materialize(mapping.cluster_sequences(w, 9.0), "clusters")
    first = made.groupBy("cluster").agg(F.min("seq").alias("first"))
    return made.join(first, "cluster").select("seq", F.col("cnt").alias("n"), (S.hamming(F.col("seq"), F.col("first")) < 9).alias("within"))


def gapped_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, seq, cnt): passages as they are, without their 21st letter, with one more after the 15th, with another one as the 26th."""
    p = distinct_passages(spark, sf_dir).where("length(seq) > 60")
    c = F.col("seq")
    cut = lambda a, z=None: F.substring(c, F.lit(a + 1), F.lit(z - a) if z else F.length(c))
    other = F.when(F.substring(c, 26, 1) == "A", "C").otherwise("A")
    versions = [(c, 5), (F.concat(cut(0, 20), cut(21)), 2), (F.concat(cut(0, 15), F.lit("G"), cut(15)), 1), (F.concat(cut(0, 25), other, cut(26)), 3)]
    return p.select("item_id", F.explode(F.array(*(F.struct(v.alias("seq"), F.lit(n).cast("bigint").alias("cnt")) for v, n in versions))).alias("x")).select("item_id", "x.seq", "x.cnt")


_VERSIONS = f"""{_P}, v AS (SELECT item_id, seq AS whole, unnest([5, 2, 1, 3]) AS cnt FROM u WHERE length(seq) > 60),
    g AS (SELECT item_id, whole, cnt, CASE cnt WHEN 5 THEN whole WHEN 2 THEN whole[:20] || whole[22:] WHEN 1 THEN whole[:15] || 'G' || whole[16:]
      ELSE whole[:25] || CASE WHEN whole[26] = 'A' THEN 'C' ELSE 'A' END || whole[27:] END AS seq FROM v)"""


@query("gapped_capture", f"WITH {_VERSIONS} SELECT item_id, seq, CAST(cnt AS BIGINT) AS cnt FROM g")
def gapped_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages' versions in gapped profiles, captured by ranges that cover all columns and glued again: each as it was."""
    keys = ["item_id", "profile_id"]
    made = materialize(mapping.gapped_alignments(gapped_versions(spark, sf_dir), key="item_id"), "alignments")
    width = made.groupBy(*keys).agg(F.max(F.array_max("places")).alias("width"))
    tiles = width.select(*keys, F.explode(F.sequence(F.lit(0), F.floor(F.col("width") / 10).cast("int"))).alias("peak_i"))
    tiles = tiles.select(*keys, "peak_i", (F.col("peak_i") * 10).alias("start"), (F.col("peak_i") * 10 + 10).alias("end"))
    parts = peaks.captured_gapped(made.withColumn("counts", F.array_repeat("cnt", F.length("seq"))), tiles, keys)
    glued = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("peak_i", "seq"))), lambda x: x["seq"]), "")
    return parts.groupBy("item_id", "profile_id", "cnt").agg(glued.alias("seq")).select("item_id", "seq", "cnt")


@query(
    "gapped_capture_means",
    f"WITH {_VERSIONS} SELECT item_id, seq[11:30 + n] AS seq, cnt + 19.5 + n / 2 AS mean FROM (SELECT *, CAST(length(seq) AS BIGINT) - length(whole) AS n FROM g)",
)
def gapped_capture_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places 10 to 30 of each profile's consensus, as columns, captured from all versions with the mean of counts that rise by the letter."""
    keys = ["item_id", "profile_id"]
    versions = materialize(gapped_versions(spark, sf_dir), "versions")
    columns = peaks.profile_columns(mapping.gapped_profiles(versions, key="item_id"), keys)
    ranges = columns.select(*keys, F.lit(0).alias("peak_i"), F.lit(10).alias("start"), F.lit(30).alias("end"))
    rising = F.transform(F.sequence(F.lit(0), F.length("seq") - 1), lambda i: F.col("cnt") + i)
    made = mapping.gapped_alignments(versions, key="item_id").withColumn("counts", rising)
    return peaks.captured_gapped(made, peaks.gapped_ranges(ranges, columns, keys), keys, how="mean").select("item_id", "seq", F.col("cnt").alias("mean"))


# -- tests by segment, and replicates --
def _p_sql(u: str, n1: str, n2: str, tie: str) -> str:
    """Upper tail by the error function's series in logarithms; DuckDB has no error function."""
    z = f"(({u} - {n1}::DOUBLE * {n2} / 2 - 0.5) / sqrt({tie} * {n1}::DOUBLE * {n2} * ({n1} + {n2} + 1) / 12) / sqrt(2.0))"
    series = "list_sum(list_transform(range(0, 300), lambda i: exp(i * ln(4 * y * y) + lgamma(i + 1) - lgamma(2 * i + 2))))"
    return f"(SELECT CASE WHEN y > 6 THEN 0 WHEN y < -6 THEN 1 WHEN y = 0 THEN 0.5 ELSE 0.5 * (1 - 2 / sqrt(pi()) * y * exp(-y * y) * {series}) END FROM (SELECT {z} AS y))"


_TESTED = """s AS (SELECT event_type, user_id // 50 * 50 AS lo, user_id % 4 AS sample, value FROM events),
x AS (SELECT event_type, lo, t, c, sample = t AS f, value FROM s JOIN (VALUES (0, 2), (0, 3), (1, 2), (1, 3)) p(t, c) ON sample = t OR sample = c),
r AS (SELECT *, rank() OVER (PARTITION BY event_type, lo, t, c ORDER BY value) + (count(*) OVER (PARTITION BY event_type, lo, t, c, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY event_type, lo, t, c, value) AS ties FROM x),
a AS (SELECT event_type, lo, t, c, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, coalesce(sum(rk) FILTER (f), 0) AS r, sum(ties * ties - 1) AS q FROM r GROUP BY ALL),
u AS (SELECT event_type, lo, t, c, n1, n2, r - n1 * (n1 + 1) / 2.0 AS u, 1 - CAST(q AS DOUBLE) / (CAST(n1 + n2 AS DOUBLE) ** 3 - (n1 + n2)) AS tie FROM a)"""


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of profiles: types, users as places, four samples of which two are treated."""
    sample = F.col("user_id") % 4
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("profile_id"), F.col("user_id").alias("pos"), sample.alias("sample"), (sample < 2).alias("treated"), "value")


@query("rank_test_pvalues", f"WITH {_TESTED} SELECT event_type, lo, t, c, round({_p_sql('u', 'n1', 'n2', 'tie')}, 9) AS p FROM u WHERE n1 > 0 AND n2 > 0 AND tie > 0")
def rank_test_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test for each type, stretch of users and pair of samples."""
    s = event_samples(spark, sf_dir).withColumn("lo", F.floor(F.col("pos") / 50) * 50)
    pairs = spark.createDataFrame([(t, c) for t in (0, 1) for c in (2, 3)], "t bigint, c bigint")
    rows = s.join(F.broadcast(pairs), (F.col("sample") == F.col("t")) | (F.col("sample") == F.col("c")))
    tests = windows.u_statistic(rows, ["profile_id", "lo", "t", "c"], "treated", "value").where("n1 > 0 and n2 > 0 and tie > 0")
    p = normal.rank_test_p(F.col("u"), F.col("n1"), F.col("n2"), F.col("tie"))
    return tests.select(F.col("profile_id").alias("event_type"), F.col("lo").cast("bigint").alias("lo"), "t", "c", F.round(p, 9).alias("p"))


@query(
    "tested_segments",
    f"""WITH {_TESTED}, p AS (SELECT event_type, lo, CASE WHEN n1 > 0 AND n2 > 0 AND tie > 0 THEN {_p_sql('u', 'n1', 'n2', 'tie')} ELSE 1 END AS p FROM u),
    m AS (SELECT event_type, lo FROM s WHERE sample < 2 GROUP BY ALL HAVING median(value) >= 10)
    SELECT event_type, lo, round(max(p) FILTER (p <= 0.4 / 2), 9) AS pvalue FROM p SEMI JOIN m USING (event_type, lo) GROUP BY ALL HAVING count(*) FILTER (p <= 0.4 / 2) >= 0.5 * count(*)""",
)
def tested_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches in which half of the pairs of samples pass."""
    s = event_samples(spark, sf_dir)
    stretches = s.select("profile_id", (F.floor(F.col("pos") / 50) * 50).cast("bigint").alias("start")).distinct().withColumn("end", F.col("start") + 50)
    found = peaks.tested_segments(stretches, s, 0.4, 2)
    return found.select(F.col("profile_id").alias("event_type"), F.col("start").alias("lo"), F.round("pvalue", 9).alias("pvalue"))


def passage_peaks(spark: SparkSession, sf_dir: str, cut: int) -> DataFrame:
    """Passages as peaks, with as many letters cut off at either end."""
    return distinct_passages(spark, sf_dir).select(F.expr(f"substr(seq, {cut + 1}, length(seq) - {2 * cut})").alias("seq"), (0.01 + cut / 1000 + F.col("item_id") % 3 / 1000).alias("pvalue"))


@query("replicate_passages", f"WITH {_P} SELECT substr(seq, 1, length(seq) - 1) AS seq, round(0.015 + item_id % 3 / 1000, 6) AS pvalue, '' AS variants FROM u")
def replicate_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicates' peaks: the passages, and what is left of them without five letters at either end."""
    made = replicates.reconcile([passage_peaks(spark, sf_dir, 0), passage_peaks(spark, sf_dir, 5)])
    return made.select("seq", F.round("pvalue", 6).alias("pvalue"), F.array_join("variants", ",").alias("variants"))


@query(
    "merged_sources",
    f"""WITH {_P}, l AS (SELECT *, CAST(length(seq) AS BIGINT) AS n FROM u), x AS (
      SELECT item_id, 0 AS replicate, seq AS peak, CAST(5 AS BIGINT) AS "start", n - 5 AS "end" FROM l UNION ALL SELECT item_id, 1, substr(seq, 6, n - 10), 0, n - 10 FROM l
      UNION ALL SELECT item_id, 2, substr(seq, 9, n - 16), 0, n - 16 FROM l)
    SELECT substr(u.seq, 4, length(u.seq) - 7) AS seq, replicate, peak, "start", "end" FROM x JOIN u USING (item_id)""",
)
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three replicates' peaks merged in pairs: all peaks that each result came from, and where they lay under their partner."""
    made = replicates.tournament([passage_peaks(spark, sf_dir, c) for c in (0, 5, 8)])
    return made.select("seq", F.explode("sources").alias("x")).select("seq", "x.replicate", "x.peak", "x.start", "x.end")
