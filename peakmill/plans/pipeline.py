"""The whole analysis: reads of treatment and control to peaks that replicates agree on."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakmill.functions.sequence import reverse_complement
from peakmill.operators import assembly, bubbles, counts, graph, mapping, peaks, replicates
from peakmill.plans.config import Config
from peakmill.runtime import materialize, scratch, session
from peakmill.sources import readers, writers


def both_strands(counted: DataFrame) -> DataFrame:
    """Counts of either spelling of counts(kmer, cnt) under the smaller."""
    turned = counted.select(reverse_complement(F.col("kmer")).alias("kmer"), "cnt")
    return counted.select("kmer", "cnt").unionByName(turned).dropDuplicates(["kmer"])


def least_abundance(raw: DataFrame, k: int, percentile: float) -> int:
    """The percentile of the mean abundances of the unitigs of all k-mers that occur twice, either strand counted."""
    vertices, _ = graph.unitigs(raw.where("cnt >= 2").select("kmer"))
    linked = graph.linked_counts(vertices.where("vid > 0").select("vid", "seq"), both_strands(raw), k)
    found = counts.minimal_abundance(linked.select("km"), percentile).collect()  # one row, or none of an empty graph
    return found[0][0] if found else 1


def graph_and_counts(treat: DataFrame, ctrl: DataFrame, config: Config) -> tuple[int, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(least, vertices, edges, arms, corrected) of one replicate's reads(seq).

    The graph holds the k-mers that occur 2 * least times in treatment, both
    strands counted together. Its k-mers alone are counted on, each strand by
    itself: arms(kmer, treat, ctrl), and corrected(kmer, cnt) by the control.
    """
    k = config.k
    raw = materialize(counts.count_kmers(treat, k, both_strands=True), "raw")
    least = config.min_abundance if config.min_abundance is not None else least_abundance(raw, k, config.percentile)
    vertices, edges = graph.unitigs(raw.where(F.col("cnt") >= 2 * least).select("kmer"))
    present = vertices.select(F.explode("kmers").alias("kmer"))
    every = treat.select("seq", F.lit(True).alias("treated")).unionByName(ctrl.select("seq", F.lit(False).alias("treated")))
    arms = materialize(counts.count_arms(every, k, F.col("treated")).join(present, "kmer", "left_semi"), "arms")
    return least, vertices, edges, arms, materialize(counts.corrected_arms(arms, factor=config.control_scale, listed=True), "corrected")


def replicate_peaks(treat: DataFrame, ctrl: DataFrame, config: Config, alpha: float, drawing: str | None = None) -> DataFrame:
    """(profile_id, peak_i, start, end, seq, pvalue) of one replicate's reads(seq); drawing: where DOT text of its components goes."""
    k = config.k
    least, vertices, edges, arms, fixed = graph_and_counts(treat, ctrl, config)
    low = counts.low_abundance(fixed, least)
    linked = graph.linked_counts(vertices.select("vid", "seq"), fixed, k)
    v, e = graph.split_low(linked.select("vid", "seq", "counts"), edges, least, k, config.compat)
    e = graph.without_antiparallel(graph.checked_edges(v, e, k), "src")
    v = materialize(graph.with_components(v, e), "components")
    if drawing:
        draw(v, e, drawing, k, least, config.unwrap)
    fixed_rows = materialize(bubbles.correct_components(v, e, k, config.bubble_length, config.compat), "bubbles")
    v, e, _ = bubbles.split_result(fixed_rows)
    e = materialize(e.select("src", "dst"), "edges")
    v = materialize(graph.with_components(v.select("vid", "seq", "counts"), e), "components")
    made = materialize(assembly.assemble_components(v, e, k, config.compat).where("cnt > 0"), "assembled")
    profiles = mapping.exact_profiles(made, "comp_id", config.compat)
    profiles = profiles.where(F.length("seq") >= k).withColumn("profile_id", F.xxhash64("comp_id", "profile_id", "seq"))
    profiles = materialize(profiles.select("profile_id", "seq", "base_counts"), "profiles")
    if config.store_low:
        queries = materialize(low.where(F.col("cnt") >= config.min_abundance_mapping).select(F.col("kmer").alias("query"), "cnt"), "queries")
        found = mapping.gapped_hits(queries, profiles, max(1, k // 3), config.identity, config.expect)
        hits = mapping.best_hits(mapping.passing_hits(found, k, config.identity), "target", "sstart")
        profiles = materialize(mapping.add_hits(profiles, hits, queries, k), "profiles")
    profiles = peaks.long_enough(profiles, k, config.filtering_fraction)
    side = lambda c: arms.select("kmer", F.col(c).alias("cnt"))
    positions = peaks.position_vectors(profiles, side("treat"), side("ctrl"), k, config.control_scale)
    return peaks.call_peaks(positions, profiles, k, alpha, config.states, config.absolute_minimum, config.compat)


def draw(vertices: DataFrame, edges: DataFrame, path: str, k: int, least: int, unwrap: bool) -> None:
    """DOT text of the components; unwrap: k-mer by k-mer."""
    inner = vertices.select(F.col("vid").alias("src"), "comp_id")
    if unwrap:
        nodes, within = graph.unwrapped(vertices, k)
        place = lambda vid, pos: F.xxhash64(vid, pos)
        last = vertices.select(F.col("vid").alias("src"), (F.size("counts") - 1).alias("pos"))
        steps = within.select("vid", place("vid", "pos").alias("src"), place("vid", "next").alias("dst")).join(vertices.select("vid", "comp_id"), "vid")
        across = edges.join(inner, "src").join(last, "src").select("comp_id", place(F.col("src"), F.col("pos")).alias("src"), place(F.col("dst"), F.lit(0)).alias("dst"))
        shown = nodes.join(vertices.select("vid", "comp_id"), "vid").select("comp_id", place(F.col("vid"), F.col("pos")).alias("vid"), F.col("kmer").alias("seq"), F.array("cnt").alias("counts"))
        writers.dot(shown, steps.select("comp_id", "src", "dst").unionByName(across), path, float(least))
    else:
        writers.dot(vertices, edges.join(inner, "src").select("comp_id", "src", "dst"), path, float(least))


def call_peaks(spark: SparkSession, experiment: list[tuple[DataFrame, DataFrame]], config: Config, drawing: str | None = None) -> DataFrame:
    """(peak_i, pvalue, seq, variants) from (treatment, control) reads of each replicate."""
    alpha = config.pvalue / max(len(experiment), 1)
    found = [
        materialize(replicate_peaks(t, c, config, alpha, drawing and f"{drawing}/replicate={i}").select("seq", "pvalue"), "peaks")
        for i, (t, c) in enumerate(experiment, 1)
    ]
    return replicates.reconcile(found, config.partner_threshold, config.widen, config.compat)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Peaks of treatment over control, without a reference genome")
    p.add_argument("--input_description", required=True)
    p.add_argument("--input_directory", required=True)
    p.add_argument("--k", type=int, required=True)
    p.add_argument("--working_dir", required=True)
    p.add_argument("--minimal_abundance", type=int)
    p.add_argument("--minimal_abundance_percentile", type=float, default=95)
    p.add_argument("--minimal_abundance_mapping", type=int, default=10)
    p.add_argument("--miss_percentage", type=float, default=90)
    p.add_argument("--filtering_fraction", type=float)
    p.add_argument("--no_store_low", action="store_true")
    p.add_argument("--states", type=int, default=5)
    p.add_argument("--pvalue_threshold", type=float, default=0.1)
    p.add_argument("--max_bubble", type=int)
    p.add_argument("--widen", type=int, default=5)
    p.add_argument("--partner_threshold", type=float, default=0.1)
    p.add_argument("--compat", action="store_true", help="keep the deterministic oddities of older results")
    p.add_argument("--draw", action="store_true", help="write DOT text of the components")
    p.add_argument("--unwrap", action="store_true", help="draw k-mer by k-mer")
    p.add_argument("--assembly_report_step", type=int, help="accepted; progress is shown by Spark")
    a = p.parse_args(argv)
    spark = session()
    config = Config(
        k=a.k, min_abundance=a.minimal_abundance, percentile=a.minimal_abundance_percentile, min_abundance_mapping=a.minimal_abundance_mapping,
        identity=a.miss_percentage, filtering_fraction=a.filtering_fraction, store_low=not a.no_store_low, states=a.states, pvalue=a.pvalue_threshold,
        max_bubble=a.max_bubble, widen=a.widen, partner_threshold=a.partner_threshold, compat=a.compat, unwrap=a.unwrap,
    )
    rows = readers.experiment(spark, a.input_description).orderBy("replicate").collect()
    pairs = [(readers.reads(spark, f"{a.input_directory}/{r.treatment}"), readers.reads(spark, f"{a.input_directory}/{r.control}")) for r in rows]
    drawing = f"{a.working_dir}/drawing" if a.draw else None
    with scratch(spark):
        writers.replicated(call_peaks(spark, pairs, config, drawing), f"{a.working_dir}/replicated_peaks")


if __name__ == "__main__":
    main()
