"""Sinks. Parquet inside, text for exchange; every writer is one distributed job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakmill.functions.sequence import counts_to_text, pvalue_label


def _text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def fasta_lines(header: object, seq: object) -> object:
    return F.concat(F.lit(">"), header, F.lit("\n"), seq)


def unitigs(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """vertices(vid, seq, counts), edges(src, dst) with headers rebuilt: LN, KC, km, counts, links of both signs."""
    sign = lambda c: F.when(c < 0, "-").otherwise("+")
    link = F.concat_ws(":", F.lit("L"), sign(F.col("src")), F.abs("dst").cast("string"), sign(F.col("dst")))
    links = edges.select(F.abs("src").alias("vid"), link.alias("l")).groupBy("vid").agg(F.array_join(F.array_sort(F.collect_set("l")), " ").alias("links"))
    kc = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    header = F.concat_ws(
        " ",
        F.col("vid").cast("string"),
        F.concat(F.lit("LN:i:"), F.length("seq").cast("string")),
        F.concat(F.lit("KC:i:"), kc.cast("string")),
        F.concat(F.lit("km:f:"), F.round(F.try_divide(kc, F.size("counts")), 1).cast("string")),
        counts_to_text(F.col("counts")),
        "links",
    )
    _text(vertices.where("vid > 0").join(links, "vid", "left").select(fasta_lines(header, F.col("seq"))), path)


def components(vertices: DataFrame, path: str) -> None:
    """One folder a component; single vertices share the folder of -1."""
    vertices.withColumn("comp_id", F.coalesce("comp_id", F.lit(-1))).write.mode("overwrite").partitionBy("comp_id").parquet(path)


def low_kmers(kmers: DataFrame, path: str) -> None:
    """kmers(kmer, cnt) under headers ``row_count_n``; rows are numbered by any order."""
    rows = kmers.withColumn("row", F.monotonically_increasing_id())
    _text(rows.select(fasta_lines(F.concat(F.col("row").cast("string"), F.lit("_count_"), F.col("cnt").cast("string")), F.col("kmer"))), path)


def assembled(rows: DataFrame, path: str) -> None:
    _text(rows.select(F.concat_ws(";", "seq", F.col("cnt").cast("string"))), path)


def profiles(rows: DataFrame, path: str) -> None:
    _text(rows.select(F.concat_ws(";", "seq", counts_to_text(F.col("base_counts")))), path)


def peaks(rows: DataFrame, path: str) -> None:
    """rows(profile_id, peak_i, seq, pvalue)."""
    header = F.concat(F.lit("assembled_sq_"), F.col("profile_id").cast("string"), F.lit("__peak_"), F.col("peak_i").cast("string"), F.lit("__pvalues_"), pvalue_label(F.col("pvalue")))
    _text(rows.select(fasta_lines(header, F.col("seq"))), path)


def replicated(rows: DataFrame, path: str) -> None:
    """rows(peak_i, pvalue, seq, variants): the peak, then its variants, numbered from 0 within the peak."""
    every = rows.select("peak_i", "pvalue", F.posexplode(F.concat(F.array("seq"), F.coalesce("variants", F.array().cast("array<string>")))).alias("n", "s"))
    header = F.concat(F.col("n").cast("string"), F.lit("_peak:"), F.col("peak_i").cast("string"), F.lit("_pval:"), pvalue_label(F.col("pvalue")))
    _text(every.select(fasta_lines(header, F.col("s"))), path)


def replaced(rows: DataFrame, path: str) -> None:
    """Error variants, tab separated under a header line; counts as text."""
    out = rows.select(
        F.col("kind").alias("about"), F.col("archived_seq").alias("archived_sq"), F.col("mapped_to_seq").alias("mapped_to_sq"), counts_to_text(F.col("counts")).alias("counts_from_total"), F.col("edit_distance").alias("edit distance")
    )
    out.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def base_profiles(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def overview(rows: DataFrame, path: str) -> None:
    """rows(seq, str_count, length, alignment_actual, alignment) with a header line."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def dot(vertices: DataFrame, edges: DataFrame, path: str, required: float = 1.0) -> None:
    """DOT text of a component graph; pen width is mean count over required, 15 at most. Layout is left to other tools."""
    mean = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c) / F.greatest(F.size("counts"), F.lit(1))
    width = F.least(mean / F.lit(required), F.lit(15.0))
    nodes = vertices.select("comp_id", F.format_string('"%d" [label="%d", penwidth=%.2f];', "vid", F.length("seq"), width).alias("value"))
    arcs = edges.select("comp_id", F.format_string('"%d" -> "%d";', "src", "dst").alias("value"))
    nodes.unionByName(arcs).write.mode("overwrite").partitionBy("comp_id").text(path)
