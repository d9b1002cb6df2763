"""Scans. All go through Spark's readers, so any store Spark reads will do; gzip is read as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakmill.functions.sequence import counts_from_text, pvalue_from_label


def experiment(spark: SparkSession, path: str) -> DataFrame:
    """(replicate, treatment, control) of a tab-separated description with a header; replicates count from 1 in file order.

    A description is a few lines long; its order is the order within the file.
    """
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    names = rows.columns[:2]
    kept = rows.select(F.col(names[0]).alias("treatment"), F.col(names[1]).alias("control")).collect()
    return spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(kept, 1)], "replicate int, treatment string, control string")


def fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(read_id, header, seq, file): records may span lines. Files are cut by the reader at the lines that start with ``>``."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "\r", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    # the first piece of a file keeps its mark
    rows = rows.where(F.trim("value") != "").withColumn("value", F.regexp_replace("value", "^\\s*>", ""))
    header = F.trim(F.substring_index("value", "\n", 1))
    body = F.regexp_replace(F.expr("substr(value, length(substring_index(value, '\n', 1)) + 1)"), "\\s", "")
    return rows.select(F.substring_index(header, " ", 1).alias("read_id"), header.alias("header"), body.alias("seq"), "file")


def fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(read_id, header, seq, file): quality is dropped. Files are cut at the line starts that open a record.

    A record is the line ``@...``, its sequence, ``+...`` and the quality line;
    cutting at ``\\n@`` may also cut before a quality line that starts with
    ``@``, and such pieces hold no line with ``+`` third and fall out; the
    sequence is complete in the piece before.
    """
    rows = spark.read.option("lineSep", "\n@").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^@", ""), "\n")
    return (
        rows.select(lines.alias("l"), "file")
        .where((F.size("l") >= 3) & F.startswith(F.try_element_at("l", F.lit(3)), F.lit("+")))
        .select(F.substring_index(F.col("l")[0], " ", 1).alias("read_id"), F.col("l")[0].alias("header"), F.col("l")[1].alias("seq"), "file")
    )


def reads(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .fastq, .fq or .fasta, .fa, each also with .gz; any other raises."""
    plain = path.removesuffix(".gz")
    if plain.endswith((".fastq", ".fq")):
        return fastq(spark, path)
    if plain.endswith((".fasta", ".fa")):
        return fasta(spark, path)
    raise ValueError(f"unknown format of reads: {path}")


def pooled(frames: list[DataFrame]) -> DataFrame:
    """All records of several scans."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def kmer_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kmer string, cnt bigint").option("sep", " ").csv(path)


def sequence_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seq string, cnt int").option("sep", ";").csv(path)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seq string, counts string").option("sep", ";").csv(path).select("seq", counts_from_text(F.col("counts")).alias("base_counts"))


def first_counts(spark: SparkSession, path: str) -> DataFrame:
    """(seq, cnt) of a profile file, only the first count."""
    return profiles(spark, path).select("seq", F.col("base_counts")[0].alias("cnt"))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of unitigs whose headers hold ``id LN:i: KC:i: km:f: c1,c2,... L:±:id:±``; comp_id is the file's name."""
    f = fasta(spark, path).withColumn("p", F.split("header", " ")).withColumn("comp_id", F.regexp_extract("file", "([^/]+)\\.comp\\.fasta$", 1))
    tag = lambda name: F.regexp_extract("header", f"{name}:[a-z]:([-0-9.eE]+)", 1)
    counts = F.try_element_at(F.filter(F.slice("p", 2, 1_000_000), lambda x: F.rlike(x, F.lit("^[0-9]+(,[0-9]+)*$"))), F.lit(-1))
    vid = F.col("read_id").cast("bigint")
    vertices = f.select(
        "comp_id",
        vid.alias("vid"),
        "seq",
        counts_from_text(counts).alias("counts"),
        tag("KC").cast("bigint").alias("kc"),
        tag("km").cast("double").alias("km"),
    )
    link = F.filter("p", lambda x: F.startswith(x, F.lit("L:")))
    edges = f.select("comp_id", vid.alias("own"), F.explode(link).alias("l")).withColumn("l", F.split("l", ":"))
    signed = lambda sign, x: F.when(sign == "-", -F.abs(x)).otherwise(F.abs(x))
    edges = edges.select(
        "comp_id",
        signed(F.col("l")[1], F.col("own")).alias("src"),
        signed(F.col("l")[3], F.col("l")[2].cast("bigint")).alias("dst"),
    )
    return vertices, edges


HIT_SCHEMA = (
    "query string, target bigint, pident double, length int, mismatch int, gapopen int, "
    "qstart int, qend int, sstart int, send int, evalue double, bitscore double"
)


def hits(spark: SparkSession, path: str) -> DataFrame:
    """Twelve-column tab-separated hits; an empty file gives an empty table."""
    return spark.read.schema(HIT_SCHEMA).option("sep", "\t").csv(path)


def peaks(spark: SparkSession, path: str) -> DataFrame:
    return fasta(spark, path).select("read_id", pvalue_from_label(F.col("read_id")).alias("pvalue"), "seq", "file")


def base_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Base weights by position, as written by writers.base_profiles."""
    return spark.read.parquet(path)
