"""Inputs of the registered queries, derived from whole tables, in Spark and in SQL.

The tables hold no DNA. Reads are documents' texts with letters turned into
bases, letter by letter; anything else falls out. The document's number gives
the arm (even: treatment) and the replicate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from peakmill.functions.codes import translated
from peakmill.runtime import spread, table

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGT" * 13
K = 11
#: The base of each letter, by its byte; others fall out.
_BASE_OF = np.zeros(256, np.uint8)
_BASE_OF[np.frombuffer(LETTERS.encode(), np.uint8)] = np.frombuffer(BASES.encode(), np.uint8)

READS_SQL = f"""reads AS (
  SELECT doc_id AS read_id, CASE WHEN doc_id % 2 = 0 THEN 'treatment' ELSE 'control' END AS arm, CAST((doc_id // 2) % 2 + 1 AS INTEGER) AS replicate,
    regexp_replace(translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g') AS seq
  FROM documents)"""


def kmers_sql(k: int) -> str:
    return f"""{READS_SQL},
kmers AS (SELECT read_id, arm, replicate, substr(seq, i, {k}) AS kmer FROM reads, unnest(range(1, CAST(length(seq) AS BIGINT) - {k} + 2)) u(i)),
arms AS MATERIALIZED (SELECT replicate, kmer, count(*) FILTER (arm = 'treatment') AS treat, count(*) FILTER (arm = 'control') AS ctrl FROM kmers GROUP BY ALL),
t AS (SELECT replicate, kmer, treat AS cnt FROM arms WHERE treat > 0)"""


def corrected_sql(k: int) -> str:
    return f"""{kmers_sql(k)},
scale AS (SELECT replicate, 0.99 * sum(treat) / sum(ctrl) AS scale FROM arms WHERE treat > 0 GROUP BY replicate),
corrected AS (
  SELECT replicate, kmer, CAST(greatest(treat - round_even(ctrl * coalesce(scale, 0), 0), 0) AS BIGINT) AS cnt
  FROM arms JOIN scale USING (replicate) WHERE treat > 0)"""


KMERS_SQL = kmers_sql(K)
CORRECTED_SQL = corrected_sql(K)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, arm, replicate, seq)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = docs.select(
        F.col("doc_id").alias("read_id"),
        F.when(F.col("doc_id") % 2 == 0, "treatment").otherwise("control").alias("arm"),
        (F.floor(F.col("doc_id") / 2) % 2 + 1).cast("int").alias("replicate"),
        F.coalesce("text", F.lit("")).alias("seq"),
    )
    schema = to_arrow_schema(named.schema)
    return named.mapInArrow(lambda batches: translated(batches, _BASE_OF, schema), named.schema)


def arm(counted: DataFrame, name: str) -> DataFrame:
    return counted.where(F.col("arm") == name).drop("arm")
