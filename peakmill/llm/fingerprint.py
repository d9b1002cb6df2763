"""Threshold-scaled document sketches, DataFrame functions only.

One rule holds for every text: its fingerprint keeps each 5-word shingle hash
below a fixed fraction of the hash range, and its FLOOR smallest hashes, which
lie below it already unless the text is short. The rule applied to the union of
two fingerprints gives the fingerprint of both texts' shingles together, so
fingerprints merge exactly at any length, and the share of one text found in a
much longer one can be estimated from both below their common cut.

Defined results: null text is empty; a text without words has an empty
fingerprint, whose likeness is 1 to another empty one and 0 to any other. A
text with one to four words has its whole sequence as its one shingle. doc_id
is of an integral or string type, with whatever gaps. Rows of equal doc_id
follow one another in the order of their texts' hashes; rows with a null doc_id
come last. A single row is its own successor. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORDS = 5
#: One hash in so many is kept.
SCALE = 4
#: At least so many of the smallest are kept.
FLOOR = 16
RANGE = 1 << 63
#: Neighbouring rows of one window group, about, and the most groups there are (their edges are a list in the plan).
RUN = 1024
MOST_RUNS = 1 << 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column) -> Column:
    """63-bit hashes of the text's shingles, repeats included."""
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    last = F.lit(RANGE - 1)

    def chain(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WORDS)
        full = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WORDS)]).bitwiseAND(last))
        return (
            F.when(F.size(h) >= WORDS, full)
            .when(F.size(h) > 0, F.array(F.xxhash64(h, F.size(h)).bitwiseAND(last)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), chain)


def keep(hashes: Column, scale: int) -> Column:
    """The rule: of distinct sorted hashes those below the cut, and the FLOOR smallest."""
    return F.filter(hashes, lambda h, i: (h <= RANGE // scale - 1) | (i < FLOOR))


def sketch(text: Column, scale: int = SCALE) -> Column:
    """Sorted hashes that the fingerprint of a text keeps."""

    def kept(a: Column) -> Column:
        small = F.array_distinct(F.filter(a, lambda h: h <= RANGE // scale - 1))
        # only short texts need all their hashes sorted
        return let(small, lambda c: F.when(F.size(c) >= FLOOR, F.sort_array(c)).otherwise(keep(F.sort_array(F.array_distinct(a)), scale)))

    return let(shingle_hashes(text), kept)


def cut(s: Column, scale: int = SCALE) -> Column:
    """Up to here a sketch holds every hash of its text."""
    return F.when(F.size(s) < FLOOR, F.lit(RANGE - 1)).otherwise(F.greatest(F.lit(RANGE // scale - 1), F.element_at(s, -1)))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of two texts' shingles together."""
    return keep(F.sort_array(F.array_union(a, b)), scale)


def _below(a: Column, b: Column, scale: int, body: Callable[[Column, Column], Column]) -> Column:
    return let(
        F.least(cut(a, scale), cut(b, scale)),
        lambda low: let(F.filter(a, lambda h: h <= low), lambda x: let(F.filter(b, lambda h: h <= low), lambda y: body(x, y))),
    )


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Jaccard similarity of two sketches below their common cut, 0 to 1."""

    def share(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return F.when(F.size(x) + F.size(y) > 0, both / (F.size(x) + F.size(y) - both)).otherwise(
            F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0)
        )

    return _below(a, b, scale, share)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The share of a's shingles that b holds too, estimated below the common cut; null if nothing of a lies there."""
    return _below(a, b, scale, lambda x, y: F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)))


def render(s: Column) -> Column:
    """Sixteen hex digits a hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def upto(edges: Column, n: int, value: Column) -> Column:
    """How many of n sorted edges are at most value, by binary search."""

    def step(held: Column, _: Column) -> Column:
        middle = F.floor((held["lo"] + held["hi"]) / 2).cast("int")
        above = F.struct((middle + 1).alias("lo"), held["hi"].alias("hi"))
        below = F.struct(held["lo"].alias("lo"), middle.alias("hi"))
        return F.when(held["lo"] >= held["hi"], held).when(F.get(edges, middle) <= value, above).otherwise(below)

    if not n:
        return F.lit(0)
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(math.ceil(math.log2(n + 1)))), start, step, lambda held: held["lo"])


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with next_text, that of the next row by doc_id; after the last comes the first.

    Rows are dealt by runs of neighbours, whose edges Spark's range sampler
    chose, so runs are even however the ids are spread. Each run's last row
    gets the first of the next run, by a join of one row a run on either side.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    # the same columns go into every use of the dealt rows, so that they are dealt once
    rows = docs.select("text", place.alias("place"))
    parts = max(1, min(MOST_RUNS, docs.count() // RUN))
    dealt = rows.select("place").repartitionByRange(parts, "place").withColumn("part", F.spark_partition_id())
    lows = dealt.groupBy("part").agg(F.min("place").alias("low")).orderBy("low").select(F.to_json("low").alias("low")).collect()  # at most MOST_RUNS rows
    edges = [r["low"] for r in lows[1:]]
    table = F.from_json(F.lit(f"[{','.join(edges)}]"), f"array<{rows.schema['place'].dataType.simpleString()}>")
    runs = len(edges) + 1
    # never null: no filter before the exchange of one use that others don't have
    near = Window.partitionBy("run").orderBy("place", "text")
    dealt = rows.withColumn("run", F.coalesce(upto(table, len(edges), F.col("place")), F.lit(0))).withColumns({"next_text": F.lead("text").over(near), "nth": F.row_number().over(near)})
    # every run holds a row: the one that is its lower edge
    starts = dealt.where("nth = 1").select(F.pmod(F.col("run") - 1, F.lit(runs)).alias("run"), F.col("text").alias("next_text"))
    ends = dealt.where("next_text is null").select("place", "text", "run")
    bridged = ends.join(starts, "run").select("place", "text", "next_text")
    every = dealt.where("next_text is not null").select("place", "text", "next_text").unionByName(bridged)
    return every.select(F.col("place.id").alias("doc_id"), "text", "next_text")


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """(doc_id, sketch, fingerprint) for every row of docs(doc_id, text)."""
    s = docs.select("doc_id", sketch(F.coalesce(F.col("text").cast("string"), F.lit("")), scale).alias("sketch"))
    return s.select("doc_id", "sketch", render(F.col("sketch")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Each text's fingerprint against that of its edited text and of the next document's text.

    The edited text has its last floor(n_chars / 2) code points replaced by as
    many first ones (or all) of the next document.
    """
    pairs = with_next(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_text").select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text"), scale).alias("own"),
        sketch(F.col("edited"), scale).alias("new"),
        sketch(F.col("next_text"), scale).alias("next"),
    )
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        render(F.col("own")).alias("fingerprint"),
        render(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new"), scale).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), scale).alias("near_next"),
    )
