"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source with rate r = target / source size is taken floor(r)
times for certain and once more with inclusion probability r - floor(r). The
cube method turns the probabilities into zeros and ones: a flight moves three
undecided documents at a time along the direction that leaves both the token
total and the document total of the sample as they are, until one of the three
is decided. Groups of bounded size fly apart; each leaves at most two undecided
documents, and these fly again in ever fewer groups until one group a source
is left. That one keeps ten documents of spread sizes for a small landing
problem, which is solved outright: the choice nearest both totals.

Draws are hashes of the seed and the group, so reruns agree. Sizes, totals and
targets cover all rows; the documents of a hot source are spread over many
groups.

Defined results: null text has size 0. A null source is a source of its own,
last in order. Documents of size 0 share their source's rate like any other.
A doc_id may repeat or be null; every row is a unit of its own, and rows of one
doc_id are dealt to flights by their texts. Extra columns, whatever their
names, are kept by ``mix`` and ignored by ``allocate``. Empty tables give empty
ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakmill.llm.words import slices
from peakmill.runtime import materialize, parts_for

#: Undecided documents of one flight.
FLIGHT = 4_000
#: Documents that the last flight of a source keeps for the landing.
RESERVE = 10
EPS = 1e-9


def words_of(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, source, size, digest of the text), and the extra bigint columns as they are."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [np.diff(t.first) for _, _, t in slices(b.column("text"))]
            size = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), size, b.column("digest"), *map(b.column, extra)], ["doc_id", "source", "size", "digest", *extra]
            )

    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), text.alias("text"), F.xxhash64(text).alias("digest"), *extra)
    return rows.mapInArrow(run, f"doc_id {kind}, source string, size bigint, digest bigint" + "".join(f", {c} bigint" for c in extra))


def ranked(sources: DataFrame, parts: int) -> DataFrame:
    """sources with rank, 0 for the first by code point, null last.

    Sorted by range, with each range's rank counted on from the ranges before;
    the driver sees one count a range.
    """
    order = F.col("source").asc_nulls_last()
    dealt = materialize(sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))  # a row a range
    own = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("own", own).join(F.broadcast(base), "part").withColumn("rank", F.col("base") + F.col("own")).drop("part", "own", "base")


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes split by the repeating weights.

    A target stops at ``most`` times its source's size; the excess is shared
    again by weight among the others until none is above. Each pass is an
    aggregate over the sources' table; one row a pass reaches the driver.
    """
    sums = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(ranked(sums, parts_for(sums.count(), 50_000)).withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size")), "targets")
    total = share * (table.agg(F.sum("source_size")).collect()[0][0] or 0)
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("weight")
        caps, free = table.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).collect()[0]
        if not free:
            break
        new = max(0.0, total - caps) / free
        if level is not None and new <= level * (1 + 1e-15):
            break
        level = new
    target = F.col("cap") if level is None or not total else F.least("cap", F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def fly(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Flight phase over (1, size): at most two of the returned probabilities are neither 0 nor 1."""
    p = p.copy()
    open_: list[int] = []
    nxt = 0
    n = len(p)
    draws = draw.random(2 * n + 8)
    used = 0
    x = size.astype(float)
    while True:
        while len(open_) < 3 and nxt < n:
            if EPS < p[nxt] < 1 - EPS:
                open_.append(nxt)
            nxt += 1
        if len(open_) < 3:
            break
        a, b, c = open_
        # null space of [[1, 1, 1], [xa, xb, xc]]
        u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up, down = np.inf, np.inf
        for i, d in zip(open_, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, -p[i] / d), min(down, (p[i] - 1) / d)
        step = up if draws[used % len(draws)] * (up + down) < down else -down
        used += 1
        for i, d in zip(open_, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * d))
            if p[i] <= EPS or p[i] >= 1 - EPS:
                p[i] = round(p[i])
        open_ = [i for i in open_ if EPS < p[i] < 1 - EPS]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the undecided (RESERVE + 2 at most) together: of all choices, the one whose tokens and then documents come nearest the expected."""
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if not len(left):
        return p
    bits = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    tokens = np.abs(bits @ size[left].astype(float) - (p[left] * size[left]).sum())
    documents = np.abs(bits.sum(1) - p[left].sum())
    # a document too many or too few weighs as a hundredth of a mean document's tokens
    best = int((tokens + documents * max(1.0, size[left].mean() / 100)).argmin())
    p = p.copy()
    p[left] = bits[best]
    return p


def last_flight(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Fly all but RESERVE undecided documents of evenly spread sizes, then land those with what is left."""
    undecided = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    by_size = undecided[np.argsort(size[undecided], kind="stable")]
    kept = by_size[np.unique(np.linspace(0, len(by_size) - 1, min(RESERVE, len(by_size))).astype(int))] if len(by_size) else by_size
    rest = np.setdiff1d(np.arange(len(p)), kept)
    p = p.copy()
    p[rest] = fly(p[rest], size[rest], draw)
    return land(p, size)


def flight(seed: int, level: int, final: bool, names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The work of one group at one level; the last level's single group of a source also lands."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        # large documents are decided first, so that what is left to land is small
        by = [c for c in ("size", "unit", "doc_key", "row_key") if c in names]
        g = g.sort_values(by, ascending=[c != "size" for c in by], kind="stable")
        rng = np.random.default_rng([seed, level, int(g["unit"].iloc[0]) & 0xFFFFFFFF, len(g)])
        size = g["size"].to_numpy(np.int64)
        g["p"] = (last_flight if final else fly)(g["p"].to_numpy(float), size, rng)
        return g[names]

    return work


def cube(units: DataFrame, seed: int) -> DataFrame:
    """units(group columns source, size, unit, p) with p decided, 0 or 1.

    Every level flies groups of about FLIGHT units; the undecided two of each
    group go on to the next level.
    """
    done = None
    level = 0
    while True:
        counts = units.groupBy("source").agg(F.ceil(F.count("p") / FLIGHT).alias("groups"))
        last = not counts.where("groups > 1").limit(1).count()
        salted = units.join(counts.select(F.col("source").alias("s"), "groups"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        salted = salted.withColumn("salt", F.pmod(F.xxhash64("unit", F.lit(seed + level)), F.col("groups")).cast("long")).drop("groups")
        work = flight(seed, level, last, units.schema.names)
        flown = materialize(salted.groupBy("source", "salt").applyInPandas(work, units.schema), "flight")
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done = flown.where(~open_) if done is None else done.unionByName(flown.where(~open_))
        if last:
            return done
        units = flown.where(open_)
        level += 1


def allocate(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of docs(doc_id, source, text)."""
    return _allocate(docs, weights, share, most, seed)


def _allocate(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, extra: tuple[str, ...] = ()
) -> DataFrame:
    """What allocate gives, and the extra bigint columns of docs."""
    # few and even files, however many parts the texts came in
    sized = materialize(words_of(docs, *extra).hint("rebalance"), "sizes")
    table = materialize(targets(sized, weights, share, most), "rates").withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = sized.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    whole = F.floor(F.col("rate") + EPS)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    unit = F.xxhash64(key, "digest", *extra, F.lit(seed))
    rated = rated.withColumns({"whole": whole, "p": F.greatest(F.col("rate") - whole, F.lit(0.0)), "doc_key": key, "unit": unit})
    decided = cube(rated.select("source", "doc_id", "doc_key", "size", "source_size", "target", "whole", "unit", "p", *extra), seed)
    copies = (F.col("whole") + F.round("p")).cast("long")
    return decided.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *extra)


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's columns (maps, which can't be hashed, apart), nulls at their places."""
    columns = [docs[f"`{f.name}`"] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[x for c in columns for x in (c.isNull(), c)])


def mix(docs: DataFrame, **how: object) -> DataFrame:
    """docs as mixed: each row as many times as allocate takes it, all its columns as they are.

    A row is known by a hash of its columns, not by its doc_id, which may repeat
    or be null. Of rows equal in all columns as many are taken more often as
    allocate decided.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    keyed = docs.select(row, row_key(docs).alias("row_key"))
    copies = _allocate(keyed.select("row.doc_id", "row.source", "row.text", "row_key"), **how, extra=("row_key",))
    taken = copies.groupBy("row_key").agg(F.sum("copies").alias("taken"), F.count("copies").alias("rows")).where("taken > 0")
    # as many rows as documents: never broadcast
    joined = keyed.join(taken.hint("merge"), "row_key")
    # equal rows share their copies, evenly
    nth = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    some = F.floor(F.col("taken") / F.col("rows")) + (nth <= F.col("taken") % F.col("rows")).cast("long")
    counted = joined.withColumn("some", some.cast("int")).where("some > 0")
    return counted.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("some")))).select("row.*")
