"""Reconciling the peaks of replicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakmill.functions.distances import infix_distances
from peakmill.functions.sequence import query_and_target, reverse_complement
from peakmill.operators.mapping import SEED, grams
from peakmill.operators.windows import best_per_key
from peakmill.runtime import materialize


def candidate_pairs(visible: DataFrame, new: DataFrame, threshold: float, compat: bool = False) -> DataFrame:
    """(vis_i, new_i, strand, query, target, flag, bound): pairs that can be within threshold of the shorter's length.

    A query with at most b edits inside the target keeps one of b + 1 equal
    blocks whole, so blocks and the target's substrings of their length meet in
    an equi-join. Strand combinations: as they are, one or the other turned.
    """
    turn = lambda c: reverse_complement(F.col(c), compat)
    strands = F.array(F.struct(F.lit(0).alias("strand"), F.col("seq").alias("s")), F.struct(F.lit(1).alias("strand"), turn("seq").alias("s")))
    size = lambda df: df.where("length(seq) > 0").withColumn("block", F.greatest(F.lit(1), F.floor(F.length("seq") / (F.floor(F.length("seq") * threshold) + 1))).cast("int"))

    def blocks(df: DataFrame, ident: str, other: DataFrame, other_id: str) -> DataFrame:
        """Pairs where df's sequence is the query."""
        q = size(df).select(F.col(ident), "block", F.explode(strands).alias("x")).select(ident, "block", F.col("x.strand").alias("strand"), F.col("x.s").alias("s"))
        seed = F.least(F.lit(SEED), F.col("block"))
        cut = F.transform(F.sequence(F.lit(0), F.floor(F.length("s") / F.col("block")).cast("int") - 1), lambda i: F.substring("s", i * F.col("block") + 1, F.least(F.lit(SEED), F.col("block"))))
        q = q.select(ident, "strand", F.length("s").alias("n"), seed.alias("size"), F.explode(F.array_distinct(cut)).alias("gram"))
        sized = other.withColumn("m", F.length("seq"))
        t = grams(sized, q.select("size").distinct(), other_id, "seq").select(other_id, "size", "gram").distinct().join(sized.select(other_id, "m"), other_id)
        return q.join(t, ["size", "gram"]).where("n <= m + n * %r" % threshold).select("vis_i", "new_i", "strand").distinct()

    pairs = blocks(visible, "vis_i", new, "new_i").unionByName(blocks(new, "new_i", visible, "vis_i")).distinct()
    joined = pairs.join(visible.select("vis_i", F.col("seq").alias("a")), "vis_i").join(new.select("new_i", F.col("seq").alias("b")), "new_i")
    role = query_and_target(F.col("a"), F.when(F.col("strand") == 1, reverse_complement(F.col("b"), compat)).otherwise(F.col("b")))
    out = joined.withColumn("r", role)
    return out.select("vis_i", "new_i", "strand", "r.query", "r.target", "r.flag", F.floor(F.length("r.query") * threshold).cast("int").alias("bound"))


def best_partners(visible: DataFrame, new: DataFrame, threshold: float = 0.1, compat: bool = False) -> DataFrame:
    """(new_i, vis_i, strand, query, target, flag, distance, start, end, score): each new peak's nearest visible one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            distance, start, end = infix_distances(f["query"].tolist(), f["target"].tolist(), f["bound"].to_numpy(dtype="int64"))
            f = f.assign(distance=distance, start=start, end=end)
            yield f[f["distance"] >= 0].drop(columns="bound")

    pairs = candidate_pairs(visible, new, threshold, compat)
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in pairs.columns if c != "bound"}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items())
    scored = pairs.mapInPandas(run, f"{schema}, distance bigint, start bigint, end bigint")
    scored = scored.withColumn("score", F.col("distance") / F.length("query"))
    return best_per_key(scored, ["new_i"], [F.col("score"), F.col("vis_i"), F.col("strand")])


def merge_replicate(visible: DataFrame, new: DataFrame, threshold: float = 0.1, widen: int = 5, compat: bool = False, traced: bool = False) -> DataFrame:
    """(seq, pvalue, variants) of visible(vis_i, seq, pvalue, variants) that new(new_i, seq, pvalue) supports; traced: and vis_i and sources.

    The replicated sequence is the target's stretch that the query lies on,
    widened; the query is a variant if it differs. Several new peaks on one
    visible: the shortest stretch stays, the others become variants, p is the
    largest. sources(side, i, start, end) are the peaks of either side that it
    was merged from: ``vis`` or ``new``, by their number, and the stretch of each, ends
    exclusive, that lies under the other.
    """
    hit = best_partners(visible, new, threshold, compat).join(new.select("new_i", F.col("pvalue").alias("p_new"), F.col("seq").alias("new_seq")), "new_i")
    first = F.greatest(F.col("start") - widen, F.lit(0))
    last = F.least(F.col("end") + widen, F.length("target"))
    hit = hit.withColumn("part", F.substring(F.col("target"), (first + 1).cast("int"), (last - first).cast("int"))).withColumn("variant", F.when(F.col("distance") > 0, F.col("query")))
    # the visible one is the target: the query lies on a stretch of it; or it is the query, and lies whole on a stretch of the new one
    held = F.length("query") == F.length("new_seq")
    rows = hit.groupBy("vis_i").agg(
        F.min_by("part", F.struct(F.length("part"), "part")).alias("seq"),
        F.collect_set("part").alias("parts"),
        F.array_compact(F.collect_set("variant")).alias("found"),
        F.max("p_new").alias("p_new"),
        *([F.collect_set(_stretch("vis", "vis_i", held)).alias("of_vis"), F.collect_set(_stretch("new", "new_i", ~held)).alias("of_new")] if traced else []),
    )
    rows = rows.join(visible.select("vis_i", "pvalue", "variants"), "vis_i")
    others = F.array_remove(F.array_union(F.array_union("variants", "found"), F.col("parts")), F.col("seq"))
    of = [F.col("vis_i"), F.array_sort(F.array_union("of_vis", "of_new")).alias("sources")] if traced else []
    return rows.select("seq", F.greatest("pvalue", "p_new").alias("pvalue"), F.array_sort(others).alias("variants"), *of)


def _stretch(side: str, ident: str, is_target: Column) -> Column:
    """One source of a merge: the whole query, or what it lies on in the target."""
    whole = F.length("query").cast("bigint")
    start, end = F.when(is_target, F.col("start")).otherwise(F.lit(0)), F.when(is_target, F.col("end") + 1).otherwise(whole)
    return F.struct(F.lit(side).alias("side"), F.col(ident).alias("i"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))


def overview_rows(overview: DataFrame, alignments: DataFrame, row: str) -> DataFrame:
    """overview with the alignments of its rows, by their number."""
    return overview.join(alignments, row)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with a number by sequence; peaks are few, a replicate's fit one window."""
    lot = F.pmod(F.xxhash64("seq"), F.lit(64))
    w = Window.partitionBy("lot_").orderBy("seq", "pvalue")
    return rows.withColumn("lot_", lot).withColumn(name, F.row_number().over(w).cast("bigint") * 64 + F.col("lot_")).drop("lot_")


def reconcile(replicates: list[DataFrame], threshold: float = 0.1, widen: int = 5, compat: bool = False) -> DataFrame:
    """(peak_i, pvalue, seq, variants): peaks(seq, pvalue) of all replicates folded from the first on.

    One replicate cannot be reconciled and raises; none supported gives an empty result.
    """
    if len(replicates) < 2:
        raise ValueError("at least two replicates are needed")
    none = F.array().cast("array<string>")
    visible = replicates[0].select("seq", "pvalue", none.alias("variants"))
    for new in replicates[1:]:
        vis = materialize(numbered(visible, "vis_i"), "visible")
        fresh = materialize(numbered(new.select("seq", "pvalue"), "new_i"), "fresh")
        visible = materialize(merge_replicate(vis, fresh, threshold, widen, compat), "replicated")
    return numbered(visible, "peak_i").select("peak_i", "pvalue", "seq", "variants")


def tournament(replicates: list[DataFrame], threshold: float = 0.1, widen: int = 5) -> DataFrame:
    """Like reconcile, but in pairs, level by level; an odd one out waits for the next level.

    (peak_i, pvalue, seq, variants, sources): sources(replicate, peak, start,
    end) are all peaks of the replicates, from 0, that a peak was merged from,
    by their own sequence, each with its stretch under its partner in its own
    first merge. They come from one list of merges, (level, result, side, peak),
    that is followed upwards level by level.
    """
    none = F.array().cast("array<string>")
    kind = "array<struct<replicate:int,peak:string,start:bigint,end:bigint>>"

    def leaf(r: DataFrame, i: int) -> DataFrame:
        own = F.struct(F.lit(i).cast("int").alias("replicate"), F.col("seq").alias("peak"), F.lit(0).cast("bigint").alias("start"), F.length("seq").cast("bigint").alias("end"))
        return r.select("seq", "pvalue", none.alias("variants"), F.array(own).cast(kind).alias("sources"), F.lit(True).alias("fresh"))

    level = [leaf(r, i) for i, r in enumerate(replicates)]
    while len(level) > 1:
        merged = []
        for a, b in zip(level[::2], level[1::2], strict=False):
            vis = materialize(numbered(a, "vis_i"), "visible")
            new = materialize(numbered(b, "new_i"), "fresh")
            made = materialize(merge_replicate(vis.select("vis_i", "seq", "pvalue", "variants"), new.select("new_i", "seq", "pvalue"), threshold, widen, traced=True), "replicated")
            # up the list of merges: what either side was merged from
            edges = made.select("seq", "pvalue", "variants", F.explode("sources").alias("x"))
            edges = materialize(edges.select("seq", "pvalue", "variants", "x.side", "x.i", F.col("x.start").alias("s"), F.col("x.end").alias("e")), "merges")
            sides = vis.select(F.lit("vis").alias("side"), F.col("vis_i").alias("i"), "sources", "fresh").unionByName(new.select(F.lit("new").alias("side"), F.col("new_i").alias("i"), "sources", "fresh"))
            below = edges.join(sides, ["side", "i"]).select("seq", "pvalue", "variants", "s", "e", "fresh", F.explode("sources").alias("o"))
            kept = lambda own, new_: F.when(F.col("fresh"), F.col(new_)).otherwise(F.col(own))
            of = F.struct(F.col("o.replicate").alias("replicate"), F.col("o.peak").alias("peak"), kept("o.start", "s").alias("start"), kept("o.end", "e").alias("end"))
            up = below.groupBy("seq", "pvalue", "variants").agg(F.array_sort(F.collect_set(of)).cast(kind).alias("sources"))
            merged.append(materialize(up.withColumn("fresh", F.lit(False)), "level"))
        level = merged + ([level[-1]] if len(level) % 2 else [])
    return numbered(level[0], "peak_i").select("peak_i", "pvalue", "seq", "variants", "sources")
