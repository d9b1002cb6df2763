"""k-mer counting, control correction and thresholds; all DataFrame operators.

k-mers travel as numbers (see ``pack``). They are counted batch by batch of
reads, then in a partial aggregate before its shuffle; treatment and control are counted in the same one, side by
side, so that correcting one by the other needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from peakmill.functions import codes as lots_of
from peakmill.functions.codes import merged, stretches, tallies
from peakmill.functions.sequence import BITS, clamp_difference, fraction, half_even, kmer_digits, pack, reverse_complement, unpack
from peakmill.operators.windows import exact_quantile

#: Lots of codes a part of the input: a few million codes each at most.
LOTS = 32


def explode_codes(reads: DataFrame, k: int, *keys: str | Column, both_strands: bool = False) -> DataFrame:
    """(keys, code): one row for each k-mer occurrence of reads(seq)."""
    rows = reads.select(*keys, F.explode(kmer_digits(F.col("seq"), k, both_strands)).alias("code"))
    return rows.withColumn("code", pack(F.col("code"), k))


def explode_kmers(reads: DataFrame, k: int, *keys: str) -> DataFrame:
    """One row for each k-mer occurrence, with the key columns."""
    return explode_codes(reads, k, *keys).select(*keys, unpack(F.col("code"), k).alias("kmer"))


def count_sides(rows: DataFrame, k: int, names: list[str], *keys: str, both_strands: bool = False, listed: bool = False) -> DataFrame:
    """(keys, kmer, names): counts of rows(keys, side, seq) by side, numbered from 0 as the names are.

    Tasks count millions of letters at a time and shuffle the counts by lots of
    codes, as arrays; each lot is merged by itself. Lots are many times the
    parts of the input, so that they don't grow with it. listed: sequences of
    one side more, not named, are a list; only k-mers in it are returned.
    """
    typed = [f for f in rows.select(*keys).schema]
    rows = rows.select(*keys, "side", "seq")
    if k > BITS:
        codes = explode_codes(rows, k, *keys, "side", both_strands=both_strands)
        made = codes.groupBy(*keys, "code").agg(*(F.count_if(F.col("side") == i).alias(x) for i, x in enumerate([*names, "list_"])))
        made = made.where("list_ > 0") if listed else made
        return made.select(*keys, unpack(F.col("code"), k).alias("kmer"), *names)
    result = StructType([*typed, StructField("kmer", StringType()), *(StructField(x, LongType()) for x in names)])
    result_arrow = to_arrow_schema(result)
    return _tallied(rows, k, *keys, both_strands=both_strands).groupBy("lot").applyInArrow(lambda t: merged(t, k, len(names), listed, result_arrow), result)


def _tallied(rows: DataFrame, k: int, *keys: str, both_strands: bool = False) -> DataFrame:
    """(keys, side, lot, codes, n) of rows(keys, side, seq): see tallies(); of longer k-mers (keys, side, lot, letters, n): see stretches()."""
    long = k > lots_of.TALLIED and not both_strands
    lots = min(LOTS * max(1, rows.rdd.getNumPartitions()), 1 << 16)
    fields = [StructField("side", IntegerType()), StructField("lot", IntegerType()), StructField("letters" if long else "codes", BinaryType()), StructField("n", BinaryType())]
    dealt = StructType([*rows.select(*keys).schema, *fields])
    dealt_arrow = to_arrow_schema(dealt)
    deal = (lambda batches: stretches(batches, k, lots, dealt_arrow)) if long else (lambda batches: tallies(batches, k, both_strands, lots, dealt_arrow))
    return rows.select(*keys, "side", "seq").mapInArrow(deal, dealt)


def summed_corrected(reads: DataFrame, k: int, treated: Column, *keys: str, factor: float = 0.99, least: int = 1, below: int | None = None) -> DataFrame:
    """(kmer, cnt): corrected_arms of count_arms by keys, added up over the keys, from least on and below a count.

    All keys' counts of a k-mer are in one lot: they are corrected and added up there, and only k-mers that stay are spelled.
    """
    if k > BITS:
        made = corrected_arms(count_arms(reads, k, treated, *keys), *keys, factor=factor).groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
        return made.where(F.col("cnt") >= least) if below is None else made.where((F.col("cnt") >= least) & (F.col("cnt") < below))
    # both passes read one shuffle; rows without a key, which the join drops, go before it, so that it is the same for both
    rows = _tallied(_by_arm(reads, treated, *keys), k, *keys)
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    rows = rows.repartition("lot")
    sums = StructType([*rows.select(*keys).schema, StructField("treat", LongType()), StructField("ctrl", LongType())])
    result = StructType([StructField("kmer", StringType()), StructField("cnt", LongType())])
    sums_arrow, result_arrow = to_arrow_schema(sums), to_arrow_schema(result)
    scale = arms_scale(rows.groupBy("lot").applyInArrow(lambda t: lots_of.totals(t, k, sums_arrow), sums), *keys, factor=factor)
    scaled = rows.join(F.broadcast(scale), list(keys)) if keys else rows.crossJoin(F.broadcast(scale))  # a row a replicate
    return scaled.select(*rows.columns, "scale").groupBy("lot").applyInArrow(lambda t: lots_of.corrected(t, k, least, below, result_arrow), result)


def count_kmers(reads: DataFrame, k: int, *keys: str, both_strands: bool = False) -> DataFrame:
    """(keys, kmer, cnt); both_strands counts a k-mer with its reverse complement, under the smaller."""
    return count_sides(reads.select(*keys, F.lit(0).alias("side"), "seq"), k, ["cnt"], *keys, both_strands=both_strands)


def _by_arm(reads: DataFrame, treated: Column, *keys: str) -> DataFrame:
    return reads.select(*keys, F.when(treated, 0).otherwise(1).alias("side"), "seq")


def count_arms(reads: DataFrame, k: int, treated: Column, *keys: str, both_strands: bool = False) -> DataFrame:
    """(keys, kmer, treat, ctrl): counts in the reads where treated holds and in the others, in one aggregate."""
    return count_sides(_by_arm(reads, treated, *keys), k, ["treat", "ctrl"], *keys, both_strands=both_strands)


def count_arms_listed(reads: DataFrame, keys: DataFrame, k: int, treated: Column) -> DataFrame:
    """count_arms of the k-mers in keys(kmer), or in longer sequences there, alone, those that never occur too: no other is ever spelled."""
    rows = _by_arm(reads, treated).unionByName(keys.select(F.lit(2).alias("side"), F.col("kmer").alias("seq")))
    return count_sides(rows, k, ["treat", "ctrl"], listed=True)


def distinct_kmers(reads: DataFrame, k: int, *keys: str) -> DataFrame:
    return count_kmers(reads, k, *keys).drop("cnt")


def count_subset(keys: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """Counts of the listed k-mers only; listed ones that never occur count 0."""
    return keys.join(counts, on, "left").fillna({"cnt": 0})


def count_listed(reads: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """count_subset without spelling anything else."""
    listed = keys.select("kmer").distinct()
    rows = reads.select(F.lit(0).alias("side"), "seq").unionByName(listed.select(F.lit(1).alias("side"), F.col("kmer").alias("seq")))
    return count_subset(listed, count_sides(rows, k, ["cnt"], listed=True), ["kmer"])


def control_scale(treat: DataFrame, ctrl: DataFrame, *keys: str, factor: float = 0.99) -> DataFrame:
    """(keys, scale): factor * sum of treatment counts / sum of control counts; null without control."""
    t = treat.groupBy(*keys).agg(F.sum("cnt").alias("t"))
    c = ctrl.groupBy(*keys).agg(F.sum("cnt").alias("c"))
    joined = t.join(c, list(keys), "left") if keys else t.crossJoin(c)  # one row each
    return joined.select(*keys, F.try_divide(F.lit(factor) * F.col("t"), F.col("c")).alias("scale"))


def arms_scale(both: DataFrame, *keys: str, factor: float = 0.99) -> DataFrame:
    """control_scale of count_arms' (keys, kmer, treat, ctrl), in one aggregate."""
    return both.groupBy(*keys).agg(F.try_divide(F.lit(factor) * F.sum("treat"), F.sum("ctrl")).alias("scale"))


def subtract_control(treat: DataFrame, ctrl: DataFrame, *keys: str, factor: float = 0.99, keep_zero: bool = False) -> DataFrame:
    """(keys, kmer, cnt): treatment less half-even-rounded scaled control, not below 0; zeros go.

    Control counts only over treatment's k-mers enter the scale.
    """
    on = [*keys, "kmer"]
    known = ctrl.join(treat.select(*on), on, "left_semi")
    scale = control_scale(treat, known, *keys, factor=factor)
    rows = treat.join(known.withColumnRenamed("cnt", "ctrl"), on, "left").fillna({"ctrl": 0})
    rows = rows.join(F.broadcast(scale), list(keys), "left") if keys else rows.crossJoin(F.broadcast(scale))  # a row a replicate
    scaled = F.coalesce(half_even(F.col("ctrl") * F.col("scale")), F.lit(0.0))
    out = rows.select(*on, clamp_difference(F.col("cnt").cast("double"), scaled).cast("bigint").alias("cnt"))
    return out if keep_zero else out.where("cnt > 0")


def corrected_arms(both: DataFrame, *keys: str, factor: float = 0.99, keep_zero: bool = False, listed: bool = False) -> DataFrame:
    """subtract_control of count_arms' (keys, kmer, treat, ctrl), without a join of k-mers.

    listed: the rows are a given list of k-mers, and control counts of all of
    them enter the scale, not only of those that treatment has.
    """
    treat = both.where("treat > 0")
    scale = arms_scale(both if listed else treat, *keys, factor=factor)
    rows = treat.join(F.broadcast(scale), list(keys)) if keys else treat.crossJoin(F.broadcast(scale))  # a row a replicate
    scaled = F.coalesce(half_even(F.col("ctrl") * F.col("scale")), F.lit(0.0))
    out = rows.select(*keys, "kmer", clamp_difference(F.col("treat").cast("double"), scaled).cast("bigint").alias("cnt"))
    return out if keep_zero else out.where("cnt > 0")


def low_abundance(counts: DataFrame, least: int) -> DataFrame:
    return counts.where((F.col("cnt") > 0) & (F.col("cnt") < least))


def abundant(counts: DataFrame, least: int) -> DataFrame:
    return counts.where(F.col("cnt") >= least)


def present_kmers(low: DataFrame, high: DataFrame) -> DataFrame:
    """All k-mers of both, duplicates kept."""
    return low.unionByName(high)


def minimal_abundance(unitigs: DataFrame, percentile: float = 95.0, *keys: str) -> DataFrame:
    """(keys, min_abundance): the mean abundances' percentile, interpolated, rounded up."""
    return exact_quantile(unitigs, list(keys), "km", percentile / 100).select(*keys, F.ceil("quantile").cast("bigint").alias("min_abundance"))


def outer_counts(treat: DataFrame, ctrl: DataFrame, on: list[str]) -> DataFrame:
    """(on, treat, ctrl) of either table's k-mers, missing counts 0."""
    return treat.withColumnRenamed("cnt", "treat").join(ctrl.withColumnRenamed("cnt", "ctrl"), on, "full").fillna({"treat": 0, "ctrl": 0})


def arm_windows(reads: DataFrame, k: int, treated: Column) -> DataFrame:
    """One row (treat, ctrl): how many k-mers the reads hold, from the lengths of their runs of letters."""
    n = F.aggregate(F.split("seq", "[^ACGT]+"), F.lit(0).cast("bigint"), lambda a, x: a + F.greatest(F.length(x) - (k - 1), F.lit(0)))
    side = lambda c: F.sum(F.when(c, n).otherwise(0))
    arm = F.coalesce(treated, F.lit(False))
    return reads.agg(side(arm).alias("treat"), side(~arm).alias("ctrl"))


def reconstruction(both: DataFrame, *keys: str, factor: float = 0.99, totals: DataFrame | None = None) -> DataFrame:
    """both with ctrl scaled to treatment's total and reconstruction = treat - ctrl, not below 0. totals(keys, treat, ctrl): where both are not all k-mers."""
    total = (both if totals is None else totals).groupBy(*keys).agg(F.try_divide(F.lit(factor) * F.sum("treat"), F.sum("ctrl")).alias("scale"))
    rows = both.join(F.broadcast(total), list(keys)) if keys else both.crossJoin(F.broadcast(total))  # a row a replicate
    ctrl = F.col("ctrl") * F.coalesce("scale", F.lit(0.0))
    return rows.withColumn("ctrl", ctrl).withColumn("reconstruction", clamp_difference(F.col("treat").cast("double"), F.col("ctrl"))).drop("scale")


def kmer_fractions(profile_kmers: DataFrame, recon: DataFrame, on: list[str]) -> DataFrame:
    """profile k-mers(used) with the parts of both samples' counts that their profile explains."""
    rows = profile_kmers.join(recon, on, "left").fillna({"treat": 0, "ctrl": 0.0, "reconstruction": 0.0})
    frac = fraction(F.col("used").cast("double"), F.col("reconstruction"))
    return rows.withColumn("frac", frac).withColumn("treat_frac", F.col("treat") * F.col("frac")).withColumn("ctrl_frac", F.col("ctrl") * F.col("frac"))


def missing_neighbours(kmers_: DataFrame, compat: bool = False) -> DataFrame:
    """k-mers one base before or after a present k-mer that are themselves absent.

    compat: the neighbour before is spelled with the base last, as older results have it.
    """
    base = F.array(*map(F.lit, "ACGT"))
    s, k = F.col("kmer"), F.length("kmer")
    after = F.transform(base, lambda b: F.concat(F.substring(s, F.lit(2), k), b))
    before = F.transform(base, lambda b: F.concat(F.substring(s, F.lit(1), k - 1), b) if compat else F.concat(b, F.substring(s, F.lit(1), k - 1)))
    return kmers_.select(F.explode(F.concat(after, before)).alias("kmer")).distinct().join(kmers_.select("kmer"), "kmer", "left_anti")


def expand_strands(unitigs: DataFrame) -> DataFrame:
    """Every unitig as +vid and, with its reverse complement and reversed counts, as -vid."""
    return unitigs.unionByName(
        unitigs.select((-F.col("vid")).alias("vid"), reverse_complement(F.col("seq")).alias("seq"), F.reverse("counts").alias("counts"))
    )
