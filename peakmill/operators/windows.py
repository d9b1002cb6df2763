"""Order-dependent operators over positions, blocks and keys, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakmill.runtime import materialize


#: Up to so many different values, of all keys together, are ranked in one window a key.
ONE_WINDOW = 1 << 20


def base_coverage(kmer_values: DataFrame, key: str, pos: str, values: list[str], k: int, last: DataFrame | None = None) -> DataFrame:
    """(key, pos, values): each base takes the largest value of the k-mers over it.

    A profile with n k-mers has n + k - 1 bases; base i is covered by the
    k-mers that start at i - k + 1 to i. last(key, n_): the place of each
    profile's last k-mer, where that is known beforehand.
    """
    n = kmer_values.groupBy(key).agg(F.max(pos).alias("n_")) if last is None else last
    tail = n.select(key, F.explode(F.sequence(F.col("n_") + 1, F.col("n_") + k - 1)).alias(pos)) if k > 1 else None
    grid = kmer_values.select(key, pos, *values)
    if tail is not None:
        grid = grid.unionByName(tail.select(key, F.col(pos).cast(kmer_values.schema[pos].dataType).alias(pos), *[F.lit(None).cast(kmer_values.schema[v].dataType).alias(v) for v in values]))
    near = Window.partitionBy(key).orderBy(pos).rowsBetween(1 - k, 0)
    return grid.select(key, pos, *[F.max(v).over(near).alias(v) for v in values])


def run_blocks(rows: DataFrame, key: str, pos: str, state: str) -> DataFrame:
    """(key, state, start, end, block): maximal runs of equal state by pos; end is exclusive, in places of the order."""
    order = Window.partitionBy(key).orderBy(pos)
    changed = F.coalesce((F.col(state) != F.lag(state).over(order)).cast("int"), F.lit(1))
    marked = rows.select(key, state, (F.row_number().over(order) - 1).alias("at"), changed.alias("c"))
    runs = marked.withColumn("block", F.sum("c").over(Window.partitionBy(key).orderBy("at")) - 1)
    return runs.groupBy(key, "block").agg(F.first(state).alias(state), F.min("at").alias("start"), (F.max("at") + 1).alias("end"))


def smooth_blocks(blocks: DataFrame, key: str, state: str, longest: int) -> DataFrame:
    """blocks with short ones (of longest or fewer places) in the state of their neighbours where these agree; edge blocks follow their one neighbour."""
    order = Window.partitionBy(key).orderBy("block")
    before, after = F.lag(state).over(order), F.lead(state).over(order)
    short = (F.col("end") - F.col("start")) <= longest
    new = (
        F.when(short & before.isNull() & after.isNotNull(), after)
        .when(short & after.isNull() & before.isNotNull(), before)
        .when(short & (before == after), before)
        .otherwise(F.col(state))
    )
    return blocks.withColumn(state, new)


#: Parts that a part of the input is dealt over, where they are sorted.
SHARES = 8


def merged_ranges(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): overlapping or touching ranges of a key as one. Each part of the input is dealt over so many that a task sorts a small share of it, however large the input."""
    ranges = ranges.repartition(SHARES * max(1, ranges.rdd.getNumPartitions()), key)
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new_", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    grouped = marked.withColumn("island_", F.sum("new_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "island_").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island_")


def rolling_mean(rows: DataFrame, key: str, order: list[str], value: str, width: int) -> DataFrame:
    """rows with mean: of the width values up to each row; the first width - 1 rows of a key go."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumns({"mean": F.avg(value).over(w.rowsBetween(1 - width, 0)), "nth_": F.row_number().over(w)})
    return marked.where(F.col("nth_") >= width).drop("nth_")


def best_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth_ = 1").drop("nth_")


def average_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with rank (ties share their mean) and ties, the number of equal values."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return rows.withColumn("ties", ties).withColumn("rank", F.rank().over(w) + (F.col("ties") - 1) / 2)


def counted_in_order(rows: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """(keys, value_, n_, more, below_): each key's different values, how often they come, and how many of the key's rows are less.

    Up to ONE_WINDOW different values of all keys are summed in a window of each
    key; beyond that, within ranges of values, and carried on from the ranges
    before, so that a key with most of the rows is many tasks' work. Null values
    come first.
    """
    spark = rows.sparkSession
    each = materialize(rows.groupBy(*keys, F.col(value).alias("value_")).agg(F.count("*").alias("n_"), *more), "values")
    if each.count() <= ONE_WINDOW:
        upto = Window.partitionBy(*keys).orderBy("value_").rowsBetween(Window.unboundedPreceding, -1)
        return each.withColumn("below_", F.coalesce(F.sum("n_").over(upto), F.lit(0)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(each.repartitionByRange(parts, *keys, "value_").withColumn("part_", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "part_").agg(F.sum("n_").alias("in_"))  # a row a key and range
    base = sums.select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)], F.col("part_").alias("p_"), F.coalesce(F.sum("in_").over(before), F.lit(0)).alias("base_"))
    same = F.col("part_") == F.col("p_")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"k{i}_"))
    lower = Window.partitionBy(*keys, "part_").orderBy("value_").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("within_", F.coalesce(F.sum("n_").over(lower), F.lit(0)))
    return near.join(base, same).withColumn("below_", F.col("base_") + F.col("within_")).select(*each.columns, "below_")


def u_statistic(rows: DataFrame, keys: list[str], first: str, value: str) -> DataFrame:
    """(keys, n1, n2, u, tie): Mann-Whitney U of the rows where the flag column holds against the others, and the tie factor. Null values rank first."""
    flag = F.coalesce(F.col(first).cast("boolean"), F.lit(False)).cast("bigint")
    ranked = counted_in_order(rows, keys, value, F.sum(flag).alias("n1_")).withColumn("rank_", F.col("below_") + (F.col("n_") + 1) / 2)
    out = ranked.groupBy(*keys).agg(
        F.sum("n1_").alias("n1"),
        F.sum(F.col("n_") - F.col("n1_")).alias("n2"),
        F.sum(F.col("rank_") * F.col("n1_")).alias("r_"),
        F.sum(F.col("n_") * (F.col("n_") * F.col("n_") - 1)).alias("t_"),
    )
    n = F.col("n1") + F.col("n2")
    return out.select(
        *keys, "n1", "n2", (F.col("r_") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), (1 - F.try_divide(F.col("t_").cast("double"), n * n * n - n)).alias("tie")
    )


def exact_quantile(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """(keys, quantile): the value at that share of each key's rows in order, interpolated; nulls are left out, a key of nulls only goes.

    Found by counts, so no task holds a key's values.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v_"))
    ordered = counted_in_order(known, keys, "v_")
    total = ordered.groupBy(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)]).agg(F.sum("n_").alias("all_"))
    same = [F.col(k).eqNullSafe(F.col(f"k{i}_")) for i, k in enumerate(keys)]
    place = (F.col("all_") - 1) * F.lit(share)
    both = ordered.join(total, same) if keys else ordered.crossJoin(F.broadcast(total))  # one row
    at = lambda p: F.max(F.when((F.col("below_") <= p) & (p < F.col("below_") + F.col("n_")), F.col("value_")))
    found = both.groupBy(*keys).agg(at(F.floor(place)).alias("lo_"), at(F.ceil(place)).alias("hi_"), F.first(place - F.floor(place)).alias("part_"))
    return found.where("lo_ is not null").select(*keys, (F.col("lo_") + (F.col("hi_") - F.col("lo_")) * F.col("part_")).alias("quantile"))


def median_gate(rows: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """(keys, median) of the keys whose median value is least or more."""
    return exact_quantile(rows, keys, value, 0.5).withColumnRenamed("quantile", "median").where(F.col("median") >= least)


def significant(tests: DataFrame, keys: list[str], p: str, alpha: float, replicates: int = 1, share: float = 0.5) -> DataFrame:
    """(keys, pvalue) of the keys of which that share of the tests passes alpha, corrected for replicates; pvalue is the largest that passed."""
    passed = F.col(p) <= alpha / replicates
    rows = tests.groupBy(*keys).agg(F.count("*").alias("n_"), F.count_if(passed).alias("passed_"), F.max(F.when(passed, F.col(p))).alias("pvalue"))
    return rows.where((F.col("passed_") >= share * F.col("n_")) & (F.col("passed_") > 0)).select(*keys, "pvalue")


def offsets(rows: DataFrame, keys: list[str], order: list[str], size: str) -> DataFrame:
    """rows with first: where each begins when the rows of a key stand one after another."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first", F.coalesce(F.sum(size).over(before), F.lit(0)))


def length_groups(sequences: DataFrame, seq: str) -> DataFrame:
    """(size, n, distinct_n): sequences and different ones of each length."""
    return sequences.groupBy(F.length(seq).alias("size")).agg(F.count("*").alias("n"), F.countDistinct(seq).alias("distinct_n"))


def blurred_segments(rows: DataFrame, key: str, pos: str, covered: str, reach: int = 2) -> DataFrame:
    """(key, start, end) of runs of places with any cover within reach of them."""
    near = Window.partitionBy(key).orderBy(pos).rowsBetween(-reach, reach)
    spread = rows.select(key, pos, F.max((F.col(covered) > 0).cast("int")).over(near).alias("on_"))
    return run_blocks(spread, key, pos, "on_").where("on_ = 1").select(key, "start", "end")


def proportional_share(rows: DataFrame, keys: list[str], weight: str, amount: str) -> DataFrame:
    """rows with share: amount split by weight within keys, each rounded half to even."""
    total = F.sum(weight).over(Window.partitionBy(*keys))
    return rows.withColumn("share", F.rint(F.try_divide(F.col(weight) * F.col(amount), total)).cast("bigint"))


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int = 3) -> DataFrame:
    return rows.withColumn("nth_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth_") <= n).drop("nth_")
