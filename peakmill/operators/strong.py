"""Strongly connected components and longest paths of graphs that no one task could hold, in rounds of joins.

Components are found by merge joins at every size: what is broadcast goes
through the driver in each of many rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakmill.runtime import materialize, materialize_while, parts_for

#: Rows of one file between rounds.
ROWS = 200_000
#: Rounds in which vertices without a way in or out are cut off before each search.
TRIM = 2


def _trimmed(edges: DataFrame, parts: int) -> DataFrame:
    """Edges whose tail has a way in and whose head a way out, TRIM times over: what is cut off is on no cycle."""
    for _ in range(TRIM):
        heads, tails = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = edges.join(heads.hint("merge"), "src", "left_semi").join(tails.hint("merge"), "dst", "left_semi").select("src", "dst")
        edges = materialize(edges.coalesce(parts), "trimmed")
    return edges


def least_both_ways(edges: DataFrame) -> DataFrame:
    """(node, low, back): the smallest node from which each node of edges(src, dst) can be reached, and the smallest it reaches, itself included.

    A round takes the least of the neighbours' lows, aggregated before the
    shuffle, and the low of its own low, as what reaches that reaches this one
    too: stretches double where ids allow, and a round is at least one edge.
    Both ways go in the same rounds.
    """
    ways = edges.select(F.lit(0).alias("way"), "src", "dst").unionByName(edges.select(F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    start = nodes.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("way"), "node", F.col("node").alias("low"), F.lit(True).alias("moved"))
    cur = materialize(start, "lows")
    parts, going = parts_for(cur.count(), ROWS), True
    while going:
        fresh = cur.where("moved")  # only lows that moved can move others
        told = ways.join(fresh.select("way", F.col("node").alias("src"), F.col("low").alias("got")).hint("merge"), ["way", "src"]).groupBy("way", F.col("dst").alias("node")).agg(F.min("got").alias("got"))
        above = fresh.select("way", F.col("node").alias("low"), F.col("low").alias("up"))
        low = F.least("low", F.coalesce("got", "low"), F.coalesce("up", "low"))
        nxt = cur.join(told.hint("merge"), ["way", "node"], "left").join(above.hint("merge"), ["way", "low"], "left").select("way", "node", low.alias("low"), (low < F.col("low")).alias("moved"))
        cur, going = materialize_while(nxt.coalesce(parts), "lows", "moved")
    fore, back = (cur.where(F.col("way") == w).select("node", "low") for w in (0, 1))
    return fore.join(back.withColumnRenamed("low", "back").hint("merge"), "node")


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of edges: component is the smallest node that it reaches and is reached from.

    Rounds of forward and backward colouring: each node gets the least node that
    reaches it and the least one it reaches. Where both are the same, that is
    its component; where an edge's ends differ in either, no cycle goes through
    it. What is left is coloured again. Null ends and self loops are ignored;
    repeated edges count once; no edges give no rows.
    """
    every = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    nodes = every.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    cur = materialize(every.where("src <> dst").distinct(), "edges")
    n = cur.count()
    settled: list[DataFrame] = []
    while n:
        parts = parts_for(n, ROWS)
        cur = _trimmed(cur, parts)
        both = materialize(least_both_ways(cur).coalesce(parts), "colours")
        settled.append(both.where("low = back").select("node", F.col("low").alias("component")))
        a = both.select(F.col("node").alias("src"), F.col("low").alias("l1"), F.col("back").alias("b1"))
        b = both.select(F.col("node").alias("dst"), F.col("low").alias("l2"), F.col("back").alias("b2"))
        # settled nodes' edges go, too
        within = cur.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("l1 = l2 and b1 = b2 and l1 <> b1").select("src", "dst")
        cur = materialize(within.coalesce(parts), "edges")
        n = cur.count()
    if not settled:
        return nodes.select("node", F.col("node").alias("component"))
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return nodes.join(found.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst) between different strong components, each once."""
    a = components.select(F.col("node").alias("src"), F.col("component").alias("a"))
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def longest_paths(costs: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, dist, before) for costs(node, cost) and the edges(src, dst) of a DAG: how far the longest way to each node is, and by which nodes it comes.

    The node a way begins with costs nothing; ``before`` are all predecessors on
    longest ways, in order of falling cost, then id, and empty where ways
    begin. All nodes are relaxed at once, level by level: a round follows only
    edges whose tail moved, so there are as many rounds as the longest way has
    edges. A cycle raises ValueError; costs are not negative.
    """
    held = materialize(costs.select("node", "cost"), "costs")
    linked = materialize(edges.select("src", "dst").distinct().join(held.select(F.col("node").alias("dst"), "cost"), "dst"), "links")
    n = held.count()
    parts = parts_for(n, ROWS)
    cur = held.select("node", F.lit(0).cast("bigint").alias("dist"), F.lit(0).alias("hops"), F.lit(True).alias("moved"))
    cur, rounds, going = materialize(cur, "levels"), 0, True
    while going:
        rounds += 1
        if rounds > n:
            raise ValueError("the graph has a cycle")
        told = linked.join(cur.where("moved").select(F.col("node").alias("src"), "dist", "hops"), "src")
        told = told.groupBy(F.col("dst").alias("node")).agg(F.max(F.col("dist") + F.col("cost")).alias("far"), F.max(F.col("hops") + 1).alias("deep"))
        far, deep = F.greatest("dist", F.coalesce("far", "dist")), F.greatest("hops", F.coalesce("deep", "hops"))
        nxt = cur.join(told, "node", "left").select("node", far.alias("dist"), deep.alias("hops"), ((far > F.col("dist")) | (deep > F.col("hops"))).alias("moved"))
        cur, going = materialize_while(nxt.coalesce(parts), "levels", "moved")
    ends = cur.select("node", "dist")
    tails = ends.join(held, "node").select(F.col("node").alias("src"), F.col("dist").alias("from"), F.col("cost").alias("tail_cost"))
    tied = linked.join(tails, "src").join(ends.withColumnRenamed("node", "dst"), "dst").where(F.col("from") + F.col("cost") == F.col("dist"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("tail_cost")).alias("c"), F.col("src").alias("v"))))
    best = tied.groupBy(F.col("dst").alias("node")).agg(F.transform(order, lambda x: x["v"]).alias("before"))
    kind = edges.schema["src"].dataType.simpleString()
    return ends.join(best, "node", "left").select("node", "dist", F.coalesce("before", F.array().cast(f"array<{kind}>")).alias("before"))


def walks(found: DataFrame, ends: DataFrame) -> DataFrame:
    """(end, walk): for each of ends(end) one longest way to it, by the first of the predecessors, from longest_paths()."""
    first = found.select(F.col("node").alias("at"), F.get("before", F.lit(0)).alias("up"))
    cur = materialize(ends.select("end", F.col("end").alias("at"), F.array("end").alias("walk")), "walks")
    done: list[DataFrame] = []
    while True:
        step = materialize(cur.join(first, "at"), "walks")
        done.append(step.where("up is null").select("end", "walk"))
        cur = step.where("up is not null").select("end", F.col("up").alias("at"), F.concat(F.array("up"), "walk").alias("walk"))
        if not cur.limit(1).count():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
