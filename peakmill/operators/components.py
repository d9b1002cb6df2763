"""Connected components of an undirected edge list by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakmill.runtime import materialize, parts_for

#: Edges of one file between rounds.
ROWS = 200_000


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is its smallest reachable node.

    Each round turns the edge list into stars: every node keeps its smallest
    neighbour (map-side ``min``), the larger neighbours are re-pointed at it.
    The edge list shrinks to one star per component in O(log n) rounds. Hot
    nodes are pre-aggregated by ``min`` before any join. Null endpoints and
    self loops are ignored; an empty edge list gives an empty result.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # larger -> smaller, without loops
    cur = materialize(
        e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    parts = parts_for(cur.count(), ROWS)
    for _ in range(max_rounds):
        low = cur.groupBy("a").agg(F.min("b").alias("m"), F.count("b").alias("n"))
        # a node with several smaller neighbours links them all to the smallest
        linked = (
            cur.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        # pointer jump: a -> b and b -> c becomes a -> c (b keeps its own link)
        parent = linked.groupBy("a").agg(F.min("b").alias("m"))
        nxt = materialize(
            linked.join(parent.select(F.col("a").alias("b"), F.col("m").alias("up")), "b", "left")
            .select("a", F.coalesce("up", "b").alias("b"))
            .distinct()
            .coalesce(parts),
            "edges",
        )
        # done when every node has one parent and no parent has a parent
        deep = nxt.join(nxt.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        wide = nxt.groupBy("a").count().where("count > 1").limit(1).count()
        cur = nxt
        if not deep and not wide:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(cur.select(F.col("a").alias("node"), "b"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component")
    )
