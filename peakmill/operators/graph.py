"""de Bruijn graphs as vertex and edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from peakmill.functions.compaction import compacted, dealt
from peakmill.functions.sequence import kmers, nonzero_fragments, reverse_complement
from peakmill.operators.components import components
from peakmill.runtime import materialize, materialize_counting, materialize_while, parts_for, replaced

#: k-mers of one lot, both strands.
LOT = 100_000


def kmer_edges(kmers_: DataFrame, *keys: str) -> DataFrame:
    """(keys, src, dst) of k-mers of which one's last k-1 letters are the other's first; at most four edges a k-mer each way."""
    left = kmers_.select(*keys, F.col("kmer").alias("src"), F.expr("substr(kmer, 2)").alias("mid"))
    right = kmers_.select(*keys, F.col("kmer").alias("dst"), F.expr("left(kmer, length(kmer) - 1)").alias("mid"))
    return left.join(right, [*keys, "mid"]).select(*keys, "src", "dst")


def checked_edges(vertices: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Edges whose ends overlap by k-1 letters. Only k-1 letters of each vertex are shuffled."""
    tail = vertices.select(F.col("vid").alias("src"), F.expr(f"right(seq, {k - 1})").alias("tail"))
    head = vertices.select(F.col("vid").alias("dst"), F.expr(f"left(seq, {k - 1})").alias("head"))
    return edges.join(tail, "src").join(head, "dst").where("tail = head").select(*edges.columns)


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def without_antiparallel(edges: DataFrame, order: str, *keys: str) -> DataFrame:
    """Of a -> b and b -> a the first by order stays; loops go."""
    pair = Window.partitionBy(*keys, F.least("src", "dst"), F.greatest("src", "dst")).orderBy(order, "src", "dst")
    first = F.first(F.struct("src", "dst")).over(pair)
    return without_loops(edges).withColumn("f", first).where("src = f.src and dst = f.dst").drop("f")


def same_sign(edges: DataFrame, sign: int) -> DataFrame:
    return edges.where(F.signum(F.col("src").cast("double")) == sign)


def shifted_ids(vertices: DataFrame) -> DataFrame:
    """Ids raised by one, as zero cannot carry a sign."""
    return vertices.withColumn("vid", F.col("vid") + 1)


def unitigs(kmers_: DataFrame, *keys: str, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices(keys, vid, seq, kmers), edges(src, dst)) of the compacted graph of a k-mer set, or of one for each of the keys.

    The set is closed under reverse complement first. A link is compacted if it
    is the only one out of its tail and into its head. k-mers are dealt by the
    minimizers of their first and of their last k-1 letters, so that all that
    share such letters meet in one lot and are chained there; one with two
    different minimizers is in two lots and joins their pieces. Pieces, not
    k-mers, are ranked by pointer doubling, in rounds of the logarithm of the
    most in a chain. A ring is cut before its smallest k-mer. vid carries the
    strand: the smaller of the two spellings is positive; a spelling that is its
    own reverse complement has one vertex. Numbers are ranks of spellings within
    a hash range, unique and repeatable. counted: vertices have the counts of
    their k-mers, too, by kmers_' cnt: the larger of either strand's.
    """
    given = materialize(kmers_.select(*keys, "kmer", (F.col("cnt") if counted else F.lit(0)).cast("bigint").alias("cnt")), "kmers")
    lots = parts_for(2 * given.count(), LOT)
    typed = list(given.select(*keys).schema)
    blobs = [StructField(x, BinaryType()) for x in ("kmers", "flags", "cnt")]
    rows = StructType([StructField("lot", LongType()), StructField("size", IntegerType()), *(StructField(f.name, ArrayType(f.dataType)) for f in typed), *blobs])
    flags = [StructField(x, BooleanType()) for x in ("open_first", "open_last", "ring")]
    texts = [StructField(x, StringType()) for x in ("first", "last", "seq", "low")]
    made = StructType([*typed, StructField("id", LongType()), *texts, *flags, StructField("counts", ArrayType(IntegerType()))])
    rows_arrow, made_arrow = to_arrow_schema(rows), to_arrow_schema(made)
    dealt_ = given.mapInArrow(lambda batches: dealt(batches, lots, rows_arrow), rows)
    pieces = materialize(dealt_.groupBy("lot").applyInArrow(lambda t: compacted(t, made_arrow), made), "pieces")
    replaced(given)
    links = pieces.where("id is null").select(*keys, F.col("first").alias("src"), F.col("last").alias("dst"))
    pieces = pieces.where("id is not null")
    counts = ["counts"] if counted else []
    whole = pieces.where("not open_first and not open_last").select(*keys, F.length("first").alias("k"), "seq", *counts)
    ends = pieces.where("open_last").select(*keys, F.col("last").alias("kmer"), F.col("id").alias("src"))
    hook = materialize(ends.join(pieces.where("open_first").select(*keys, F.col("first").alias("kmer"), F.col("id").alias("dst")), [*keys, "kmer"]).select("src", "dst"), "hooks")
    if hooks := hook.count():
        joined = materialize(_joined(pieces.where("open_first or open_last"), _ranked(hook, parts_for(hooks, 200_000)), *keys, counted=counted), "joined")
        whole = whole.unionByName(joined.drop("ring"))
        links = links.unionByName(joined.where("ring").select(*keys, F.expr("right(seq, k)").alias("src"), F.expr("left(seq, k)").alias("dst")))
    spelled = whole.withColumn("key", F.least("seq", reverse_complement(F.col("seq"))))
    lot = F.pmod(F.xxhash64(*keys, "key"), F.lit(1 << 20))
    ids = spelled.select(*keys, "key").distinct().withColumn("lot", lot)
    ids = ids.select(*keys, "key", (F.row_number().over(Window.partitionBy("lot").orderBy(*keys, "key")).cast("bigint") * (1 << 20) + F.col("lot")).alias("id"))
    vid = F.when(F.col("seq") == F.col("key"), F.col("id")).otherwise(-F.col("id")).alias("vid")
    vertices = materialize(spelled.join(ids, [*keys, "key"]).select(*keys, vid, "seq", "k", *counts), "vertices")
    tails = vertices.select(*keys, F.expr("right(seq, k)").alias("src"), F.col("vid").alias("a"))
    heads = vertices.select(*keys, F.expr("left(seq, k)").alias("dst"), F.col("vid").alias("b"))
    edges = links.join(tails, [*keys, "src"]).join(heads, [*keys, "dst"]).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return vertices.select(*keys, "vid", "seq", kmers(F.col("seq"), F.col("k")).alias("kmers"), *counts), edges


def _ranked(hook: DataFrame, parts: int) -> DataFrame:
    """(id, head, dist, ring) of the nodes of hooks (src, dst), of which each has one at most either way: the first of its chain, or the smallest of its ring, and how far it is."""
    # up: the node `jump` places before, or the chain's head once reached; low: smallest node passed
    heads = hook.select(F.col("src").alias("id")).join(hook.select(F.col("dst").alias("id")), "id", "left_anti")
    inner = hook.select(F.col("dst").alias("id"), F.col("src").alias("up"), F.lit(1).cast("bigint").alias("dist"), F.lit(False).alias("done"), F.least("src", "dst").alias("low"))
    cur = heads.select("id", F.col("id").alias("up"), F.lit(0).cast("bigint").alias("dist"), F.lit(True).alias("done"), F.col("id").alias("low"))
    cur, left = materialize_counting(cur.unionByName(inner).coalesce(parts), "chains", "not done")
    while left:
        nxt = cur.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"), F.col("low").alias("low2"))
        before = cur
        cur, now = materialize_counting(
            cur.where("not done")
            .join(nxt, "up")
            .select("id", F.col("up2").alias("up"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), F.least("low", "low2").alias("low"))
            .unionByName(cur.where("done"))
            .coalesce(parts),
            "chains",
            "not done",
        )
        replaced(before)
        # a chain that goes on has a node a step beyond those that are done, which the next round reaches: only rings are left
        if now == left:
            break
        left = now
    placed = cur.where("done").select("id", F.col("up").alias("head"), "dist", F.lit(False).alias("ring"))
    return placed.unionByName(_rings(_lowest(cur.where("not done").select("id", "up", "low"), parts_for(left, 200_000)), hook).withColumn("ring", F.lit(True))) if left else placed


def _lowest(ring: DataFrame, parts: int) -> DataFrame:
    """(id, low) of nodes on rings, whose low is the least of as many nodes as up is before them: the least of the whole ring.

    If twice as many change no low, stretches that follow one another all round have the same one.
    """
    moving = True
    while moving:
        nxt = ring.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        nxt = ring.join(nxt, "up").select("id", F.col("up2").alias("up"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved"))
        ring, moving = materialize_while(nxt.coalesce(parts), "rings", "moved")
        ring = ring.drop("moved")
    return ring.select("id", "low")


def _rings(ring: DataFrame, hook: DataFrame) -> DataFrame:
    """(id, head, dist) of nodes on rings, cut before the smallest node of each."""
    step = ring.join(hook.select(F.col("dst").alias("id"), F.col("src").alias("up")), "id")
    is_head = F.col("id") == F.col("low")
    cur, going = materialize_while(step.select("id", F.when(is_head, F.col("id")).otherwise(F.col("up")).alias("up"), F.when(is_head, 0).otherwise(1).cast("bigint").alias("dist"), is_head.alias("done")).withColumn("going", ~F.col("done")), "rings", "going")
    while going:
        nxt = cur.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        cur, going = materialize_while(
            cur.join(nxt, "up").select(
                "id",
                F.when(F.col("done"), F.col("up")).otherwise(F.col("up2")).alias("up"),
                F.when(F.col("done"), F.col("dist")).otherwise(F.col("dist") + F.col("dist2")).alias("dist"),
                (F.col("done") | F.col("done2")).alias("done"),
            ).withColumn("going", ~F.col("done")),
            "rings",
            "going",
        )
    return cur.select("id", F.col("up").alias("head"), "dist")


def _joined(pieces: DataFrame, placed: DataFrame, *keys: str, counted: bool) -> DataFrame:
    """(keys, k, seq, ring, counts) of the chains of pieces that were placed: each begins with the k-mer that the one before ends with."""
    each = pieces.drop("ring").join(placed, "id").groupBy(*keys, "head", "ring").agg(
        F.array_sort(F.collect_list(F.struct("dist", "seq", *(["counts"] if counted else [])))).alias("p"), F.min("low").alias("low"), F.length(F.min("low")).alias("k")
    )
    rest = lambda f: F.transform(F.slice("p", 2, 1 << 30), f)
    each = each.select(
        *keys,
        "k",
        "ring",
        "low",
        F.concat(F.col("p")[0]["seq"], F.array_join(rest(lambda x: F.substring(x["seq"], F.col("k") + 1, F.length(x["seq"]))), "")).alias("seq"),
        *([F.concat(F.col("p")[0]["counts"], F.flatten(rest(lambda x: F.slice(x["counts"], F.lit(2), F.size(x["counts"]))))).alias("counts")] if counted else []),
    )
    # a ring's last k-mer is its first; it is turned to its smallest
    n, at = F.length("seq") - F.col("k"), F.instr("seq", F.col("low")) - 1
    around = lambda x, first, size: F.concat(F.substring(x, first + 1, size - first), F.substring(x, F.lit(1), first))
    times = F.ceil((n + F.col("k") - 1) / n).cast("int")
    seq = F.when(F.col("ring"), F.substring(F.repeat(around(F.col("seq"), at, n), times), F.lit(1), n + F.col("k") - 1)).otherwise(F.col("seq"))
    made = [F.concat(F.slice("counts", at + 1, n - at), F.slice("counts", F.lit(1), at)).alias("counts")] if counted else []
    made = [F.when(F.col("ring"), m).otherwise(F.col("counts")).alias("counts") for m in made]
    return each.select(*keys, "k", "ring", seq.alias("seq"), *made)


def linked_counts(vertices: DataFrame, counts: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, vid, seq, counts, kc, km): each vertex with its k-mers' counts in order, missing ones 0."""
    rows = vertices.select(*keys, "vid", "seq", F.posexplode(kmers(F.col("seq"), k)).alias("pos", "kmer"))
    got = rows.join(counts.select(*keys, "kmer", "cnt"), [*keys, "kmer"], "left").fillna({"cnt": 0})
    return got.groupBy(*keys, "vid", "seq").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "cnt"))), lambda x: x["cnt"].cast("int")).alias("counts"),
        F.sum("cnt").alias("kc"),
        F.avg("cnt").alias("km"),
    )


def filter_simple(vertices: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Vertices with any count, and a sum, of least or more; edges between them."""
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c)
    kept = vertices.where((total >= least) & F.exists("counts", lambda c: c >= least))
    ids = kept.select("vid")
    return kept, edges.join(ids.withColumnRenamed("vid", "src"), "src", "left_semi").join(ids.withColumnRenamed("vid", "dst"), "dst", "left_semi").select(*edges.columns)


def split_low(vertices: DataFrame, edges: DataFrame, least: int, k: int, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices cut into their runs of k-mers with counts of least or more, and the edges that survive.

    The first run keeps the vertex id; run r > 0 of vertex v gets an id beyond
    all old ones. An edge in survives if the first k-mer does, an edge out if
    the last does, and leaves from the last run. compat: edges out of a vertex
    with several runs are lost.
    """
    shown = F.transform("counts", lambda c: F.when(c >= least, c).otherwise(0))
    runs = vertices.select("vid", F.size("counts").alias("n"), F.posexplode(nonzero_fragments(shown, F.col("seq"), k)).alias("run", "f"))
    runs = runs.select("vid", "n", "run", F.col("f.start").alias("start"), F.col("f.seq").alias("seq"), F.col("f.counts").alias("counts"))
    top = vertices.agg(F.coalesce(F.max(F.abs("vid")), F.lit(0)).alias("top"))
    runs = runs.crossJoin(F.broadcast(top))  # one row
    # unique: pairs of run number and id, spread over the numbers beyond top
    fresh = F.col("top") + (F.col("run") - 1) * (2 * F.col("top") + 1) + F.col("vid") + F.col("top") + 1
    runs = materialize(runs.withColumn("new", F.when(F.col("run") == 0, F.col("vid")).otherwise(fresh)).drop("top"), "runs")
    last = (F.col("start") + F.size("counts")) == F.col("n")
    into = runs.where("run = 0 and start = 0").select(F.col("vid").alias("dst"), F.col("new").alias("to"))
    outof = runs.where(last if not compat else last & (F.col("run") == 0)).select(F.col("vid").alias("src"), F.col("new").alias("from"))
    kept = edges.join(outof, "src").join(into, "dst").select(F.col("from").alias("src"), F.col("to").alias("dst"))
    return runs.select(F.col("new").alias("vid"), "seq", "counts"), kept


def with_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices with comp_id: the smallest vid reachable either way; null for single vertices."""
    found = components(without_loops(edges)).select(F.col("node").alias("vid"), F.col("component").alias("comp_id"))
    return vertices.join(found, "vid", "left")


def unwrapped(vertices: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Every k-mer of every vertex as a vertex (vid, pos, kmer, cnt), and the edges (vid, pos, next) within vertices."""
    rows = vertices.select("vid", F.posexplode(F.arrays_zip(kmers(F.col("seq"), k).alias("kmer"), F.col("counts").alias("cnt"))).alias("pos", "x"))
    rows = rows.select("vid", "pos", "x.kmer", "x.cnt")
    edges = rows.select("vid", "pos", F.lead("pos").over(Window.partitionBy("vid").orderBy("pos")).alias("next")).where("next is not null")
    return rows, edges


def branching(edges: DataFrame) -> DataFrame:
    """(vid, out_degree) of vertices with several ways on."""
    return edges.groupBy(F.col("src").alias("vid")).agg(F.count("dst").alias("out_degree")).where("out_degree > 1")


def component_sizes(labelled: DataFrame) -> DataFrame:
    """(size, components) histogram of comp_id."""
    return labelled.where("comp_id is not null").groupBy("comp_id").agg(F.count("vid").alias("size")).groupBy("size").agg(F.count("comp_id").alias("components"))


def forking(labelled: DataFrame, edges: DataFrame, least: int = 100, share: float = 0.3) -> DataFrame:
    """Components of least vertices or more of which the share with two to four ways on suffices."""
    deg = edges.groupBy(F.col("src").alias("vid")).agg(F.count("dst").alias("d"))
    fork = F.coalesce(F.col("d"), F.lit(0)).between(2, 4).cast("int")
    return labelled.where("comp_id is not null").join(deg, "vid", "left").groupBy("comp_id").agg(F.count("vid").alias("size"), F.avg(fork).alias("share")).where((F.col("size") >= least) & (F.col("share") >= share))


def coverage(assembled: DataFrame, reads: DataFrame) -> DataFrame:
    """One row: bases explained by assembled(seq, cnt), bases read, their ratio."""
    a = assembled.agg(F.coalesce(F.sum(F.length("seq") * F.col("cnt")), F.lit(0)).alias("explained"))
    b = reads.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))
    return a.crossJoin(b).withColumn("ratio", F.try_divide("explained", "bases"))  # one row each
