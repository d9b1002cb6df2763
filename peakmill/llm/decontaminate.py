"""Benchmark passages in training texts by a positional inverted index, DataFrame functions only.

``build_index`` stores postings (term, document, position) in segments, one for
each part of the input, sorted by term, so that a scan for some terms skips the
rest; only terms that a filter lets through are stored, the test terms here. A
search starts from the postings of the rarest term of each window of a test
item. A posting at position p of a term that stands at place o of the item puts
the item's beginning at p - o; lists so adjusted are intersected with the
second rarest term's, and what is left with all others'. ``phrase_matches``
returns exact matches, ``near_matches`` those with words put in between.

A word is a 64-bit hash here, a document its doc_id and its text's hash, so rows
of equal doc_id and different texts are apart, and equal rows are one document
that every one of them gets the result of. A null doc_id is an id like any
other; items without an item_id are searched for and not named. Null texts have no words. A text of any length is one row while
it is read, then postings; a window of any words at all is found however
frequent they are. Empty tables give empty results; a document without words
has none hit. Extra columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakmill.runtime import materialize

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Filters have at most so many bits (as powers of two): when more is put in, they let more through, and joins decide all the same.
MOST_BITS = 24
#: Up to so many rows the test side of the first join is broadcast; beyond it, both sides are dealt with SALTS parts a term.
SMALL = 100_000
SALTS = 32
DOC = ["doc_id", "text_hash"]


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; there may be an empty one at either end."""
    return F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), BETWEEN)


def word_count(words: Column) -> Column:
    last = F.element_at(words, -1)
    return (F.size(words) - (F.get(words, F.lit(0)) == "").cast("int") - ((F.size(words) > 1) & (last == "")).cast("int")).cast("long")


def bits_of(hashes: DataFrame, n: int) -> DataFrame:
    """One row: ``bits``, longs of which the bits are set where the n 64-bit values of hashes(h) fall, 16 a value or fewer."""
    power = min(MOST_BITS, max(10, math.ceil(math.log2(max(n, 1) * 16))))
    slot = F.pmod("h", F.lit(1 << power))
    held = hashes.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(h, {1 << power}) & 63 as int))").alias("bit"))
    every = held.unionByName(hashes.sparkSession.range(1 << (power - 6)).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("bit")))
    dense = every.groupBy("at").agg(F.bit_or("bit").alias("bit"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bit"))), lambda x: x["bit"]).alias("bits"))


def let_through(rows: DataFrame, bits: DataFrame, h: Column, also: Column | None = None) -> DataFrame:
    """The rows whose h has its bit set, or for which also holds."""
    slot = F.pmod(h, F.size("bits").cast("long") * 64)
    word = F.get("bits", F.shiftright(slot, 6).cast("int"))
    held = F.getbit(word, slot.bitwiseAND(63).cast("int")) == 1
    wide = rows.crossJoin(F.broadcast(bits))  # one row of at most 2**MOST_BITS bits
    return wide.where(held if also is None else held | also).drop("bits")


def build_index(docs: DataFrame, terms: DataFrame | None = None, n_terms: int = 0) -> DataFrame:
    """(term, doc_id, text_hash, pos, n_words) of docs(doc_id, text), written once.

    With terms(h) only their postings are stored (and a few others that the
    filter takes for them). A document's posting at position 0 is always there.
    """
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    each = words.select(*DOC, word_count(F.col("words")).alias("n_words"), F.posexplode("words").alias("pos", "word"))
    hashed = each.select(F.xxhash64("word").alias("term"), *DOC, "pos", "n_words", (F.col("word") != "").alias("word"))
    first = F.col("pos") == 0
    if terms is None:
        kept = hashed.where(F.col("word") | first)
    else:
        kept = let_through(hashed, bits_of(terms, n_terms), F.col("term"), first).where(F.col("word") | first)
    return materialize(kept.drop("word").sortWithinPartitions("term"), "postings")


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, item_hash, off, term, width) of items(item_id, text): width is that of a window, WINDOW or all words of a shorter item."""
    words = items.select("item_id", F.xxhash64("item_id", "text").alias("item_hash"), F.filter(words_of(F.col("text")), lambda w: w != "").alias("words"))
    width = F.least(F.size("words"), F.lit(WINDOW)).alias("width")
    each = words.select("item_id", "item_hash", width, F.posexplode("words").alias("off", "word"))
    return each.select("item_id", "item_hash", "off", F.xxhash64("word").alias("term"), "width").distinct()


def windows_of(held: DataFrame, index: DataFrame) -> DataFrame:
    """(item_hash, start, width, o1, t1, o2, t2): each window of words that all occur, with places and terms of its two rarest.

    Windows are rows: each word goes to the windows it lies in, where the first
    two by count, then place, are found.
    """
    found = index.where("n_words > 0").groupBy("term").agg(F.count("*").alias("cf"))
    size = held.groupBy("item_hash").agg(F.count("*").alias("n"))
    rows = held.join(found, "term").join(size, "item_hash")
    low, high = F.greatest(F.col("off") - F.col("width") + 1, F.lit(0)), F.least(F.col("off"), F.col("n") - F.col("width"))
    each = rows.withColumn("start", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    place = F.struct("cf", "off", "term")
    by = each.groupBy("item_hash", "start", "width").agg(F.count("*").alias("present"), F.array_sort(F.collect_list(place)).alias("o"))
    whole = by.where("present = width")
    one, two = F.get("o", F.lit(0)), F.get("o", F.least(F.col("width") - 1, F.lit(1)))
    return whole.select("item_hash", "start", "width", one["off"].alias("o1"), one["term"].alias("t1"), two["off"].alias("o2"), two["term"].alias("t2"))


def same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["text_hash"].eqNullSafe(b["text_hash"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def starts_of(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_hash, o1, o2, t2, diag): where an item begins if a posting is that of a window's rarest term."""
    pairs = windows.select("item_hash", "o1", "t1", "o2", "t2").distinct()
    postings = index.select(F.col("term").alias("t1"), *DOC, "pos")
    if pairs.count() <= SMALL:
        met = postings.join(F.broadcast(pairs), "t1")
    else:  # a frequent term's postings go to SALTS tasks
        spread = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = postings.withColumn("salt", F.pmod(F.xxhash64(*DOC, "pos"), F.lit(SALTS)).cast("int")).join(spread, ["t1", "salt"])
    return met.select(*DOC, "item_hash", "o1", "o2", "t2", (F.col("pos") - F.col("o1")).alias("diag"))


def _in_docs_of(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Postings of the documents that rows are about, by a filter of bounded size."""
    docs = rows.select(F.col("text_hash").alias("h")).distinct()
    return let_through(index, bits_of(docs, docs.count()), F.col("text_hash"))


def phrase_matches(index: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, item_hash, pos, length): stretches of a document in which windows of an item stand one after the other.

    A stretch is as long as it can be: each WINDOW words of it (or all of a
    shorter item's) are consecutive words of the item.
    """
    held = materialize(item_words(items), "item_words")
    windows = materialize(windows_of(held, index), "windows")
    first = materialize(starts_of(index, windows), "starts")
    # the second rarest
    terms = windows.select(F.col("t2").alias("h")).distinct()
    second = let_through(_in_docs_of(index, first), bits_of(terms, terms.count()), F.col("term"))
    a, b = first.withColumn("at", F.col("diag") + F.col("o2")), second.select(*DOC, "term", "pos")
    near = a.join(b, same_doc(a, b) & (a["at"] == b["pos"]) & (a["t2"] == b["term"]), "left_semi")
    near = materialize(near.select(*DOC, "item_hash", "o1", "o2", "diag").distinct(), "starts2")
    # all words of the windows that these two stand for
    of = near.join(windows.select("item_hash", "start", "width", "o1", "o2"), ["item_hash", "o1", "o2"])
    spread = of.select(*DOC, "item_hash", "diag", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("off")).distinct()
    wanted = spread.join(held, ["item_hash", "off"]).withColumn("at", F.col("diag") + F.col("off"))
    full = _in_docs_of(index, near).select(*DOC, "term", "pos")
    met = wanted.join(full, same_doc(wanted, full) & (wanted["at"] == full["pos"]) & (wanted["term"] == full["term"]), "left_semi")
    line = Window.partitionBy(*DOC, "item_hash", "diag").orderBy("off")
    runs = met.withColumn("run", F.col("off") - F.row_number().over(line)).groupBy(*DOC, "item_hash", "item_id", "diag", "width", "run").agg(F.min("at").alias("pos"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= F.col("width")).select(*DOC, "item_id", "item_hash", "pos", "length")


def near_matches(index: DataFrame, items: DataFrame, slop: int) -> DataFrame:
    """(doc_id, text_hash, item_id, item_hash, start, pos, spread): windows of an item whose words all stand in a document, in which words
    of a window are moved against one another by ``slop`` places at most; pos is the first place, spread (least, 0 for an exact match) how far they are moved.

    Adjusted by their places, the window's lists meet within slop of the rarest term's.
    """
    held = materialize(item_words(items), "item_words")
    windows = materialize(windows_of(held, index), "windows")
    first = materialize(starts_of(index, windows), "starts")
    of = first.join(windows.select("item_hash", "start", "width", "o1", "o2"), ["item_hash", "o1", "o2"])
    each = of.select(*DOC, "item_hash", "start", "width", F.col("diag").alias("near"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("off"))
    wanted = each.join(held.select("item_hash", "item_id", "off", "term"), ["item_hash", "off"])
    # a place meets those in its own block of slop + 1 places and in the next ones to either side
    block = slop + 1
    wanted = wanted.withColumn("block", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.floor((F.col("near") + F.col("off")) / block) + i)))
    full = _in_docs_of(index, first).select(*DOC, "term", "pos", F.floor(F.col("pos") / block).alias("block")).distinct()
    met = wanted.alias("w").join(full.alias("f"), (F.col("w.text_hash") == F.col("f.text_hash")) & F.col("w.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("w.term") == F.col("f.term")) & (F.col("w.block") == F.col("f.block")))
    key = [F.col(f"w.{c}").alias(c) for c in (*DOC, "item_hash", "item_id", "start", "width", "near", "off")]
    shifted = met.select(*key, F.col("f.pos").alias("pos"), (F.col("f.pos") - F.col("w.off")).alias("diag")).where(f"abs(diag - near) <= {slop}")
    by = ["doc_id", "text_hash", "item_hash", "item_id", "start", "width", "near"]
    # a band begins at one of the places: each word is in the bands of up to slop places below its own
    bands = shifted.withColumn("band", F.explode(F.sequence(F.col("diag") - slop, F.col("diag")))).where(F.col("band") <= F.col("near"))
    full_bands = bands.groupBy(*by, "band").agg(F.countDistinct("off").alias("n"), F.min("pos").alias("pos"), F.collect_set(F.struct("off", "diag")).alias("at")).where("n = width")
    tight = full_bands.select(*by, "pos", _spread(F.col("at"), F.col("band"), slop).alias("spread"))
    return tight.groupBy(*DOC, "item_id", "item_hash", "start", F.col("near")).agg(F.min(F.struct("spread", "pos")).alias("b")).select(*DOC, "item_id", "item_hash", "start", "b.pos", "b.spread").distinct()


def _spread(at: Column, band: Column, slop: int) -> Column:
    """The least s with which the band from its first place to s places on holds every word."""
    every = F.size(F.array_distinct(F.transform(at, lambda x: x["off"])))
    held = lambda s: F.size(F.array_distinct(F.transform(F.filter(at, lambda x: x["diag"] <= band + s), lambda x: x["off"])))
    return F.array_min(F.filter(F.sequence(F.lit(0), F.lit(slop)), lambda s: held(s) == every))


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs(doc_id, text) against items(item_id, text)."""
    terms = materialize(item_words(items).select(F.col("term").alias("h")).distinct(), "terms")
    index = build_index(docs, terms, terms.count())
    found = materialize(phrase_matches(index, items), "matches")
    hit = found.select(*DOC, F.explode(F.sequence(F.col("pos"), (F.col("pos") + F.col("length") - 1).cast("int"))).alias("pos")).distinct().groupBy(*DOC).agg(F.count("*").alias("n_hit"))
    named = found.groupBy(*DOC).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("named"))
    rows = index.where("pos = 0").select(*DOC, "n_words")
    h, n = hit.withColumnRenamed("text_hash", "th").withColumnRenamed("doc_id", "di"), named.withColumnRenamed("text_hash", "th").withColumnRenamed("doc_id", "di")
    both = h.join(n, h["th"].eqNullSafe(n["th"]) & h["di"].eqNullSafe(n["di"])).select(h["di"], h["th"], "n_hit", "named")
    every = rows.join(both, rows["text_hash"].eqNullSafe(both["th"]) & rows["doc_id"].eqNullSafe(both["di"]), "left")
    names = F.coalesce("named", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return every.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
