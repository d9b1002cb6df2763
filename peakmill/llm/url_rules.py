"""URL filtering by given host rules, then by mined association rules.

Spark's FP-growth mines combinations of URL tokens (host, domain, the labels
before it, words of hyphenated labels, path segments, query keys, ...) that
occur with the label "bad". A combination
becomes a rule if its support and confidence suffice and no part of it is as
confident. Rules match by an inverted index: each stands under its rarest
token, URLs look their tokens up, and the rule's other tokens are checked.

Mining and matching run over distinct URLs, so repeated pages weigh once. Tokens
that stand in the very same labelled URLs are mined as one, and a rule on it is
one on each of them.

Defined results: a null url, or one without ``://``, has an empty host and path
and only the token ``none``; it is allowed unless a rule says otherwise. Labels
with a null url or null flag are ignored; a URL with several labels is bad if
one is. Without labels nothing is mined and all that no given rule blocks is
allowed. Equal pages are judged each alike, urls of any length whole, and of
equally confident mined rules the one with more support, then the last by text,
is named. Empty tables give empty ones. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakmill.runtime import materialize

BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host_: Column, path_: Column, rules: dict[str, str]) -> Column:
    """(text, verdict) of the longest given rule that fits; null if none does.

    rules: ``host/path`` to verdict. A rule fits its host and all subdomains if
    the path starts with the rule's. Of equally long ones, the last by text.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,text:string,host:string,path:string,verdict:string>")
    table = F.array(
        *[
            F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("text"), F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path"), F.lit(v).alias("verdict"))
            for r, v in rules.items()
        ]
    )
    fits = lambda r: ((host_ == r["host"]) | F.endswith(host_, F.concat(F.lit("."), r["host"]))) & F.startswith(path_, r["path"])
    return F.array_max(F.filter(table, fits))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; numbers are generalised."""
    h, p = host(url), path(url)
    labels = F.split(h, "\\.")
    n = F.size(labels)
    query = F.regexp_extract(url, "(?s)^.*?://[^?#]*\\?([^#]*)", 1)
    number = lambda s: F.regexp_replace(s, "[0-9]+", "0")
    none = F.array().cast("array<string>")
    before = F.when(n > 2, F.slice(labels, 1, F.greatest(n - 2, F.lit(1)))).otherwise(none)
    # all labels but the last can be made of words
    hyphened = F.filter(F.slice(labels, 1, F.greatest(n - 1, F.lit(1))), lambda x: F.contains(x, F.lit("-")))
    words = F.filter(F.flatten(F.transform(hyphened, lambda x: F.split(x, "-"))), lambda w: w != "")
    parts = F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, "(?s)^(.*?)://", 1))), F.concat(F.lit("host="), h)),
        F.when(n > 2, F.array(F.concat(F.lit("domain="), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(none),
        F.transform(before, lambda x: F.concat(F.lit("label="), number(x))),
        F.transform(words, lambda w: F.concat(F.lit("word="), number(w))),
        F.transform(F.filter(F.split(p, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("segment="), number(s))),
        F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query="), F.split(s, "=")[0])),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(none),
    )
    return F.when(F.contains(url, F.lit("://")), F.array_distinct(parts)).otherwise(F.array(F.lit("none")))


def mine(
    labels: DataFrame, min_support: float = 0.002, min_count: int = 20, min_confidence: float = 0.5, min_lift: float = 1.2
) -> DataFrame:
    """Rules (rule, antecedent, support, confidence, key) from labels(url, bad).

    Pruned: a rule goes if its support is under min_support of the labelled
    URLs or under min_count of them, its confidence under min_confidence or under min_lift times the share
    of bad ones, or if a rule on fewer of its tokens is as confident.
    """
    spark = labels.sparkSession
    seen = materialize(
        labels.where("url is not null and bad is not null").groupBy("url").agg(F.max(F.col("bad").cast("int")).alias("bad")), "labelled"
    )
    n, bad = seen.agg(F.count("bad"), F.coalesce(F.sum("bad"), F.lit(0))).collect()[0]
    schema = "rule string, antecedent array<string>, support double, confidence double, key string"
    if not n or not bad:
        return spark.createDataFrame([], schema)
    support = min(1.0, max(min_support, min_count / n))
    known = materialize(token_classes(seen, int(support * n)), "classes")
    # baskets of classes, by their first tokens; every labelled URL has one, as supports are shares of all
    held = seen.select("url", F.explode(tokens(F.col("url"))).alias("rep")).join(known.select("rep"), "rep").groupBy("url").agg(F.collect_list("rep").alias("reps"))
    none = F.array().cast("array<string>")
    mark = F.when(F.col("bad") == 1, F.array(F.lit(BAD))).otherwise(none)
    items = materialize(seen.join(held, "url", "left").select(F.concat(F.coalesce("reps", none), mark).alias("items"), "bad"), "baskets")
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(items).freqItemsets
    sets = materialize(found.select(F.sort_array("items").alias("items"), "freq"), "itemsets")
    hit = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("both"))
    conf = F.col("both") / F.col("freq")
    rules = (
        hit.join(sets, "items")
        .withColumns({"confidence": conf, "support": F.col("both") / n, "rule": F.array_join("items", " ")})
        .where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * bad / n))
    )
    # a rule without one of its tokens that is as confident makes it redundant
    smaller = rules.where(F.size("items") > 1).select("rule", "confidence", F.explode("items").alias("t"), "items").select(
        F.col("rule").alias("larger"), F.col("confidence").alias("own"), F.array_join(F.array_remove("items", F.col("t")), " ").alias("rule")
    )
    redundant = smaller.join(rules.select("rule", "confidence"), "rule").where("confidence >= own").select(F.col("larger").alias("rule")).distinct()
    rules = rules.join(redundant, "rule", "left_anti")
    # any token of a class stands for it: one rule for each choice
    members = rules.select("rule", F.explode("items").alias("rep")).join(known, "rep").groupBy("rule").agg(F.collect_list("members").alias("members"))
    grow = lambda sofar, more: F.flatten(F.transform(sofar, lambda x: F.transform(more, lambda m: F.array_append(x, m))))
    choices = F.aggregate("members", F.array(none), grow)
    each = rules.join(members, "rule").select("support", "confidence", F.explode(choices).alias("antecedent")).select(F.sort_array("antecedent").alias("antecedent"), "support", "confidence")
    named = materialize(each.withColumn("rule", F.array_join("antecedent", " ")), "rules")
    # the rarest token of a rule is its place in the index
    single = known.select(F.explode("members").alias("key"), "n")
    placed = named.select("rule", F.explode("antecedent").alias("key")).join(single, "key").groupBy("rule").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    return named.join(placed, "rule").select("rule", "antecedent", "support", "confidence", "key")


def token_classes(urls: DataFrame, least: int) -> DataFrame:
    """(rep, members, n): tokens of the distinct urls(url) that stand in the very same ones, and in ``least`` of them or more.

    Such tokens are one item to the miner, or a long path that many URLs share
    would make as many itemsets as it has subsets. Sets of URLs are told apart
    by their number and 128 bits.
    """
    each = urls.select(F.xxhash64("url").alias("a"), F.xxhash64("url", F.lit(1)).alias("b"), F.explode(tokens(F.col("url"))).alias("token"))
    of = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where(F.col("n") >= least)
    return of.groupBy("n", "a", "b").agg(F.min("token").alias("rep"), F.sort_array(F.collect_list("token")).alias("members")).select("rep", "members", "n")


def blocked_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_rule, confidence) of the distinct urls(url) that a mined rule fits: its most confident one."""
    looked = urls.withColumn("tokens", tokens(F.col("url"))).withColumn("key", F.explode("tokens"))
    fits = F.size(F.array_except("antecedent", "tokens")) == 0
    return (
        looked.join(rules, "key")
        .where(fits)
        .groupBy("url")
        .agg(F.max_by("rule", F.struct("confidence", "support", "rule")).alias("mined_rule"), F.max("confidence").alias("confidence"))
    )


def judge(pages: DataFrame, given: dict[str, str], rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule) for every row of pages(page_id, url)."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    mined = blocked_urls(pages.where("url is not null").select("url").distinct(), rules).select("url", "mined_rule")
    fit = pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn(
        "fit", given_rule(F.col("host"), F.col("path"), given)
    )
    # grows with the input: never broadcast
    return fit.join(mined.hint("merge"), "url", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.text").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("fit").isNull(), F.col("mined_rule")).alias("mined_rule"),
    )
