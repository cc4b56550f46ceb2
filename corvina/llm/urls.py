"""URL rules by a sort-merge range join, in DataFrame operations only.

A rule is a host and a path prefix; it fits its host and all subdomains. Its canonical key is the reversed host, a
separator and the path, so that "starts with the rule's path" is an interval of keys, and the intervals of rules nest
or are disjoint. A url is looked up once for each suffix of its host that some rule could name (at most as many as
the longest rule host has labels): each gives a point in the same order. Rules and points are sorted together by key
over range partitions. The sweep keeps the stack of active rules: each rule carries the chain of rules that enclose it,
and the last rule at or before a point brings the stack as it stood there; its innermost entry that still covers the
point fits. The stack at the end of a partition is handed to the next.

Null urls and urls without "://": host and path are empty, no rule fits and the default verdict holds. Rows that
share a page_id are judged each for itself. Where two rules of one length fit, the one with the longer host wins; of
rules with the same host and path the last by verdict order (block) wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorts before every character of a host or path, so a key orders by host first.
SEP = "\u0001"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rule_chains(rules: DataFrame) -> DataFrame:
    """(key, labels, chain) of each distinct rule; chain: the rules that enclose it and itself, outermost first.

    The enclosing rules of a rule have the same host and a prefix of its path, so they are found by a join on
    (host, path length): each rule asks for the prefixes of its own path.
    """
    keyed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("rev", reversed_host(F.col("host")))
    keyed = keyed.withColumn("labels", F.size(F.split("host", r"\.", -1))).withColumn("key", F.concat("rev", F.lit(SEP), "path"))
    entry = F.struct(F.length("path").alias("depth"), F.col("key").alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    outer = keyed.select("key", entry.alias("entry"))
    asks = keyed.select(F.col("key").alias("inner"), "labels", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.concat("rev", F.lit(SEP), F.expr("path").substr(F.lit(1), n)))).alias("key"))
    chains = asks.join(outer, "key").groupBy("inner", "labels").agg(F.array_sort(F.collect_list("entry")).alias("chain"))
    return chains.select(F.col("inner").alias("key"), "labels", "chain")


def judge(spark: SparkSession, urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``urls``: page_id, url. ``rules``: verdict, host, path. Gives page_id, host, path, rule, verdict."""
    urls = urls.select("page_id", F.col("url").cast("string").alias("url")).withColumn("row", F.monotonically_increasing_id())
    urls = written(spark, urls.select("page_id", "row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    chains = written(spark, rule_chains(rules), "rules")
    most = chains.agg(F.max("labels")).first()[0] or 0  # labels of the longest rule host

    # the last `most` labels at most, outermost first: each suffix of the host is a point
    tail = F.slice(F.reverse(F.split("host", r"\.", -1)), 1, max(most, 1))
    point = urls.where(F.lit(most > 0)).select("row", "path", tail.alias("tail"))
    point = point.select("row", F.explode(F.transform(F.sequence(F.lit(1), F.size("tail")), lambda n: F.concat(F.array_join(F.slice("tail", 1, n), "."), F.lit(SEP), "path"))).alias("key"))
    chain_type = chains.schema["chain"].dataType
    events = chains.select("key", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("row"), "chain").unionByName(point.select("key", F.lit(1).alias("kind"), "row", F.lit(None).cast(chain_type).alias("chain")))
    # `row` in the range: equal keys of any number are split over partitions
    ranged = events.repartitionByRange("key", "kind", "row").withColumn("part", F.spark_partition_id())
    ranged = written(spark, ranged, "sweep")

    # a row for each partition: the stack it ends with, handed on
    ends = ranged.groupBy("part").agg(F.max_by("chain", F.struct("key", "kind")).alias("any"), F.max(F.when(F.col("kind") == 0, F.struct("key", "chain"))).alias("last"))
    carried = ends.select("part", F.last("last.chain", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind", "row").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("stack", F.last("chain", ignorenulls=True).over(sweep)).where("kind = 1")
    swept = swept.join(F.broadcast(carried), "part").withColumn("stack", F.coalesce("stack", "carried"))
    active = F.filter("stack", lambda e: F.col("key").startswith(e["key"]))
    fits = swept.select("row", F.try_element_at(active, F.lit(-1)).alias("fit")).where("fit is not null")
    best = fits.groupBy("row").agg(F.max(F.struct(F.length("fit.rule").alias("n"), (F.length("fit.rule") - F.col("fit.depth")).alias("host_n"), F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"))).alias("best"))
    return urls.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
