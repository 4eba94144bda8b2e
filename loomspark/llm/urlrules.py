"""Operator 9: URL filters by a sort-merge range join, in DataFrame functions only.

A host turned round label by label and closed by a dot makes a key under which a rule's host and
all its subdomains are one interval: `net.example.` up to `net.example/` (the character after the
dot). Such intervals are nested or apart. Pages are dealt evenly into sweeps, whatever their
hosts, and every sweep gets the rules' interval starts. In a sweep pages and starts are sorted by
key; the last start before a page carries the stack of rules around it, and the page's rule is
the longest of the stack whose interval holds its key and whose path begins its path.

The rules go to every sweep, so those of a sweep are at most about `MAX_RULES`: more are dealt into
lots by host, each page goes through a sweep of every lot, and its best rule of all lots counts.
Sweeps grow in number with the pages, at about `sweep_rows` each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules that go to a sweep, about.
MAX_RULES = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(name: Column) -> Column:
    """Labels in reverse order, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(name, "\\.", -1)), "."), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", sweep_rows: int = 500_000, max_rules: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages.

    rules has host, path and verdict. A rule fits its host and all subdomains if the url's path
    starts with the rule's; the longest host and path together wins (then the longer host). Of
    rules for one host and path, `block` goes before `allow`. Rules with a null or empty host or a
    null verdict are void; a null path is empty. Pages without a fitting rule get `default` and a
    null rule. Null urls and urls without `://` have an empty host and path and no rule. Repeated
    pages each give a row; other columns are ignored.
    """
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host <> '' and r_verdict is not null")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    lots = max(1, -(-rules.count() // max_rules))
    lot = F.pmod(F.xxhash64("r_host"), F.lit(lots)).alias("lot")
    sweeps = max(1, -(-pages.count() // sweep_rows), min(64, pages.sparkSession.sparkContext.defaultParallelism))

    # The rules of each interval, and for each start the stack of intervals around it: itself and
    # those of its parent domains, as an equi-join on the host's suffixes.
    rule = F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), F.col("r_path"), F.col("r_verdict"), F.concat("r_host", "r_path").alias("rule"), reversed_host(F.col("r_host")).alias("key"))
    own = rules.groupBy("r_host", lot).agg(F.collect_list(rule).alias("own"))
    labels = F.split("r_host", "\\.", -1)
    upward = rules.select("r_host").distinct().select(F.col("r_host").alias("start"), lot, F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("r_host"))
    stacks = upward.join(own, ["r_host", "lot"]).groupBy("start", "lot").agg(F.flatten(F.collect_list("own")).alias("stack"))
    starts = stacks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sweeps - 1).cast("long"))).alias("sweep"), reversed_host(F.col("start")).alias("key"), "lot", F.lit(0).alias("kind"), "stack", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    every_lot = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long")))
    numbered = read.withColumn("row", F.monotonically_increasing_id())
    dealt = F.pmod(F.xxhash64("row", "host", "path"), F.lit(sweeps))
    none = F.lit(None).cast(starts.schema["stack"].dataType)
    pages_ = numbered.select(dealt.alias("sweep"), reversed_host(F.col("host")).alias("key"), every_lot.alias("lot"), F.lit(1).alias("kind"), none.alias("stack"), "row", "page_id", "host", "path")

    sweep = Window.partitionBy("sweep", "lot").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.filter(F.col("active"), lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["r_path"]))
    judged = starts.unionByName(pages_).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1").withColumn("best", F.array_max(active))
    if lots > 1:
        judged = judged.groupBy("row", "page_id", "host", "path").agg(F.max("best").alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
