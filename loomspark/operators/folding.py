"""Folds of partial results: in order over chunks, last wins over sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.jsonmodel import is_truthy


#: Units whose lists are joined at once; their texts are joined in turn.
RANGE = 512


def fold_chunks(fields: DataFrame, *keys: str, range_: int = RANGE) -> DataFrame:
    """Of top-level fields (keys, unit_idx, ord, key, json_type, value_json) one for each key.

    In the order of units the first value stays, lists are joined and a falsy value gives way to a
    truthy one. So a key has its first truthy value or, if that is a list, all its lists in order
    (those before are empty); without a truthy value it has its first. All three are associative:
    the first ones are minima, and lists are joined by ranges of units and then range by range, so
    that no row gathers more than `range_` values, however many units a document has. ord becomes
    the order of first appearance.
    """
    item = F.struct("unit_idx", "ord", F.col("json_type").alias("t"), F.col("value_json").alias("v"))
    is_list = F.col("json_type") == "array"
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["v"]), ",")
    inner = F.substring("value_json", F.lit(2), F.length("value_json") - 2)
    entry = F.when(is_list & (inner != ""), F.struct("unit_idx", "ord", inner.alias("v")))
    # what is no list goes to one range: it only has minima
    ranged = fields.withColumn("_range", F.when(is_list, F.floor(F.col("unit_idx") / range_)).otherwise(-1))
    firsts = [F.min("first").alias("first"), F.min("truthy").alias("truthy")]
    by_range = ranged.groupBy(*keys, "key", "_range").agg(F.min(item).alias("first"), F.min(F.when(is_truthy(F.col("json_type"), F.col("value_json")), item)).alias("truthy"), joined(F.collect_list(entry)).alias("v"))
    text = F.when(F.col("v") != "", F.struct("_range", "v"))
    folded = by_range.groupBy(*keys, "key").agg(*firsts, joined(F.collect_list(text)).alias("lists"))
    best = F.coalesce("truthy", "first")
    value = F.when(best["t"] == "array", F.concat(F.lit("["), "lists", F.lit("]"))).otherwise(best["v"])
    return folded.select(*keys, "key", F.col("first.unit_idx").alias("first_unit"), F.col("first.ord").alias("ord"), best["t"].alias("json_type"), value.alias("value_json"))


def fold_sections(fields: DataFrame, *keys: str) -> DataFrame:
    """One value for each key: that of the last section; order of first appearance."""
    out = fields.groupBy(*keys, "key").agg(F.max_by(F.struct("json_type", "value_json"), "unit_idx").alias("m"), F.min(F.struct("unit_idx", "ord")).alias("f"))
    return out.select(*keys, "key", F.col("f.unit_idx").alias("first_unit"), F.col("f.ord").alias("ord"), "m.json_type", "m.value_json")


def objects(folded: DataFrame, *keys: str) -> DataFrame:
    """data: the JSON object of folded fields, in order of first appearance."""
    name = F.regexp_extract(F.to_json(F.array(F.col("key"))), r"(?s)^\[(.*)\]$", 1)
    item = F.struct("first_unit", "ord", F.concat(name, F.lit(":"), F.col("value_json")).alias("x"))
    return folded.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("i")).select(*keys, F.concat(F.lit("{"), F.array_join(F.transform("i", lambda x: x["x"]), ","), F.lit("}")).alias("data"))
