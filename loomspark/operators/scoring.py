"""Validation and scores: errors, field and overall confidence, completeness, accuracy, flags, costs, ratings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.jsonmodel import TYPES, is_truthy
from loomspark.functions.matching import found_of

#: The confidence under which a field is flagged; price of 1,000 tokens in and out; the advice of a review.
LOW = 0.6
PRICE_IN, PRICE_OUT = 0.03, 0.06
RECOMMENDATION = "Human review recommended for flagged fields"


def type_matches(json_type: Column, expected: Column) -> Column:
    """Whether a value's type is the expected one; unknown names fit all, true and false are integers and numbers."""
    return (
        F.when(~expected.isin(*TYPES), True)
        .when(expected == "number", json_type.isin("integer", "number", "boolean"))
        .when(expected == "integer", json_type.isin("integer", "boolean"))
        .otherwise(json_type == expected)
    )


def missing_required(present: DataFrame, required: DataFrame, *keys: str) -> DataFrame:
    """Required names that a document lacks: a left anti join. required has keys, key and ord; present keys and key."""
    return required.join(present.select(*keys, "key"), [*keys, "key"], "left_anti").withColumn("message", F.concat(F.lit("Missing required field: "), F.col("key")))


def type_mismatches(top: DataFrame, expected: DataFrame, *keys: str) -> DataFrame:
    """Top-level fields of another type than declared. expected has keys, key, type and types."""
    known = top.join(expected, [*keys, "key"])
    any_of = F.exists(F.col("types"), lambda t: type_matches(F.col("json_type"), t))
    wrong = F.when(F.col("types").isNotNull(), ~any_of).otherwise(F.col("type").isNotNull() & ~type_matches(F.col("json_type"), F.col("type")))
    return known.where(wrong).withColumn("message", F.concat(F.lit("Type mismatch for "), F.col("key"), F.lit(": expected "), F.coalesce("type", F.array_join("types", ","))))


def field_confidence(required: Column, in_source: Column, truthy: Column) -> Column:
    """0.7, more if required or found in the source, less if empty; added in this order."""
    value = F.lit(0.7)
    value = F.when(required, value + F.lit(0.1)).otherwise(value)
    value = F.when(in_source, value + F.lit(0.15)).otherwise(value)
    value = F.when(truthy, value).otherwise(value - F.lit(0.2))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def overall_confidence(base: Column, n_errors: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n_errors > 0, base * (F.lit(1.0) - n_errors * F.lit(0.1))).otherwise(base)))


def completeness(n_required: Column, n_present: Column) -> Column:
    return F.when(n_required > 0, n_present / n_required).otherwise(1.0)


def accuracy(n_strings: Column, n_found: Column) -> Column:
    return F.when(n_strings > 0, n_found / n_strings).otherwise(1.0)


def flags(n_errors: Column, low_fields: Column, confidence: Column, threshold: float = LOW) -> Column:
    """Names of what a person should look at, distinct and sorted."""
    errors = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n_errors.cast("int"), F.lit(1)) - 1), lambda i: i < n_errors), lambda i: F.concat(F.lit("validation_error_"), i.cast("string")))
    overall = F.when(confidence < threshold, F.array(F.lit("overall_confidence_low"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(errors, low_fields, overall)))


def tokens_in(total: Column) -> Column:
    return F.floor(total * F.lit(0.7)).cast("bigint")


def tokens_out(total: Column) -> Column:
    return F.floor(total * F.lit(0.3)).cast("bigint")


def micro_cost(total: Column) -> Column:
    """Cost in millionths: exact, unlike a rounded double."""
    return tokens_in(total) * 30 + tokens_out(total) * 60


def cost(total: Column) -> Column:
    return tokens_in(total) * F.lit(PRICE_IN) / F.lit(1000.0) + tokens_out(total) * F.lit(PRICE_OUT) / F.lit(1000.0)


def _rounded(cost: pd.Series) -> pd.Series:
    return cost.map(lambda x: round(x, 4), na_action="ignore")


def rounded_cost(total: Column) -> Column:
    """cost() to four places by the double's exact value, which Spark's round() doesn't look at."""
    return F.pandas_udf(_rounded, "double")(cost(total))


def llm_share(llm_seconds: Column, seconds: Column) -> Column:
    """Share of the time that went to the provider, in percent."""
    return F.when(seconds > 0, llm_seconds / seconds * F.lit(100.0)).otherwise(0.0)


def efficiency(seconds: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - seconds * F.lit(10.0)))


def cost_rating(value: Column) -> Column:
    return F.when(value < 0.10, "Excellent").when(value < 0.50, "Good").otherwise("High")


def quality_rating(value: Column) -> Column:
    return F.when(value > 0.85, "Excellent").when(value > 0.70, "Good").otherwise("Needs Review")


def validate(fields: DataFrame, properties: DataFrame, *keys: str) -> DataFrame:
    """validation_errors of each document with any: missing fields in schema order, then wrong types in data order.

    properties has the keys' documents joined already (keys, key, ord, type, types, required, parent_path).
    """
    top = fields.where("depth = 0")
    level = properties.where("parent_path = ''")
    missing = missing_required(top, level.where("required").select(*keys, "key", "ord"), *keys).select(*keys, F.lit(0).alias("kind"), "ord", "message")
    wrong = type_mismatches(top, level.where("schema_path is not null").select(*keys, "key", "type", "types"), *keys).select(*keys, F.lit(1).alias("kind"), "ord", "message")
    both = missing.unionByName(wrong).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("kind", "ord", "message"))).alias("e"))
    return both.select(*keys, F.transform("e", lambda x: x["message"]).alias("validation_errors"))


def score_fields(fields: DataFrame, properties: DataFrame, texts: DataFrame, *keys: str) -> DataFrame:
    """keys and scores, an array of (seq, path, confidence) in the data's order, for fields reached through declared objects.

    texts has keys and text_lower, one row for each. Of fields with equal paths (a dot may stand in
    a key) the last one counts. The fields of a document meet its text as one list, so that the
    text is there once, and their strings are found in one pass over it.
    """
    declared = properties.where("schema_path is not null").select(*keys, F.col("schema_path").alias("parent_path"), F.lit(True).alias("reached")).distinct()
    required = properties.where("required").select(*keys, "parent_path", "key", F.lit(True).alias("required")).distinct()
    reached = fields.where("not in_list").join(declared, [*keys, "parent_path"], "left").where("depth = 0 or reached")
    joined = reached.join(required, [*keys, "parent_path", "key"], "left")
    about = F.struct("seq", "path", F.coalesce("required", F.lit(False)).alias("required"), F.lower("text").alias("value"), is_truthy(F.col("json_type"), F.col("value_json")).alias("truthy"))
    last = joined.groupBy(*keys, "path").agg(F.max_by(about, "seq").alias("f"))
    lists = last.groupBy(*keys).agg(F.array_sort(F.collect_list("f")).alias("f"))
    met = lists.join(texts, list(keys)).withColumn("hits", found_of(F.col("text_lower"), F.transform("f", lambda f: f["value"])))
    hit = lambda i: F.coalesce(F.get("hits", i), F.lit(False))
    scores = F.transform("f", lambda f, i: F.struct(f["seq"].alias("seq"), f["path"].alias("path"), field_confidence(f["required"], hit(i), f["truthy"]).alias("confidence")))
    return met.select(*keys, scores.alias("scores"))
