"""Schema analytics and the choice of a strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import jsonmodel

#: Sizes and scores at which strategies change.
LARGE_BYTES, LARGE_CHARS, HUGE_CHARS = 100_000, 100_000, 1_000_000
STRATEGIES = ("simple", "chunked", "hierarchical")


def score(depth: Column, objects: Column, properties: Column, complex_: Column, tokens: Column) -> Column:
    return depth * F.lit(10.0) + objects * F.lit(2.0) + properties * F.lit(0.5) + F.when(complex_, 20.0).otherwise(0.0) + tokens * F.lit(0.01)


def is_complex(depth: Column, objects: Column, score_: Column) -> Column:
    return (depth > 3) | (objects > 20) | (score_ > 50)


def complexity(schemas: DataFrame) -> DataFrame:
    """Add the complexity of each schema, from its nodes (an array) and its estimated tokens; null without nodes.

    All of it is worked out within the row: a schema's nodes are at hand there, and neither they
    nor its texts are shuffled.
    """
    some = lambda c: F.when(F.size("nodes") > 0, c)
    out = schemas.select(
        "*", F.array_max(F.transform("nodes", lambda n: n["depth"])).cast("bigint").alias("nesting_depth"), some(F.size(F.filter("nodes", lambda n: n["type"] == "object")).cast("bigint")).alias("total_objects"),
        some(F.aggregate("nodes", F.lit(0).cast("bigint"), lambda total, n: total + n["n_properties"])).alias("total_properties"), some(F.exists("nodes", lambda n: n["has_keyword"] & ~n["under_list"])).alias("has_complex_types"),
    ).drop("nodes")
    out = out.withColumn("complexity_score", score(F.col("nesting_depth"), F.col("total_objects"), F.col("total_properties"), F.col("has_complex_types"), F.col("estimated_tokens")))
    return out.withColumn("is_complex", is_complex(F.col("nesting_depth"), F.col("total_objects"), F.col("complexity_score")))


def analyze(schemas: DataFrame) -> DataFrame:
    """schemas (schema_id, schema_json) with texts, sections and complexity, which are null where schema_error says why a schema can't be used.

    Each fact is a function of its own, so that those which nobody asks for aren't worked out.
    """
    # the root is level 0 and a dict without dicts inside is the depth itself
    read = schemas.select("schema_id", "schema_json", jsonmodel.schema_texts("schema_json").alias("t"), jsonmodel.sections_of("schema_json").alias("sections"), jsonmodel.nodes_of("schema_json").alias("nodes"), F.floor(jsonmodel.ascii_length("schema_json") / 4).alias("estimated_tokens"))
    return complexity(read.select("schema_id", "schema_json", F.col("t.dump").alias("schema_dump"), "sections", F.col("t.error").alias("schema_error"), "nodes", "estimated_tokens"))


def properties(schemas: DataFrame) -> DataFrame:
    """schema_id and a row for each property."""
    return schemas.select("schema_id", F.explode(jsonmodel.properties_of("schema_json")).alias("p")).select("schema_id", "p.*")


def select_strategy(n_bytes: Column, complex_: Column, override: Column | None = None, large: int = LARGE_BYTES) -> Column:
    """By size and complexity; an override wins, `auto`, an empty or no override don't count, and an unknown one gives null."""
    own = F.when((n_bytes > large) & complex_, "hierarchical").when((n_bytes > large) | complex_, "chunked").otherwise("simple")
    if override is None:
        return own
    asked = F.nullif(F.nullif(override, F.lit("auto")), F.lit(""))
    return F.when(asked.isNull(), own).when(asked.isin(*STRATEGIES), asked)


def recommend_strategy(n_chars: Column, score_: Column, large: int = LARGE_CHARS, huge: int = HUGE_CHARS) -> Column:
    return F.when((n_chars > huge) & (score_ > 50), "hierarchical").when((n_chars > large) | (score_ > 50), "chunked").otherwise("simple")

