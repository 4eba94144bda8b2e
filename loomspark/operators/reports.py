"""Projections for people and services: responses, summaries, review reports, CSV as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import preview
from loomspark.operators import scoring


def api_response(results: DataFrame, *more: str) -> DataFrame:
    return results.select("doc_id", *more, F.col("extracted_data").alias("data"), F.col("confidence_score").alias("confidence"), "field_confidences", "low_confidence_fields", "processing_time", "strategy_used")


def file_response(results: DataFrame) -> DataFrame:
    """The response that names the content's and the schema's file, which are columns of the results."""
    return api_response(results, "content_filename", "schema_filename").withColumnRenamed("data", "extracted_data")


def summary(results: DataFrame, errors: int = 3, low: int = 3) -> DataFrame:
    """First errors and low fields, and how many there are; a preview of the data; costs and ratings, if the results were evaluated."""
    rated = [c for c in ("token_usage", "estimated_cost", "completeness", "accuracy", "efficiency", "cost_rating", "quality_rating") if c in results.columns]
    return results.select("doc_id", "success", "confidence_score", *rated, F.slice("validation_errors", 1, errors).alias("first_errors"), F.size("validation_errors").alias("n_errors"), F.slice("low_confidence_fields", 1, low).alias("first_low"), F.greatest(F.size("low_confidence_fields") - low, F.lit(0)).alias("n_more_low"), preview(F.col("extracted_data")).alias("preview"))


def review(results: DataFrame) -> DataFrame:
    """Documents with flags, for review."""
    return results.where(F.size("flags") > 0).select("doc_id", F.col("flags").alias("low_confidence_fields"), "validation_errors", F.col("confidence_score").alias("overall_confidence"), F.lit(scoring.RECOMMENDATION).alias("recommendation"))


def _cell(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("nan"))


def csv_text(table: DataFrame, order: str, columns: list[str] | None = None, head: int = 10) -> DataFrame:
    """One row, text: counts, column names, the first rows in order, and how many more there are."""
    columns = columns or table.columns
    row = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), _cell(F.col(c))) for c in columns])
    # only `head` rows are ordered and numbered
    first = table.orderBy(order).limit(head).withColumn("i", F.row_number().over(Window.orderBy(order)))
    lines = first.select("i", F.concat(F.lit("Row "), F.col("i").cast("string"), F.lit(": "), row).alias("line")).agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("rows"))
    count = table.agg(F.count(F.lit(1)).alias("n"))
    top = F.concat(F.lit("CSV file with "), F.col("n").cast("string"), F.lit(f" rows and {len(columns)} columns"))
    more = F.when(F.col("n") > head, F.array(F.concat(F.lit("... and "), (F.col("n") - head).cast("string"), F.lit(" more rows")))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.array(top, F.lit("Columns: " + ", ".join(columns)), F.lit(""), F.lit("Data sample:")), F.transform("rows", lambda r: r["line"]), more)
    return count.join(F.broadcast(lines)).select(F.array_join(parts, "\n").alias("text"))
