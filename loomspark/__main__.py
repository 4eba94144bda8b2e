"""python -m loomspark sample|extract|evaluate: files in, folders of results out."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomspark.operators import reports, scoring
from loomspark.plans import engine
from loomspark.plans.phases import Phases
from loomspark.plans.settings import Settings
from loomspark.sources import files


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomspark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("sample", help="write a small document and a schema").add_argument("to")
    for name in ("extract", "evaluate"):
        p = commands.add_parser(name)
        p.add_argument("content", help="a file or folder of documents")
        p.add_argument("schema", help="a file or folder of JSON schemas")
        p.add_argument("to", help="a folder for the results")
        p.add_argument("--strategy", choices=list(engine.STRATEGIES))
        p.add_argument("--threshold", type=float)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("loomspark").getOrCreate()
    if given.command == "sample":
        files.write_sample(spark, given.to)
        return 0
    settings = Settings.of(spark)
    docs, schemas = files.read_documents(spark, given.content, max_file_size=settings.max_file_size), files.read_schemas(spark, given.schema)
    phases = Phases(spark)
    run = engine.evaluate if given.command == "evaluate" else engine.extract
    results = engine.written(run(docs.select("doc_id", "text", "error"), schemas.select("schema_id", "schema_json"), strategy=given.strategy or settings.strategy, threshold=given.threshold or settings.confidence_threshold, max_text_chars=settings.max_text_chars, phases=phases))
    files.write_results(results, given.to)
    files.write_result_files(results.join(docs.select("doc_id", "path"), "doc_id"), f"{given.to}/files")
    reports.summary(results).show(20, truncate=100)
    took = phases.table()
    took.show(20, truncate=40)
    took.select(F.sum("provider_seconds").alias("provider"), F.sum("seconds").alias("all")).select(scoring.llm_share(F.col("provider"), F.col("all")).alias("percent of the time that was the provider's")).show()
    return 0 if results.where("not success").isEmpty() else 1


if __name__ == "__main__":
    raise SystemExit(main())
