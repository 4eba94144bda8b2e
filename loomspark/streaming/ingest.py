"""Files as they arrive: a stream of documents, extracted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.plans.engine import extract
from loomspark.plans.settings import Settings
from loomspark.sources.files import as_documents, too_large


def document_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, max_file_size: int | None = None) -> DataFrame:
    """doc_id, path, text and error of files under a path as they arrive, read by the format of their names. What isn't given is as the session's settings say."""
    settings = Settings.of(spark)
    files_per_trigger, max_file_size = files_per_trigger or settings.files_per_trigger, max_file_size or settings.max_file_size
    layout = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(layout).format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).load(path)
    read = as_documents(files.where(F.col("length") <= max_file_size)).unionByName(too_large(files, max_file_size))
    return read.select(F.xxhash64("path").alias("doc_id"), "path", "text", "error")


def extract_stream(stream: DataFrame, schemas: DataFrame, to: str, checkpoint: str, provider=None) -> StreamingQuery:
    """Extract each batch once and add it to a Parquet table, in a folder of its own so that a repeated batch replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        extract(batch.select("doc_id", "text", "error"), schemas, provider=provider).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
