"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where that is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Rows of a task whose work is much for the bytes it reads.
ROWS = 8_192


def spread(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """Narrow rows dealt by key over tasks of about `rows` each: Spark cuts a table by its bytes alone, and a small file may hold a million rows."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
