"""Files in and out: text, CSV and PDF documents, schemas, result tables."""

from __future__ import annotations

import importlib.util
import io
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import jsonmodel
from loomspark.functions.text import file_format, stem
from loomspark.operators.reports import review
from loomspark.operators.scoring import RECOMMENDATION
from loomspark.sources.csvtext import read_csv_texts, whole_text
from loomspark.sources.named import write_named

#: Fixed value: size from which a file is marked as large.
WARN_BYTES = 50 * 1024 * 1024


def decoded(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def pdf_available() -> bool:
    return any(importlib.util.find_spec(m) for m in ("pdfplumber", "pypdf", "PyPDF2"))


def _pdf_text(content: bytes) -> str | None:
    """Text of a file's pages; a second library where the first fails or finds none."""
    for name in ("pdfplumber", "pypdf", "PyPDF2"):
        if importlib.util.find_spec(name) is None:
            continue
        try:
            lib = __import__(name)
            pages = lib.open(io.BytesIO(content)).pages if name == "pdfplumber" else lib.PdfReader(io.BytesIO(content)).pages
            text = "\n\n".join(t for p in pages if (t := p.extract_text()))
            if text.strip():
                return text
        except Exception:  # a broken file is one row without text
            continue
    return None


def _read(content: pd.Series, format_: pd.Series) -> pd.DataFrame:
    """Text and error of PDF and CSV files; a broken file is one row with an error."""

    def one(x: bytes | None, kind: str) -> tuple[str | None, str | None]:
        if x is None:
            return None, None
        if kind == "pdf":
            text = _pdf_text(x)
            return text, None if text is not None else "Could not extract text from PDF" if pdf_available() else "PDF processing not available"
        try:
            return whole_text(x), None
        except Exception as e:
            return None, f"Could not process CSV file: {e}"

    return pd.DataFrame([one(x, k) for x, k in zip(content, format_, strict=True)], columns=["text", "error"])


def as_documents(files: DataFrame) -> DataFrame:
    """path, filename, text, size_mb, large and error of binary files, by the format of their names. One pass, for streams too."""
    named = files.select("path", "content", "length").withColumn("format", file_format(F.col("path")))
    plain = F.col("format") == "text"
    parsed = F.pandas_udf(_read, "text string, error string")(F.when(~plain, F.col("content")), F.col("format"))
    return named.withColumn("parsed", parsed).select(
        "path", F.when(plain, decoded(F.col("content"))).otherwise(F.col("parsed.text")).alias("text"), "parsed.error", (F.col("length") / 1048576.0).alias("size_mb"), (F.col("length") > WARN_BYTES).alias("large"), F.regexp_extract("path", "([^/]*)$", 1).alias("filename")
    )


def _strict(content: pd.Series) -> pd.Series:
    def one(x: bytes | None) -> str | None:
        try:
            x.decode("utf-8") if x is not None else None
        except UnicodeDecodeError as e:
            return str(e)
        return None

    return content.map(one)


def too_large(files: DataFrame, max_file_size: int) -> DataFrame:
    """Rows, as of as_documents, for the files beyond a size. Their content isn't read: the size is known from the listing, and no column needs more."""
    error = F.format_string(f"the file has %d bytes, more than {max_file_size}", "length")
    return files.where(F.col("length") > max_file_size).select("path", F.lit(None).cast("string").alias("text"), error.alias("error"), (F.col("length") / 1048576.0).alias("size_mb"), (F.col("length") > WARN_BYTES).alias("large"), F.regexp_extract("path", "([^/]*)$", 1).alias("filename"))


def read_documents(spark: SparkSession, path: str, strict: bool = False, max_file_size: int | None = None) -> DataFrame:
    """Documents of all files under a path, with a doc_id hashed from their path. strict: text that isn't UTF-8 is an error instead of Latin-1. Files beyond max_file_size bytes are rows with an error."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # the source leaves files out by their length before it opens them
    files = every if max_file_size is None else every.where(F.col("length") <= max_file_size)
    out = as_documents(files)
    if strict:
        bad = files.select("path", F.pandas_udf(_strict, "string")("content").alias("bad")).where(F.col("bad").isNotNull() & (file_format(F.col("path")) == "text"))
        out = out.join(bad, "path", "left").withColumn("error", F.coalesce("error", "bad")).withColumn("text", F.when(F.col("bad").isNull(), F.col("text"))).drop("bad")
    if max_file_size is not None:
        out = out.unionByName(too_large(every, max_file_size))
    return out.withColumn("doc_id", F.xxhash64("path"))


def read_csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and text of the CSV files under a path, read by Spark in splits: for files too large for one task.

    Each file has its own header and encoding. Files whose cells hold line ends are read whole.
    """
    texts, ended = read_csv_texts(spark, path)
    if ended.isEmpty():
        return texts
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cC][sS][vV]").load(path)
    whole = whole.select(F.col("_metadata.file_path").alias("path"), "content", "length").join(ended, "path", "left_semi")
    return texts.unionByName(as_documents(whole).select("path", "text"))


def _valid(schema: pd.Series) -> pd.Series:
    return schema.map(lambda x: jsonmodel.is_schema(x))


def read_schemas(spark: SparkSession, path: str) -> DataFrame:
    """schema_id (the path) and schema_json of schema files, one each; those that aren't JSON objects are left to the caller as valid = false."""
    read = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("schema_id"), F.col("value").alias("schema_json"))
    return read.withColumn("valid", F.pandas_udf(_valid, "boolean")("schema_json"))


def _pretty(data: pd.Series) -> pd.Series:
    return data.map(lambda x: json.dumps(json.loads(x), indent=2, ensure_ascii=False), na_action="ignore")


def pretty(data: Column) -> Column:
    """JSON text with an indent of two, other characters than ASCII kept."""
    return F.pandas_udf(_pretty, "string")(data)


def output_name(name: Column, kind: str = "") -> Column:
    """The default name of a document's result file, or of that of its metrics or review."""
    return F.concat(stem(name), F.lit("_extracted" + (f"_{kind}" if kind else "") + ".json"))


def result_files(results: DataFrame) -> DataFrame:
    """name and value of the files of results that have a path: data of those that succeeded, metrics of all, reviews of those with flags.

    Results whose path has the stem of another's, or that follow several schemas, get a hash of path
    and schema in their names, so that no two names are alike.
    """
    own = results.withColumn("_stem", stem(F.col("path")))
    alike = own.groupBy("_stem").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_stem", F.lit(True).alias("_alike"))
    tail = F.when(F.col("_alike"), F.concat(F.lit("-"), F.lower(F.hex(F.xxhash64("path", "schema_id"))), F.lit(".json"))).otherwise(F.lit(".json"))
    named = own.join(alike, "_stem", "left").withColumn("_name", F.concat("_stem", tail))
    at = lambda kind="": output_name(F.col("_name"), kind).alias("name")
    told = [c for c in results.columns if c not in ("path", "extracted_data")]
    out = named.where("success").select(at(), pretty(F.col("extracted_data")).alias("value"))
    out = out.unionByName(named.select(at("metrics"), pretty(F.to_json(F.struct(*told), {"ignoreNullFields": "false"})).alias("value")))
    if "flags" in results.columns:
        advice = F.struct(F.col("flags").alias("low_confidence_fields"), "validation_errors", F.col("confidence_score").alias("overall_confidence"), F.lit(RECOMMENDATION).alias("recommendation"))
        out = out.unionByName(named.where(F.size("flags") > 0).select(at("review"), pretty(F.to_json(advice)).alias("value")))
    return out


def write_result_files(results: DataFrame, path: str) -> None:
    """Files `<stem>_extracted.json`, `<stem>_extracted_metrics.json` and `<stem>_extracted_review.json` of results that have a path."""
    write_named(result_files(results), path)


def write_results(results: DataFrame, path: str) -> None:
    """Three folders: extracted data, metrics, and reviews of flagged documents."""
    results.select("doc_id", "schema_id", "extracted_data", pretty(F.col("extracted_data")).alias("pretty")).write.mode("overwrite").json(f"{path}/extracted")
    results.drop("extracted_data").write.mode("overwrite").json(f"{path}/metrics")
    if "flags" in results.columns:
        review(results).write.mode("overwrite").json(f"{path}/review")


#: A small document and a schema to try.
SAMPLE_TEXT = "name: Ada Lovelace\nemail: ada@example.org\nsummary: Wrote the first published program.\nskills: mathematics, analysis\n"
SAMPLE_SCHEMA = '{"type":"object","properties":{"name":{"type":"string"},"email":{"type":"string"},"summary":{"type":"string"},"skills":{"type":"string"}},"required":["name","email"]}'


def sample(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The sample document and schema as tables."""
    return spark.createDataFrame([(1, SAMPLE_TEXT)], "doc_id long, text string"), spark.createDataFrame([("person", SAMPLE_SCHEMA)], "schema_id string, schema_json string")


def write_sample(spark: SparkSession, path: str) -> None:
    """The sample as files: a folder with the text, one with the schema."""
    for name, content in (("content", SAMPLE_TEXT.rstrip("\n")), ("schema", SAMPLE_SCHEMA)):
        spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
