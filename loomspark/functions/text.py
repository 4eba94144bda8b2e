"""Column functions that shape documents: words, chunks, truncation, samples, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a chunk and of its overlap, characters of a text and a schema in a prompt, size from which a document is sampled.
CHUNK_WORDS, OVERLAP_WORDS = 4000, 200
PROMPT_TEXT, PROMPT_SCHEMA = 8000, 3000
SAMPLE_BYTES = 10 * 1024 * 1024
#: White space between words: that of Unicode and four separators.
BLANK = r"(?U)[\s\x1c-\x1f]+"

#: The prompt and the system prompts of the strategies.
PROMPT = """Extract structured data from the following text according to the provided JSON schema.

{context}
{focus}

INSTRUCTIONS:
1. Read the text carefully and extract all relevant information
2. Follow the JSON schema exactly - match types, structure, and constraints
3. If a field is not clearly present in the text, omit it rather than guess
4. For arrays, extract all relevant items found in the text
5. For enums, use only the allowed values specified in the schema
6. Return ONLY valid JSON that matches the schema structure

TEXT TO EXTRACT FROM:
{text}

JSON SCHEMA:
{schema}

EXTRACTED DATA (JSON only):"""
SYSTEM = {
    "simple": "You are an expert data extraction specialist. Extract structured data from text according to JSON schemas with perfect accuracy.",
    "chunked": "You are an expert data extraction specialist. Extract structured data from this text chunk according to the JSON schema. Focus on completeness and accuracy.",
    "hierarchical": "You are an expert data extraction specialist. Focus on extracting data for the '{section}' section of the schema with high accuracy.",
}


def words(text: Column) -> Column:
    """Words of a text, as split at any white space."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def n_chunks(n_words: Column, stride: int = CHUNK_WORDS - OVERLAP_WORDS) -> Column:
    """max(1, ceil(words / stride))."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(n_words / F.lit(stride)).cast("bigint"))


def word_chunks(docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """Add chunk_idx and chunk_text: runs of `size` words that overlap; a text without words is its own chunk."""
    stride = size - overlap
    # chunks are made before they are exploded, so that no row carries the words of its whole text
    split = docs.withColumn("_w", words(F.col("text")))
    runs = F.transform(F.sequence(F.lit(0), n_chunks(F.size("_w"), stride).cast("int") - 1), lambda i: F.array_join(F.slice("_w", i * stride + 1, size), " "))
    chunks = split.withColumn("_c", F.when(F.size("_w") == 0, F.array("text")).otherwise(runs)).drop("_w")
    # the outer form: from the other one a filter on the array's size is inferred, which makes all chunks twice
    exploded = chunks.select(*docs.columns, F.posexplode_outer("_c").alias("chunk_idx", "chunk_text")).where("chunk_idx is not null")
    return exploded.withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


def cut(text: Column, most: int, mark: str) -> Column:
    """The first characters and a mark, if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def prompt_text(text: Column, most: int = PROMPT_TEXT) -> Column:
    return cut(text, most, "... [truncated]")


def prompt_schema(dump: Column, most: int = PROMPT_SCHEMA) -> Column:
    return cut(dump, most, "... [schema truncated]")


def prompt(text: Column, schema_dump: Column, context: Column | None = None, focus: Column | None = None, most: int = PROMPT_TEXT) -> Column:
    """The whole prompt; lines of an absent context or focus stay empty."""
    line = lambda name, c: F.lit("") if c is None else F.coalesce(F.concat(F.lit(f"{name}: "), c), F.lit(""))
    parts = {"context": line("Context", context), "focus": line("Focus", focus), "text": prompt_text(text, most), "schema": prompt_schema(schema_dump)}
    out, rest = [], PROMPT
    for name in ("context", "focus", "text", "schema"):
        before, rest = rest.split("{" + name + "}", 1)
        out += [F.lit(before), parts[name]]
    return F.concat(*out, F.lit(rest))


def strategic_sample(text: Column, strategy: Column, most: int = SAMPLE_BYTES) -> Column:
    """First half and last tenth of a text beyond `most` bytes that is to go in one call."""
    sampled = F.concat(F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int")), F.lit("\n...[content truncated]...\n"), F.right(text, F.floor(F.length(text) * F.lit(0.1)).cast("int")))
    return F.when((F.octet_length(text) > most) & (strategy == "simple"), sampled).otherwise(text)


def file_format(name: Column) -> Column:
    """pdf, csv or text, by a file name's extension."""
    lower = F.lower(name)
    return F.when(lower.endswith(".pdf"), "pdf").when(lower.endswith(".csv"), "csv").otherwise("text")


def stem(name: Column) -> Column:
    """A file's name without folders and its last extension."""
    base = F.regexp_extract(name, "([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def preview(json: Column, most: int = 500) -> Column:
    return F.when(F.length(json) > most, F.concat(F.left(json, F.lit(most)), F.lit("...\n}"))).otherwise(json)
