"""Extraction of many documents by many schemas, and its evaluation.

Documents (doc_id, text) meet schemas (schema_id, schema_json) in pairs; every pair gets a number
of its own (`row`) and a strategy, is cut into units, goes to a completion provider and comes back
as fields, which are folded, validated and scored by joins on `row`, so that repeated and null ids
are documents like others. The pairs are written once; the text takes part once for the prompts and
once for the scores. Failures are rows, never failed jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import jsonmodel, matching, text
from loomspark.operators import folding, schema, scoring
from loomspark.plans.completion import Heuristic, Missing
from loomspark.plans.phases import Phases
from loomspark.sources.tables import written

KEYS = ("doc_id", "schema_id")
#: Schemas whose facts are broadcast at most, bytes of their texts (facts repeat a text up to five times), ids that are; beyond that joins are dealt by key.
BROADCAST_SCHEMAS, BROADCAST_BYTES, BROADCAST_IDS = 1_000, 4 << 20, 100_000
#: Tokens an answer may have, and the confidence of folded results.
MAX_TOKENS = {"simple": 4000, "chunked": 3000, "hierarchical": 4000}
BASE = {"chunked": 0.8, "hierarchical": 0.85}
#: A limit that cuts no text.
WHOLE = (1 << 31) - 1


def _small(schemas: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of schemas, broadcast if the schemas are few and small."""
    n, size = schemas.limit(BROADCAST_SCHEMAS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("schema_json")), F.lit(0))).first()
    return F.broadcast(facts) if n <= BROADCAST_SCHEMAS and size <= BROADCAST_BYTES else facts


def _with_schema_id(docs: DataFrame, schemas: DataFrame) -> DataFrame:
    """Documents with a schema_id. Those without one meet every schema: the ids stand in lists of a thousand, each document goes to every list and takes its ids."""
    if "schema_id" in docs.columns:
        return docs
    n = schemas.count()
    parts, salts = max(1, -(-n // 1000)), 1 if n <= BROADCAST_IDS else 64
    lists = schemas.groupBy(F.pmod(F.xxhash64("schema_id"), F.lit(parts)).cast("int").alias("_part")).agg(F.collect_list("schema_id").alias("_ids"))
    lists = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = docs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)).cast("int"))
    met = dealt.join(F.broadcast(lists) if salts == 1 else lists, ["_part", "_salt"])
    return met.withColumn("schema_id", F.explode("_ids")).drop("_part", "_salt", "_ids")


def pairs(docs: DataFrame, schemas: DataFrame, strategy: str | None = None) -> DataFrame:
    """Documents with a row number, their schema's facts and a strategy. docs may have a schema_id (else each meets all), a strategy of its own, and an error for documents that couldn't be read."""
    met = _with_schema_id(docs, schemas).join(_small(schemas, schema.analyze(schemas)), "schema_id")
    own = F.col("strategy") if "strategy" in docs.columns else F.lit(strategy).cast("string")
    met = met.withColumn("doc_error", F.when(F.col("error").isNotNull(), F.col("error")) if "error" in docs.columns else F.lit(None).cast("string"))
    met = met.withColumn("doc_error", F.coalesce("doc_error", F.when(F.col("text").isNull(), "the document has no text")))
    return met.withColumn("row", F.monotonically_increasing_id()).withColumn("asked", own).withColumn("strategy_used", F.when(F.col("schema_dump").isNotNull(), schema.select_strategy(F.octet_length("text"), F.col("is_complex"), own)))


def units(met: DataFrame, max_text_chars: int = text.PROMPT_TEXT) -> DataFrame:
    """Prompts: one for a document, for each chunk, or for each section of the schema."""
    keys, met = ("row", *KEYS), met.where("doc_error is null")
    prompt = lambda *of, **how: text.prompt(*of, most=max_text_chars, **how).alias("user_prompt")
    most = lambda strategy: F.lit(MAX_TOKENS[strategy]).alias("max_tokens")
    simple = met.where("strategy_used = 'simple'").select(*keys, F.lit(0).alias("unit_idx"), F.lit(text.SYSTEM["simple"]).alias("system_prompt"), prompt(F.col("text"), F.col("schema_dump")), most("simple"))
    cut = text.word_chunks(met.where("strategy_used = 'chunked'").select(*keys, "text", "schema_dump").withColumn("n_all", text.n_chunks(F.size(text.words(F.col("text"))))))
    context = F.format_string("chunk %d/%d", F.col("chunk_idx") + 1, F.col("n_all"))
    chunked = cut.select(*keys, F.col("chunk_idx").cast("int").alias("unit_idx"), F.lit(text.SYSTEM["chunked"]).alias("system_prompt"), prompt(F.col("chunk_text"), F.col("schema_dump"), context=context), most("chunked"))
    each = met.where("strategy_used = 'hierarchical'").select(*keys, "text", F.posexplode("sections").alias("unit_idx", "section"))
    focus = F.concat(F.lit("Focus on extracting data for: "), F.col("section.name"))
    by_section = each.select(*keys, "unit_idx", F.replace(F.lit(text.SYSTEM["hierarchical"]), F.lit("{section}"), F.col("section.name")).alias("system_prompt"), prompt(F.col("text"), F.col("section.dump"), focus=focus), most("hierarchical"))
    return simple.unionByName(chunked).unionByName(by_section)


def totals(units_: DataFrame, *keys: str, more: Sequence[Column] = ()) -> DataFrame:
    """Tokens and number of the units of each document."""
    return units_.groupBy(*keys).agg(F.sum("total_tokens").alias("token_usage"), F.count(F.lit(1)).cast("int").alias("chunks_processed"), *more)


def _keeper(phases: Phases | None):
    """How a phase's result is written: as a phase of the run, if there is one to note them in."""
    return phases.written if phases is not None else lambda name, df: written(df)


def extract(docs: DataFrame, schemas: DataFrame, strategy: str | None = None, provider=None, threshold: float = scoring.LOW, max_text_chars: int = text.PROMPT_TEXT, phases: Phases | None = None) -> DataFrame:
    """One row for each document and schema: success, extracted_data, scores, errors, flags.

    Documents that have an error or no text aren't asked about and fail with it.
    Schemas that are no JSON objects, unknown strategies and failed completions give success = false
    and an error_message, as do schemas and answers nested more than jsonmodel.DEPTH levels deep; no
    document's text, schema or answer fails the others. Rows with repeated or null
    ids are documents of their own. processing_time is the seconds that the provider took. phases
    gets what each phase took.
    """
    keep = _keeper(phases)
    return _extract(keep("schemas and strategies", pairs(docs, schemas, strategy)), schemas, provider, threshold, max_text_chars, keep).drop("row")


def _extract(met: DataFrame, schemas: DataFrame, provider, threshold: float, max_text_chars: int, keep) -> DataFrame:
    answers = keep("answers", (provider or Heuristic()).complete(units(met, max_text_chars)))
    parsed = answers.withColumn("p", jsonmodel.parse_completion("content"))
    parsed = keep("parsing", parsed.select("row", "unit_idx", "total_tokens", "seconds", F.coalesce("error", "p.error").alias("error"), F.col("p.data").alias("data"), F.col("p.confidence").alias("parse_confidence")))
    about = met.select("row", *KEYS, "strategy_used", "asked", "schema_error", "doc_error")
    per_doc = totals(parsed, "row", more=[F.sum("seconds").alias("processing_time"), F.max("error").alias("error"), F.min_by("parse_confidence", "unit_idx").alias("parse_confidence"), F.bool_or(F.col("data").startswith("{")).alias("has_object")])

    top = jsonmodel.fields(parsed, "data", "row", "unit_idx").where("depth = 0").join(about.select("row", "strategy_used"), "row")
    chunked = folding.fold_chunks(top.where("strategy_used <> 'hierarchical'"), "row")
    sections = folding.fold_sections(top.where("strategy_used = 'hierarchical'"), "row")
    data = keep("folding", folding.objects(chunked.unionByName(sections), "row"))

    fields = keep("fields", jsonmodel.fields(data, "data", "row"))
    properties = about.select("row", "schema_id").join(_small(schemas, schema.properties(schemas)), "schema_id")
    errors = scoring.validate(fields, properties, "row")
    lower = met.select("row", F.lower("text").alias("text_lower"))
    scored = scoring.score_fields(fields, properties, lower, "row")
    confidences = scored.select("row", F.map_from_entries(F.transform("scores", lambda x: F.struct(x["path"], x["confidence"]))).alias("field_confidences"), F.transform(F.filter("scores", lambda x: x["confidence"] < threshold), lambda x: x["path"]).alias("low_confidence_fields"))

    out = about.join(per_doc, "row", "left").join(data, "row", "left").join(errors, "row", "left").join(confidences, "row", "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    problem = F.when(F.col("doc_error").isNotNull(), F.col("doc_error")).when(F.col("schema_error").isNotNull(), F.col("schema_error")).when(F.col("strategy_used").isNull(), F.concat(F.lit("unknown strategy: "), "asked")).when(F.col("error").isNotNull(), F.col("error")).when((F.col("strategy_used") == "simple") & ~F.col("has_object"), "the completion is no object")
    out = out.withColumn("error_message", problem).withColumn("success", problem.isNull())
    base = F.when(F.col("strategy_used") == "simple", F.col("parse_confidence")).when(F.col("strategy_used") == "chunked", BASE["chunked"]).otherwise(BASE["hierarchical"])
    # an object without members has no fields, and yet lacks what is required
    out = out.withColumn("validation_errors", none(F.col("validation_errors"), "array<string>"))
    confidence = F.when(F.col("success"), scoring.overall_confidence(base, F.size("validation_errors"))).otherwise(0.0)
    return out.select(
        "row", *KEYS, "success", F.when(F.col("success"), F.coalesce("data", F.lit("{}"))).alias("extracted_data"), confidence.alias("confidence_score"), F.coalesce("field_confidences", F.create_map().cast("map<string,double>")).alias("field_confidences"), F.coalesce("strategy_used", F.lit("unknown")).alias("strategy_used"), F.coalesce("processing_time", F.lit(0.0)).alias("processing_time"),
        F.coalesce("token_usage", F.lit(0)).alias("token_usage"), F.coalesce("chunks_processed", F.lit(0)).alias("chunks_processed"), "validation_errors", none(F.col("low_confidence_fields"), "array<string>").alias("low_confidence_fields"), "error_message",
    )


def evaluate(docs: DataFrame, schemas: DataFrame, strategy: str | None = "auto", provider=None, threshold: float = scoring.LOW, max_text_chars: int = text.PROMPT_TEXT, phases: Phases | None = None) -> DataFrame:
    """extract() with sizes, costs, completeness, accuracy, flags and ratings.

    `auto` takes the recommended strategy; a long text that goes in one call is sampled for it,
    while quality is measured on the whole text.
    """
    given = _with_schema_id(docs, schemas).join(_small(schemas, schema.analyze(schemas).select("schema_id", "complexity_score")), "schema_id")
    chosen = schema.recommend_strategy(F.length("text"), F.col("complexity_score")) if strategy in (None, "", "auto") else F.lit(strategy)
    keep = _keeper(phases)
    met = keep("schemas and strategies", pairs(given.drop("strategy").withColumn("strategy", chosen).drop("complexity_score"), schemas))
    sampled = met.withColumn("text", text.strategic_sample(F.col("text"), F.col("strategy")))
    results = keep("scores", _extract(sampled, schemas, provider, threshold, max_text_chars, keep))

    # strings of the answer meet the text as one list, so that the text is there once and is read once
    strings = jsonmodel.fields(results.select("row", "extracted_data"), "extracted_data", "row").where(F.trim("text") != "")
    strings = strings.groupBy("row").agg(F.collect_list(F.lower(F.trim("text"))).alias("values"))
    about = met.join(strings, "row", "left")
    n_found = F.size(F.filter(matching.found_of(F.when(F.col("values").isNotNull(), F.lower("text")), F.col("values")), lambda hit: hit))
    sizes = about.select("row", F.length("text").cast("bigint").alias("document_chars"), (F.octet_length("text") / F.lit(1048576.0)).alias("document_mb"), "complexity_score", "nesting_depth", "total_objects", "total_properties", F.size("values").alias("n_strings"), n_found.alias("n_found"))
    fields = jsonmodel.fields(results.select("row", "extracted_data"), "extracted_data", "row").where("depth = 0")
    required = _small(schemas, schema.properties(schemas).where("parent_path = '' and required").select("schema_id", "key"))
    truthy = fields.where(jsonmodel.is_truthy(F.col("json_type"), F.col("value_json"))).select("row", "key", F.lit(1).alias("ok")).distinct()
    complete = results.select("row", "schema_id").join(required, "schema_id").join(truthy, ["row", "key"], "left").groupBy("row").agg(F.count(F.lit(1)).alias("n_required"), F.count("ok").alias("n_present"))
    out = results.join(sizes, "row").join(complete, "row", "left")
    failed = ~F.col("success") | (F.col("extracted_data") == "{}")
    some = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    return (
        out.withColumn("completeness", F.when(failed, 0.0).otherwise(scoring.completeness(some("n_required"), some("n_present"))))
        .withColumn("accuracy", F.when(failed, 0.0).otherwise(scoring.accuracy(some("n_strings"), some("n_found"))))
        .withColumn("flags", scoring.flags(F.size("validation_errors"), F.col("low_confidence_fields"), F.col("confidence_score"), threshold))
        .withColumn("input_tokens", scoring.tokens_in(F.col("token_usage")))
        .withColumn("output_tokens", scoring.tokens_out(F.col("token_usage")))
        .withColumn("estimated_cost", scoring.rounded_cost(F.col("token_usage")))
        .withColumn("total_llm_calls", F.col("chunks_processed"))
        .withColumn("efficiency", scoring.efficiency(F.col("processing_time")))
        .withColumn("cost_rating", scoring.cost_rating(F.col("estimated_cost")))
        .withColumn("quality_rating", scoring.quality_rating(F.col("confidence_score")))
        .drop("row", "n_strings", "n_found", "n_required", "n_present")
    )


def health(provider=None) -> dict[str, str]:
    """Whether a provider other than the offline stand-in is set."""
    return {"status": "no_provider" if provider is None or isinstance(provider, Missing) else "healthy"}


#: Strategies and what they are for; the default; suffixes of supported files by kind.
STRATEGIES = {"simple": "Direct extraction for simple documents", "chunked": "Process large documents in chunks", "hierarchical": "Multi-level processing for complex schemas", "auto": "Automatically choose the best strategy"}
DEFAULT = "auto"
FILE_TYPES = {"text": [".txt", ".md", ".json"], "pdf": [".pdf"], "data": [".csv"], "bibliography": [".bib"]}


def strategies(spark: SparkSession) -> DataFrame:
    """The catalogue of strategies."""
    return spark.createDataFrame(list(STRATEGIES.items()), "strategy string, description string").withColumn("is_default", F.col("strategy") == DEFAULT)


def file_types(spark: SparkSession, pdf: bool) -> DataFrame:
    """kind and suffix of supported files; pdf: whether a library for it is there."""
    return spark.createDataFrame([(k, x) for k, suffixes in FILE_TYPES.items() for x in suffixes if k != "pdf" or pdf], "kind string, suffix string")
