"""The reference operators as queries on the driver's tables, and the same in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import jsonmodel, matching, text
from loomspark.functions.jsonmodel import is_truthy
from loomspark.operators import folding, reports, schema, scoring
from loomspark.plans import engine
from loomspark.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("SELECT doc_id, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes, strlen(text) / 1048576.0::DOUBLE AS mb FROM documents")
def doc_size(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("bytes"), (F.octet_length("text") / F.lit(1048576.0)).alias("mb"))


@_query("SELECT doc_id, CASE WHEN strlen(text) > 4000 AND doc_id % 2 = 0 THEN 'hierarchical' WHEN strlen(text) > 4000 OR doc_id % 2 = 0 THEN 'chunked' ELSE 'simple' END AS strategy FROM documents")
def strategy_select(spark, d):
    return _t(spark, d, "documents").select("doc_id", schema.select_strategy(F.octet_length("text"), F.col("doc_id") % 2 == 0, large=4000).alias("strategy"))


@_query("SELECT doc_id, CASE WHEN length(text) > 8000 AND doc_id % 100 > 50 THEN 'hierarchical' WHEN length(text) > 3000 OR doc_id % 100 > 50 THEN 'chunked' ELSE 'simple' END AS strategy FROM documents")
def strategy_recommend(spark, d):
    return _t(spark, d, "documents").select("doc_id", schema.recommend_strategy(F.length("text"), F.col("doc_id") % 100, 3000, 8000).alias("strategy"))


@_query("""SELECT doc_id, CASE WHEN a IN ('simple', 'chunked', 'hierarchical') THEN a WHEN a IS NOT NULL AND a NOT IN ('auto', '') THEN NULL
WHEN strlen(text) > 4000 THEN 'hierarchical' ELSE 'chunked' END AS strategy FROM (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'simple' WHEN 2 THEN 'chunked' WHEN 3 THEN 'bogus' WHEN 4 THEN '' END AS a FROM documents)""")
def strategy_override(spark, d):
    k = F.col("doc_id") % 6
    asked = F.when(k == 0, "auto").when(k == 1, "simple").when(k == 2, "chunked").when(k == 3, "bogus").when(k == 4, "")
    return _t(spark, d, "documents").select("doc_id", schema.select_strategy(F.octet_length("text"), F.lit(True), asked, 4000).alias("strategy"))


@_query("""SELECT page_id, name, CASE WHEN ends_with(lower(name), '.pdf') THEN 'pdf' WHEN ends_with(lower(name), '.csv') THEN 'csv' ELSE 'text' END AS format, regexp_replace(name, '(.)\\.[^.]*$', '\\1') AS stem
FROM (SELECT page_id, 'page' || page_id || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.csv' WHEN 2 THEN '.md' ELSE '' END AS name FROM pages)""")
def format_dispatch(spark, d):
    end = F.when(F.col("page_id") % 4 == 0, ".PDF").when(F.col("page_id") % 4 == 1, ".csv").when(F.col("page_id") % 4 == 2, ".md").otherwise("")
    named = _t(spark, d, "pages").select("page_id", F.concat(F.lit("page"), F.col("page_id").cast("string"), end).alias("name"))
    return named.select("page_id", "name", text.file_format(F.col("name")).alias("format"), text.stem(F.col("name")).alias("stem"))


def _chunk_sql(size: int, stride: int) -> str:
    return f"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT *, unnest(range(0, greatest(1, ceil(len(w) / {stride}.0)::BIGINT))) AS i FROM w)
SELECT doc_id, i AS chunk_idx, md5(CASE WHEN len(w) = 0 THEN text ELSE array_to_string(w[i * {stride} + 1 : i * {stride} + {size}], ' ') END) AS chunk FROM c"""


@_query(_chunk_sql(4000, 3800))
def word_chunks(spark, d):
    return text.word_chunks(_t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_idx", F.md5("chunk_text").alias("chunk"))


@_query(_chunk_sql(400, 380))
def word_chunks_small(spark, d):
    return text.word_chunks(_t(spark, d, "documents").select("doc_id", "text"), 400, 20).select("doc_id", "chunk_idx", F.md5("chunk_text").alias("chunk"))


@_query("""SELECT doc_id, n::BIGINT AS n_words, greatest(1, ceil(n / 380.0))::BIGINT AS n_chunks FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)""")
def chunk_counts(spark, d):
    n = F.size(text.words(F.col("text")))
    return _t(spark, d, "documents").select("doc_id", n.cast("bigint").alias("n_words"), text.n_chunks(n, 380).alias("n_chunks"))


@_query("""SELECT doc_id, md5(CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || '... [truncated]' ELSE text END) AS for_text, md5(CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || '... [schema truncated]' ELSE text END) AS for_schema FROM documents""")
def prompt_truncate(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(text.prompt_text(F.col("text"))).alias("for_text"), F.md5(text.prompt_schema(F.col("text"))).alias("for_schema"))


def _prompt_sql() -> str:
    filled = text.PROMPT.replace("'", "''")
    for name, value in (("context", "Context: chunk ' || (doc_id % 3 + 1) || '/3"), ("focus", ""), ("text", "' || CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || '... [truncated]' ELSE text END || '"), ("schema", '{"type":"object"}')):
        filled = filled.replace("{" + name + "}", value)
    return f"SELECT doc_id, md5('{filled}') AS prompt FROM documents"


@_query(_prompt_sql())
def prompt_build(spark, d):
    context = F.concat(F.lit("chunk "), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("/3"))
    return _t(spark, d, "documents").select("doc_id", F.md5(text.prompt(F.col("text"), F.lit('{"type":"object"}'), context=context)).alias("prompt"))


@_query("""SELECT doc_id, md5(CASE WHEN strlen(text) > 3000 AND doc_id % 2 = 0 THEN substr(text, 1, length(text) // 2) || chr(10) || '...[content truncated]...' || chr(10) || right(text, floor(length(text) * 0.1::DOUBLE)::BIGINT) ELSE text END) AS sample FROM documents""")
def strategic_sample(spark, d):
    strategy = F.when(F.col("doc_id") % 2 == 0, "simple").otherwise("chunked")
    return _t(spark, d, "documents").select("doc_id", F.md5(text.strategic_sample(F.col("text"), strategy, 3000)).alias("sample"))


@_query("""WITH h AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS i, * FROM nation),
l AS (SELECT string_agg('Row ' || i || ': n_nationkey: ' || n_nationkey || ' | n_name: ' || coalesce(n_name, 'nan') || ' | n_regionkey: ' || n_regionkey, chr(10) ORDER BY i) AS l FROM h WHERE i <= 10), c AS (SELECT count(*) AS n FROM nation)
SELECT 'CSV file with ' || n || ' rows and 3 columns' || chr(10) || 'Columns: n_nationkey, n_name, n_regionkey' || chr(10) || chr(10) || 'Data sample:' || chr(10) || l || CASE WHEN n > 10 THEN chr(10) || '... and ' || (n - 10) || ' more rows' ELSE '' END AS text FROM l, c""")
def csv_render(spark, d):
    return reports.csv_text(_t(spark, d, "nation"), "n_nationkey", ["n_nationkey", "n_name", "n_regionkey"])


@_query("""WITH n AS (SELECT p_partkey AS schema_id, (p_partkey % 14)::BIGINT AS n FROM part),
p AS (SELECT schema_id, n, i, 'f' || i AS name, '"f' || i || '":{"type":"string"}' AS prop, CASE WHEN i % 2 = 0 THEN '"f' || i || '"' END AS req FROM (SELECT *, unnest(range(0, n)) AS i FROM n)),
g AS (SELECT schema_id, CASE WHEN n <= 5 THEN 0 ELSE i // 5 END AS ord, n, count(*) AS k, string_agg(prop, ',' ORDER BY i) AS props, coalesce(string_agg(req, ',' ORDER BY i), '') AS req FROM p GROUP BY ALL)
SELECT schema_id, ord::BIGINT AS ord, CASE WHEN n <= 5 THEN 'main' ELSE 'section_' || (ord + 1) END AS section, '{"type":"object","properties":{' || props || '},"required":[' || req || ']}' AS json FROM g
UNION ALL SELECT schema_id, 0, 'main', '{"type":"object","properties":{},"required":[]}' FROM n WHERE n = 0""")
def section_groups(spark, d):
    """Sections of schemas of up to 13 properties, one for each part, half of them required."""
    n = F.col("p_partkey") % 14
    places = F.filter(F.sequence(F.lit(0), F.lit(13)), lambda i: i < n)
    name = lambda i: F.concat(F.lit('"f'), i.cast("string"), F.lit('"'))
    props = F.array_join(F.transform(places, lambda i: F.concat(name(i), F.lit(':{"type":"string"}'))), ",")
    required = F.array_join(F.transform(F.filter(places, lambda i: i % 2 == 0), name), ",")
    schemas = spread(_t(spark, d, "part").select("p_partkey"), "p_partkey").select(F.col("p_partkey").alias("schema_id"), F.concat(F.lit('{"type": "object", "properties": {'), props, F.lit('}, "required": ['), required, F.lit("]}")).alias("schema_json"))
    # the outer form: from the other one a filter on the list's size is inferred, which makes all sections twice, the first time before they are dealt
    parts = schema.analyze(schemas).select("schema_id", F.posexplode_outer("sections").alias("ord", "s")).where("ord is not null")
    return parts.select("schema_id", F.col("ord").cast("bigint").alias("ord"), F.col("s.name").alias("section"), F.col("s.json").alias("json"))


#: A nested schema for each part, in the words that Spark's and DuckDB's SQL share: up to six levels, lists, lists within lists, unions.
_SCHEMA_OF_PART = """repeat('{"type":"object","properties":{"inner":', p_size % 6) || '{"title":"' || p_name || '","type":"object","properties":{"name":{"type":"string"},"size":{"type":' || CASE WHEN p_size % 2 = 0 THEN '"integer"' ELSE '["integer","null"]' END || '}'
|| CASE WHEN p_partkey % 3 = 0 THEN ',"type":{"type":"array","items":[{"type":"object","properties":{"a":{},"b":{"if":{}}}},[{"type":"object"}]]}' ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN ',"kind":{"anyOf":[{"type":"object"},{"$ref":"#"}]}' ELSE '' END
|| CASE WHEN p_partkey % 5 = 0 THEN ',"list":{"items":[{"properties":{"c":{"oneOf":[]}}}]}' ELSE '' END || '},"required":["name"]}' || repeat('},"required":["inner","missing"]}', p_size % 6)"""


@_query(f"""WITH RECURSIVE s AS (SELECT p_partkey AS schema_id, {_SCHEMA_OF_PART} AS doc FROM part), t AS (SELECT schema_id, j.id, j.parent, j.type, j.value FROM s, json_tree(s.doc) j),
n AS (SELECT schema_id, id, type, value, 0 AS depth, false AS under_list FROM t WHERE parent IS NULL
      UNION ALL SELECT t.schema_id, t.id, t.type, t.value, n.depth + CASE WHEN t.type = 'OBJECT' THEN 1 ELSE 0 END, n.under_list OR t.type = 'ARRAY' FROM n JOIN t ON t.schema_id = n.schema_id AND t.parent = n.id WHERE NOT (n.type = 'ARRAY' AND t.type = 'ARRAY')),
f AS (SELECT schema_id, max(depth)::BIGINT AS nesting_depth, count(*) FILTER (json_type(value, '$.type') = 'VARCHAR' AND json_extract_string(value, '$.type') = 'object')::BIGINT AS total_objects,
      coalesce(sum(len(json_keys(value, '$.properties'))) FILTER (json_type(value, '$.properties') = 'OBJECT'), 0)::BIGINT AS total_properties,
      bool_or(NOT under_list AND list_has_any(json_keys(value), ['anyOf', 'oneOf', 'allOf', 'if', 'then', 'else', '$ref'])) AS has_complex_types FROM n WHERE type = 'OBJECT' GROUP BY schema_id),
r AS (SELECT f.*, (length(doc) // 4)::BIGINT AS estimated_tokens FROM f JOIN s USING (schema_id)),
x AS (SELECT *, nesting_depth * 10.0::DOUBLE + total_objects * 2.0::DOUBLE + total_properties * 0.5::DOUBLE + CASE WHEN has_complex_types THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END + estimated_tokens * 0.01::DOUBLE AS complexity_score FROM r)
SELECT *, nesting_depth > 3 OR total_objects > 20 OR complexity_score > 50 AS is_complex FROM x""")
def schema_complexity(spark, d):
    schemas = spread(_t(spark, d, "part").select("p_partkey", "p_size", "p_name"), "p_partkey").select(F.col("p_partkey").alias("schema_id"), F.expr(_SCHEMA_OF_PART).alias("schema_json"))
    return schema.analyze(schemas).select("schema_id", "nesting_depth", "total_objects", "total_properties", "has_complex_types", "estimated_tokens", "complexity_score", "is_complex")


#: A nested answer for each document, in the words that both SQLs share, and the schema it is held against.
_ANSWER = """'{"lang":"' || lang || '","about":{"source":"' || source || '","size":' || CAST(n_chars AS VARCHAR(20)) || ',"none":"","deep":{"x":0}},"tags":["' || lang || '"]' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ',"extra":null' END || '}'"""
_ANSWER_SCHEMA = """{"type":"object","properties":{"lang":{"type":"string"},"about":{"type":"object","properties":{"source":{"type":"integer"},"none":{"type":"string"},"deep":{"type":"object","properties":{"x":{}}}},"required":["source","none","gone"]},"tags":{"type":"object"},"extra":{"type":"string"}},"required":["lang","extra","about"]}"""


def _answers(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, fields of their answers, and the schema's properties for each."""
    docs = _t(spark, d, "documents").where("lang is not null and source is not null and n_chars is not null").withColumn("data", F.expr(_ANSWER))
    schemas = spark.createDataFrame([("s", _ANSWER_SCHEMA)], "schema_id string, schema_json string")
    properties = docs.select("doc_id", F.lit("s").alias("schema_id")).join(F.broadcast(schema.properties(schemas)), "schema_id")
    return docs, jsonmodel.fields(docs, "data", "doc_id"), properties


_KNOWN = "(SELECT * FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL)"


@_query(f"""SELECT doc_id, path, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7::DOUBLE + CASE WHEN required THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN found THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN truthy THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END)) AS confidence
FROM (SELECT doc_id, 'lang' AS path, true AS required, contains(lower(text), lower(lang)) AS found, lang <> '' AS truthy FROM {_KNOWN}
UNION ALL SELECT doc_id, 'about', true, false, true FROM {_KNOWN} UNION ALL SELECT doc_id, 'about.source', true, contains(lower(text), lower(source)), source <> '' FROM {_KNOWN} UNION ALL SELECT doc_id, 'about.size', false, false, n_chars <> 0 FROM {_KNOWN}
UNION ALL SELECT doc_id, 'about.none', true, true, false FROM {_KNOWN} UNION ALL SELECT doc_id, 'about.deep', false, false, true FROM {_KNOWN} UNION ALL SELECT doc_id, 'about.deep.x', false, false, false FROM {_KNOWN}
UNION ALL SELECT doc_id, 'tags', false, false, true FROM {_KNOWN} UNION ALL SELECT doc_id, 'extra', true, false, false FROM {_KNOWN} WHERE doc_id % 3 <> 0) WHERE required IS NOT NULL""")
def nested_confidence(spark, d):
    """Confidences of fields within declared objects, by their paths; items of lists have none."""
    docs, fields, properties = _answers(spark, d)
    scored = scoring.score_fields(fields, properties, docs.select("doc_id", F.lower("text").alias("text_lower")), "doc_id")
    return scored.select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.path", "s.confidence")


@_query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Missing required field: extra|Type mismatch for tags: expected object' ELSE 'Type mismatch for tags: expected object|Type mismatch for extra: expected string' END AS errors FROM {_KNOWN}""")
def nested_errors(spark, d):
    """Missing fields in the schema's order, then wrong types in the data's; only the top level is checked."""
    _, fields, properties = _answers(spark, d)
    return scoring.validate(fields, properties, "doc_id").select("doc_id", F.array_join("validation_errors", "|").alias("errors"))


@_query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_field(spark, d):
    fields = jsonmodel.fields(_t(spark, d, "events").select("event_id", "props"), "props", "event_id")
    return fields.where("path = 'k'").select("event_id", F.col("value_json").cast("bigint").alias("k"))


@_query(r"SELECT page_id, md5(regexp_extract(trim(html), '(?s)\{.*\}', 0)) AS braces FROM pages")
def brace_extract(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(jsonmodel.braced_of("html")).alias("braces"))


@_query(r"""WITH c AS (SELECT event_id, props || ' "k": 5, "name": "' || event_type || '", "flag": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END || ', "name": 7' AS c FROM events),
p AS (SELECT event_id, 0 AS pat, unnest(range(0, len(k))) AS pos, unnest(k) AS key, unnest(v) AS raw FROM (SELECT event_id, regexp_extract_all(c, '"(\w+)"\s*:\s*"([^"]*)"', 1) AS k, regexp_extract_all(c, '"(\w+)"\s*:\s*"([^"]*)"', 2) AS v FROM c)
UNION ALL SELECT event_id, 1, unnest(range(0, len(k))), unnest(k), unnest(v) FROM (SELECT event_id, regexp_extract_all(c, '"(\w+)"\s*:\s*(\d+)', 1) AS k, regexp_extract_all(c, '"(\w+)"\s*:\s*(\d+)', 2) AS v FROM c)
UNION ALL SELECT event_id, 2, unnest(range(0, len(k))), unnest(k), unnest(v) FROM (SELECT event_id, regexp_extract_all(c, '"(\w+)"\s*:\s*(true|false|null)', 1) AS k, regexp_extract_all(c, '"(\w+)"\s*:\s*(true|false|null)', 2) AS v FROM c)),
l AS (SELECT *, row_number() OVER (PARTITION BY event_id, key ORDER BY pat DESC, pos DESC) AS r FROM p)
SELECT event_id, key, CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN 'integer' WHEN raw IN ('true', 'false') THEN 'boolean' WHEN raw = 'null' THEN 'null' ELSE 'string' END AS type, nullif(raw, 'null') AS value FROM l WHERE r = 1""")
def kv_salvage(spark, d):
    content = F.concat("props", F.lit(' "k": 5, "name": "'), "event_type", F.lit('", "flag": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("null"), F.lit(', "name": 7'))
    return _t(spark, d, "events").select("event_id", F.inline(jsonmodel.salvaged_of(content)))


@_query("SELECT conv_id, md5('[' || string_agg(turn || ',' || (turn * 2), ',' ORDER BY turn) || ']') AS value, count(*)::BIGINT AS units FROM conversations GROUP BY conv_id")
def chunk_merge_lists(spark, d):
    turns = _t(spark, d, "conversations")
    value = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit(","), (F.col("turn") * 2).cast("string"), F.lit("]"))
    rows = turns.select("conv_id", F.col("turn").alias("unit_idx"), F.lit(0).alias("ord"), F.lit("items").alias("key"), F.lit("array").alias("json_type"), value.alias("value_json"))
    return folding.fold_chunks(rows, "conv_id").join(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("units")), "conv_id").select("conv_id", F.md5("value_json").alias("value"), "units")


@_query("""SELECT user_id, coalesce(min_by(event_type, event_id) FILTER (event_type NOT IN ('view', 'click')), min_by(CASE WHEN event_type IN ('view', 'click') THEN '' ELSE event_type END, event_id)) AS value FROM events GROUP BY user_id""")
def chunk_merge_scalars(spark, d):
    value = F.when(F.col("event_type").isin("view", "click"), '""').otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    rows = _t(spark, d, "events").select("user_id", F.col("event_id").alias("unit_idx"), F.lit(0).alias("ord"), F.lit("kind").alias("key"), F.lit("string").alias("json_type"), value.alias("value_json"))
    return folding.fold_chunks(rows, "user_id").select("user_id", F.regexp_replace("value_json", '"', "").alias("value"))


@_query("SELECT user_id, event_type AS key, max_by(value, event_id) AS value, max(event_id) AS unit FROM events GROUP BY user_id, event_type")
def section_merge(spark, d):
    events = _t(spark, d, "events")
    rows = events.select("user_id", F.col("event_id").alias("unit_idx"), F.lit(0).alias("ord"), F.col("event_type").alias("key"), F.lit("number").alias("json_type"), F.col("value").cast("string").alias("value_json"))
    last = events.groupBy("user_id", F.col("event_type").alias("key")).agg(F.max("event_id").alias("unit"))
    return folding.fold_sections(rows, "user_id").join(last, ["user_id", "key"]).select("user_id", "key", F.col("value_json").cast("double").alias("value"), "unit")


_COST = "SELECT doc_id, t, floor(t * 0.7::DOUBLE)::BIGINT AS i, floor(t * 0.3::DOUBLE)::BIGINT AS o FROM (SELECT doc_id, (length(text) // 4)::BIGINT AS t FROM documents)"


@_query(f"SELECT doc_id, t AS tokens, i AS input_tokens, o AS output_tokens, 30 * i + 60 * o AS micro_cost FROM ({_COST})")
def token_cost(spark, d):
    t = F.floor(F.length("text") / 4)
    return _t(spark, d, "documents").select("doc_id", t.alias("tokens"), scoring.tokens_in(t).alias("input_tokens"), scoring.tokens_out(t).alias("output_tokens"), scoring.micro_cost(t).alias("micro_cost"))


def _labels(spark, d) -> tuple[DataFrame, DataFrame]:
    """Fields that labels have of each document, and the two names that each document ought to have."""
    labels = _t(spark, d, "labels")
    present = labels.select("doc_id", F.explode(F.map_from_arrays(F.array(F.lit("quality"), F.lit("toxic")), F.array("quality", "toxic"))).alias("key", "v")).where("v is not null and not (key = 'toxic' and doc_id % 3 = 0)")
    required = labels.select("doc_id", F.posexplode(F.array(F.lit("quality"), F.lit("toxic"), F.lit("lang"))).alias("ord", "key"))
    return present, required


_PRESENT = "(SELECT doc_id, 'quality' AS key, quality AS v FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', toxic FROM labels WHERE toxic IS NOT NULL AND doc_id % 3 <> 0)"
_REQUIRED = "(SELECT doc_id, unnest(['quality', 'toxic', 'lang']) AS key FROM labels)"


@_query(f"SELECT r.doc_id, r.key, 'Missing required field: ' || r.key AS message FROM {_REQUIRED} r WHERE NOT EXISTS (SELECT 1 FROM {_PRESENT} p WHERE p.doc_id = r.doc_id AND p.key = r.key)")
def required_missing(spark, d):
    present, required = _labels(spark, d)
    return scoring.missing_required(present, required, "doc_id").select("doc_id", "key", "message")


_TYPED = "(SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'string' ELSE 'boolean' END AS json_type, CASE event_id % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' ELSE 'odd' END AS type FROM events)"


@_query(f"SELECT event_id, 'Type mismatch for k: expected ' || type AS message FROM {_TYPED} WHERE (type = 'integer' AND json_type NOT IN ('integer', 'boolean')) OR (type = 'number' AND json_type NOT IN ('integer', 'number', 'boolean'))")
def type_mismatch(spark, d):
    e, k = _t(spark, d, "events").select("event_id"), F.col("event_id")
    top = e.select("event_id", F.lit("k").alias("key"), F.when(k % 4 == 0, "integer").when(k % 4 == 1, "number").when(k % 4 == 2, "string").otherwise("boolean").alias("json_type"))
    expected = e.select("event_id", F.lit("k").alias("key"), F.when(k % 3 == 0, "integer").when(k % 3 == 1, "number").otherwise("odd").alias("type"), F.lit(None).cast("array<string>").alias("types"))
    return scoring.type_mismatches(top, expected, "event_id").select("event_id", "message")


_FIELD = """(SELECT doc_id, key, v, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7::DOUBLE + CASE WHEN key = 'lang' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(lower(text), lower(v)) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN v = '' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)) AS confidence
FROM (SELECT doc_id, text, unnest(['lang', 'source', 'head']) AS key, unnest([CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END, source, left(text, 5)]) AS v FROM documents))"""


def _fields(spark, d) -> DataFrame:
    docs = _t(spark, d, "documents")
    keys = F.array(F.lit("lang"), F.lit("source"), F.lit("head"))
    values = docs.select("doc_id", "text", F.array(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("lang")), F.col("source"), F.left("text", F.lit(5))).alias("v"))
    found = matching.found_of(F.lower("text"), F.transform("v", F.lower))
    rows = values.select("doc_id", F.inline(F.arrays_zip(keys.alias("key"), F.col("v"), found.alias("found"))))
    truthy = is_truthy(F.lit("string"), F.concat(F.lit('"'), "v", F.lit('"')))
    return rows.select("doc_id", "key", "v", scoring.field_confidence(F.col("key") == "lang", F.coalesce("found", F.lit(False)), truthy).alias("confidence"))


@_query(f"SELECT doc_id, key, confidence, confidence < 0.6::DOUBLE AS low FROM {_FIELD}")
def field_confidence(spark, d):
    return _fields(spark, d).select("doc_id", "key", "confidence", (F.col("confidence") < scoring.LOW).alias("low"))


@_query("SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN event_id % 13 > 0 THEN 0.8::DOUBLE * (1.0::DOUBLE - (event_id % 13) * 0.1::DOUBLE) ELSE 0.8::DOUBLE END)) AS confidence FROM events")
def overall_confidence(spark, d):
    return _t(spark, d, "events").select("event_id", scoring.overall_confidence(F.lit(0.8), F.col("event_id") % 13).alias("confidence"))


@_query(f"SELECT r.doc_id, count(p.key) FILTER (p.v <> 0) / count(*)::DOUBLE AS completeness FROM {_REQUIRED} r LEFT JOIN {_PRESENT} p ON p.doc_id = r.doc_id AND p.key = r.key GROUP BY r.doc_id")
def completeness(spark, d):
    present, required = _labels(spark, d)
    ok = present.where(is_truthy(F.lit("integer"), F.col("v"))).select("doc_id", "key", F.lit(1).alias("ok"))
    n = required.join(ok, ["doc_id", "key"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("ok").alias("k"))
    return n.select("doc_id", scoring.completeness(F.col("n"), F.col("k")).alias("completeness"))


@_query("""SELECT doc_id, CASE WHEN n > 0 THEN k / n::DOUBLE ELSE 1.0::DOUBLE END AS accuracy FROM (SELECT doc_id, count(*) FILTER (trim(v) <> '') AS n, count(*) FILTER (trim(v) <> '' AND contains(lower(text), lower(trim(v)))) AS k
FROM (SELECT doc_id, text, unnest([lang, source, left(text, 5), ' ']) AS v FROM documents) GROUP BY doc_id)""")
def accuracy(spark, d):
    strings = F.filter(F.transform(F.array("lang", "source", F.left("text", F.lit(5)), F.lit(" ")), lambda v: F.lower(F.trim(v))), lambda v: v != "")
    n = _t(spark, d, "documents").select("doc_id", F.size(strings).alias("n"), F.size(F.filter(matching.found_of(F.lower("text"), strings), lambda hit: hit)).alias("k"))
    return n.select("doc_id", scoring.accuracy(F.col("n"), F.col("k")).alias("accuracy"))


@_query(f"""WITH f AS (SELECT doc_id, list(key ORDER BY key) FILTER (confidence < 0.6::DOUBLE) AS low FROM {_FIELD} GROUP BY doc_id),
g AS (SELECT doc_id, doc_id % 4 AS n, coalesce(low, []) AS low FROM f)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(list_transform(range(0, n), lambda i: 'validation_error_' || i), low), CASE WHEN n >= 3 THEN ['overall_confidence_low'] ELSE [] END))), ',') AS flags,
'Human review recommended for flagged fields' AS recommendation FROM g WHERE n > 0 OR len(low) > 0""")
def review_flags(spark, d):
    low = _fields(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("confidence") < scoring.LOW, F.col("key")))).alias("low"))
    n = F.col("doc_id") % 4
    results = low.select("doc_id", scoring.flags(n, F.col("low"), scoring.overall_confidence(F.lit(0.8), n)).alias("flags"), F.lit(None).cast("array<string>").alias("validation_errors"), scoring.overall_confidence(F.lit(0.8), n).alias("confidence_score"))
    return reports.review(results).select("doc_id", F.array_join("low_confidence_fields", ",").alias("flags"), "recommendation")


@_query(f"""SELECT doc_id, CASE WHEN c < 0.1::DOUBLE THEN 'Excellent' WHEN c < 0.5::DOUBLE THEN 'Good' ELSE 'High' END AS cost_rating, CASE WHEN q > 0.85::DOUBLE THEN 'Excellent' WHEN q > 0.7::DOUBLE THEN 'Good' ELSE 'Needs Review' END AS quality_rating,
greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - (doc_id % 12) * 10.0::DOUBLE)) AS efficiency FROM (SELECT doc_id, i * 0.03::DOUBLE / 1000.0::DOUBLE + o * 0.06::DOUBLE / 1000.0::DOUBLE AS c, (doc_id % 10) / 10.0::DOUBLE AS q FROM ({_COST}))""")
def ratings(spark, d):
    k = F.col("doc_id")
    return _t(spark, d, "documents").select("doc_id", scoring.cost_rating(scoring.cost(F.floor(F.length("text") / 4))).alias("cost_rating"), scoring.quality_rating((k % 10) / F.lit(10.0)).alias("quality_rating"), scoring.efficiency(k % 12).alias("efficiency"))


_RESULT = """(SELECT doc_id, text AS extracted_data, doc_id % 5 <> 0 AS success, (doc_id % 9) / 10.0::DOUBLE AS confidence_score, list_transform(range(0, doc_id % 6), lambda i: 'error ' || i) AS e, list_transform(range(0, doc_id % 8), lambda i: 'field_' || i) AS l FROM documents)"""


def _results(spark, d) -> DataFrame:
    """Results made up of documents, with up to five errors and seven low fields each."""
    some = lambda n, name: F.transform(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < F.col("doc_id") % n), lambda i: F.concat(F.lit(name), i.cast("string")))
    return _t(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("text").alias("extracted_data"), (F.col("doc_id") % 5 != 0).alias("success"), ((F.col("doc_id") % 9) / F.lit(10.0)).alias("confidence_score"), some(6, "error ").alias("validation_errors"), some(8, "field_").alias("low_confidence_fields"),
        F.create_map(F.lit("a"), F.lit(0.7)).alias("field_confidences"), F.lit(0.0).alias("processing_time"), F.lit("simple").alias("strategy_used"),
    )


@_query(f"""SELECT doc_id, success, confidence_score, array_to_string(e[1:3], ',') AS first_errors, len(e)::BIGINT AS n_errors, array_to_string(l[1:5], ',') AS first_low, greatest(len(l) - 5, 0)::BIGINT AS n_more_low,
md5(CASE WHEN length(extracted_data) > 500 THEN left(extracted_data, 500) || '...' || chr(10) || '}}' ELSE extracted_data END) AS preview FROM {_RESULT}""")
def result_summary(spark, d):
    s = reports.summary(_results(spark, d), errors=3, low=5)
    return s.select("doc_id", "success", "confidence_score", F.array_join("first_errors", ",").alias("first_errors"), F.col("n_errors").cast("bigint").alias("n_errors"), F.array_join("first_low", ",").alias("first_low"), F.col("n_more_low").cast("bigint").alias("n_more_low"), F.md5("preview").alias("preview"))


@_query(f"SELECT doc_id, 'doc' || doc_id || '.txt' AS filename, md5(extracted_data) AS data, confidence_score AS confidence, 0.7::DOUBLE AS a, array_to_string(l, ',') AS low, 'simple' AS strategy_used FROM {_RESULT}")
def api_response(spark, d):
    r = reports.api_response(_results(spark, d), "filename")
    return r.select("doc_id", "filename", F.md5("data").alias("data"), "confidence", F.col("field_confidences")["a"].alias("a"), F.array_join("low_confidence_fields", ",").alias("low"), "strategy_used")


@_query(f"SELECT doc_id, md5(extracted_data) AS extracted_data, confidence_score AS confidence, 0.7::DOUBLE AS a, array_to_string(l, ',') AS low, 'simple' AS strategy_used, 'doc' || doc_id || '.txt' AS content_filename, 'schema_' || (doc_id % 3) || '.json' AS schema_filename FROM {_RESULT}")
def file_response(spark, d):
    """The response to an extraction of two files, which names both."""
    r = reports.file_response(_results(spark, d).withColumns({"content_filename": F.col("filename"), "schema_filename": F.concat(F.lit("schema_"), (F.col("doc_id") % 3).cast("string"), F.lit(".json"))}))
    return r.select("doc_id", F.md5("extracted_data").alias("extracted_data"), "confidence", F.col("field_confidences")["a"].alias("a"), F.array_join("low_confidence_fields", ",").alias("low"), "strategy_used", "content_filename", "schema_filename")


@_query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS confidence,
CASE event_id % 4 WHEN 2 THEN '{"n":' || event_id || ',"ok":true}' WHEN 3 THEN '{}' ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS data FROM events""")
def parse_confidence(spark, d):
    k, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    broken = F.concat(F.lit('{"n": '), n, F.lit(',, "ok": true'))
    content = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Here:\n```\n"), "props", F.lit("\n```"))).when(k == 2, broken).otherwise("nothing was found")
    return _t(spark, d, "events").select("event_id", jsonmodel.parse_completion(content).alias("p")).select("event_id", "p.confidence", "p.data")


@_query("SELECT event_id, 0 AS seq, 'k' AS path, 'integer' AS json_type, json_extract_string(props, '$.k') AS value_json FROM events UNION ALL SELECT event_id, 1, 'a', 'array', '[{\"b\":' || event_id || '}]' FROM events UNION ALL SELECT event_id, 2, 'a.0', 'object', '{\"b\":' || event_id || '}' FROM events UNION ALL SELECT event_id, 3, 'a.0.b', 'integer', event_id::VARCHAR FROM events")
def json_fields(spark, d):
    data = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "a": [{"b": '), F.col("event_id").cast("string"), F.lit("}]}"))
    return jsonmodel.fields(_t(spark, d, "events").select("event_id", data.alias("data")), "data", "event_id").select("event_id", "seq", "path", "json_type", "value_json")


@_query("SELECT doc_id, CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(x.replace("'", "''") for x in text.SYSTEM.values())) + " END AS system_prompt FROM documents")
def system_prompts(spark, d):
    k = F.col("doc_id") % 3
    return _t(spark, d, "documents").select("doc_id", F.when(k == 0, text.SYSTEM["simple"]).when(k == 1, text.SYSTEM["chunked"]).otherwise(text.SYSTEM["hierarchical"]).alias("system_prompt"))


@_query("SELECT conv_id, sum(length(text) // 4)::BIGINT AS token_usage, count(*)::INTEGER AS chunks_processed, 0.8::DOUBLE AS confidence FROM conversations GROUP BY conv_id")
def unit_totals(spark, d):
    units = _t(spark, d, "conversations").select("conv_id", F.floor(F.length("text") / 4).alias("total_tokens"))
    return engine.totals(units, "conv_id").withColumn("confidence", F.lit(engine.BASE["chunked"]))


@_query("""WITH c(strategy, description, is_default) AS (VALUES ('simple', 'Direct extraction for simple documents', false), ('chunked', 'Process large documents in chunks', false), ('hierarchical', 'Multi-level processing for complex schemas', false), ('auto', 'Automatically choose the best strategy', true)),
s AS (SELECT CASE WHEN strlen(text) > 4000 AND doc_id % 2 = 0 THEN 'hierarchical' WHEN strlen(text) > 4000 OR doc_id % 2 = 0 THEN 'chunked' ELSE 'simple' END AS strategy FROM documents)
SELECT c.strategy, description, is_default, count(s.strategy) AS n_documents FROM c LEFT JOIN s ON s.strategy = c.strategy GROUP BY ALL""")
def strategy_catalogue(spark, d):
    """The strategies, and for how many documents each is chosen."""
    chosen = _t(spark, d, "documents").select(schema.select_strategy(F.octet_length("text"), F.col("doc_id") % 2 == 0, large=4000).alias("strategy")).groupBy("strategy").agg(F.count(F.lit(1)).alias("n_documents"))
    return engine.strategies(spark).join(chosen, "strategy", "left").select("strategy", "description", "is_default", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


@_query(r"""WITH t(kind, suffix) AS (VALUES ('text', '.txt'), ('text', '.md'), ('text', '.json'), ('pdf', '.pdf'), ('data', '.csv'), ('bibliography', '.bib')),
p AS (SELECT page_id, lower(regexp_extract('page' || page_id || CASE page_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.csv' WHEN 2 THEN '.md' WHEN 3 THEN '.x.bib' WHEN 4 THEN '.Json' WHEN 5 THEN '.txt' ELSE '.html' END, '(\.[^./]*)$', 1)) AS suffix FROM pages)
SELECT page_id, p.suffix, kind FROM p LEFT JOIN t ON t.suffix = p.suffix""".replace("\\\\", "\\"))
def supported_types(spark, d):
    """The kind of file that each page would be under another name, null for kinds that aren't known."""
    end = F.element_at(F.array(*map(F.lit, (".PDF", ".csv", ".md", ".x.bib", ".Json", ".txt", ".html"))), (F.col("page_id") % 7 + 1).cast("int"))
    suffix = F.lower(F.regexp_extract(F.concat(F.lit("page"), F.col("page_id").cast("string"), end), r"(\.[^./]*)$", 1))
    return _t(spark, d, "pages").select("page_id", suffix.alias("suffix")).join(F.broadcast(engine.file_types(spark, True)), "suffix", "left").select("page_id", "suffix", "kind")


#: The schema of the end-to-end queries.
SCHEMA = '{"type":"object","properties":{"first_words":{"type":"string"},"email":{"type":"string"},"token":{"type":"string"}},"required":["first_words","email"]}'


#: Fixed facts of SCHEMA, which has 1 object on 2 levels.
_FACTS = {"nesting_depth": 2, "total_objects": 1, "total_properties": 3}
_SCORE = _FACTS["nesting_depth"] * 10.0 + _FACTS["total_objects"] * 2.0 + _FACTS["total_properties"] * 0.5 + len(json.dumps(json.loads(SCHEMA), separators=(",", ":"))) // 4 * 0.01


def _offline_sql(auto: bool) -> str:
    """What the offline provider answers, unit by unit, and what becomes of it."""
    dump = json.dumps(json.loads(SCHEMA), indent=1, separators=(",", ":"))
    fixed = len(text.PROMPT) - len("{context}{focus}{text}{schema}") + len(dump)
    value = lambda n: f"CASE WHEN regexp_matches(t, '{_line(n)}') THEN trim(regexp_extract(t, '{_line(n)}', 1), ' ' || chr(9) || chr(13) || chr(12)) END"
    large = "length(text) > 100000" if auto else "true"
    return rf"""
WITH w AS (SELECT doc_id, text, {large} AS large, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT *, CASE WHEN large THEN greatest(1, ceil(len(w) / 3800.0)::BIGINT) ELSE 1 END AS n FROM w),
c AS (SELECT doc_id, i, CASE WHEN large THEN 'Context: chunk ' || (i + 1) || '/' || n ELSE '' END AS context, CASE WHEN NOT large OR len(w) = 0 THEN text ELSE array_to_string(w[i * 3800 + 1 : i * 3800 + 4000], ' ') END AS t FROM (SELECT *, unnest(range(0, n)) AS i FROM n)),
u AS (SELECT *, [{value("email")}, {value("token")}, array_to_string(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')[1:3], ' ')] AS v FROM c),
f AS (SELECT doc_id, i, unnest(['email', 'token', 'first_words']) AS key, unnest(v) AS v, unnest([0, 1, 2]) AS k FROM u),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY k) AS ord FROM f WHERE v IS NOT NULL),
tokens AS (SELECT doc_id, sum((l + content) // 4)::BIGINT AS token_usage, count(*)::INTEGER AS units FROM (SELECT u.doc_id, u.i, {fixed} + length(any_value(u.context)) + length(any_value(u.t)) AS l, sum(length(p.key) + 4 + length(to_json(p.v)::VARCHAR)) + 2 * count(*) AS content FROM u JOIN p ON p.doc_id = u.doc_id AND p.i = u.i GROUP BY u.doc_id, u.i) GROUP BY doc_id),
g AS (SELECT doc_id, key, coalesce(min_by(v, i) FILTER (v <> ''), '') AS v, min(i * 10 + ord) AS place FROM p GROUP BY doc_id, key),
s AS (SELECT g.*, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.7::DOUBLE + CASE WHEN key <> 'token' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN contains(lower(text), lower(v)) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN v = '' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)) AS score,
      contains(lower(text), lower(trim(v))) AS found FROM g JOIN documents USING (doc_id)),
d AS (SELECT doc_id, '{{' || string_agg('"' || key || '":' || to_json(v)::VARCHAR, ',' ORDER BY place) || '}}' AS extracted_data, max(score) FILTER (key = 'first_words') AS first_words_confidence, max(score) FILTER (key = 'email') AS email_confidence,
      array_to_string(coalesce(list(key ORDER BY place) FILTER (score < 0.6::DOUBLE), []), ',') AS low, count(*) FILTER (key = 'email') = 0 AS lacks, count(*) FILTER (key <> 'token' AND v <> '') AS present, count(*) FILTER (trim(v) <> '') AS strings, count(*) FILTER (trim(v) <> '' AND found) AS found FROM s GROUP BY doc_id),
r AS (SELECT doc_id, true AS success, extracted_data, CASE WHEN lacks THEN 0.8::DOUBLE * (1.0::DOUBLE - 1 * 0.1::DOUBLE) ELSE 0.8::DOUBLE END AS confidence_score, first_words_confidence, email_confidence, low, CASE WHEN large THEN 'chunked' ELSE 'simple' END AS strategy_used, token_usage, units AS chunks_processed,
      CASE WHEN lacks THEN 'Missing required field: email' ELSE '' END AS errors, present, strings, d.found AS found, lacks, text FROM d JOIN tokens USING (doc_id) JOIN w USING (doc_id))
"""


def _line(name: str) -> str:
    """The offline provider's pattern."""
    return rf"(?im)^[^\w\n]*{name}[ \t]*[:=][ \t]*([^\n]+)$"


_RESULT_COLUMNS = "doc_id, success, extracted_data, confidence_score, first_words_confidence, email_confidence, low, strategy_used, token_usage, chunks_processed, errors"


def _offline(results: DataFrame, *more) -> DataFrame:
    confidence = lambda n: F.col("field_confidences")[n].alias(f"{n}_confidence")
    return results.select("doc_id", "success", "extracted_data", "confidence_score", confidence("first_words"), confidence("email"), F.array_join("low_confidence_fields", ",").alias("low"), "strategy_used", "token_usage", "chunks_processed", F.array_join("validation_errors", ",").alias("errors"), *more)


@_query(_offline_sql(False) + f"SELECT {_RESULT_COLUMNS} FROM r")
def extract_offline(spark, d):
    """Documents through prompts, the offline provider, parsing, folds, validation and scores."""
    schemas = spark.createDataFrame([("sample", SCHEMA)], "schema_id string, schema_json string")
    return _offline(engine.extract(_t(spark, d, "documents").select("doc_id", "text"), schemas, strategy="chunked", max_text_chars=engine.WHOLE))


@_query(
    _offline_sql(True)
    + f"""SELECT {_RESULT_COLUMNS}, present / 2::DOUBLE AS completeness, CASE WHEN strings > 0 THEN found / strings::DOUBLE ELSE 1.0::DOUBLE END AS accuracy, CASE WHEN lacks THEN 'validation_error_0' ELSE '' END AS flags,
floor(token_usage * 0.7::DOUBLE)::BIGINT AS input_tokens, floor(token_usage * 0.3::DOUBLE)::BIGINT AS output_tokens, length(text)::BIGINT AS document_chars, {_SCORE}::DOUBLE AS complexity_score, {_FACTS["nesting_depth"]}::BIGINT AS nesting_depth, {_FACTS["total_objects"]}::BIGINT AS total_objects, {_FACTS["total_properties"]}::BIGINT AS total_properties,
CASE WHEN confidence_score > 0.85::DOUBLE THEN 'Excellent' WHEN confidence_score > 0.7::DOUBLE THEN 'Good' ELSE 'Needs Review' END AS quality_rating FROM r"""
)
def evaluate_offline(spark, d):
    schemas = spark.createDataFrame([("sample", SCHEMA)], "schema_id string, schema_json string")
    results = engine.evaluate(_t(spark, d, "documents").select("doc_id", "text"), schemas, max_text_chars=engine.WHOLE)
    return _offline(results, "completeness", "accuracy", F.array_join("flags", ",").alias("flags"), "input_tokens", "output_tokens", "document_chars", "complexity_score", "nesting_depth", "total_objects", "total_properties", "quality_rating")
