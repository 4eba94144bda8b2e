import json

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspark import queries
from loomspark.functions import jsonmodel, text
from loomspark.operators import folding, schema, scoring
from loomspark.__main__ import main
from loomspark.plans import completion, engine
from loomspark.plans.settings import Settings
from loomspark.sources import files, tables
from loomspark.streaming import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in queries.ORACLE:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.sql(queries.ORACLE[name])
    names = list(found.columns)
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr([plain(r[c]) for c in names]) for r in rows) == sorted(repr([plain(v) for v in r]) for r in found.fetchall())


@pytest.mark.parametrize("n,chunks", [(0, 1), (1, 1), (3800, 1), (3801, 2), (4001, 2), (7700, 3)])
def test_chunks(spark, n, chunks):
    t = " ".join(map(str, range(n))) if n else " \n "
    got = [r.chunk_text for r in text.word_chunks(spark.createDataFrame([(t,)], "text string")).orderBy("chunk_idx").collect()]
    ws = t.split()
    assert got == ([" ".join(ws[i * 3800 : i * 3800 + 4000]) for i in range(chunks)] if n else [t])


def test_words_split_at_any_white_space(spark):
    t = "".join(f"w{i}{chr(i)}" for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000)
    assert spark.createDataFrame([(t,)], "t string").select(text.words(F.col("t"))).first()[0] == t.split()


@pytest.mark.parametrize("required,found,truthy,want", [(0, 0, 1, 0.7), (1, 0, 1, 0.7999999999999999), (0, 1, 1, 0.85), (1, 1, 1, 0.95), (0, 0, 0, 0.49999999999999994), (1, 0, 0, 0.5999999999999999), (0, 1, 0, 0.6499999999999999), (1, 1, 0, 0.75)])
def test_field_confidence(spark, required, found, truthy, want):
    got = spark.range(1).select(scoring.field_confidence(F.lit(bool(required)), F.lit(bool(found)), F.lit(bool(truthy)))).first()[0]
    assert abs(got - want) < 1e-12 and (got < 0.6) == (want < 0.6)


def test_fold_of_mixed_values(spark):
    parts = [{"a": [1], "b": "", "c": [], "d": "x", "e": "k"}, {"a": [2, 3], "b": "y", "c": "z", "d": [1], "f": None}, {"a": [], "b": "w", "f": 0}]
    want: dict = {}
    for p in parts:
        for k, v in p.items():
            if k not in want:
                want[k] = json.loads(json.dumps(v))
            elif isinstance(v, list) and isinstance(want[k], list):
                want[k] += v
            elif v and not want[k]:
                want[k] = v
    rows = spark.createDataFrame([(1, i, json.dumps(p)) for i, p in enumerate(parts)], "doc_id long, unit_idx int, data string")
    top = jsonmodel.fields(rows, "data", "doc_id", "unit_idx").where("depth = 0")
    assert json.loads(folding.objects(folding.fold_chunks(top, "doc_id"), "doc_id").first().data) == want
    last = {k: v for p in parts for k, v in p.items()}
    assert json.loads(folding.objects(folding.fold_sections(top, "doc_id"), "doc_id").first().data) == last


@pytest.mark.parametrize(
    "content,data,confidence",
    [('x {"a": 1} y', {"a": 1}, 0.8), ('{"a": 1,}', {"a": 1}, 0.3), ('"n": "12", "b": true, "c": null, "d": 3.5', {"n": 12, "b": True, "c": None, "d": 3}, 0.3), ("", {}, 0.1), ('{"a": "x\ny"}', {"a": "x y"}, 0.3), ("[1]", [1], 0.8), ('{"a":1,"a":2}', {"a": 2}, 0.8)],
)
def test_parse(spark, content, data, confidence):
    got = spark.createDataFrame([(content,)], "c string").select(jsonmodel.parse_completion("c").alias("p")).first().p
    assert json.loads(got.data) == data and got.confidence == confidence


def test_truth(spark):
    values = ["", 0, 0.0, -0.0, False, None, [], {}, "0", 1, 0.5, True, [0], {"a": 0}, "false", 1e5, 0e5]
    rows = spark.createDataFrame([(i, jsonmodel.json_type(v), json.dumps(v)) for i, v in enumerate(values)], "i int, t string, v string")
    got = {r.i: r.x for r in rows.select("i", jsonmodel.is_truthy(F.col("t"), F.col("v")).alias("x")).collect()}
    assert [got[i] for i in range(len(values))] == [bool(v) for v in values]


def plain_facts(s):
    """Depth, objects, properties and keywords of a schema, by plain recursion."""
    depth = lambda x: max([1 + depth(y) for y in x.values() if isinstance(y, dict)] + [1 + depth(z) for y in x.values() if isinstance(y, list) for z in y if isinstance(z, dict)] + [0])
    every = lambda x: [x] + [n for y in x.values() for z in (y if isinstance(y, list) else [y]) if isinstance(z, dict) for n in every(z)]
    nodes = every(s)
    return depth(s), sum(n.get("type") == "object" for n in nodes), sum(len(n.get("properties", {})) for n in nodes)


def test_schema_facts(spark):
    s = {"type": "object", "properties": {f"p{i}": {"type": "object", "properties": {"type": {"type": "string"}, "é": {"anyOf": [{"type": "object", "properties": {"x": {}}}]}}} for i in range(6)}, "required": ["p5", "p0"], "allOf": [{"if": {}}]}
    r = schema.analyze(spark.createDataFrame([("s", json.dumps(s)), ("t", '{"oneOf_": 1, "list": [{"$ref": "x"}]}')], "schema_id string, schema_json string")).orderBy("schema_id").collect()
    assert (r[0].nesting_depth, r[0].total_objects, r[0].total_properties) == plain_facts(s)
    assert r[0].estimated_tokens == len(json.dumps(s, separators=(",", ":"))) // 4 and r[0].has_complex_types and r[0].is_complex
    assert abs(r[0].complexity_score - (10 * r[0].nesting_depth + 2 * r[0].total_objects + 0.5 * r[0].total_properties + 20 + 0.01 * r[0].estimated_tokens)) < 1e-9
    assert [(x.name, list(json.loads(x.json)["properties"]), json.loads(x.json)["required"]) for x in r[0].sections] == [("section_1", [f"p{i}" for i in range(5)], ["p0"]), ("section_2", ["p5"], ["p5"])]
    assert not r[1].has_complex_types and [x.name for x in r[1].sections] == ["main"]


def _recorded(spark, docs, schemas, answers, **how):
    units = completion.prompt_key(engine.units(engine.pairs(docs, schemas, **how)))
    rows = [(u.prompt_key, answers(u), 10) for u in units.collect()]
    return completion.Replay(spark.createDataFrame(rows, "prompt_key string, content string, total_tokens long"))


def test_engine_validates_and_scores(spark):
    s = {"type": "object", "properties": {"name": {"type": "string"}, "age": {"type": "integer"}, "home": {"type": "object", "properties": {"city": {"type": "string"}}, "required": ["city"]}}, "required": ["name", "mail"]}
    schemas = spark.createDataFrame([("s", json.dumps(s))], "schema_id string, schema_json string")
    docs = spark.createDataFrame([(1, "Ada lives in London"), (2, "nothing"), (3, "")], "doc_id long, text string")
    answers = {"Ada lives in London": '{"name": "ada", "age": 1.0, "home": {"city": ""}}', "nothing": "no idea"}
    replay = _recorded(spark, docs, schemas, lambda u: next((a for t, a in answers.items() if t in u.user_prompt), None), strategy="simple")
    rows = {r.doc_id: r for r in engine.extract(docs, schemas, "simple", replay).collect()}
    one = rows[1]
    assert one.validation_errors == ["Missing required field: mail", "Type mismatch for age: expected integer"]
    assert abs(one.confidence_score - 0.64) < 1e-12 and one.token_usage == 10
    assert {k: round(v, 9) for k, v in one.field_confidences.items()} == {"name": 0.95, "age": 0.7, "home": 0.7, "home.city": 0.75}
    assert rows[2].success and rows[2].extracted_data == "{}" and len(rows[2].validation_errors) == 2
    assert not rows[3].success and rows[3].error_message == "no recorded answer"
    bad = engine.extract(docs, schemas, "bogus", replay).collect()
    assert all(not r.success and r.strategy_used == "unknown" for r in bad)


def test_hierarchical_sections(spark):
    s = {"type": "object", "properties": {f"p{i}": {"type": "string"} for i in range(7)}, "required": ["p6"]}
    schemas = spark.createDataFrame([("s", json.dumps(s))], "schema_id string, schema_json string")
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    replay = _recorded(spark, docs, schemas, lambda u: '{"p0": "some", "x": 1}' if "section_1" in u.system_prompt else '{"p6": "text", "x": 2}', strategy="hierarchical")
    r = engine.extract(docs, schemas, "hierarchical", replay).first()
    assert json.loads(r.extracted_data) == {"p0": "some", "x": 2, "p6": "text"} and r.chunks_processed == 2 and abs(r.confidence_score - 0.85) < 1e-12


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "in/b.MD").write_text("name: é", encoding="utf-8")
    (tmp_path / "in/c.csv").write_text("x,y\n" + "\n".join(f"{i},v{i}" for i in range(12)) + "\n,z\n")
    (tmp_path / "in/d.pdf").write_bytes(b"%PDF-broken")
    got = {r.filename: r for r in files.read_documents(spark, str(tmp_path / "in")).collect()}
    assert got["a.txt"].text == "é" and got["b.MD"].text == "name: é" and got["d.pdf"].text is None and got["d.pdf"].error
    lines = got["c.csv"].text.split("\n")
    assert lines[0] == "CSV file with 13 rows and 2 columns" and lines[1] == "Columns: x, y" and lines[-1] == "... and 3 more rows" and lines[4].endswith("y: v0")
    docs, schemas = files.sample(spark)
    results = engine.evaluate(docs, schemas)
    files.write_results(results, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/extracted")).count() == 1
    r = results.first()
    assert r.completeness == 1.0 and r.accuracy == 1.0 and r.flags == []


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("name: Ada\nemail: a@b.c\n")
    _, schemas = files.sample(spark)
    q = ingest.extract_stream(ingest.document_stream(spark, str(tmp_path / "in")), schemas, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert json.loads(spark.read.parquet(str(tmp_path / "out")).first().extracted_data)["name"] == "Ada"


def test_bad_schemas_are_rows(spark):
    schemas = spark.createDataFrame([("list", "[1]"), ("broken", '{"type":'), ("null", None), ("odd", '{"properties": true, "required": true}')], "schema_id string, schema_json string")
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    rows = {(r.doc_id, r.schema_id): r for r in engine.extract(docs, schemas).collect()}
    assert len(rows) == 8
    assert all(not rows[1, s].success and rows[1, s].error_message == "the schema is no JSON object" for s in ("list", "broken", "null"))
    assert rows[1, "odd"].success and rows[1, "odd"].validation_errors == []


def test_low_fields_keep_the_order_of_the_data(spark):
    schemas = spark.createDataFrame([("s", '{"type":"object","properties":{"z":{"type":"string"},"o":{"type":"object","properties":{"y":{"type":"integer"},"b":{"type":"integer"}}},"a":{"type":"integer"}}}')], "schema_id string, schema_json string")
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    replay = _recorded(spark, docs, schemas, lambda u: '{"z": null, "o": {"y": 0, "b": 0}, "a": 0}', strategy="simple")
    r = engine.extract(docs, schemas, "simple", replay).first()
    assert r.low_confidence_fields == ["z", "o.y", "o.b", "a"]


def test_repeated_and_null_ids_are_documents(spark):
    schemas = spark.createDataFrame([("s", '{"type":"object","properties":{"a":{"type":"string"}},"required":["b"]}')], "schema_id string, schema_json string")
    docs = spark.createDataFrame([(1, "a: one"), (1, "a: two"), (1, "a: two"), (None, "a: three"), (None, "nothing"), (2, None)], "doc_id long, text string")
    rows = engine.extract(docs, schemas, "simple").collect()
    want = [("1", '{"a":"one"}'), ("1", '{"a":"two"}'), ("1", '{"a":"two"}'), ("2", ""), ("None", '{"a":"three"}'), ("None", "{}")]
    assert sorted((str(r.doc_id), r.extracted_data or "") for r in rows) == want
    assert all(r.chunks_processed <= 1 for r in rows)
    again = engine.evaluate(docs, schemas, "simple").collect()
    assert sorted(r.extracted_data or "" for r in again) == sorted(r.extracted_data or "" for r in rows)
    assert engine.extract(docs.limit(0), schemas).collect() == [] and engine.evaluate(docs, schemas.limit(0)).collect() == []


def test_dotted_keys_share_a_path(spark):
    schemas = spark.createDataFrame([("s", '{"type":"object","properties":{"a":{"type":"object","properties":{"b":{"type":"integer"}}},"a.b":{"type":"integer"}}}')], "schema_id string, schema_json string")
    docs = spark.createDataFrame([(1, "text"), (2, "other")], "doc_id long, text string")
    answers = {"text": '{"a":{"b":1},"a.b":0}', "other": '{"a":{"b":0},"a.b":2}'}
    replay = _recorded(spark, docs, schemas, lambda u: next(a for t, a in answers.items() if f"FROM:\n{t}\n" in u.user_prompt), strategy="simple")
    rows = {r.doc_id: r for r in engine.extract(docs, schemas, "simple", replay).collect()}
    assert {k: round(v, 9) for k, v in rows[1].field_confidences.items()} == {"a": 0.7, "a.b": 0.5}  # the last of equal paths counts
    assert {k: round(v, 9) for k, v in rows[2].field_confidences.items()} == {"a": 0.7, "a.b": 0.7}
    assert rows[1].low_confidence_fields == ["a.b"] and rows[2].low_confidence_fields == []


def test_calls_are_isolated(spark):
    class _Provider:
        def __init__(self, broken_close):
            self.broken_close = broken_close

        def __call__(self, system, user, most):
            if "fail" in user:
                raise RuntimeError("no luck")
            return '{"a":"x"}', most

        def close(self):
            if self.broken_close:
                raise RuntimeError("can't close")

    schemas = spark.createDataFrame([("s", '{"type":"object","properties":{"a":{"type":"string"}}}')], "schema_id string, schema_json string")
    docs = spark.createDataFrame([(i, "fail" if i % 3 == 0 else "fine x") for i in range(9)], "doc_id long, text string")
    for broken in (False, True):
        rows = engine.extract(docs, schemas, "simple", completion.Calls(lambda: _Provider(broken))).collect()  # noqa: B023
        assert all(r.success == (r.doc_id % 3 != 0) and (r.error_message == "no luck") == (r.doc_id % 3 == 0) for r in rows)
        assert all(r.token_usage == (4000 if r.success else 0) and r.processing_time >= 0 for r in rows)

    def none():
        raise ValueError("no client")

    rows = engine.extract(docs, schemas, "simple", completion.Calls(none)).collect()
    assert all(not r.success and r.error_message == "no client" for r in rows)
    assert completion.api_key({"OPENAI_API_KEY": "", "OPENAI_API_KEY_SECRET": "k"}) == "k" and completion.api_key({}) is None
    assert engine.health() == {"status": "no_provider"} and engine.health(_Provider(False)) == {"status": "healthy"}


def test_many_schemas_for_each_document(spark):
    schemas = spark.range(2500).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("schema_id"), F.lit('{"type":"object"}').alias("schema_json"))
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    met = engine.pairs(docs, schemas)
    assert met.count() == 5000 and met.select("doc_id", "schema_id").distinct().count() == 5000 and met.select("row").distinct().count() == 5000


@pytest.mark.parametrize("tokens,cost", [(10, 0.0004), (999, 0.0389), (1000, 0.039), (3000, 0.117), (12345, 0.4814)])
def test_costs(spark, tokens, cost):
    t = F.lit(tokens)
    got = spark.range(1).select(scoring.rounded_cost(t), scoring.llm_share(F.lit(1.0), F.lit(4.0)), scoring.llm_share(F.lit(1.0), F.lit(0.0))).first()
    assert tuple(got) == (cost, 25.0, 0.0)


def test_rounding_is_by_exact_value(spark):
    rows = spark.range(5000).select(scoring.cost(F.col("id")).alias("c"), scoring.rounded_cost(F.col("id")).alias("r")).collect()
    assert all(x.r == round(x.c, 4) for x in rows)


@pytest.mark.parametrize("text_,valid", [('{"a":1}', True), ('{"a":NaN}', True), ('{"a":1,"a":2}', True), ('{"a":1} x', False), ("[1]", False), ("{", False)])
def test_schema_files(spark, tmp_path, text_, valid):
    (tmp_path / "s.json").write_text(text_)
    assert [r.valid for r in files.read_schemas(spark, str(tmp_path)).collect()] == [valid]


def test_strict_files_and_large_csv(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "b.txt").write_text("fine é", encoding="utf-8")
    got = {r.filename: r for r in files.read_documents(spark, str(tmp_path), strict=True).collect()}
    assert got["a.txt"].text is None and "utf-8" in got["a.txt"].error and got["b.txt"].text == "fine é" and got["b.txt"].error is None
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/c.csv").write_text("x,y\n" + "\n".join(f"{i},v{i}" for i in range(12)) + "\n")
    whole = files.read_documents(spark, str(tmp_path / "csv")).first().text
    assert files.read_csv_documents(spark, str(tmp_path / "csv")).first().text == whole


def test_stream_reads_by_format(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "in/b.pdf").write_bytes(b"%PDF-broken")
    q = ingest.document_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.path[-5:]: r for r in spark.table("arrived").collect()}
    assert got["a.csv"].text.startswith("CSV file with 1 rows") and got["b.pdf"].text is None and got["b.pdf"].error


def test_settings_and_command_line(spark, tmp_path):
    spark.conf.set("spark.loomspark.max_text_chars", "123")
    try:
        assert Settings.of(spark).max_text_chars == 123 and Settings.of(spark).strategy == "auto"
    finally:
        spark.conf.unset("spark.loomspark.max_text_chars")
    assert main(["sample", str(tmp_path / "sample")]) == 0
    assert main(["evaluate", str(tmp_path / "sample/content"), str(tmp_path / "sample/schema"), str(tmp_path / "out"), "--strategy", "simple"]) == 0
    out = [r for r in spark.read.json(str(tmp_path / "out/extracted")).collect() if "Ada" in r.extracted_data]
    assert out and json.loads(out[0].pretty)["name"] == "Ada Lovelace" and out[0].pretty.startswith('{\n  "name"')
    assert {r.suffix for r in engine.file_types(spark, False).collect()} == {".txt", ".md", ".json", ".csv", ".bib"}
    named = spark.createDataFrame([("a/b.txt",), ("c.tar.gz",)], "n string").select(files.output_name(F.col("n"))).collect()
    assert [r[0] for r in named] == ["b_extracted.json", "c.tar_extracted.json"]


def test_sample_facts(spark):
    """The shapes that the schema analysis was specified on: a depth, objects, properties and score each."""
    s = {"type": "object", "properties": {"p": {"type": "object", "properties": {"n": {"type": "string"}, "e": {"type": "string"}}}, "w": {"type": "array", "items": {"type": "object", "properties": {"c": {"type": "array", "items": {"type": "string"}}}}}}, "required": ["p"]}
    r = schema.analyze(spark.createDataFrame([("s", json.dumps(s))], "schema_id string, schema_json string")).first()
    assert (r.nesting_depth, r.total_objects, r.total_properties) == plain_facts(s) and not r.has_complex_types
    assert [x.name for x in r.sections] == ["main"]


@pytest.mark.parametrize("query", ["section_groups", "schema_complexity"])
def test_schemas_of_a_small_file_are_dealt(spark, tmp_path, query):
    """A file that Spark reads in one task is read as JSON in many, each text once for a fact, and no fact is shuffled."""
    n = 3 * tables.ROWS
    parts = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_name"), (F.col("id") % 50).cast("int").alias("p_size"))
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = queries.QUERIES[query](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.rdd.getNumPartitions() == 3 and out.select("schema_id").distinct().count() == n
    assert plan.count("Repartition") == 1 and plan.count("ArrowEvalPython") == 1 and "Join" not in plan and "Aggregate" not in plan.split("ArrowEvalPython")[0]


def test_offline_lines_take_linear_time():
    import time

    began = time.perf_counter()
    prompt = "TEXT TO EXTRACT FROM:\n" + "\n" * 200_000 + "email: x\n\nJSON SCHEMA:\n{\n \"email\":{"
    assert json.loads(completion.heuristic("", prompt, 1)[0]) == {"email": "x"} and time.perf_counter() - began < 2


@pytest.mark.parametrize("facts,score,complex_", [((10, 15, 47, True, 5447), 227.97, True), ((7, 16, 90, True, 2323), 190.23, True), ((6, 5, 21, False, 266), 83.16, True), ((2, 1, 3, False, 26), 23.76, False)])
def test_golden_scores(spark, facts, score, complex_):
    depth, objects, properties, has, tokens = facts
    row = spark.range(1).select(schema.score(*map(F.lit, facts)).alias("score")).select("score", schema.is_complex(F.lit(depth), F.lit(objects), F.col("score")).alias("c")).first()
    assert abs(row.score - score) < 1e-9 and row.c is complex_
