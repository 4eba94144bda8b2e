"""What fails stays in its row, its file or its try: odd inputs, lost tasks, long documents."""

import json
import os
import random
import subprocess
import sys
import textwrap
import tracemalloc
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.functions import jsonmodel, matching
from loomspark.operators import folding
from loomspark.plans import completion, engine
from loomspark.sources import files, named

ROOT = Path(__file__).resolve().parent.parent
GOOD = '{"type":"object","properties":{"a":{"type":"string"}},"required":["a"]}'
DEEP = 3000
ODD_SCHEMAS = {
    "numbers_required": '{"required":[1,"a"],"properties":{"a":{"type":"string"}}}',
    "odd_types": '{"properties":{"a":{"type":["string",1]}}}',
    "deep": '{"properties":{"a":' * DEEP + "{}" + "}}" * DEEP,
    "list": "[1]",
    "half": '{"properties":{"\\ud800":{"type":"string"}},"required":["\\ud800"]}',
}
ODD_ANSWERS = {"half": '{"a":"\\ud800"}', "deep": '{"a":' * DEEP + "1" + "}" * DEEP, "deep_1200": '{"a":' * 1200 + "1" + "}" * 1200, "long_number": '{"a": ' + "9" * 5000 + "}", "none": None, "list": "[1]", "half_key": '{"\\udfff":1,"a":"x"}'}


def answering(answers):
    """A provider whose answer is named by the text."""
    return completion.Calls(lambda: lambda system, prompt, most: (answers[prompt.partition("TEXT TO EXTRACT FROM:\n")[2].partition("\n")[0]], 1))


def test_odd_schemas_fail_alone(spark):
    docs = spark.createDataFrame([(1, "good")], "doc_id long, text string")
    schemas = spark.createDataFrame([("good", GOOD), *ODD_SCHEMAS.items()], "schema_id string, schema_json string")
    got = {r.schema_id: r for r in engine.extract(docs, schemas, strategy="simple", provider=answering({"good": '{"a":"x"}'})).collect()}
    assert {k for k, r in got.items() if not r.success} == {"deep", "list"}
    assert got["deep"].error_message == f"the schema is nested more than {jsonmodel.DEPTH} levels deep" and got["list"].error_message == "the schema is no JSON object"
    assert got["good"].validation_errors == [] and got["numbers_required"].validation_errors == [] and got["odd_types"].validation_errors == []
    assert got["half"].validation_errors == ["Missing required field: �"]


@pytest.mark.parametrize("run", [engine.extract, engine.evaluate])
def test_odd_answers_fail_alone(spark, run):
    answers = {"good": '{"a":"good"}', **ODD_ANSWERS}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(answers)], "doc_id long, text string")
    schemas = spark.createDataFrame([("s", GOOD)], "schema_id string, schema_json string")
    got = {list(answers)[r.doc_id]: r for r in run(docs, schemas, strategy="simple", provider=answering(answers)).collect()}
    assert len(got) == len(answers)
    assert {k for k, r in got.items() if not r.success} == {"deep", "deep_1200", "long_number", "list"}
    assert got["good"].extracted_data == answers["good"] and got["good"].confidence_score == 0.8
    assert got["half"].extracted_data == '{"a":"\\ud800"}' and got["deep"].error_message == f"the completion is nested more than {jsonmodel.DEPTH} levels deep"
    assert json.loads(got["half_key"].extracted_data)["a"] == "x" and got["none"].extracted_data == "{}"


def test_deepest_answer(spark):
    n = jsonmodel.DEPTH
    for levels, ok in ((n, True), (n + 1, False)):
        answers = {"x": '{"a":' * levels + "1" + "}" * levels}
        docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
        schemas = spark.createDataFrame([("s", GOOD)], "schema_id string, schema_json string")
        assert engine.extract(docs, schemas, strategy="simple", provider=answering(answers)).first().success is ok


def test_documents_without_text_are_not_asked_about(spark):
    docs = spark.createDataFrame([(1, "x", None), (2, None, None), (3, None, "unreadable"), (4, "y", "half read")], "doc_id long, text string, error string")
    schemas = spark.createDataFrame([("s", GOOD)], "schema_id string, schema_json string")
    got = {r.doc_id: r for r in engine.extract(docs, schemas, provider=answering({"x": '{"a":"x"}'})).collect()}
    assert {i: r.error_message for i, r in got.items()} == {1: None, 2: "the document has no text", 3: "unreadable", 4: "half read"}
    assert got[2].chunks_processed == 0


def test_without_a_provider_all_fail(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    schemas = spark.createDataFrame([("s", GOOD)], "schema_id string, schema_json string")
    assert isinstance(completion.keyed({}, lambda key: None), completion.Missing) and isinstance(completion.keyed({"OPENAI_API_KEY": "k"}, lambda key: None), completion.Calls)
    row = engine.extract(docs, schemas, provider=completion.keyed({}, lambda key: None)).first()
    assert not row.success and row.error_message == "no provider is set" and engine.health(completion.Missing()) == {"status": "no_provider"}


def plain_fold(values):
    """A value after another: the first stays, lists are joined, a falsy one gives way to a truthy one."""
    out = values[0]
    for v in values[1:]:
        if isinstance(out, list) and isinstance(v, list):
            out = out + v
        elif not out and v:
            out = v
    return out


VALUES = st.sampled_from(["", "x", 0, 0.0, 7, None, True, False, [], [1], [2, "a"], {}, {"k": 1}])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(VALUES, min_size=1, max_size=9), min_size=1, max_size=8))
def test_fold_equals_plain_one(spark, columns):
    rows = [(d, i, 0, "k", jsonmodel.json_type(v), jsonmodel.dumps(v)) for d, values in enumerate(columns) for i, v in enumerate(values)]
    random.Random(0).shuffle(rows)
    fields = spark.createDataFrame(rows, "doc int, unit_idx int, ord int, key string, json_type string, value_json string")
    got = {r.doc: (r.json_type, r.value_json) for r in folding.fold_chunks(fields, "doc", range_=3).collect()}
    want = {d: plain_fold(values) for d, values in enumerate(columns)}
    assert got == {d: (jsonmodel.json_type(v), jsonmodel.dumps(v)) for d, v in want.items()}


def test_fold_of_a_hundred_thousand_units(spark):
    n = 100_000
    units = spark.range(n).select(F.lit(1).alias("doc"), F.col("id").alias("unit_idx"), F.explode(F.array(F.lit("items"), F.lit("name"))).alias("key"))
    is_list = F.col("key") == "items"
    value = F.when(is_list, F.when(F.col("unit_idx") % 3 == 0, "[]").otherwise(F.concat(F.lit("["), F.col("unit_idx").cast("string"), F.lit("]")))).otherwise(F.when(F.col("unit_idx") < n - 5, '""').otherwise(F.concat(F.lit('"'), F.col("unit_idx").cast("string"), F.lit('"'))))
    rows = units.select("doc", "unit_idx", F.lit(0).alias("ord"), "key", F.when(is_list, "array").otherwise("string").alias("json_type"), value.alias("value_json"))
    got = {r.key: r.value_json for r in folding.fold_chunks(rows, "doc").collect()}
    assert json.loads(got["items"]) == [i for i in range(n) if i % 3] and got["name"] == f'"{n - 5}"'


@settings(max_examples=200, deadline=None)
@given(st.text("abé ß", max_size=60), st.lists(st.one_of(st.none(), st.text("abé ß", max_size=6)), max_size=12), st.integers(0, 9))
def test_strings_are_found_as_one_by_one(text, strings, start):
    before, matching.START = matching.START, start
    try:
        assert matching.found(text, strings) == [s is not None and s in text for s in strings]
    finally:
        matching.START = before


def results(spark):
    rows = [(1, "/in/a/x.txt", True, '{"b":1,"a":"é"}', []), (2, "/in/b/x.md", True, '{"a":2}', ["overall_confidence_low"]), (3, "/in/y.txt", True, '{"a":3}', ["a"]), (4, "/in/z", False, None, ["overall_confidence_low"])]
    return spark.createDataFrame(rows, "doc_id long, path string, success boolean, extracted_data string, flags array<string>").withColumns({"schema_id": F.lit("s"), "validation_errors": F.array().cast("array<string>"), "confidence_score": F.lit(0.5)})


def test_result_files(spark, tmp_path):
    files.write_result_files(results(spark), str(tmp_path / "out"))
    got = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    alike = sorted(n for n in got if n.startswith("x-"))
    assert set(got) - set(alike) == {"y_extracted.json", "y_extracted_metrics.json", "y_extracted_review.json", "z_extracted_metrics.json", "z_extracted_review.json"}
    assert len(alike) == 5 and {json.loads(got[n])["a"] for n in alike if n.endswith("_extracted.json")} == {"é", 2}
    assert got["y_extracted.json"] == '{\n  "a": 3\n}' and json.loads(got["y_extracted_review.json"]) == {"low_confidence_fields": ["a"], "validation_errors": [], "overall_confidence": 0.5, "recommendation": "Human review recommended for flagged fields"}
    assert json.loads(got["z_extracted_metrics.json"])["success"] is False and any(got[n] == '{\n  "b": 1,\n  "a": "é"\n}' for n in alike)
    files.write_result_files(results(spark), str(tmp_path / "out"))  # the same files again
    assert {p.name for p in (tmp_path / "out").iterdir()} == set(got)


def test_names_that_clash_write_nothing(spark, tmp_path):
    twice = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "name string, value string").repartition(3)
    with pytest.raises(Exception, match="one name|several rows"):
        named.write_named(twice, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []
    with pytest.raises(Exception, match="no file can be named"):
        named.write_named(spark.createDataFrame([("../a", "1")], "name string, value string"), str(tmp_path / "out"))
    named.write_named(twice.where("name = 'b'"), str(tmp_path / "out"))
    with pytest.raises(Exception, match="holds files"):
        named.write_named(twice.where("name = 'b'"), str(tmp_path / "out"), overwrite=False)


def run_with_retries(code, tmp_path):
    """A program in a session of its own whose tasks are tried up to four times."""
    head = f"""
        import os, sys
        from pyspark.sql import SparkSession, functions as F
        tmp = {str(tmp_path)!r}
        conf = {{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "3", "spark.checkpoint.dir": tmp + "/shared", "spark.driver.memory": "1g"}}
        spark = SparkSession.builder.master("local[2,4]").config(map=conf).getOrCreate()
        def first_time(name):
            try:
                os.close(os.open(tmp + "/" + name, os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
    """
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(head) + textwrap.dedent(code)], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_files_of_a_task_that_is_tried_again(tmp_path):
    run_with_retries(
        """
        from loomspark.sources import named
        write = named.NamedFilesWriter.write
        def dies_once(self, rows):
            out = write(self, rows)
            if first_time("died"):
                os._exit(1)
            return out
        named.NamedFilesWriter.write = dies_once
        import pyspark.cloudpickle as c
        c.register_pickle_by_value(named)
        named.write_named(spark.range(30).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.col("id").cast("string").alias("value")).repartition(3), tmp + "/out")
        """,
        tmp_path,
    )
    assert (tmp_path / "died").exists()
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {f"f{i}": str(i) for i in range(30)}


def test_no_prompt_is_asked_twice_when_a_task_dies(tmp_path):
    run_with_retries(
        """
        from loomspark.plans import completion, engine
        def make():
            n = [0]
            def call(system, prompt, most):
                text = prompt.partition("TEXT TO EXTRACT FROM:\\n")[2].partition("\\n")[0]
                with open(tmp + "/calls", "a") as f:
                    f.write(text + "\\n")
                n[0] += 1
                if n[0] == 4 and first_time("died"):
                    os._exit(1)  # the fourth answer is lost with its task
                if text == "t3" and first_time("failed"):
                    raise ValueError("no")
                return '{"a":"' + text + '"}', 1
            return call
        docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 20).cast("string")).alias("text"))
        schemas = spark.createDataFrame([("s", '{"properties":{"a":{"type":"string"}},"required":["a"]}')], "schema_id string, schema_json string")
        for k in range(2):
            rows = engine.extract(docs, schemas, strategy="simple", provider=completion.Logged(make, tmp + "/log", flush=1, buckets=2)).collect()
            assert len(rows) == 40
            failed = {r.doc_id for r in rows if not r.success}
            assert failed == ({3, 23} if k == 0 else set()), failed
            assert all(r.extracted_data == '{"a":"t%d"}' % (r.doc_id % 20) for r in rows if r.success)
        """,
        tmp_path,
    )
    calls = Counter((tmp_path / "calls").read_text().split())
    assert len(calls) == 20 and sum(calls.values()) == 22  # the lost one and the failed one again


def test_log_of_no_prompts(spark, tmp_path):
    schemas = spark.createDataFrame([("s", GOOD)], "schema_id string, schema_json string")
    log = completion.Logged(lambda: None, str(tmp_path / "log"))
    assert engine.extract(spark.createDataFrame([], "doc_id long, text string"), schemas, provider=log).collect() == []
    failed = engine.extract(spark.createDataFrame([(1, "x")], "doc_id long, text string"), schemas, provider=log).first()
    assert not failed.success and "not callable" in failed.error_message


def test_large_files_are_errors_and_stay_unread(spark, tmp_path):
    (tmp_path / "small.txt").write_text("small")
    (tmp_path / "large.txt").write_text("x" * 5000)
    (tmp_path / "large.csv").write_text("a,b\n" + "1,2\n" * 2000)
    docs = files.read_documents(spark, str(tmp_path), max_file_size=1000)
    got = {r.filename: r for r in docs.collect()}
    assert got["small.txt"].text == "small" and got["small.txt"].error is None
    assert got["large.txt"].text is None and got["large.txt"].error == "the file has 5000 bytes, more than 1000" and "more than 1000" in got["large.csv"].error
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1000)" in plan and "GreaterThan(length,1000)" in plan
    large = files.too_large(spark.read.format("binaryFile").load(str(tmp_path)), 1000)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in large


def test_phases_of_a_run(spark):
    from loomspark.operators import scoring
    from loomspark.plans.phases import Phases

    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    schemas = spark.createDataFrame([("s", GOOD)], "schema_id string, schema_json string")

    def make():
        import time

        def call(system, prompt, most):
            time.sleep(0.01)
            return '{"a":"x"}', 1

        return call

    run = Phases(spark)
    assert engine.evaluate(docs, schemas, strategy="simple", provider=completion.Calls(make), phases=run).count() == 30
    got = {r.phase: r for r in run.table().collect()}
    assert list(got) == ["schemas and strategies", "answers", "parsing", "folding", "fields", "scores"]
    assert all(r.rows == 30 and r.seconds > 0 and r.tasks > 0 and r.cpu_seconds > 0 and r.output_bytes > 0 for r in got.values())
    assert got["answers"].provider_seconds >= 0.3 and got["answers"].text_bytes == 30 * len('{"a":"x"}') and got["folding"].peak_memory > 0
    assert run.table().agg(scoring.llm_share(F.sum("provider_seconds"), F.sum("seconds"))).first()[0] > 0 and run.seconds() >= got["answers"].seconds


def _peak(work) -> int:
    """The most bytes that Python's own objects take during work()."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_texts_of_a_batch_are_looked_through_one_by_one():
    texts, strings = pa.array([f"{i} " + "word " * 20_000 for i in range(100)]), pa.array([[str(i), "none", None] for i in range(100)])
    got = []
    assert _peak(lambda: got.append(matching._found(texts, strings))) < texts.nbytes // 10
    assert got[0].to_pylist() == [[True, False, False]] * 100


class _Prompts:
    """Units whose mapInArrow() calls its function in this process."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch

    def select(self, *names: str) -> "_Prompts":
        return _Prompts(self.batch.select(list(names)))

    def mapInArrow(self, f, schema: str) -> list[pa.RecordBatch]:
        return list(f(iter([self.batch])))


def test_prompts_of_a_batch_are_asked_one_by_one():
    n = 100
    units = pa.RecordBatch.from_pydict({"row": pa.array(range(n)), "unit_idx": pa.array([0] * n, pa.int32()), "system_prompt": ["s"] * n, "user_prompt": [f"{i} " + "word " * 20_000 for i in range(n)], "max_tokens": pa.array([7] * n, pa.int32())})
    got = []
    ask = completion.Calls(lambda: lambda system, user, most: (user.split(" ", 1)[0], len(user) + most))
    assert _peak(lambda: got.extend(ask.complete(_Prompts(units)))) < units.nbytes // 10
    assert [(r["row"], r["content"], r["error"]) for r in got[0].to_pylist()] == [(i, str(i), None) for i in range(n)]
