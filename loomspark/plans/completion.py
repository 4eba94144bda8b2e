"""Completion providers: units in, contents out.

A unit is (row, doc_id, schema_id, unit_idx, system_prompt, user_prompt, max_tokens), where `row`
is a number of its own for each document and schema; a provider gives (row, unit_idx, content,
total_tokens, error, seconds). Answers can differ from call to call, so the engine writes them to a
table before it goes on.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.sources.named import located

ANSWER = "row long, unit_idx int, content string, total_tokens long, error string, seconds double"
_ANSWER = pa.schema([("row", pa.int64()), ("unit_idx", pa.int32()), ("content", pa.string()), ("total_tokens", pa.int64()), ("error", pa.string()), ("seconds", pa.float64())])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows one by one, so that one prompt at a time is there beside the Arrow batch."""
    return (tuple(x.as_py() for x in row) for row in zip(*batch.columns, strict=True))


def prompt_key(df: DataFrame) -> DataFrame:
    """Add prompt_key, by which equal prompts are told."""
    return df.withColumn("prompt_key", F.sha2(F.concat_ws("\n", "system_prompt", "user_prompt"), 256))


class Missing:
    """No provider: every unit fails, none is asked."""

    def complete(self, units: DataFrame) -> DataFrame:
        return units.select("row", "unit_idx", F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("total_tokens"), F.lit("no provider is set").alias("error"), F.lit(0.0).alias("seconds"))


class Replay:
    """Answers recorded in a table of prompt_key, content and total_tokens; other prompts give an error."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded

    def complete(self, units: DataFrame) -> DataFrame:
        # one answer for each prompt, however often it was recorded
        known = self.recorded.groupBy("prompt_key").agg(F.min_by(F.struct("content", "total_tokens"), F.struct("content", "total_tokens")).alias("a"))
        joined = prompt_key(units).join(known, "prompt_key", "left")
        return joined.select("row", "unit_idx", "a.content", F.coalesce("a.total_tokens", F.lit(0)).cast("long").alias("total_tokens"), F.when(F.col("a.content").isNull(), "no recorded answer").alias("error"), F.lit(0.0).alias("seconds"))


class Calls:
    """Calls a function for each prompt: call(system_prompt, user_prompt, max_tokens) -> (content, total_tokens).

    make() builds the function once in a worker, and its `close`, if it has one, is called at the end.
    """

    def __init__(self, make: Callable[[], Callable[[str, str, int], tuple[str, int]]]):
        self.make = make

    def complete(self, units: DataFrame) -> DataFrame:
        make = self.make

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            call = None
            try:
                for batch in batches:
                    out = []
                    for row, unit_idx, *prompt in _rows(batch):
                        began = time.perf_counter()
                        try:
                            call = call or make()
                            content, tokens = call(*prompt)
                            out.append((row, unit_idx, content, tokens, None, time.perf_counter() - began))
                        except Exception as e:  # one document's failure is its own row
                            out.append((row, unit_idx, None, 0, str(e), time.perf_counter() - began))
                    yield pa.RecordBatch.from_pylist([dict(zip(_ANSWER.names, x, strict=True)) for x in out], _ANSWER)
            finally:
                try:
                    if hasattr(call, "close"):
                        call.close()
                except Exception:  # the answers are there already
                    pass

        return units.select("row", "unit_idx", "system_prompt", "user_prompt", "max_tokens").mapInArrow(run, ANSWER)


class Logged:
    """Calls, each prompt once, with the answers kept in a log from which later runs take them.

    The log is a folder of JSON lines, a folder for each bucket of prompt keys. A task works on whole
    buckets: it first reads which of a bucket's prompts have an answer, then asks for the others and
    adds every `flush` answers as a file. A task that is lost and tried again, and a job that is
    started again, so ask only for what isn't logged; at most `flush` calls of a lost task are made
    twice. Equal prompts of many documents are one call. Errors are logged too, and asked again by the
    next run.
    """

    def __init__(self, make: Callable[[], Callable[[str, str, int], tuple[str, int]]], path: str, flush: int = 16, buckets: int = 256):
        self.make, self.path, self.flush, self.buckets = make, path.rstrip("/"), flush, buckets

    def complete(self, units: DataFrame) -> DataFrame:
        make, path, flush, run = self.make, self.path, self.flush, uuid.uuid4().hex
        keyed_ = prompt_key(units)
        # the number of tokens belongs to the question
        keyed_ = keyed_.withColumn("prompt_key", F.concat_ws(":", "prompt_key", "max_tokens"))
        asked = keyed_.groupBy("prompt_key").agg(F.first("system_prompt").alias("system_prompt"), F.first("user_prompt").alias("user_prompt"), F.first("max_tokens").alias("max_tokens"))
        asked = asked.withColumn("bucket", F.pmod(F.xxhash64("prompt_key"), F.lit(self.buckets)).cast("int")).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "prompt_key")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = located(path)
            call, bucket, done, held = None, None, set(), []

            def add() -> None:
                if held:
                    folder = f"{root}/bucket={bucket}"
                    store.create_dir(folder, recursive=True)
                    name = uuid.uuid4().hex
                    with store.open_output_stream(f"{folder}/_{name}") as f:
                        f.write("".join(json.dumps(x) + "\n" for x in held).encode())
                    store.move(f"{folder}/_{name}", f"{folder}/{name}.json")  # whole or not at all
                    held.clear()

            try:
                for batch in batches:
                    for own, key, *prompt in _rows(batch):
                        if own != bucket:
                            add()
                            bucket, done = own, _answered(store, f"{root}/bucket={own}", run)
                        if key in done:
                            continue
                        began = time.perf_counter()
                        try:
                            call = call or make()
                            content, tokens = call(*prompt)
                            held.append({"prompt_key": key, "content": content, "total_tokens": tokens, "error": None, "seconds": time.perf_counter() - began, "run": run})
                        except Exception as e:  # one prompt's failure is its own row
                            held.append({"prompt_key": key, "content": None, "total_tokens": 0, "error": str(e), "seconds": time.perf_counter() - began, "run": run})
                        if len(held) >= flush:
                            add()
                add()
            finally:
                try:
                    if hasattr(call, "close"):
                        call.close()
                except Exception:  # the answers are there already
                    pass
            yield pa.RecordBatch.from_pydict({"n": pa.array([0], pa.int32())})

        asked.select("bucket", "prompt_key", "system_prompt", "user_prompt", "max_tokens").mapInArrow(work, "n int").write.format("noop").mode("overwrite").save()
        layout = "prompt_key string, content string, total_tokens long, error string, seconds double, run string"
        store, root = located(path)
        some = any(f.type == fs.FileType.Directory for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)))
        spark = units.sparkSession
        read = spark.read.schema(layout).json(f"{path}/*/*.json") if some else spark.createDataFrame([], layout)
        # an answer before an error; of several one
        rank = F.struct(F.col("error").isNotNull().alias("failed"), "content", "error", "total_tokens", "seconds")
        known = read.where(F.col("error").isNull() | (F.col("run") == run)).groupBy("prompt_key").agg(F.min(rank).alias("a"))
        return keyed_.select("row", "unit_idx", "prompt_key").join(known, "prompt_key", "left").select("row", "unit_idx", "a.content", "a.total_tokens", "a.error", "a.seconds")


def _answered(store: fs.FileSystem, folder: str, run: str) -> set[str]:
    """Keys of a bucket's log that have an answer, or an error of this run."""
    out: set[str] = set()
    for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.path.endswith(".json"):
            with store.open_input_stream(info.path) as f:
                for line in f.read().splitlines():
                    x = json.loads(line)
                    if x["error"] is None or x["run"] == run:
                        out.add(x["prompt_key"])
    return out


def heuristic(system_prompt: str, user_prompt: str, max_tokens: int) -> tuple[str, int]:
    """A stand-in that works offline: `name: value` lines for the schema's property names. Not what a model would answer."""
    text, _, schema = user_prompt.partition("\n\nJSON SCHEMA:\n")
    text = text.partition("TEXT TO EXTRACT FROM:\n")[2]
    names = re.findall(r'^  ?"([^"\n]+)":\{', schema, re.M)
    found = {n: m[1].strip(" \t\r\f") for n in dict.fromkeys(names) if (m := re.search(rf"(?aim)^[^\w\n]*{re.escape(n)}[ \t]*[:=][ \t]*([^\n]+)$", text))}
    if "first_words" in names:
        found["first_words"] = " ".join(text.split()[:3])
    content = json.dumps(found, ensure_ascii=False)
    return content, (len(user_prompt) + len(content)) // 4


#: Names under which the environment may hold a provider's key, in order.
KEY_NAMES = ("OPENAI_API_KEY", "OPENAI_API_KEY_SECRET")


def api_key(environment: Mapping[str, str]) -> str | None:
    """The provider's key in an environment, if there is one. Give it to `make` of Calls; it is never logged or written."""
    return next((environment[n] for n in KEY_NAMES if environment.get(n)), None)


def keyed(environment: Mapping[str, str], make: Callable[[str], Callable[[str, str, int], tuple[str, int]]]) -> Calls | Missing:
    """Calls with the key that an environment holds; without one, a provider whose units all fail."""
    key = api_key(environment)
    return Calls(lambda: make(key)) if key else Missing()


class Heuristic(Calls):
    """The offline stand-in as a provider."""

    def __init__(self):
        super().__init__(lambda: heuristic)
