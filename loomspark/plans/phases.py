"""What the phases of a run took: rows, bytes, seconds, CPU and memory, one row for each phase.

A phase ends where its result is written. What passes there is observed (rows, bytes of text, seconds
of the provider) in the job that writes it; time is that of the job, CPU seconds and the largest
memory of a task are those that Spark keeps of the job's stages. Nothing runs twice for it.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.tables import written


@dataclass
class Phase:
    """One phase; peak_memory is the most execution memory that a task held, in bytes."""

    phase: str
    rows: int
    text_bytes: int
    provider_seconds: float
    seconds: float
    tasks: int
    cpu_seconds: float
    gc_seconds: float
    peak_memory: int
    output_bytes: int
    spilled_bytes: int


_TYPES = {"str": "string", "int": "long", "float": "double"}


class Phases:
    """Phases of one run, in order."""

    def __init__(self, spark: SparkSession):
        self.spark, self.done = spark, []

    def written(self, name: str, df: DataFrame) -> DataFrame:
        """As tables.written, and a phase."""
        spark, tag, seen = self.spark, f"phase-{uuid.uuid4().hex}", Observation()
        texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() == "string"]
        size = sum(texts, F.lit(0)).cast("long")
        provider = F.col("seconds") if "seconds" in df.columns else F.lit(0.0)
        observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("text_bytes"), F.coalesce(F.sum(provider), F.lit(0.0)).alias("provider_seconds"))
        spark.addTag(tag)
        began = time.perf_counter()
        try:
            out = written(observed)
        finally:
            spark.removeTag(tag)
        took = time.perf_counter() - began
        self.done.append(Phase(name, *(seen.get[k] for k in ("rows", "text_bytes", "provider_seconds")), took, **_stages(spark, tag)))
        return out

    def table(self) -> DataFrame:
        """A row for each phase."""
        return self.spark.createDataFrame([tuple(asdict(p).values()) for p in self.done], ", ".join(f"{f.name} {_TYPES[str(f.type)]}" for f in fields(Phase)))

    def seconds(self) -> float:
        return sum(p.seconds for p in self.done)


def _stages(spark: SparkSession, tag: str) -> dict[str, float]:
    """Sums, and the largest task's memory, over the stages of the jobs with a tag."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    store, sums = sc.statusStore(), {"tasks": 0, "cpu_seconds": 0.0, "gc_seconds": 0.0, "peak_memory": 0, "output_bytes": 0, "spilled_bytes": 0}
    jobs, ids = store.jobsList(None), set()
    for i in range(jobs.size()):
        job = jobs.apply(i)
        if any(str(t).endswith(tag) for t in _each(job.jobTags())):
            ids.update(_each(job.stageIds()))
    for i in ids:
        stage = store.lastStageAttempt(int(i))
        sums["tasks"] += stage.numCompleteTasks()
        sums["cpu_seconds"] += stage.executorCpuTime() / 1e9
        sums["gc_seconds"] += stage.jvmGcTime() / 1e3
        sums["peak_memory"] = max(sums["peak_memory"], stage.peakExecutionMemory())
        sums["output_bytes"] += stage.outputBytes()
        sums["spilled_bytes"] += stage.diskBytesSpilled()
    return sums


def _each(found) -> list:
    """Elements of a Scala collection."""
    it = found.iterator()
    out = []
    while it.hasNext():
        out.append(it.next())
    return out
