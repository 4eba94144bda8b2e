"""Options of a run, from the session's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from loomspark.functions import text
from loomspark.operators import scoring


@dataclass(frozen=True)
class Settings:
    """What may be set as spark.loomspark.<name>. Defaults are those of the operators."""

    title: str = "loomspark"
    version: str = "1.0.0"
    confidence_threshold: float = scoring.LOW
    max_text_chars: int = text.PROMPT_TEXT
    #: Files beyond this many bytes are errors, not documents.
    max_file_size: int = 10 * 1024 * 1024
    files_per_trigger: int = 1000
    strategy: str = "auto"

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        found = {f.name: spark.conf.get(f"spark.loomspark.{f.name}", None) for f in fields(cls)}
        return cls(**{f.name: type(f.default)(found[f.name]) for f in fields(cls) if found[f.name] is not None})
