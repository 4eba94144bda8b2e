"""CSV files as text: counts, column names and the first rows, each file by its own header and encoding.

Large files are read in Spark's own splits of lines. What is needed of a file as a whole (its
encoding, its header, how many rows, what kind of values each column has) comes from aggregations
that combine within splits, so that one file with most lines is no hot spot; of the rows, the first
of each split and then of each file are kept. Only those are decoded and rendered.
"""

from __future__ import annotations

import csv
import io
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.sources.tables import written

#: Rows that are shown.
HEAD = 10
#: What counts as no value, and how truth is written.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TRUTH = {"True": True, "TRUE": True, "true": True, "False": False, "FALSE": False, "false": False}
#: Numbers as they may stand in a cell.
INTEGER, NUMBER = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"


def kind_of(n: int, integers: int, numbers: int, truths: int, missing: int) -> str:
    """Kind of a column: integer, float, bool or object, from how many of its cells are what. Missing values make numbers floats."""
    there = n - missing
    if integers == there and not missing and there:
        return "integer"
    if numbers == there:
        return "float"
    return "bool" if truths == there else "object"


def _value(cell: str | None, kind: str):
    if cell is None or cell in MISSING:
        return float("nan")
    return {"integer": int, "float": float, "bool": TRUTH.get}.get(kind, str)(cell)


def rendered(header: list[str], rows: list[list[str | None]], kinds: list[str], n: int) -> str:
    """Text of a file of n rows. A row of numbers of which one is a float shows all as floats."""
    names: list[str] = []
    for i, name in enumerate(header):
        name = name or f"Unnamed: {i}"
        k = 1
        while name in names:
            name, k = f"{header[i] or f'Unnamed: {i}'}.{k}", k + 1
        names.append(name)
    floats = set(kinds) == {"integer", "float"}
    lines = []
    for i, row in enumerate(rows, 1):
        cells = [_value(c, k) for c, k in zip([*row, *[None] * (len(header) - len(row))], kinds, strict=False)]
        cells = [float(c) if floats else c for c in cells]
        lines.append(f"Row {i}: " + " | ".join(f"{name}: {c}" for name, c in zip(names, cells, strict=True)))
    more = [f"... and {n - len(rows)} more rows"] if n > len(rows) else []
    return "\n".join([f"CSV file with {n} rows and {len(names)} columns", "Columns: " + ", ".join(names), "", "Data sample:", *lines, *more])


def whole_text(content: bytes) -> str:
    """rendered() of a small file, whose cells may hold line ends."""
    try:
        text = content.decode()
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    # a line that holds one empty cell is no row, as is an empty line
    table = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if r]
    if not table:
        raise ValueError("no columns")
    header, rows = table[0], table[1:]
    kinds = []
    for i in range(len(header)):
        cells = [r[i] if i < len(r) else "" for r in rows]
        there = [c for c in cells if c not in MISSING]
        kinds.append(kind_of(len(cells), sum(bool(re.search(INTEGER, c)) for c in there), sum(bool(re.search(NUMBER, c)) for c in there), sum(c in TRUTH for c in there), len(cells) - len(there)))
    return rendered(header, rows[:HEAD], kinds, len(rows))


def _cells(line: Column) -> Column:
    """Cells of a line. Every match begins with a comma, so that none is empty."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"[^,]*|[^,]*)'), F.lit(1))
    return F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'(?s)^"((?:[^"]|"")*)".*$', "$1"), F.lit('""'), F.lit('"'))).otherwise(c))


def _render(first: pd.Series, lines: pd.Series, facts: pd.Series, n: pd.Series) -> pd.Series:
    def one(header, rows, columns, count) -> str:
        by_place = {c["pos"]: c for c in columns}
        # what a row lacks is missing
        kinds = [kind_of(count, c["integers"], c["numbers"], c["truths"], c["missing"] + count - c["n"]) if (c := by_place.get(i)) else kind_of(count, 0, 0, 0, count) for i in range(len(header))]
        return rendered(list(header), [list(r) for r in rows], kinds, count)

    return pd.Series([one(*x) for x in zip(first, lines, facts, n, strict=True)], dtype=object)


def read_csv_texts(spark: SparkSession, path: str, glob: str = "*.[cC][sS][vV]") -> tuple[DataFrame, DataFrame]:
    """path and text of the CSV files under a path; and the paths of files whose cells hold line ends, which are left to whole_text().

    A file is UTF-8 if all its lines are, else Latin-1. Empty lines are no rows. A file without a
    line has no row here.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    lines = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value").where("value <> ''")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    files = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.min(F.struct("block", "at")).alias("first"), (F.count(F.lit(1)) - 1).alias("n"), F.max(quotes % 2).alias("odd"))
    files = written(files)

    # the header and the first rows, of each split and then of the file
    by_split, by_file = Window.partitionBy("path", "block").orderBy("at"), Window.partitionBy("path").orderBy("block", "at")
    shown = lines.withColumn("i", F.row_number().over(by_split)).where(F.col("i") <= HEAD + 1).withColumn("i", F.row_number().over(by_file)).where(F.col("i") <= HEAD + 1)
    raw = F.col("value").cast("binary")
    decoded = F.when(F.col("utf8"), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
    text = F.when(F.col("i") == 1, F.regexp_replace(decoded, "^﻿", "")).otherwise(decoded)
    heads = shown.join(files.where("odd = 0"), "path").select("path", "n", "i", _cells(text).alias("cells")).groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("i", "cells"))).alias("rows"))

    # kinds of the columns: numbers and truths are ASCII, so lines needn't be decoded for them
    cells = lines.select("path", "block", "at", F.posexplode(_cells(F.make_valid_utf8("value"))).alias("pos", "cell"))
    missing, is_ = F.col("cell").isin(*MISSING), lambda pattern: F.count_if(F.col("cell").rlike(pattern))
    tallies = [F.count(F.lit(1)).alias("n"), is_(INTEGER).alias("integers"), is_(NUMBER).alias("numbers"), F.count_if(F.col("cell").isin(*TRUTH)).alias("truths"), F.count_if(missing).alias("missing")]
    # the header's cells are taken off again: which line is a file's first isn't known while its lines are read
    all_cells = cells.groupBy("path", "pos").agg(*tallies)
    header = shown.where("i = 1").select("path", F.posexplode(_cells(F.make_valid_utf8(F.regexp_replace("value", "^﻿", "")))).alias("pos", "cell")).groupBy("path", "pos").agg(*tallies)
    less = lambda c: (F.col(f"a.{c}") - F.coalesce(F.col(f"h.{c}"), F.lit(0))).alias(c)
    columns = all_cells.alias("a").join(header.alias("h"), ["path", "pos"], "left").select("path", F.struct("pos", *map(less, ("n", "integers", "numbers", "truths", "missing"))).alias("c")).groupBy("path").agg(F.collect_list("c").alias("facts"))
    render = F.pandas_udf(_render, "string")
    texts = heads.join(columns, "path").select("path", render(F.col("rows")[0]["cells"], F.transform(F.slice("rows", 2, HEAD), lambda r: r["cells"]), "facts", "n").alias("text"))
    return texts, files.where("odd = 1").select("path")
