"""CSV files as text, in splits and whole, against pandas."""

import io

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.sources import csvtext, files

CASES = {
    "ints.csv": b"x,y\n1,2\n03,4\n",
    "mixed.csv": "naïve,b\n1,x\n2,\n".encode(),
    "latin.csv": "naïve,b\n1,é\n".encode("latin-1"),
    "floats.csv": b"a,b\n1,2.50\n3,\n",
    "gap.csv": b"a,b\n1,2\n,4\n",
    "text.csv": b'a,"b ""q"""\n"x, y",1\n"say ""hi""",2\n',
    "truth.csv": b"a,b\nTrue,1\nfalse,2\n",
    "truth_gap.csv": b"a,b\nTrue,1\n,2\n",
    "many.csv": b"k,v\n" + b"".join(b"%d,v%d\n" % (i, i) for i in range(1234)),
    "late.csv": b"k,v\n" + b"".join(b"%d,%d\n" % (i, i) for i in range(500)) + b"x,1\n",
    "late_float.csv": b"k,v\n" + b"".join(b"%d,%d\n" % (i, i) for i in range(500)) + b"1,1.5\n",
    "short.csv": b"a,b,c\n1\n2,3\n",
    "twice.csv": b"a,a,\n1,2,3\n",
    "header.csv": b"a,b\n",
    "crlf.csv": b"a,b\r\n1,2\r\n\r\n3,4\r\n",
    "bom.csv": "a,b\n1,2\n".encode("utf-8-sig"),
    "lines.csv": b'a,b\n"one\ntwo",2\n',
    "big.csv": b"a,b\n1e3,123456789012345678\n-2,+5\n",
}


def by_pandas(content: bytes) -> str:
    try:
        table = pd.read_csv(io.BytesIO(content), index_col=False)
    except UnicodeDecodeError:
        table = pd.read_csv(io.BytesIO(content), encoding="latin-1", index_col=False)
    rows = [f"Row {i + 1}: " + " | ".join(f"{c}: {v}" for c, v in row.items()) for i, (_, row) in enumerate(table.head(10).iterrows())]
    more = [f"... and {len(table) - 10} more rows"] if len(table) > 10 else []
    return "\n".join([f"CSV file with {len(table)} rows and {len(table.columns)} columns", f"Columns: {', '.join(map(str, table.columns))}", "\nData sample:", *rows, *more])


@pytest.mark.parametrize("name", CASES)
def test_whole_files_as_pandas(name):
    assert csvtext.whole_text(CASES[name]) == by_pandas(CASES[name])


def test_files_of_different_headers_in_splits(spark, tmp_path):
    for name, content in CASES.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x,y\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # large files have several splits
    try:
        got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_csv_documents(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {name: by_pandas(content) for name, content in CASES.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["1", "2.5", "-3", "", "NA", "x y", "True", "false", "1e2", "inf", " 4", "é"]), min_size=2, max_size=2), min_size=1, max_size=12))
def test_kinds_as_pandas(rows):
    content = ("a,b\n" + "".join(",".join(r) + "\n" for r in rows)).encode()
    assert csvtext.whole_text(content) == by_pandas(content)
