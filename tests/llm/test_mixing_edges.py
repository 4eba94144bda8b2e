"""Operator 3 where the end of a target lies in large blocks: it is narrowed down, and targets are met as before."""

import collections

import pytest
from pyspark.sql import functions as F

from loomspark.llm import mixing


def missed(rows):
    """Of each source, the share of its target that isn't taken."""
    taken, target, size = collections.Counter(), {}, {}
    for r in rows:
        taken[r.source_size, r.target] += r.taken
        target[r.source_size, r.target] = r.target
        size[r.source_size] = r.source_size
    return [(target[k] - taken[k]) / target[k] for k in target if target[k]]


@pytest.mark.parametrize("equal", [False, True])
def test_ends_are_narrowed_down(spark, monkeypatch, equal):
    some = spark.range(60_000)  # short texts of five sources, so that targets can be met closely
    documents = some.select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 30 + 1).cast("int")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.floor(F.sqrt(F.col("id") % 36)).cast("string")).alias("source"), F.lit(0).cast("long").alias("n_chars"))
    if equal:  # one text without an id makes most rows of a source
        first = documents.orderBy("doc_id").limit(1)
        copies = first.withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit("some words to take")}).crossJoin(spark.range(20_000)).drop("id")
        documents = documents.unionByName(copies)
    before = mixing.taken(documents).collect()
    monkeypatch.setattr(mixing, "BLOCKS", 512)
    monkeypatch.setattr(mixing, "FILL_WORDS", 1_024)
    monkeypatch.setattr(mixing, "MANY", 100)
    seen = []
    filled = mixing._filled
    monkeypatch.setattr(mixing, "_filled", lambda df: (seen.append(df.groupBy("key").agg(F.sum("size").alias("words"), F.max("size").alias("largest")).collect()), filled(df))[1])
    after = mixing.taken(documents).collect()
    words = sum(r.size for r in after)
    assert 2 * 17 * words // 512 > 4 * 4 * 1_024  # far more than what may be looked through at once
    # the finest blocks on either side, and the documents at their ends
    assert seen[0] and all(r.words <= 8 * 1_024 + 4 * r.largest for r in seen[0])
    assert max(missed(after)) <= max(max(missed(before)), 0.005) and min(missed(after)) >= 0
    assert {(r.doc_id, r.size, r.source_size, r.target) for r in after} == {(r.doc_id, r.size, r.source_size, r.target) for r in before} and all(r.taken <= 3 * r.size for r in after)
    again = mixing.taken(documents.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    if not equal:
        assert sorted(map(key, again)) == sorted(map(key, after))


def test_components_with_hubs(spark, monkeypatch):
    from loomspark.llm import dedup

    links = [(0, i) for i in range(1, 400)] + [(399, i) for i in range(400, 800)] + [(i, i + 1) for i in range(1000, 1030)] + [(5000, 4000), (4000, 4500)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {i: 0 for i in range(800)} | {i: 1000 for i in range(1000, 1031)} | dict.fromkeys((4000, 4500, 5000), 4000)
    for hub in (4, 100_000):
        monkeypatch.setattr(dedup, "HUB", hub)
        assert {r.cls: r.comp for r in dedup.components(df).collect()} == want
        assert dedup.components(df.limit(0)).collect() == []
