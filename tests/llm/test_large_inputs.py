"""Texts, pages, urls and vectors far larger or more ragged than usual."""

import collections

import numpy as np
from pyspark.sql import functions as F

from loomspark.llm import html, licenses, quality, tiles, urlrules

MEGA = 1 << 20


def test_texts_of_many_megabytes(spark):
    phrase = "mit license "
    rows = [(1, "word " * (MEGA // 2) + phrase), (2, "x" * (3 * MEGA)), (3, phrase * (MEGA // 16)), (4, "é " * MEGA)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0)})
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (MEGA // 2 + 2, 1, MEGA // 2, MEGA // 2, "mit")
    assert (got[2].n_words, got[2].n_base, got[2].base_labels) == (1, 0, "") and got[3].n_base == MEGA // 16 and got[4].n_words == MEGA
    scored = quality.score(df, quality.fit(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))).collect()
    assert sorted(r.doc_id for r in scored) == [1, 2, 3, 4] and all(0 <= r.score <= 1 for r in scored)


def test_pages_of_many_megabytes(spark):
    text = "word " * (MEGA // 2)
    page = lambda i: f"<body><nav>{'<a href=/>x</a>' * 100_000}</nav><article><p>{i} {text}</p>{'<p>end</p>' * 3}</article></body>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(2)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == {i: f"{i} {text.strip()}\nend\nend\nend" for i in range(2)}


def test_long_urls_and_many_paths_of_a_host(spark):
    long = "/p" + "x" * MEGA
    rules = spark.createDataFrame([("a.example", f"/d{i}/", "block") for i in range(3_000)] + [("a.example", long, "block"), ("example", "/", "allow")], "host string, path string, verdict string")
    urls = ["http://a.example/d7/x", "http://b.a.example/d2999/", "http://a.example/d7", f"http://a.example{long}y", "http://" + "l." * 500 + "a.example/d1/", "x" * MEGA]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule) for r in urlrules.judge(pages, rules).collect()}
    assert got == {0: ("block", "a.example/d7/"), 1: ("block", "a.example/d2999/"), 2: ("allow", "example/"), 3: ("block", "a.example" + long), 4: ("block", "a.example/d1/"), 5: ("allow", None)}


def test_ragged_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.standard_normal(1 + i % 9)]) for i in range(200)] + [(200, [])]
    full = np.zeros((201, 9))
    for i, v in rows:
        full[i, : len(v)] = v
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    z = np.floor(1024 * full)
    for bytes_ in (tiles.VECTOR_BYTES, 8 * 9 * 20):  # the latter: shards of 20 rows
        monkeypatch.setattr(tiles, "VECTOR_BYTES", bytes_)
        got = collections.defaultdict(list)
        for r in tiles.exact_top_k(df, F.col("vec_id") % 40 == 0).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        for q in range(0, 201, 40):
            s = (z @ z[q]).astype(np.int64)
            assert got[q] == [(i, s[i]) for i in np.lexsort((np.arange(201), -s)) if i != q][:10]
    near = collections.defaultdict(list)
    for r in tiles.nearest(df, F.col("vec_id") % 40 == 3).orderBy("query_id", "rank").collect():
        near[r.query_id].append(r.score)
    assert len(near) == 5 and all(len(x) == 5 and sorted(x, reverse=True) == x for x in near.values())
