"""Operators 11 to 13 against the library, numpy and plain loops."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomspark.llm import negatives, pieces, queries, whitening
from loomspark.llm.pieces import Pieces, _wire

DATA = "/root/testdata/sf0.001"
MODEL = P.path("piece_bpe_32k.model")
PARTS = ["a", "b", "in", " ", "  ", "   ", "▁", "\n", "\t", "é", "é", "漢", "字", "😀", "\x00", "<s>", "<unk>", "<0x0A>", "​", " ", "﻿", "'", "th", "the", "er", " t", "ing", "Z", "1", "2024", "\U0010ffff", "ั", "ส", "zzz"]


def content():
    with open(MODEL, "rb") as f:
        return f.read()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, text):
    ids = library.encode(text)
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def _number(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def changed(kinds=(), trainer=(), normal=()):
    """The model with kinds of some pieces and fields of its settings set anew."""
    out = b""
    for field, value in _wire(content()):
        if field == 1:
            p = dict(_wire(value))
            kind = dict(kinds).get(p[1].decode(), p.get(3, 1))
            value = b"\x0a" + _number(len(p[1])) + p[1] + b"\x15" + p.get(2, struct.pack("<f", 0)) + b"\x18" + _number(kind)
        else:
            value += b"".join(_number(k << 3) + _number(v) for k, v in {2: trainer, 3: normal}.get(field, ()))
        out += _number(field << 3 | 2) + _number(len(value)) + value
    return out


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_pieces_equal_the_library_on_random_texts():
    library, ours = sentencepiece.SentencePieceProcessor(model_file=MODEL), Pieces(content())
    rng = random.Random(2)
    for text in [*random_texts(3000), "", " ", "  ", "x" * 5000, "ab " * 2000, "the" * 3000]:
        assert ours.digest(text) == (*expected(library, text), 0)
        assert ours.encode(text) == library.encode(text)
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(300) for _ in range(rng.randrange(8))]
        assert ours.decode(ids) == library.decode(ids)


@pytest.mark.parametrize(
    "change",
    [
        {"kinds": [("▁the", pieces.USER_DEFINED), ("ing", pieces.USER_DEFINED), ("é", pieces.USER_DEFINED)]},
        {"kinds": [("▁th", pieces.UNUSED), ("er", pieces.UNUSED), ("▁▁", pieces.UNUSED)]},
        {"trainer": [(35, 0)], "kinds": [(f"<0x{i:02X}>", 1) for i in range(256)]},
        {"normal": [(3, 0)]},
        {"normal": [(4, 1)]},
    ],
    ids=["user_defined", "unused", "no_bytes", "no_first_space", "fewer_spaces"],
)
def test_pieces_of_other_models(change):
    model = changed(**change)
    library, ours = sentencepiece.SentencePieceProcessor(model_proto=model), Pieces(model)
    for text in random_texts(600, 3):
        assert ours.encode(text) == library.encode(text)
        assert ours.digest(text) == (*expected(library, text), 0)


def test_pieces_forget_and_go_on(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 20)
    library, ours = sentencepiece.SentencePieceProcessor(model_file=MODEL), Pieces(content())
    for text in random_texts(300, 4) * 2:
        assert ours.digest(text)[:3] == expected(library, text)
    assert len(ours._memo[0]) < 100


def test_pieces_take_the_librarys_word():
    library, ours = sentencepiece.SentencePieceProcessor(model_file=MODEL), Pieces(content())
    ours._short = lambda symbols: symbols  # an encoder that merges nothing
    got = ours.digest("the thing")
    assert got[:3] == expected(library, "the thing") and got[3] == 2


def test_pieces_refuse_other_vocabularies():
    with pytest.raises(ValueError, match="merge type"):
        Pieces(changed(trainer=[(3, 1)]))


def test_sentencepiece_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_sentencepiece(spark, DATA).collect()}
    assert got == {r.doc_id: (*expected(library, r.text or ""), 0) for r in docs}


def test_pieces_of_odd_documents(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x"), (2, None), (3, ""), (4, "word " * 30000), (5, " \n\t"), (6, "é" * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_tokens", "ids_sha256", "ids")})
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in pieces.round_trip(df, MODEL).collect())
    assert got == sorted((str(i), *expected(library, t or ""), 0) for i, t in rows)
    assert pieces.round_trip(df.limit(0), MODEL).collect() == []
    back = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t or "") for i, t in rows)


def plain_whitening(rows, k=4):
    """Of each row: deviation, whitened; explained; by numpy on the distinct whole vectors."""
    x = np.floor(256 * rows).astype(np.int64)
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(0)
    c = u - sums / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes.T[::-1]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ axes[:k].T / np.sqrt(values[:k]), values[:k] / values.sum()


def test_whitening_equals_numpy(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, deviation, white, explained = plain_whitening(np.stack(table.embedding).astype(float))
    got = queries.op12_embedding_whitening(spark, DATA).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 4 * len(table) and set(got.n) == {n}
    assert got.deviation.to_numpy().reshape(-1, 4)[:, 0].tolist() == deviation.tolist()
    w = got.whitened.to_numpy().reshape(-1, 4)
    assert np.abs(w * np.sign((w * white).sum(0)) - white).max() < 1e-9
    assert np.allclose(got.explained.to_numpy().reshape(-1, 4)[0], explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("x", "v", "n", "shard", "pair", "pivots", "component")})


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 3)).round(2)
    x[20:40] = x[20]  # copies stand in the fit list once
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    odd = [(100, None, 0), (101, [1.0, None, 2.0], 0), (102, [float("nan")] * 3, 0), (103, [float("inf"), 0.0, 0.0], 0), (None, [0.5, 0.5, 0.5], 0), (0, rows[0][1], 1), (104, [0.25], 0), (105, [0.25, 0.0], 0), (106, [], 0)]
    got = whitening.whiten(vectors(spark, rows + odd)).toPandas()
    whole = np.vstack([x.astype(np.float32), [[0.5] * 3], x[:1].astype(np.float32), [[0.25, 0, 0]] * 2, [[0, 0, 0]]]).astype(float)
    n, deviation, white, _ = plain_whitening(whole)
    assert len(got) == 3 * len(whole) and set(got.n) == {n} and sorted(set(got.component)) == [1, 2, 3]
    assert sorted(got.deviation) == sorted(np.repeat(deviation, 3))
    assert np.allclose(sorted(got.whitened.abs()), sorted(np.abs(white).ravel()))
    wide = whitening.fit(spark.createDataFrame([(list(map(int, 100 * v)),) for v in x], "x array<long>").distinct(), pairs=2)
    at_once = whitening.fit(spark.createDataFrame([(list(map(int, 100 * v)),) for v in x], "x array<long>").distinct())
    assert np.allclose(wide.values, at_once.values)
    assert whitening.whiten(vectors(spark, rows).limit(0)).collect() == []


def test_whitening_without_variance_and_beyond_63_bits(spark):
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None)] * 4
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i], 0) for i in range(5)])).collect()
    assert {r.component for r in line if r.whitened is None} == {2} and all(r.identity_error < 1e-9 for r in line)
    large = whitening.whiten(vectors(spark, [(1, [3e38, 0.0], 0), (2, [0.0, 1.0], 0), (3, [3e38, 5.0], 0)])).collect()
    assert {r.deviation for r in large} == {(1 << 63) - 1}


def plain_mining(rows, anchors, positives=5, negatives=3):
    rows = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64), y) for i, v, y in rows]
    out = []
    for a, v, y in rows:
        if a not in anchors:
            continue
        scored = sorted((-int(v @ w), i, z) for i, w, z in rows if i != a)
        for p, i, _ in [s for s in scored if s[2] == y][:positives]:
            fits = [(n, j) for n, j, z in scored if z != y and 50 * -p <= 100 * -n <= 95 * -p][:negatives]
            out += [(a, i, k, j, -p, -n) for k, (n, j) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [32_768, 60])
def test_mining_equals_plain_loops(spark, shard_rows):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((4, 8)) * 2
    x = np.vstack([centres[i % 4] + rng.standard_normal(8) * (0.2 if i % 3 else 1.5) for i in range(300)])
    x[100:160] = x[100]  # ties
    rows = [(i, [float(np.float32(c)) for c in v], int(rng.integers(3))) for i, v in enumerate(x)]
    odd = [(500, None, 1), (501, rows[0][1], None), (502, [float("nan")] * 8, 1), (None, rows[0][1], 1)]
    got = negatives.mine(vectors(spark, rows + odd), F.col("vec_id") % 10 == 0, shard_rows=shard_rows, block_rows=10)
    want = plain_mining(rows, {i for i in range(0, 300, 10)})
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want and want


def test_brackets_hold_every_score():
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((5, 12)) * 300
    x = np.floor(centres[rng.integers(5, size=500)] + rng.standard_normal((500, 12)) * 20)
    most = (x * x).sum(1).max()
    table, asked = negatives.PivotTable(x[::3], most), x[::7]
    low, high = negatives.brackets(table.distances(asked, True), (asked * asked).sum(1), table.distances(x), most)
    s = asked @ x.T
    assert (low <= s).all() and (s <= high).all()
    assert (high < np.sort(s, axis=1)[:, -6, None]).mean() > 0.5  # on clustered vectors the brackets leave out most rows


def test_mining_of_odd_tables(spark):
    empty = vectors(spark, [(1, [1.0], 0)]).limit(0)
    assert negatives.mine(empty, F.col("vec_id") % 2 == 0).collect() == []
    two = [(0, [1.0, 0.0], 1), (1, [1.0], 1), (2, [0.75, 9.0], 2), (3, [0.75], 2), (3, [0.75], 2), (4, [], 2), (5, [-1.0], 2)]
    got = sorted(map(tuple, negatives.mine(vectors(spark, two), F.col("vec_id") == 0).select("positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    assert got == [(1, 1, 2, 65536, 49152), (1, 2, 3, 65536, 49152), (1, 3, 3, 65536, 49152)]
    large = [(0, [3e38, 0.0], 1), (1, [3e38, 1.0], 1), (2, [1e10, 0.0], 2)]
    assert [r.positive_score for r in negatives.mine(vectors(spark, large), F.col("vec_id") == 0, low_percent=100, high_percent=100).collect()] == [(1 << 63) - 1]


def test_mining_query(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, DATA).select(columns).collect())) == sorted(con.sql(queries.OP13).project(",".join(columns)).fetchall())
