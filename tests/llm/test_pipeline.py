import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.01"


def test_stages_keep_their_promises(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    tables = []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables.append(docs.collect())
    judged, single, mixed, encoded = tables
    kept = {r.doc_id for r in judged}
    assert all((i in kept) == bool(q) for i, q in labels.items())
    texts = collections.Counter(r.text for r in single)
    assert max(texts.values()) == 1 and {r.doc_id for r in single} <= kept
    copies = collections.Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in single}
    assert collections.Counter(r.doc_id for r in encoded) == copies
    assert list(mixed[0].asDict()) == pipeline.COLUMNS


def test_near_dedup_takes_five_words(spark):
    words = [f"w{i}" for i in range(245)]
    rows = [(1, " ".join(words[:200]), "en", "s", 0), (2, " ".join(words), "en", "s", 0), (3, " ".join(words[::-1]), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.dedup_stage(spark, docs, DATA).collect()) == [1, 3]


def test_repeated_and_null_ids(spark):
    text = lambda k, n=50: " ".join(f"{k}x{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("a")), (1, text("b")), (None, text("c")), (None, text("c")), (None, text("d")), (2, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.text for r in pipeline.dedup_stage(spark, docs, DATA).collect()]
    assert sorted(got) == sorted(text(k) for k in "abcd")
    rows = [(None, text(k, 20), s) for k in range(30) for s in ("s", "t", "u")] + [(7, text(k, 20), "u") for k in range(30)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    # weights 1, 2, 3 of 2,400 words: sources take 400, 800 and 1,200
    taken = collections.Counter(r.source for r in pipeline.mixing_stage(spark, docs, DATA).collect())
    assert taken == {"s": 20, "t": 40, "u": 60}


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that stages use inside."""
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (None, "h i j k l m", None, None, None), (2, None, None, None, None), (3, "", "en", "t", 0), (4, "word " * 30000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("x") for c in ("row", "number", "score", "size", "key", "held_out", "shard", "part", "position", "copy", "keep_text", "one")})


@pytest.mark.parametrize("k", range(4))
def test_stages_of_odd_rows_and_empty_tables(spark, k):
    name, stage = pipeline.STAGES[k]
    docs = odd(spark)
    got = stage(spark, docs, DATA)
    rows = got.collect()
    assert got.columns == (pipeline.COLUMNS if k < 3 else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    ids = collections.Counter(str(r.doc_id) for r in rows)
    if name == "near_dedup":  # one of the repeated rows; texts without words are linked with nothing
        assert ids == {"1": 1, "None": 1, "2": 1, "3": 1, "4": 1}
    elif name == "mixing":  # weights 1, 2 and 3 for s, t and null; t has no words, null at most 3 times its own
        assert ids["2"] == ids["3"] == 1 and ids["None"] == 3 and ids["4"] <= 3
    elif name == "byte_bpe":
        assert ids == {"1": 2, "None": 1, "2": 1, "3": 1, "4": 1}
    assert set(ids) <= {"1", "None", "2", "3", "4"}
    assert stage(spark, docs.limit(0), DATA).collect() == []


def test_stages_equal_plain_ones(spark):
    """Near-dedup against brute force over five-word sets, mixing against its targets, ids against the tokenizer's library."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = documents.collect()

    def words(t):
        return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {rows[i].doc_id: rows[find(i)].doc_id for i in range(len(rows))}
    kept = [r.doc_id for r in pipeline.dedup_stage(spark, documents, DATA).collect()]
    assert len(kept) == len(set(groups.values())) and {groups[i] for i in kept} == set(groups.values())
    mixed = pipeline.mixing_stage(spark, documents, DATA).collect()
    text = {r.doc_id: r.text for r in rows}
    assert all(text[r.doc_id] == r.text for r in mixed)
    size, taken = collections.Counter(), collections.Counter()
    for r in rows:
        size[r.source] += len(words(r.text))
    for r in mixed:
        taken[r.source] += len(words(r.text))
    target, names = {}, sorted(size)
    weight, free = {s: i % 3 + 1 for i, s in enumerate(names)}, set(names)
    while free:
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        target |= {s: 3 * size[s] for s in over} if over else {s: level * weight[s] for s in free}
        free -= over or set(free)
    copies = collections.Counter(r.doc_id for r in mixed)
    for s in names:  # never over, and what is missing is less than any document that could still be taken
        passes = min(3, int(target[s] // max(size[s], 1)))
        more = [len(words(r.text)) for r in rows if r.source == s and words(r.text) and copies[r.doc_id] == passes < 3]
        assert 0 <= target[s] - taken[s] < min(more, default=1)
