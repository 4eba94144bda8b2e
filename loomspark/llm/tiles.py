"""Operators 1 and 5: search of a stated query set among all vectors.

Both deal vectors into shards and queries into blocks, bring every block to every shard, and let
one task at a time work on one block against one shard. What a task finds is a bounded list for
each query; lists are merged by a tree, `FAN` shards at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.tables import written

#: Vectors in a shard, about; queries in a block, about (every vector is copied for each block, every query for each shard); shards whose lists are merged at once; queries of a tile.
SHARD, BLOCK, FAN, TILE = 32_768, 32_768, 16, 512
#: Bytes of a shard's or block's vectors as doubles, at most: those of wide vectors have fewer rows.
VECTOR_BYTES = 16 << 20


def clean(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of rows with an id and only finite components."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Vectors as rows of a matrix for each column, all of one width; shorter ones count as filled with zeros."""
    lists = [c.combine_chunks() for c in columns]
    sizes = [np.diff(c.offsets.to_numpy()) for c in lists]
    width = max((int(n.max()) for n in sizes if len(n)), default=0)
    out = []
    for c, n in zip(lists, sizes, strict=True):
        flat = c.flatten().to_numpy(zero_copy_only=False)
        if (n == width).all():
            out.append(flat.reshape(len(n), width).astype(np.float64, copy=False))
        else:
            x = np.zeros((len(n), width))
            x[np.arange(width)[None, :] < n[:, None]] = flat
            out.append(x)
    return out


def search(vectors: DataFrame, queries: DataFrame, task: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]], score: str, k: int, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of all shards, as found by `task` in each.

    vectors is a written table; its rows are dealt by their places, so that no id or vector draws
    rows together. task(queries, shard) gets two tables with the columns of the inputs and returns
    query_id, vec_id and score of at most a bounded number of rows for each query.
    """
    n, m = vectors.count(), queries.count()
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 0)
    shard_rows, block_rows = (min(rows, max(1, VECTOR_BYTES // (8 * width))) for rows in (shard_rows, block_rows))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    # every block meets every shard: the block is one key, the shard another
    numbers = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks))).withColumn("shard", numbers(shards))
    right = vectors.withColumn("shard", F.pmod(F.xxhash64(F.lit(2), F.monotonically_increasing_id()), F.lit(shards))).withColumn("block", numbers(blocks))
    layout = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if score == "long" else pa.float64()), ("shard", pa.int64())])

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return layout.empty_table()
        q, v, s = task(a, b)
        return pa.table([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, layout.field("score").type), pa.array(np.full(len(q), key[1].as_py()), pa.int64())], schema=layout)

    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(run, f"query_id long, vec_id long, score {score}, shard long")
    best = lambda *by: Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")
    while shards > FAN:
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN)).withColumn("rank", F.row_number().over(best("shard"))).where(F.col("rank") <= k).drop("rank")
        shards = -(-shards // FAN)
    return found.withColumn("rank", F.row_number().over(best())).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _head(scores: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest, ties to smaller ids; columns come in order of id. own: places that don't count."""
    q, c = scores.shape
    if c > k:
        held = np.where(own, np.iinfo(np.int64).min, scores)
        edge = np.partition(held, c - k, axis=1)[:, c - k]
        over = ~own & (scores > edge[:, None])
        level = ~own & (scores == edge[:, None])
        room = k - over.sum(1)
        level &= np.cumsum(level, axis=1) <= room[:, None]  # the first of equals have the smaller ids
        return np.nonzero(over | level)
    return np.nonzero(~own)


def exact_top_k(embeddings: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """Operator 1: exact top-k by integer inner product of floor(scale * x).

    Tiles are products of a query block and a shard; each tile keeps its k best of each query by
    partial selection, and the lists are merged by a tree. Candidates are the rows of another
    vec_id than the query's. Vectors that are null or hold null or non-finite components and rows
    without a vec_id take no part; vectors of unequal length count as filled with zeros; repeated
    rows are candidates like others (a query that stands in several rows asks once, with the
    first of its vectors in order). Ties go to the smaller vec_id. Products beyond 53 bits are
    computed in 64-bit integers; scores beyond 63 bits count as the
    largest or smallest of 63 bits. Other columns are
    ignored. Returns query_id, rank (from 1), vec_id, score.
    """
    whole = clean(embeddings).withColumn("v", F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)))
    whole = written(whole)
    asked = written(whole.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))

    def task(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked, ids = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, y = matrix(a["v"], b["v"])
        ids, y = ids[order], y[order]
        out = [_tile(asked[i : i + TILE], x[i : i + TILE], ids, y, k) for i in range(0, len(x), TILE)]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return search(whole, asked, task, "long", k, shard_rows, block_rows)


def _tile(asked: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id and score of the k best of some queries among vectors in order of id."""
    most_x, most_y = float(np.abs(x).max(initial=0)), float(np.abs(y).max(initial=0))
    bound = most_x * most_y * max(1, x.shape[1])
    if bound < 2**53:
        scores = (x @ y.T).astype(np.int64)
    elif bound < 2**63 and max(most_x, most_y) < 2**63:
        scores = x.astype(np.int64) @ y.astype(np.int64).T
    else:
        scores = np.array([[int(v) for v in r] for r in x], object).reshape(x.shape) @ np.array([[int(v) for v in r] for r in y], object).reshape(y.shape).T
        scores = np.clip(scores, 1 - 2**63, 2**63 - 1).astype(np.int64)
    i, j = _head(scores, asked[:, None] == ids[None, :], k)
    return asked[i], ids[j], scores[i, j]


class Codes:
    """Learned rotated binary codes: principal axes, then rotations that bring the signs closest (several, for longer codes)."""

    def __init__(self, sample: np.ndarray, rotations: int = 2, rounds: int = 15, seed: int = 7):
        rng = np.random.default_rng(seed)
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        _, axes = np.linalg.eigh(x.T @ x)
        self.rotations = []
        for _ in range(rotations):
            r, _ = np.linalg.qr(rng.standard_normal(axes.shape))
            y = x @ axes
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.sign(y @ r).T @ y)
                r = (u @ w).T
            self.rotations.append(axes @ r)
        self.rotation = np.hstack(self.rotations)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Substrings of 16 bits, a row for each vector."""
        bits = (x @ self.rotation) > 0
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 16)))
        return np.packbits(bits, axis=1).view(np.uint16)


_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
#: All substrings by their number of ones, and how many have at most so many.
_MASKS = np.argsort(_ONES, kind="stable").astype(np.uint16)
_UPTO = np.cumsum(np.bincount(_ONES))


class Index:
    """A shard's substring tables: for each substring the rows in order of its value, and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = [(np.argsort(s, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << 16))])) for s in codes.T]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows in the buckets that may hold codes within a Hamming radius, in order.

        By the pigeonhole principle such a row is within r div m of the code in one of the first
        r mod m + 1 substrings, or within one less in one of the others (m in all).
        """
        near, m = np.zeros(len(self.codes), bool), len(self.tables)
        for s, (order, first) in enumerate(self.tables):
            r = min(radius // m - (s > radius % m), 16)
            if r >= 0:
                buckets = (_MASKS[: _UPTO[r]] ^ code[s]).astype(np.int64)
                a, n = first[buckets], first[buckets + 1] - first[buckets]
                a, n = a[n > 0], n[n > 0]
                near[order[np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)]] = True
        return np.flatnonzero(near)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows within a Hamming radius of a code: those probed whose whole codes are."""
        rows = self.probed(code, radius)
        return rows[_ONES[self.codes[rows] ^ code].sum(1, dtype=np.int32) <= radius]


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would overflow or vanish brought to about 1."""
    most = np.abs(x).max(1, keepdims=True)
    odd = (most > 1e100) | (most < 1e-100)
    return x / np.where(odd, most, 1.0) if odd.any() else x


def fit(vectors: DataFrame, k: int, sample_rows: int, recall: float) -> tuple[Codes, int] | None:
    """Codes and the Hamming radius, from at most `sample_rows` vectors.

    The k nearest of all rows are as near as that part of k which falls to the sample (one at
    least); the radius holds the share `recall` of those.
    """
    n = vectors.count()
    rows = vectors.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 20)) < int(min(1.0, 1.2 * sample_rows / max(n, 1)) * (1 << 20))).limit(sample_rows).select("v").toArrow()["v"] if n else None
    x = matrix(rows)[0] if rows is not None and len(rows) else np.zeros((0, 0))
    x = x[(np.abs(x) > 0).any(1)] if x.size else x
    if len(x) < 2:
        return None
    codes = Codes(x)
    c, unit = codes(x), x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, len(x), max(1, len(x) // 500))
    cos = unit[asked] @ unit.T
    cos[np.arange(len(asked)), asked] = -2
    kk = min(max(1, -(-k * len(x) // n)), len(x) - 1)
    top = np.argpartition(-cos, kk - 1, axis=1)[:, :kk]
    far = _ONES[c[asked][:, None, :] ^ c[top]].sum(2, dtype=np.int32)
    return codes, int(np.quantile(far, recall))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5, sample_rows: int = 8_192, recall: float = 0.96, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """Operator 5: approximate nearest neighbours by multi-index hashing, reranked by cosine.

    Codes and the radius are learned on a sample of at most `sample_rows`; every row is indexed.
    Equal vectors are indexed once, with the k + 1 smallest of their ids, which is all that an
    answer can hold of them (equal cosines go to the smaller ids). In a shard, probing retrieves
    every code within the radius. A query that gets fewer than k that way is answered by comparing
    it with all rows. Candidates are the rows of another vec_id than the query's.

    Vectors that are null, zero or hold null or non-finite components and rows without a vec_id
    take no part; shorter vectors count as filled with zeros; a query that stands in several rows
    asks once, with the first of its vectors in order; repeated rows count once. Other columns are
    ignored; an empty table gives no rows. Returns query_id, rank (from 1), vec_id, score.
    """
    rows = clean(embeddings).where(F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    # copies are told by two hashes of the vector, so that the vectors are shuffled once
    rows = rows.withColumns({"one": F.xxhash64("v"), "two": F.xxhash64(F.lit(7), "v")})
    copies = ["one", "two"]
    # their smallest ids by rank within the group, dealt by a salt first so that no task gets them all
    by_salt = Window.partitionBy(*copies, "salt").orderBy("vec_id")
    ids = rows.select(*copies, "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64(F.lit(4), "vec_id"), F.lit(64)))
    ids = ids.withColumn("r", F.row_number().over(by_salt)).where(F.col("r") <= k + 1).groupBy(*copies).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    classes = written(rows.groupBy(*copies).agg(F.first("v").alias("v")).join(ids, copies).select("v", "ids", F.col("ids")[0].alias("vec_id")))
    asked = written(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    fitted = fit(classes, k, sample_rows, recall)

    def task(a: pa.Table, b: pa.Table, probe: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = (_scaled(z) for z in matrix(a["v"], b["v"]))
        probe = probe and fitted is not None and fitted[0].rotation.shape[0] == x.shape[1]
        index = Index(fitted[0](y)) if probe else None
        codes = fitted[0](x) if probe else None
        norm_y = np.sqrt((y * y).sum(1))
        lists = b["ids"].combine_chunks()
        members, first = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for i, q in enumerate(a["vec_id"].to_numpy()):
            near = index.within(codes[i], fitted[1]) if probe else np.arange(len(y))
            if not len(near):
                continue
            if len(near) > k + 1:  # the query's own class is one of them at most; rounding can't drop one of the k + 1
                rough = (y[near] @ x[i]) / norm_y[near]
                near = near[rough >= (cut := np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]) - 1e-9 * abs(cut) - 1e-300]
            score = cosine(np.broadcast_to(x[i], (len(near), x.shape[1])), y[near])
            n = first[near + 1] - first[near]
            flat, s = members[np.arange(n.sum()) + np.repeat(first[near] - np.cumsum(n) + n, n)], np.repeat(score, n)
            s, flat = s[flat != q], flat[flat != q]
            top = np.lexsort((flat, -s))[:k]
            out.append((np.full(len(top), q), flat[top], s[top]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    found = written(search(classes, asked, task, "double", k, shard_rows, block_rows))
    short = asked.join(found.groupBy("query_id").count().where(F.col("count") >= k), F.col("query_id") == F.col("vec_id"), "left_anti")
    if short.isEmpty():
        return found
    short = written(short)
    rest = search(classes, short, lambda a, b: task(a, b, probe=False), "double", k, shard_rows, block_rows)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
