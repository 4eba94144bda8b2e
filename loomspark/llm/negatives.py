"""Operator 13: hard-negative mining by a pivot table.

A coordinate that fills every vector up to the largest norm M (and 0 for anchors) makes an inner
product s a distance d: d * d = |anchor|² + M² - 2 s. The pivot table has the distance of every
vector, and of every anchor, to some pivots. By the triangle inequality the distance of an anchor
and a vector is between the largest difference and the least sum of theirs to one pivot, which
brackets the score without the vectors. Who can't be among the answers by its bracket is left out;
the scores of the others are computed exactly, in whole numbers.

Anchors in blocks meet vectors in shards as in operator 1, twice: for positives, then for the rows
of other labels within the band that each positive's score sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.tiles import BLOCK, SHARD, matrix, search
from loomspark.sources.tables import written

#: Pivots, rows that they are chosen from at most, anchors of a tile; share of a tile's pairs from which scores come from a product of matrices.
PIVOTS, SAMPLE, TILE, DENSE = 16, 4_096, 64, 0.05
#: Brackets are this much wider than computed, relative to the numbers in them: rounding leaves no one out.
SLACK = 1e-9
#: Vectors of a run when brackets are computed.
RUN = 2_048
_LEAST = -(1 << 63)


def whole(embeddings: DataFrame, label: Column, scale: float = 256.0) -> DataFrame:
    """vec_id, label and v (floor(scale * component) as double) of rows with an id, a label and only finite components."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(v, lambda c: F.when(F.abs(c * scale) < 2.0**53, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return embeddings.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), scaled.alias("v")).where("label is not null")


class PivotTable:
    """Pivots in the space where inner products are distances, and distances to them.

    They are picked from a sample, each the one farthest from those before it. Any pivots give right
    brackets, so the sample bears on speed alone.
    """

    def __init__(self, sample: np.ndarray, most: float, pivots: int = PIVOTS):
        self.most = most
        x = np.hstack([sample, self._rest(sample)[:, None]])
        chosen = [int(np.argmax((x * x).sum(1)))] if len(x) else []
        far = np.full(len(x), np.inf)
        while chosen and len(chosen) < min(pivots, len(x)):
            far = np.minimum(far, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1)))
            if not far.max() > 0:
                break
            chosen.append(int(np.argmax(far)))
        self.pivots = x[chosen]

    def _rest(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x * x).sum(1), 0.0))

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """A row for each vector, a column for each pivot."""
        width = max(x.shape[1], self.pivots.shape[1] - 1)
        rest = np.zeros(len(x)) if anchors else self._rest(x)
        x = np.hstack([np.pad(x, ((0, 0), (0, width - x.shape[1]))), rest[:, None]])
        p = np.hstack([np.pad(self.pivots[:, :-1], ((0, 0), (0, width + 1 - self.pivots.shape[1]))), self.pivots[:, -1:]])
        return np.stack([np.sqrt(((x - one) ** 2).sum(1)) for one in p], axis=1) if len(p) else np.zeros((len(x), 0))


def brackets(asked: np.ndarray, norms: np.ndarray, rows: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible score of each anchor (a row; its distances to pivots, its squared norm) and vector (a column)."""
    low, high = np.empty((len(asked), len(rows))), np.empty((len(asked), len(rows)))
    for k in range(0, len(rows), RUN):  # runs that stay in a processor's cache
        some = slice(k, k + RUN)
        near, far = np.zeros((len(asked), len(rows[some]))), np.full((len(asked), len(rows[some])), np.inf)
        both = np.empty_like(near)
        for a, b in zip(asked.T, rows[some].T, strict=True):
            np.abs(np.subtract(a[:, None], b, out=both), out=both)
            np.maximum(near, both, out=near)
            np.minimum(far, np.add(a[:, None], b, out=both), out=far)
        with np.errstate(invalid="ignore", over="ignore"):
            whole_ = norms[:, None] + most
            slack = SLACK * (whole_ + far * far + 1)
            low[:, some], high[:, some] = (whole_ - far * far) / 2 - slack, (whole_ - near * near) / 2 + slack
    # numbers too large for doubles bracket nothing
    low[~np.isfinite(low)], high[~np.isfinite(high)] = -np.inf, np.inf
    return low, high


def scores(x: np.ndarray, y: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers where wanted, elsewhere the least number; beyond 63 bits the nearest that they hold."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, x.shape[1])
    out = np.full(wanted.shape, _LEAST, np.int64)
    if most < 2**53 and wanted.mean() > DENSE:
        product = x @ y.T
        out[wanted] = product[wanted].astype(np.int64)
        return out
    i, j = np.nonzero(wanted)
    for k in range(0, len(i), 1 << 16):
        a, b = x[i[k : k + (1 << 16)]], y[j[k : k + (1 << 16)]]
        if most < 2**53:
            s = (a * b).sum(1).astype(np.int64)
        else:
            s = [max(min(sum(int(p) * int(q) for p, q in zip(r, t, strict=True)), (1 << 63) - 1), 1 - (1 << 63)) for r, t in zip(a, b, strict=True)]
        out[i[k : k + (1 << 16)], j[k : k + (1 << 16)]] = s
    return out


def _best(held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest numbers over the least one, ties to earlier columns."""
    if held.shape[1] > k:
        edge = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k, None]
        over, level = held > edge, (held == edge) & (held > _LEAST)
        return np.nonzero(over | (level & (np.cumsum(level, axis=1) <= k - over.sum(1, keepdims=True))))
    return np.nonzero(held > _LEAST)


def _tiles(a: pa.Table, b: pa.Table, most: float):
    """Of each tile of anchors: their places, vectors and brackets; and all vectors in order of id."""
    order = np.argsort(b["vec_id"].to_numpy(), kind="stable")
    x, y = matrix(a["v"], b["v"])
    p, q = matrix(a["pivots"], b["pivots"])
    y, q = y[order], q[order]
    norms = (x * x).sum(1)
    for i in range(0, len(x), TILE):
        at = slice(i, i + TILE)
        yield at, x[at], y, order, brackets(p[at], norms[at], q, most)


def _positives(most: float, k: int):
    def task(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = []
        asked, ids, own, label = (t[c].to_numpy() for t, c in ((a, "vec_id"), (b, "vec_id"), (a, "label"), (b, "label")))
        for at, x, y, order, (low, high) in _tiles(a, b, most):
            fits = (own[at][:, None] == label[order][None, :]) & (asked[at][:, None] != ids[order][None, :])
            if len(y) > k:  # k of them score at least so much
                least = np.partition(np.where(fits, low, -np.inf), len(y) - k, axis=1)[:, len(y) - k, None]
                fits &= high >= least
            s = scores(x, y, fits)
            i, j = _best(s, k)
            out.append((asked[at][i], ids[order][j], s[i, j]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return task


def band(positive: int, low: int, high: int) -> tuple[int, int]:
    """Scores from low to high percent of a positive's, as whole numbers."""
    return -(-low * positive // 100), high * positive // 100


def _negatives(most: float, k: int, low_percent: int, high_percent: int):
    def task(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [(np.empty(0, np.int64),) * 3]
        ids, own, label = b["vec_id"].to_numpy(), a["label"].to_numpy(), b["label"].to_numpy()
        pairs = a["pairs"].to_pylist()
        for at, x, y, order, (low, high) in _tiles(a, b, most):
            other = own[at][:, None] != label[order][None, :]
            bands = [[(p["pair"], *band(p["score"], low_percent, high_percent)) for p in some] for some in pairs[at]]
            # anchors have few positives; the n-th bands of all anchors of the tile go together
            lots = []
            for n in range(max(map(len, bands), default=0)):
                rows = [r for r, x_ in enumerate(bands) if len(x_) > n]
                least, most_ = (np.array([max(min(bands[r][n][c], (1 << 63) - 1), 1 - (1 << 63)) for r in rows], np.int64)[:, None] for c in (1, 2))
                lots.append((np.array(rows), np.array([bands[r][n][0] for r in rows], np.int64), least, most_))
            fits = np.zeros_like(other)
            for rows, _, least, most_ in lots:
                fits[rows] |= other[rows] & (high[rows] >= least) & (low[rows] <= most_)
            s = scores(x, y, fits)
            for rows, numbers, least, most_ in lots:
                held = s[rows]
                held = np.where((held >= least) & (held <= most_) & fits[rows], held, _LEAST)
                i, j = _best(held, k)
                out.append((numbers[i], ids[order][j], held[i, j]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return task


def mine(
    embeddings: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: float = 256.0, pivots: int = PIVOTS, shard_rows: int = SHARD, block_rows: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    An anchor's positives are its best other rows of its label; a positive's negatives are the best
    rows of other labels that score from low_percent to high_percent of it, so that a positive below
    0 has none. label: an expression over the table's columns, its column `label` if not given.

    Rows with a null id or label, a null vector or any null or non-finite component take no part;
    vectors of unequal length count as filled with zeros. An anchor that stands in several rows asks
    once, with the first of its vectors and labels in order; repeated rows are candidates like
    others, and rows of the anchor's own id are no positives. Ties go to the smaller vec_id. Scores
    beyond 63 bits count as the nearest that 63 bits hold. Other columns are ignored; an empty table
    gives no rows. Copies made, beside the table: as in operator 1, twice.
    """
    rows = written(whole(embeddings, F.col("label") if label is None else label, scale))
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    n, most = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    share = min(1.0, 1.2 * SAMPLE / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64(F.lit(5), "vec_id", "v"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(SAMPLE).select("v").toArrow()["v"] if n else None
    table = PivotTable(matrix(picked)[0] if picked is not None and len(picked) else np.zeros((0, 0)), float(most or 0.0), pivots)

    def with_pivots(df: DataFrame, anchors: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                d = table.distances(matrix(pa.chunked_array([batch.column("v")]))[0], anchors)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(d), pa.list_(pa.float64()))], [*batch.schema.names, "pivots"])

        return df.mapInArrow(run, df.withColumn("pivots", F.array().cast("array<double>")).schema)

    vectors = written(with_pivots(rows, False))
    asked = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("a")).select("vec_id", "a.v", "a.label")
    asked = written(with_pivots(asked, True))
    found = search(vectors, asked, _positives(table.most, positives), "long", positives, shard_rows, block_rows)
    found = written(found.withColumn("pair", F.monotonically_increasing_id()))
    # at most `positives` for each anchor
    by_anchor = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.collect_list(F.struct("pair", "score")).alias("pairs"))
    again = written(asked.join(by_anchor, "vec_id"))
    mined = search(vectors, again, _negatives(table.most, negatives, low_percent, high_percent), "long", negatives, shard_rows, block_rows)
    about = found.select("pair", F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(about, mined["query_id"] == about["pair"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
