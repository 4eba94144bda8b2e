"""Operator 12: embedding whitening.

Vectors are brought to integers. The fit list holds each distinct one once; its sums are exact. One
aggregation has a generated SQL expression for every pair of dimensions of the upper triangle, the
sum of the centred products; the covariance is put together from its one row and decomposed by
LAPACK on the driver, which holds a matrix of dimensions by dimensions and no rows. Rows are then
projected on the leading components, each with what it needs of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.sources.tables import written

#: Pairs of dimensions in one aggregation (those of 127 dimensions); wider vectors take several. Largest width: its covariance has 128 MB.
PAIRS, WIDEST = 8_128, 4_096


@dataclass(frozen=True)
class Whitening:
    """n vectors, exact sums of each dimension, eigenvalues from the largest, unit eigenvectors as rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def rank(self) -> int:
        """Components whose eigenvalue is more than rounding."""
        floor = len(self.sums) * np.finfo(float).eps * max(float(self.values[0]) if len(self.values) else 0.0, 0.0)
        return int((self.values > floor).sum())


def whole(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and x (array of long, floor(scale * component)) of rows whose vector isn't null and holds only finite components."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("embedding").isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * F.lit(scale))).alias("x"))


def _filled(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists of long as rows of a matrix, filled with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _at(i: int) -> Column:
    """A dimension of x; vectors that are shorter have 0."""
    return F.coalesce(F.get("x", F.lit(i)), F.lit(0).cast("long"))


def fit(distinct: DataFrame, pairs: int = PAIRS) -> Whitening | None:
    """Moments and components of a table of distinct x; None without rows."""
    n, width = distinct.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        return None
    if width > WIDEST:
        raise ValueError(f"vectors of {width} dimensions are wider than {WIDEST}")
    sums: list[int] = []
    for first in range(0, width, 1024):
        some = range(first, min(first + 1024, width))
        row = list(distinct.agg(*[F.try_sum(_at(i)) for i in some]).first())
        if None in row:  # beyond 63 bits: in three parts of 21 bits, the upper one with the sign
            parts = lambda x: (F.shiftright(x, 42), F.shiftright(x, 21).bitwiseAND((1 << 21) - 1), x.bitwiseAND((1 << 21) - 1))
            found = list(distinct.agg(*[F.sum(p) for i in some for p in parts(_at(i))]).first())
            row = [(a << 42) + (b << 21) + c for a, b, c in zip(*[iter(found)] * 3, strict=True)]
        sums += row
    # centred once for each row, so that a pair is one product
    centred = distinct.select(*[(_at(i).cast("double") - F.lit(s / n)).alias(f"c{i}") for i, s in enumerate(sums)])
    upper = [(i, j) for i in range(width) for j in range(i, width)]
    covariance = np.zeros((width, width))
    for k in range(0, len(upper), pairs):
        lot = upper[k : k + pairs]
        row = centred.agg(*[F.expr(f"sum(c{i} * c{j})") for i, j in lot]).first()
        for (i, j), total in zip(lot, row, strict=True):
            covariance[i, j] = covariance[j, i] = total / n
    values, axes = np.linalg.eigh(covariance)
    return Whitening(n, sums, values[::-1], axes.T[::-1])


def projected(rows: DataFrame, model: Whitening, components: int, *keys: str) -> DataFrame:
    """keys, deviation, and whitened, an array with an entry for each of the leading components (null where the eigenvalue is none)."""
    width, k = len(model.sums), min(components, len(model.sums))
    mean, n, sums = model.mean, model.n, model.sums
    real = min(k, model.rank)
    scaled = model.axes[:real] / np.sqrt(model.values[:real])[:, None]
    layout = rows.select(*keys).withColumns({"deviation": F.lit(0).cast("long"), "whitened": F.array().cast("array<double>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _filled(batch.column("x"), width)
            most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
            if width * most * most < 1 << 63:
                apart = n * x - np.array(sums, np.int64)
                deviation = (apart * apart).sum(1).tolist()
            else:  # whole numbers of any size; what 63 bits don't hold counts as the largest that they do
                deviation = [min(sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)), (1 << 63) - 1) for r in x.tolist()]
            white = (x.astype(np.float64) - mean) @ scaled.T
            lists = [[*r, *[None] * (k - real)] for r in white.tolist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(deviation, pa.int64()), pa.array(lists, pa.list_(pa.float64()))], [*keys, "deviation", "whitened"])

    return rows.select(*keys, "x").mapInArrow(run, layout)


def identity_error(distinct: DataFrame, model: Whitening, components: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over the components that have one; None if none has."""
    real = min(components, model.rank)
    if not real:
        return None
    white = projected(distinct, model, real).select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(real)])
    means = white.agg(*[F.avg(f"w{i}") for i in range(real)]).first()
    centred = white.select(*[(F.col(f"w{i}") - F.lit(m)).alias(f"w{i}") for i, m in enumerate(means)])
    upper = [(i, j) for i in range(real) for j in range(i, real)]
    row = centred.agg(*[F.expr(f"sum(w{i} * w{j})") for i, j in upper]).first()
    return max(abs(total / model.n - (i == j)) for (i, j), total in zip(upper, row, strict=True))


def whiten(embeddings: DataFrame, components: int = 4, scale: float = 256.0) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error of every row and leading component.

    Rows whose vector is null or holds null or non-finite components are dropped; shorter vectors
    count as filled with zeros, and there are as many components as dimensions at most. A null
    vec_id stays null; repeated rows and equal vectors each give their rows, but stand in the fit
    list once. A component without variance (its eigenvalue is rounding, as all are of one distinct
    vector) has a null whitened, and explained 0 if there is no variance at all; identity_error is
    over the others, null without any. Components beyond 63 bits count as the nearest that 63 bits
    hold, and so does deviation. Other columns are ignored; an empty table gives no rows.
    """
    rows = written(whole(embeddings, scale))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    distinct = written(rows.select(filled.alias("x")).distinct())
    model = fit(distinct)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not model.sums:
        return embeddings.sparkSession.createDataFrame([], out)
    k = min(components, len(model.sums))
    trace = float(model.values.sum())
    explained = F.array(*[F.lit(float(max(v, 0.0) / trace) if trace > 0 else 0.0) for v in model.values[:k]])
    error = F.lit(identity_error(distinct, model, k)).cast("double")
    each = projected(rows, model, k, "vec_id").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), error.alias("identity_error"))
