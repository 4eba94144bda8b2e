"""Operator 8: a quality classifier of histogram gradient-boosted trees over document statistics.

Statistics are computed over whole texts, vectorised over many texts at once. Trees are grown on
histograms of binned statistics, level by level, all nodes of a level together; trained trees are
complete, flattened into arrays in heap order, and traversed for all rows and trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import LOWER, NOT_SPACE, hashes, slices, words

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "punctuation", "symbol", "exclamation", "bar", "star", "non_ascii", "lines", "line_bytes",
    "distinct_words", "distinct_pairs", "distinct_lines", "top_word", "symbol_ended", "upper_words", "bare_symbols", "long_words", "stops", "distinct_bytes", "ended_lines",
]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, LETTER, DIGIT = _class(bytes(range(65, 91))), _class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)])), _class(b"0123456789")
PUNCTUATION, SYMBOL = _class(b".,;:!?'\"()-"), _class(b"*$%&#@|^~<>{}[]\\/_=+`")
_NEWLINE = _class(b"\n")


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; all 0 for an empty one."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off]).astype(np.float64)
    starts, lengths = words(data, off)
    first = np.searchsorted(starts, off)
    doc = np.repeat(np.arange(n), np.diff(first))
    n_words = np.diff(first).astype(np.float64)
    by_word = lambda mask: np.bincount(doc, weights=mask, minlength=n) / np.maximum(n_words, 1)
    h = hashes(LOWER[data], starts, lengths)
    last, head = data[starts + lengths - 1] if len(starts) else data[:0], data[starts] if len(starts) else data[:0]
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    uppers = np.concatenate([[0], np.cumsum(UPPER[data])])
    word_letters, word_uppers = letters[starts + lengths] - letters[starts], uppers[starts + lengths] - uppers[starts]
    lines, line_lengths = words(data, off, ~_NEWLINE)
    line_first = np.searchsorted(lines, off)
    line_doc = np.repeat(np.arange(n), np.diff(line_first))
    line_hash = hashes(data, lines, line_lengths)
    n_lines = np.diff(line_first).astype(np.float64)
    ended = np.isin(data[lines + line_lengths - 1], np.frombuffer(b".!?", np.uint8)) if len(lines) else np.empty(0, bool)
    distinct_words, distinct_pairs, top, distinct_lines, distinct_bytes = (np.zeros(n) for _ in range(5))
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b > a:
            _, counts = np.unique(h[a:b], return_counts=True)
            distinct_words[i], top[i] = len(counts), counts.max()
            distinct_pairs[i] = len(np.unique(h[a : b - 1] * np.uint64(3) + h[a + 1 : b])) if b - a > 1 else 1
            own = line_hash[line_first[i] : line_first[i + 1]]
            _, at = np.unique(own, return_index=True)
            distinct_lines[i] = line_lengths[line_first[i] : line_first[i + 1]][at].sum()
            distinct_bytes[i] = np.count_nonzero(np.bincount(data[off[i] : off[i + 1]], minlength=256))
    some, w = np.maximum(size, 1), np.maximum(n_words, 1)
    line_bytes = np.bincount(line_doc, weights=line_lengths, minlength=n)
    out = [
        np.log1p(size), np.log1p(n_words), total(NOT_SPACE[data]) / w, total(UPPER[data]) / np.maximum(total(LETTER[data]), 1), total(DIGIT[data]) / some, total(PUNCTUATION[data]) / some, total(SYMBOL[data]) / some,
        total(data == 33) / some, total(data == 124) / some, total(data == 42) / some, total(data >= 128) / some, n_lines / w, line_bytes / np.maximum(n_lines, 1),
        distinct_words / w, distinct_pairs / w, distinct_lines / np.maximum(line_bytes, 1), top / w, by_word(SYMBOL[last]), by_word((word_uppers > 1) & (word_uppers == word_letters)), by_word((word_letters == 0) & SYMBOL[head]), by_word(lengths > 20), by_word((lengths <= 3) & (word_letters == lengths)), distinct_bytes / 256,
        np.bincount(line_doc, weights=ended, minlength=n) / np.maximum(n_lines, 1),
    ]
    return np.where(size[:, None] > 0, np.stack(out, 1), 0.0)


class Trees:
    """Boosted complete trees of one depth: feature and threshold of inner nodes in heap order, values of leaves."""

    def __init__(self, base: float, features: np.ndarray, thresholds: np.ndarray, values: np.ndarray):
        self.base, self.features, self.thresholds, self.values = base, features, thresholds, values

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1, all rows and trees at once."""
        count, inner = self.features.shape
        if not count:
            return np.full(len(x), self.base)
        tree, node = np.arange(count)[None, :], np.zeros((len(x), count), np.int64)
        row = np.arange(len(x))[:, None]
        while node.size and node[0, 0] < inner:
            node = 2 * node + 1 + (x[row, self.features[tree, node]] > self.thresholds[tree, node])
        return self.base + self.values[tree, node - inner].sum(1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-self.margin(x))) if len(x) else np.empty(0)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: float = 2.0) -> Trees:
    """Grow trees on histograms of gradients and curvatures of the logistic loss."""
    none = np.zeros((0, (1 << depth) - 1), np.int64)
    if not len(y) or y.min() == y.max():  # nothing to learn: no labels, or all alike
        return Trees(0.0 if not len(y) else float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), none, none.astype(float), np.zeros((0, 1 << depth)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    m, base = x.shape[1], float(np.log(y.mean() / (1 - y.mean())))
    f, offset = np.full(len(y), base), np.arange(m)[None, :] * bins
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, c = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        tf, tt = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        for level in range(depth):
            width = 1 << level
            cell = (node[:, None] * (m * bins) + offset + binned).ravel()
            hist = [np.bincount(cell, weights=np.repeat(v, m), minlength=width * m * bins).reshape(width, m, bins) for v in (g, c)]
            gl, cl = (np.cumsum(v, 2)[:, :, :-1] for v in hist)
            gt, ct = (v.sum(2)[:, :, None] for v in hist)
            gain = gl**2 / (cl + l2) + (gt - gl) ** 2 / (ct - cl + l2) - gt**2 / (ct + l2)
            gain = np.where((cl >= least) & (ct - cl >= least), gain, -1.0).reshape(width, -1)
            best = gain.argmax(1)
            split = gain[np.arange(width), best] > 1e-6
            feature, at = best // (bins - 1), best % (bins - 1)
            for k in range(width):
                if split[k] and at[k] < len(edges[feature[k]]):
                    tf[width - 1 + k], tt[width - 1 + k] = feature[k], edges[feature[k]][at[k]]
            right = x[np.arange(len(y)), tf[width - 1 + node]] > tt[width - 1 + node]
            node = 2 * node + right
        leaf = rate * np.bincount(node, weights=g, minlength=1 << depth) / (np.bincount(node, weights=c, minlength=1 << depth) + l2)
        f = f + leaf[node]
        features.append(tf)
        thresholds.append(tt)
        values.append(leaf)
    return Trees(base, np.stack(features), np.stack(thresholds), np.stack(values))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of an id in decimal, modulo n; of a null id that of no bytes."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Trees:
    """Trees learned from labels.quality of documents whose id's remainder by 3 is not 1.

    At most `sample_rows` labelled ids, those with the smallest hashes. Null labels don't count; of
    several labels of an id the larger counts, of several texts of an id the first in order.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(remainder(F.col("doc_id"), 3) != 1)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(statistics(data, off)), pa.list_(pa.float64()))], ["quality", "x"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    rows = found.select("text", "quality").mapInArrow(run, "quality int, x array<double>").toPandas()
    rows = rows.iloc[np.lexsort(np.stack([np.asarray(v) for v in rows["x"]]).T)] if len(rows) else rows  # the order of arrival is not to matter
    return train(np.stack(list(rows["x"])) if len(rows) else np.zeros((0, len(STATISTICS))), rows["quality"].to_numpy(np.float64))


def score(documents: DataFrame, trees: Trees, columns: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents (and further columns of it).

    Reads doc_id and text. Null texts count as empty; empty texts get a score too. A null doc_id
    stays null. Repeated rows each give a row; other columns are ignored; nothing is shuffled.
    """
    extra = documents.select(*(columns or []))
    fields = [f for f in extra.schema if f.name not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in slices(batches):
            p = trees(statistics(data, off))
            kept = [batch.column("_" + f) for f in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array(p >= 0.5).cast(pa.int32()), *kept] if names else [batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array(p >= 0.5).cast(pa.int32())], result)

    names = [f.name for f in fields]
    with_text = ["text"] if names else []
    result = ["doc_id", *with_text, "held_out", "score", "predicted", *("_" + f for f in names)]
    types = {"doc_id": "long", "text": "string", "held_out": "boolean", "score": "double", "predicted": "int"} | {"_" + f.name: f.dataType.simpleString() for f in fields}
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), *(F.col(f).alias("_" + f) for f in names))
    return read.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in result))
