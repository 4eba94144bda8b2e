"""Helpers shared by the training-data operators: size-checked joins and numpy views of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; every use is of narrow rows (under about 100 bytes).
BROADCAST_ROWS = 200_000

#: The white space of the contracts, space and U+0009 to U+000D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = "[^\\x20\\x09-\\x0D]+"


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join a table to a side that is usually small and has one row for each key.

    The side's rows are counted: up to BROADCAST_ROWS it is broadcast, beyond that both sides
    are dealt by key and a salt, so that one hot key is spread over many tasks.
    """
    rows = small.count() if rows is None else rows
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), on, how)
    salts = 16
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in on] or [F.lit(0)]), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, "_salt"], how).drop("_salt")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and where each row starts and ends; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes of text (one row at least): the rows, their bytes and offsets."""
    for batch in batches:
        data, off = utf8(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


_HELD: dict = {}


def once(value, make):
    """make(value), kept in this worker process as long as `value` is the same object (that of a broadcast)."""
    if _HELD.get("value") is not value:
        _HELD.clear()
        _HELD.update(value=value, made=make(value))
    return _HELD["made"]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte and length of each run of member bytes; no run crosses rows."""
    inside = member[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = off[:-1][np.diff(off) > 0]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cuts[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after)
    return starts, ends - starts + 1


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run."""
    if not len(starts):
        return np.empty(0, np.uint64)
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    # a factor of its own for each place: by powers of one number, words of some hundred letters in the order of Thue and Morse are alike
    factors = mix(np.arange(1, int(lengths.max()) + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    values = _TABLE[data[within + np.repeat(starts, lengths)]] * factors[within]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
