"""Operator 4: LM scoring by prediction by partial matching.

The model is a trie of byte contexts up to `order` bytes, counted over all training documents. A
byte costs what the longest context that has it gives it, and an escape for each longer context
that lacks it; what a longer context has is excluded from the shorter ones (symbol exclusion). A
context with total C and D different bytes gives a byte seen c times (2c - 1) / 2C and the escape
D / 2C; below the shortest context all remaining bytes are alike.

Since the trained trie stays as it is, and a shorter context has all bytes that a longer one has,
what exclusion takes from a context depends on the next longer one alone. It is computed once for
each node.

No process holds the trie. A byte's cost depends on its key alone (its context and itself), so each
block of documents asks for the keys it holds, once each, with its counts. The requests are dealt to
shards by a hash of a context's last bytes; a shard sums the counts, settles the keys it can, and
hands on the others and the entries of shorter contexts to shards of these. Blocks and shards grow
in number with the corpus, not in size. The answers meet their block's texts, and scoring is one
table lookup for each byte. The words of the unigram base are asked for in the same way.

A text is modelled as its tokens: A-Z lower-cased, words without white space, each closed by a
space, then one end mark (a line feed, which no word holds). The score is therefore comparable
with the unigram base, which spreads its probability over the same sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import LOWER, hashes, mix, once, slices, utf8, words
from loomspark.llm.quality import remainder
from loomspark.sources.tables import written

#: Bytes that a modelled text can hold: all but four kinds of white space.
ALPHABET = 252
END, SPACE = 10, 32
#: Length of the longest context; bytes of text in a block (the larger, the fewer keys are asked for twice).
ORDER, BLOCK = 6, 1 << 26
#: Keys that a task holds before it sums them up; shards for each block.
FLUSH, SHARDS = 1 << 20, 2
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def stream(low: np.ndarray, off: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all modelled bytes (the byte lowest, its context above), and where each text's keys begin and end."""
    n = len(off) - 1
    first = np.searchsorted(starts, off)
    n_words = np.diff(first)
    spans = np.concatenate([[0], np.cumsum(lengths + 1)])
    size = spans[first[1:]] - spans[first[:-1]] + 1  # words, spaces, end mark
    at = np.concatenate([[0], np.cumsum(size)])
    pads = order * (np.arange(n) + 1)
    out = np.full(int(at[-1]) + order * n, SPACE, np.uint8)
    doc = np.repeat(np.arange(n), n_words)
    place = spans[:-1] + doc + pads[doc]  # of each word's first byte: earlier words, end marks, pads
    within = np.arange(int(lengths.sum())) - np.repeat(spans[:-1] - np.arange(len(lengths)), lengths) if len(lengths) else np.empty(0, np.int64)
    out[within + np.repeat(place, lengths)] = low[within + np.repeat(starts, lengths)]
    begin = at[:-1] + pads
    out[begin + size - 1] = END
    for k in range(1, order + 1):
        out[begin - k] = END
    keys = np.zeros(len(out), np.uint64)
    for k in range(order + 1):
        keys[k:] |= out[: len(out) - k].astype(np.uint64) << np.uint64(8 * k)
    real = np.ones(len(out), bool)
    for k in range(1, order + 1):
        real[begin - k] = False
    return keys[real], at


class Table:
    """Places of 64-bit keys, by open addressing over numpy arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.size = np.uint64(64 - bits), 1 << bits
        self.place = np.full(self.size, -1, np.int32)
        self.keys = keys
        at, todo = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(todo):
            free = self.place[at[todo]] < 0
            self.place[at[todo[free]]] = todo[free]
            todo = todo[self.place[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & (self.size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key among the table's, -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        found = self.place[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & (self.size - 1)
            found[open_] = self.place[at[open_]]
            f = found[open_]
            open_ = open_[(f >= 0) & (self.keys[f] != keys[open_])]
        return found


class Model:
    """The trie from contexts of `order` bytes down to `lowest`, an entry for each context and byte seen after it; keys are sorted.

    It may hold a part of the corpus's keys, if that has all of each context of `lowest` bytes.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, lowest: int = 0):
        self.order, self.lowest = order, lowest
        by_order = []
        for k in range(order, lowest - 1, -1):
            if k < order:
                # update exclusion: a shorter context counts a byte once for each longer context that met it
                keys, counts = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
            nodes, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            by_order.insert(0, (keys, counts, nodes, of, np.bincount(of, weights=counts, minlength=len(nodes)), np.bincount(of, minlength=len(nodes)).astype(np.float64)))
        self.shortest = by_order[0][:2]
        self.levels = {}
        for k, (unique, c, nodes, of, total, kinds) in enumerate(by_order, lowest):
            taken, other = np.zeros(len(nodes)), np.zeros(len(nodes))
            if k > lowest:  # what the next shorter context keeps once this one's bytes are excluded
                u, c1, n1, _, t1, k1 = by_order[k - 1 - lowest]
                of1 = np.searchsorted(n1, nodes & np.uint64((1 << 8 * (k - 1)) - 1))
                same = c1[np.searchsorted(u, unique & np.uint64((1 << 8 * k) - 1))]
                taken = t1[of1] - np.bincount(of, weights=same, minlength=len(nodes))
                other = k1[of1] - kinds
            self.levels[k] = {
                "entries": Table(unique),
                "alone": np.log10((2 * c - 1) / (2 * total[of])),
                "counts": c,
                "nodes": Table(nodes),
                "escape": np.log10(kinds / (2 * total)),
                # one more for contexts that are not there
                "kinds": np.append(kinds, 0),
                "rest": np.append(taken, 0),
                "rest_kinds": np.append(other, 0),
            }

    def __call__(self, keys: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Settles bytes in the contexts above `lowest` (of 0, all): state, and which bytes are settled.

        Rows of the state: log10 of the probability so far; of the context that was escaped from,
        what it leaves of the next one (-1 if there is none), its kinds, and the bytes excluded.
        """
        state = start(len(keys)) if state is None else state.copy()
        out, settled = state[0], np.zeros(len(keys), bool)
        todo = np.arange(len(keys))
        rest, kinds, seen = state[1], state[2], state[3]
        for k in range(self.order, self.lowest - (self.lowest == 0), -1):
            level = self.levels[k]
            own = keys & _low(k + 1)
            found = level["entries"](own)
            hit = found >= 0
            f, r = found[hit], rest[hit]
            out[todo[hit]] += np.where(r < 0, level["alone"][f], np.log10((2.0 * level["counts"][f] - 1) / (2 * np.where(r < 0, 1, r))))
            settled[todo[hit]] = True
            miss = ~hit
            todo, keys, rest, kinds, seen, own = todo[miss], keys[miss], rest[miss], kinds[miss], seen[miss], own[miss]
            node = level["nodes"](own >> np.uint64(8))
            there = node >= 0
            first, later = there & (rest < 0), there & (rest > 0)
            out[todo[first]] += level["escape"][node[first]]
            out[todo[later]] += np.log10(kinds[later] / (2 * rest[later]))
            rest, kinds, seen = np.where(there, level["rest"][node], rest), np.where(there, level["rest_kinds"][node], kinds), np.where(there, level["kinds"][node], seen)
        if self.lowest == 0:
            out[todo] -= np.log10(np.maximum(ALPHABET - seen, 1))
            settled[:] = True
        state[1, todo], state[2, todo], state[3, todo] = rest, kinds, seen
        return state, settled


def start(n: int) -> np.ndarray:
    """The state of n bytes in their longest contexts."""
    return np.stack([np.zeros(n), np.full(n, -1.0), np.zeros(n), np.zeros(n)])


def _low(n_bytes: int) -> np.uint64:
    return np.uint64((1 << 8 * n_bytes) - 1)


def steps(order: int) -> list[int]:
    """Bytes of the contexts that keys are dealt by, one deal after another: those between two are settled together. Of one byte there are 63,504 entries at most."""
    out = [order]
    while out[-1] > 1:
        out.append(max(out[-1] - 2, 1))
    return out if len(out) > 1 else [order, order]


def deal(keys: np.ndarray, k: int, n_shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that brings keys with the same last k bytes of context together, equal shards keeping their order, and shard, begin and end of each."""
    return runs((mix((keys >> np.uint64(8)) & _low(k)) % np.uint64(n_shards)).astype(np.int64))


def runs(label: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order = np.argsort(label, kind="stable")
    label = label[order]
    cuts = np.flatnonzero(np.diff(label)) + 1
    begin = [0, *cuts.tolist()] if len(label) else []
    return order, list(zip(label[begin].tolist(), begin, [*begin[1:], len(label)], strict=True)) if len(label) else []


def pack(values: np.ndarray) -> bytes:
    """An array of 8 or 4 bytes a value in few bytes; sorted integers get few ones."""
    if values.dtype == np.uint64:
        values = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), np.uint8)
    values = np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=np.uint64) if dtype == np.uint64 else values


#: Rows between blocks and shards. Kind 0: keys that a block (`of`) asks for, their counts in training texts; 1: trie entries and counts; 2: keys not settled, their blocks and states; 3: answers to a block; 4: words that a block asks for, their counts in its training texts; 5: those in all of them; 6 and 7: a shard's distinct training words and their number (`of`).
PACKED = "kind int, shard long, of long, keys binary, data binary"
_PACKED = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("of", pa.int64()), ("keys", pa.binary()), ("data", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, _PACKED.types, strict=True)], schema=_PACKED)


def _answers(keys: np.ndarray, blocks: np.ndarray, logs: np.ndarray) -> list[tuple]:
    order, parts = runs(blocks)
    keys, logs = keys[order], logs[order].astype(np.float32)
    out = []
    for block, a, b in parts:
        by = np.argsort(keys[a:b])
        out.append((3, 0, block, pack(keys[a:b][by]), pack(logs[a:b][by])))
    return out


def _open(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries and counts; keys that are asked for, their blocks and states."""
    got: dict[int, list] = {0: [], 1: [], 2: []}
    for kind, of, keys, data in zip(*(rows.column(c).to_pylist() for c in ("kind", "of", "keys", "data")), strict=True):
        if kind in got:
            got[kind].append((unpack(keys, np.uint64), of, data))
    asked = [(k, np.full(len(k), of), start(len(k))) for k, of, _ in got[0]]
    for k, _, data in got[2]:
        table = unpack(data, np.float64).reshape(5, -1)
        asked.append((k, table[0].view(np.int64), table[1:]))
    entries = [(k, unpack(data, np.int64)) for k, _, data in got[0] + got[1]]
    keys, counts = (np.concatenate([e[i] for e in entries]) if entries else np.empty(0, t) for i, t in ((0, np.uint64), (1, np.int64)))
    keys, counts = _summed(keys[counts > 0], counts[counts > 0])
    if not asked:
        return keys, counts, np.empty(0, np.uint64), np.empty(0, np.int64), start(0)
    return keys, counts, *(np.concatenate([a[i] for a in asked], axis=-1) for i in range(3))


def _settling(*args: int):
    return lambda rows: settle(rows, *args)


def word_counts(rows: pa.Table) -> list[tuple]:
    """What a shard knows of its words: answers to blocks, and how many there are."""
    rows = rows.filter(pc.equal(rows.column("kind"), 4))
    asked = [(of, packed, unpack(packed, np.uint64), unpack(data, np.int64)) for of, packed, data in zip(*(rows.column(c).to_pylist() for c in ("of", "keys", "data")), strict=True)]
    if not asked:
        return []
    keys, n = _summed(np.concatenate([k for *_, k, _ in asked]), np.concatenate([n for *_, n in asked]))
    out = [(5, 0, of, packed, pack(n[np.searchsorted(keys, k)])) for of, packed, k, _ in asked]
    return [*out, (6, 0, int((n > 0).sum()), b"", b""), (7, 0, int(n.sum()), b"", b"")]


def settle(rows: pa.Table, order: int, lowest: int, after: int, n_shards: int) -> pa.Table:
    """What a shard knows of its keys in contexts of `order` bytes down to `lowest` + 1; the rest goes to shards by contexts of `after` bytes."""
    keys, counts, asked, blocks, state = _open(rows)
    model = Model(keys, counts, order, lowest)
    # at the end of the trie the next deal settles the rest
    state, settled = model(asked, state) if lowest else (state, np.zeros(len(asked), bool))
    out = _answers(asked[settled], blocks[settled], state[0][settled]) + word_counts(rows)
    keys, counts = model.shortest
    by, parts = deal(keys, after, n_shards)
    for shard, a, b in parts:
        out.append((1, shard, 0, pack(keys[by[a:b]]), pack(counts[by[a:b]].astype(np.int64))))
    open_ = np.flatnonzero(~settled)
    by, parts = deal(asked[open_], after, n_shards)
    open_ = open_[by]
    for shard, a, b in parts:
        at = open_[a:b][np.argsort(asked[open_[a:b]], kind="stable")]
        out.append((2, shard, 0, pack(asked[at]), pack(np.concatenate([blocks[at].view(np.float64)[None], state[:, at]]).reshape(-1))))
    return _rows(out)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class _Sums:
    """Counts by key, summed up as they come."""

    def __init__(self):
        self.parts, self.size, self.limit = [], 0, FLUSH

    def add(self, keys: np.ndarray, counted: np.ndarray) -> None:
        """Keys of 63 bits, and which of them count."""
        both = np.sort(keys << np.uint64(1) | counted.astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, np.int64)
        both, n = both[first], np.diff(np.append(first, len(both)))
        self.parts.append(_summed(both >> np.uint64(1), np.where(both & np.uint64(1), n, 0)))
        self.size += len(self.parts[-1][0])
        if self.size > self.limit:
            self._merge()
            self.limit = max(FLUSH, 2 * self.size)

    def _merge(self) -> None:
        self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.size = len(self.parts[0][0])

    def pop(self) -> tuple[np.ndarray, np.ndarray] | None:
        """All sums, if there are any."""
        if not self.size:
            return None
        self._merge()
        out, self.parts, self.size, self.limit = self.parts[0], [], 0, FLUSH
        return out


def placed(read: DataFrame, block_bytes: int) -> DataFrame:
    """Written, with `block`: runs of rows of about block_bytes of text (one row at least), named by their first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = None, 0
        for batch in batches:
            blocks = []
            for row, n in zip(batch.column("row").to_pylist(), np.diff(utf8(batch.column("text"))[1]).tolist(), strict=True):
                if block is None or size + n > block_bytes:
                    block, size = row, 0
                size += n
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], [*batch.schema.names, "block"])

    return written(read.mapInArrow(run, "row long, doc_id long, held_out boolean, text string, block long"))


def requests(texts: DataFrame, order: int, dealt_by: int, n_shards: int) -> DataFrame:
    """Each block's keys and words with their counts in training texts, by shards."""
    if order > 6:
        raise ValueError("keys hold contexts of 6 bytes at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_, words_, block = _Sums(), _Sums(), None

        def sent() -> Iterator[pa.RecordBatch]:
            for kind, sums, dealt in ((0, keys_, lambda k: deal(k, dealt_by, n_shards)), (4, words_, lambda k: runs((k % np.uint64(n_shards)).astype(np.int64)))):
                if (got := sums.pop()) is None:
                    continue
                keys, n = got
                by, parts = dealt(keys)
                for i in range(0, len(parts), 500):
                    yield from _rows([(kind, shard, block, pack(keys[by[a:b]]), pack(n[by[a:b]])) for shard, a, b in parts[i : i + 500]]).to_batches()

        for rows in batches:
            _, parts = runs(rows.column("block").to_numpy())
            for name, a, b in parts:
                if name != block:
                    yield from sent()
                    block = name
                for batch, data, off in slices(iter([rows.slice(a, b - a)]), limit=1 << 20):
                    low = LOWER[data]
                    starts, lengths = words(low, off)
                    keys, at = stream(low, off, starts, lengths, order)
                    train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
                    keys_.add(keys, np.repeat(train, np.diff(at)))
                    words_.add(hashes(low, starts, lengths) >> np.uint64(1), np.repeat(train, np.diff(np.searchsorted(starts, off))))
        yield from sent()

    return texts.select("block", "held_out", "text").mapInArrow(run, PACKED)


def answers(texts: DataFrame, order: int, n_shards: int) -> tuple[DataFrame, int, int]:
    """Kind, `of` (a block), keys and data: 3, log10 of the probability of each key that the block holds; 5, the count of each word. Then the distinct words and the number of words of all training texts."""
    deals = steps(order)
    rows, found = requests(texts, order, deals[1], n_shards), []
    for i in range(len(deals) - 1):
        k, lowest, after = deals[i], deals[i + 1], deals[min(i + 2, len(deals) - 1)]
        rows = written(rows.groupBy("shard").applyInArrow(_settling(k, lowest, after, n_shards), PACKED))
        found.append(rows.where("kind in (3, 5)").select("kind", "of", "keys", "data"))
        if i == 0:
            n_words = {r["kind"]: r["n"] for r in rows.where("kind > 5").groupBy("kind").agg(F.sum("of").alias("n")).collect()}
        rows = rows.where("kind in (1, 2)")
    keys, n, *_ = _open(rows.where("kind = 1").toArrow())
    ends = texts.sparkSession.sparkContext.broadcast((keys, n, deals[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once(ends.value, lambda x: Model(*x))
        for batch in batches:
            _, _, asked, blocks, state = _open(pa.Table.from_batches([batch]))
            yield from _rows(_answers(asked, blocks, model(asked, state)[0][0])).select(["kind", "of", "keys", "data"]).to_batches()

    found.append(written(rows.where("kind = 2").mapInArrow(run, "kind int, of long, keys binary, data binary")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, n_words.get(6, 0), n_words.get(7, 0)


def score(documents: DataFrame, order: int = ORDER, block_bytes: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of documents.

    Learns from rows whose crc32(doc_id as text) mod 5 is not 1, all of them, by contexts of up to
    `order` bytes (6 at most) whatever the corpus's size. Words are told apart by 63-bit hashes; no
    vocabulary is held in one place. Null texts count as empty: one token, the end. A null doc_id
    is no text for crc32 and stays null. Repeated rows are learned and scored each. Without
    training rows all counts are 0: bytes are then alike, and the base has N = V = 0. Other columns
    are ignored; an empty table gives no rows.
    """
    read = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), F.col("text").cast("string").alias("text"))
    read = placed(read, block_bytes)
    about = read.agg(F.countDistinct("block").alias("blocks"), F.count_if(~F.col("held_out")).alias("docs")).first()
    n_blocks, docs = max(1, about["blocks"]), about["docs"]
    answered, distinct, n_all = answers(read, order, SHARDS * n_blocks)
    n_all, v_all = n_all + docs, distinct + (docs > 0)  # with the end marks
    own, rest = float(np.log10(docs + 0.5)), float(np.log10(n_all + 0.5 * (v_all + 1)))

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        def table(kind: int, dtype: type) -> tuple[Table, np.ndarray]:
            rows = known.filter(pc.equal(known.column("kind"), kind))
            keys, values = (np.concatenate([np.empty(0, t), *(unpack(d, t) for d in rows.column(c).to_pylist())]) for c, t in (("keys", np.uint64), ("data", dtype)))
            return Table(keys), values

        if not texts.num_rows:
            return pa.Table.from_batches([], SCORES)
        costs, counts = table(3, np.float32), table(5, np.int64)
        return pa.Table.from_batches([x for b in texts.to_batches() for x in scores(b, *costs, *counts)], SCORES)

    def scores(texts: pa.RecordBatch, cost: Table, costs: np.ndarray, table: Table, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch, data, off in slices(iter([texts]), limit=1 << 19):
            low = LOWER[data]
            starts, lengths = words(low, off)
            stream_keys, at = stream(low, off, starts, lengths, order)
            p = np.concatenate([[0.0], np.cumsum(costs[cost(stream_keys)], dtype=np.float64)])
            first = np.searchsorted(starts, off)
            doc, n = np.repeat(np.arange(len(off) - 1), np.diff(first)), np.diff(first) + 1
            c = counts[table(hashes(low, starts, lengths) >> np.uint64(1))]
            known = np.bincount(doc, weights=c > 0, minlength=len(off) - 1).astype(np.int64) + (docs > 0)
            base = np.bincount(doc, weights=np.log10(c + 0.5), minlength=len(off) - 1) + own - n * rest
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array(known), pa.array(np.full(len(n), n_all)), pa.array(base), pa.array(p[at[1:]] - p[at[:-1]])], schema=SCORES)

    # as many partitions as blocks on both sides, so that one has a few blocks at any size
    texts = read.select("block", "doc_id", "held_out", "text").repartition(n_blocks, "block").groupBy("block")
    known = answered.withColumnRenamed("of", "block").repartition(n_blocks, "block").groupBy("block")
    return texts.cogroup(known).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
