"""Operator 6: byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 so that one Aho-Corasick automaton finds every vocabulary entry in a
piece of text in one sweep. From the longest entry at each place the encoder goes forward while
adjacent tokens are compatible (merging would leave the border between them alone) and backtracks
to shorter entries where not; a place found to be a dead end is never tried again, so the work is
linear in the length of the piece and the result is that of the merges in rank order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomspark.llm.common import once

#: Entries that a worker remembers of pieces and of token pairs before it starts afresh.
MEMO = 400_000
#: Longest piece that is remembered.
MEMO_PIECE = 64
#: Largest vocabulary file that is sent to the executors.
VOCABULARY_BYTES = 64 << 20


class Bpe:
    """Encoder and decoder for a vocabulary of ranked byte strings."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token = {r: b for b, r in ranks.items()}
        self.length = {r: len(b) for b, r in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for bytes_, rank in sorted(ranks.items(), key=lambda x: x[1]):
            halves = self._halves(bytes_, rank)
            if halves is not None:  # other entries are only reached as whole pieces
                self.parts[rank] = halves
                self.automaton.add_word(bytes_.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = {r: self._prefix(self.token[r]) for r in self.parts}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[str, int, bytes]] = {}

    @classmethod
    def from_file(cls, content: bytes, pattern: str) -> Bpe:
        """From lines of a base64 entry and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}, pattern)

    def _halves(self, bytes_: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes an entry last, itself twice for one byte."""
        if len(bytes_) == 1:
            return rank, rank
        parts = [bytes_[i : i + 1] for i in range(len(bytes_))]
        while len(parts) > 2:
            found = [(self.ranks[ab], i) for i in range(len(parts) - 1) if self.ranks.get(ab := parts[i] + parts[i + 1], rank) < rank]
            if not found:
                return None
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _prefix(self, bytes_: bytes) -> int:
        """The longest shorter entry that an entry begins with, or -1."""
        for n in range(len(bytes_) - 1, 0, -1):
            if (r := self.ranks.get(bytes_[:n])) is not None and r in self.parts:
                return r
        return -1

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens in rank order leaves the border between them."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            found = self.pairs[a, b] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        # Undo merges on either side, latest first; a merge across the border that comes before
        # the last one undone would have happened.
        before = 1 << 40
        while True:
            across = self.ranks.get(self.token[a] + self.token[b])
            if across is not None and across < before:
                return False
            left, right = self.parts[a][1], self.parts[b][0]
            if left == a and right == b:
                return True
            # of equal ranks the left one is merged first
            if right == b or (left != a and a > b):
                before, a = a, left
            else:
                before, b = b + 1, right

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, length, shorter = len(piece), self.length, self.shorter
        longest = [-1] * (n + 1)
        for end, t in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length[t] + 1] = t
        ids: list[int] = []
        dead = bytearray(n + 1)
        at, t = 0, longest[0]
        while at < n:
            while t >= 0 and (dead[at + length[t]] or (ids and not self.compatible(ids[-1], t))):
                t = shorter[t]
            if t >= 0:
                ids.append(t)
                at += length[t]
                t = longest[at]
            else:
                dead[at] = 1
                if not ids:
                    raise ValueError(f"the vocabulary lacks the byte {piece[at]}")
                t = ids.pop()
                at -= length[t]
                t = shorter[t]
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return [i for p in self.pattern.findall(text) for i in self.encode_piece(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids."""
        return b"".join(map(self.token.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the bytes decoded from them."""
        memo, out = self.pieces, []
        for p in self.pattern.findall(text):
            found = memo.get(p)
            if found is None:
                ids = self.encode_piece(p.encode())
                found = ",".join(map(str, ids)), len(ids), self.decode(ids)
                if len(p) <= MEMO_PIECE:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[p] = found
            out.append(found)
        return sum([x[1] for x in out]), hashlib.sha256(",".join([x[0] for x in out]).encode()).hexdigest(), hashlib.sha256(b"".join([x[2] for x in out])).hexdigest()


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        content = f.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is over {VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(content)


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; a null text has no ids, as an empty one."""
    content = _vocabulary(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(content.value, lambda x: Bpe.from_file(x, pattern))
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select(documents["doc_id"].cast("long"), documents["text"].cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text_bytes of ids; null ids decode to no bytes."""
    content = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {int(b): base64.b64decode(a) for a, b in map(bytes.split, content.value.splitlines()) if a}
        for batch in batches:
            out = [b"".join(map(token.__getitem__, x or [])) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "text_bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text_bytes binary")


def round_trip(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of documents.

    Reads doc_id and text only. Nothing is shuffled; a task holds one Arrow batch of texts, the
    vocabulary and a bounded memo. Null text: as empty (no tokens, hashes of no bytes). Null
    doc_id: kept as null. Repeated rows: each gives its row. Empty tables give no rows. Columns
    of other names, even those of the result, are ignored.
    """
    content = _vocabulary(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(content.value, lambda x: Bpe.from_file(x, pattern))
        for batch in batches:
            n, ids, back = [], [], []
            for t in batch.column("text"):
                x = bpe.digest(t.as_py() or "")
                n.append(x[0])
                ids.append(x[1])
                back.append(x[2])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(documents["doc_id"].cast("long"), documents["text"].cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
