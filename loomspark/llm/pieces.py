"""Operator 11: SentencePiece encoding and decoding with merge-type vocabularies.

Symbols start as single characters. An agenda holds every adjacent pair whose text is a vocabulary
piece, best score first and leftmost first among equals; the top is merged and the pairs beside it
are put on the agenda, until it is empty. Symbols that are no pieces become bytes.

Two adjacent characters that stand so in no piece can never come into one symbol, so a text is cut
between them and every part has an agenda of its own; a worker remembers short parts. Each part that
it doesn't remember is held against the sentencepiece library; where the library says otherwise, its
ids count and the part is counted.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from loomspark.llm.common import once

#: Parts of a generation (a worker remembers this one and the one before), the longest that is remembered, and the largest model file that is sent to the executors.
MEMO, MEMO_PART, MODEL_BYTES = 200_000, 64, 64 << 20
#: Fixed values of the model format: kinds of pieces, how white space is written, what an unknown piece decodes to unless the model says otherwise.
UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 2, 3, 4, 5, 6
SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
_PLACE = (1 << 40) - 1


def _wire(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(message):
        key = number()
        size = {0: 0, 1: 8, 5: 4}.get(key & 7)
        if size == 0:
            yield key >> 3, number()
            continue
        size = number() if size is None else size
        yield key >> 3, message[at : at + size]
        at += size


class Pieces:
    """Encoder and decoder for a model file of the BPE type."""

    def __init__(self, content: bytes, check: bool = True):
        self.piece: list[str] = []
        self.kind: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        normal: dict = {}
        for field, value in _wire(content):
            if field == 1:
                p = dict(_wire(value))
                self.piece.append(p.get(1, b"").decode())
                scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kind.append(p.get(3, 1))
            elif field == 2:
                trainer = dict(_wire(value))
            elif field == 3:
                normal = dict(_wire(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("the model's vocabulary is not of the merge type")
        if trainer.get(24, 0) or not normal.get(5, 1):
            raise ValueError("models that write white space after words, or as itself, are not known here")
        self.dummy, self.strip = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.plain = not normal.get(2) and not self.strip
        self.fallback = bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, UNKNOWN_TEXT.encode()).decode()
        self.unknown = self.kind.index(UNKNOWN)
        merged = [i for i, k in enumerate(self.kind) if k not in (UNKNOWN, CONTROL, BYTE)]
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in merged}, reverse=True))}
        self.rank = {self.piece[i]: order[scores[i]] for i in merged}
        self.id = {self.piece[i]: i for i in merged} | {p: i for i, (p, k) in enumerate(zip(self.piece, self.kind, strict=True)) if k in (UNKNOWN, CONTROL, BYTE)}
        self.byte = {int(self.piece[i][3:5], 16): i for i, k in enumerate(self.kind) if k == BYTE}
        self.value = {i: b for b, i in self.byte.items()}
        own = sorted((self.piece[i] for i, k in enumerate(self.kind) if k == USER_DEFINED), key=len, reverse=True)
        self.frozen = re.compile("(" + "|".join(map(re.escape, own)) + ")") if own else None
        self.unused = {self.piece[i] for i, k in enumerate(self.kind) if k == UNUSED}
        # parts are on their own if nothing that one of them does is seen in another
        self.parted = self.fallback and not own and not self.unused
        within = {a + b for p in self.rank for a, b in pairwise(p)}
        known = sorted({c for ab in within for c in ab})
        self._class = np.zeros(0x110000, np.int32)
        self._class[list(map(ord, known))] = range(1, len(known) + 1)
        self._kinds = len(known) + 1
        codes = np.array([[ord(a), ord(b)] for a, b in within] or np.zeros((0, 2)), np.int64)
        self._joined = np.sort(self._class[codes[:, 0]].astype(np.int64) * self._kinds + self._class[codes[:, 1]])
        self._table = np.zeros(self._kinds**2, bool) if self._kinds <= 8_000 else None
        if self._table is not None:
            self._table[self._joined] = True
        self.check, self.library = check, sentencepiece.SentencePieceProcessor(model_proto=content) if check or not self.plain else None
        # a character of no piece, which the library is given before a part so that the part doesn't begin the text
        self._apart = next(c for c in map(chr, (*range(1, 32), *range(0xE000, 0xF8FF))) if c not in self.id and not self._class[ord(c)])
        self._lead = len(self.library.encode(self._apart)) if check else 0
        self._special = {i for i, k in enumerate(self.kind) if k in (UNKNOWN, CONTROL, BYTE)}
        self._memo: tuple[dict[str, tuple[str, int, str, int]], dict[str, tuple[str, int, str, int]]] = {}, {}

    def normalised(self, text: str) -> str:
        """White space written as the vocabulary has it; normalisation other than that is the library's."""
        if not self.plain:
            return self.library.normalize(text)
        return (SPACE if self.dummy and text else "") + text.replace(" ", SPACE)

    def parts(self, text: str) -> list[str]:
        """A normalised text, cut where no piece goes on."""
        if not self.parted or len(text) < 2:
            return [text] if text else []
        kinds = self._class[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if self._table is not None:
            joined = self._table[kinds[:-1] * self._kinds + kinds[1:]]
        else:
            joined = np.isin(kinds[:-1].astype(np.int64) * self._kinds + kinds[1:], self._joined)
        cuts = (np.flatnonzero(~joined) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def symbols(self, part: str) -> list[str]:
        """Symbols of a part, in order, when no more pairs can be merged."""
        if self.parted and len(part) <= MEMO_PART:
            return self._short([*part])
        out, fixed = [], set()
        for i, x in enumerate(self.frozen.split(part) if self.frozen else [part]):
            if i % 2:
                fixed.add(len(out))
                out.append(x)
            else:
                out += x
        return self._merged(out, fixed)

    def _short(self, symbols: list[str]) -> list[str]:
        """As _merged, with an agenda that is the list of all pairs' ranks, searched anew each time: faster for a few symbols."""
        get, none = self.rank.get, len(self.piece)
        agenda = [get(a + b, none) for a, b in pairwise(symbols)]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], none)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], none)
        return symbols

    def _merged(self, symbols: list[str], fixed: set[int]) -> list[str]:
        n, rank = len(symbols), self.rank
        if n == 1:
            return symbols
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        origin: dict[str, tuple[str, str]] = {}
        agenda: list[int] = []

        def offer(left: int, right: int) -> None:
            if left < 0 or right >= n or left in fixed or right in fixed:
                return
            text = symbols[left] + symbols[right]
            if (r := rank.get(text)) is not None:
                heapq.heappush(agenda, r << 40 | left)
                if text in self.unused:
                    origin[text] = symbols[left], symbols[right]

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            top = heapq.heappop(agenda)
            left = top & _PLACE
            right = after[left]
            # an entry is out of date if one of its symbols has been merged since
            if not symbols[left] or right >= n or rank.get(text := symbols[left] + symbols[right]) != top >> 40 or left in fixed or right in fixed:
                continue
            symbols[left], symbols[right] = text, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        out = [s for s in symbols if s]
        return [x for s in out for x in self._used(s, origin)] if self.unused else out

    def _used(self, symbol: str, origin: dict[str, tuple[str, str]]) -> list[str]:
        """An unused piece gives way to the two it was merged from."""
        out, todo = [], [symbol]
        while todo:
            s = todo.pop()
            if s in self.unused and s in origin:
                todo += reversed(origin[s])
            else:
                out.append(s)
        return out

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part of a normalised text."""
        symbols = self.symbols(part)
        found = [self.id.get(s, self.unknown) for s in symbols]
        if self.unknown not in found:
            return found
        out: list[int] = []
        unknown = False
        for s in symbols:
            i = self.id.get(s, self.unknown)
            if i != self.unknown:
                out.append(i)
            elif self.fallback:
                out += [self.byte[b] for b in s.encode()]
            elif not unknown:  # unknown symbols side by side are one
                out.append(i)
            unknown = i == self.unknown
        return out

    def _checked(self, parts: list[str]) -> list[tuple[list[int], int]]:
        """Ids of each part, and 1 if they had to be taken from the library."""
        ids = [self.encode_part(p) for p in parts]
        if not self.check:
            return [(x, 0) for x in ids]
        said = self.library.encode([self._apart + p.replace(SPACE, " ") for p in parts], num_threads=1)
        return [(x, 0) if x == y[self._lead :] else (y[self._lead :], 1) for x, y in zip(ids, said, strict=True)]

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return [i for p in self.parts(self.normalised(text)) for i in self.encode_part(p)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes side by side are characters, each that is part of none a replacement character; the space before the first word goes."""
        return self._decoded(ids, True)

    def _decoded(self, ids: list[int], first: bool) -> str:
        out: list[str] = []
        held = bytearray()
        seen = False
        for i in ids:
            kind = self.kind[i]
            if kind == BYTE:
                held.append(self.value[i])
                continue
            if held:
                out.append(_characters(held))
                held.clear()
            if seen or any(out):
                first = False
            seen = False
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.unknown_text)
                continue
            text = self.piece[i]
            if first and (self.dummy or self.strip) and text.startswith(SPACE):
                text, seen = text[1:], not self.strip
            out.append(text.replace(SPACE, " "))
        return "".join(out) + _characters(held)

    def _known(self, parts: list[str]) -> dict[str, tuple[str, int, str, int]]:
        """Ids as text, their number, the text decoded from them and 1 if they are the library's, for parts at least."""
        young, old = self._memo
        if len(young) > MEMO:
            young, old = self._memo = {}, young
        young.update((p, old[p]) for p in old.keys() & parts if p not in young)
        new = [p for p in dict.fromkeys(parts) if p not in young]
        for part, (ids, unlike) in zip(new, self._checked(new) if new else [], strict=True):
            back = "".join([self.piece[i] for i in ids]).replace(SPACE, " ") if self._special.isdisjoint(ids) else self._decoded(ids, False)
            young[part] = ",".join(map(str, ids)), len(ids), back, unlike
        return young

    def digest(self, text: str) -> tuple[int, str, str, int]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the text decoded from them, parts that the library encodes otherwise."""
        if self.parted and self.plain:
            parts = self.parts(self.normalised(text))
            known = self._known(parts)
            found = [known[p] for p in parts]
            for p in {p for p in parts if len(p) > MEMO_PART}:
                del known[p]
            n, ids, back, unlike = sum([x[1] for x in found]), ",".join([x[0] for x in found]), "".join([x[2] for x in found]), sum([x[3] for x in found])
            back = back.removeprefix(" ") if self.dummy else back
        else:
            listed = self.encode(text)
            said = self.library.encode(text) if self.check else listed
            unlike = int(said != listed)
            n, ids, back = len(said), ",".join(map(str, said)), self.decode(said)
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), unlike


def _characters(data: bytes) -> str:
    """UTF-8 text; a byte that begins no character is a replacement character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                break
            except UnicodeDecodeError:
                n = 0
        out += [] if n else ["�"]
        at += n or 1
    return "".join(out)


def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:
        content = f.read(MODEL_BYTES + 1)
    if len(content) > MODEL_BYTES:
        raise ValueError(f"{path} is over {MODEL_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(content)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text, without begin or end ids; a null text has no ids, as an empty one."""
    content = _model(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = once(content.value, lambda x: Pieces(x, False))
        for batch in batches:
            ids = [pieces.encode(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select(documents["doc_id"].cast("long"), documents["text"].cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of ids; null ids decode to an empty text."""
    content = _model(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = once(content.value, lambda x: Pieces(x, False))
        for batch in batches:
            out = [pieces.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, path: str, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_unlike (parts whose ids are the library's) of every row of documents.

    Reads doc_id and text only. Nothing is shuffled; a task holds one Arrow batch of texts, the
    vocabulary, a bounded memo and the agenda of one part, about 100 bytes for each of its
    characters (a part ends wherever no piece goes on). Null text: as empty (no
    tokens, hashes of no bytes). Null doc_id: kept as null. Repeated rows: each gives its row. Empty
    tables give no rows. Columns of other names, even those of the result, are ignored.
    """
    content = _model(documents, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = once(content.value, lambda x: Pieces(x, check))
        for batch in batches:
            found = [pieces.digest(t.as_py() or "") for t in batch.column("text")]
            columns = [list(c) for c in zip(*found, strict=True)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_unlike"])

    return documents.select(documents["doc_id"].cast("long"), documents["text"].cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_unlike long")
