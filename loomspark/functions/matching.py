"""Which of many strings stand in a text, found in one pass over it."""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters at the start of a text that each string is looked for in by itself: what stands everywhere is found there.
START = 4_096


def found(text: str, strings: Sequence[str | None]) -> list[bool]:
    """Whether each string stands in the text; the empty one does, no string doesn't.

    One automaton over the strings that the text's start doesn't hold reads the text once, so that
    time grows with the text and the strings, not with their product.
    """
    start = text[:START]
    hits = {s: s in start for s in strings if s is not None}
    open_ = {s for s, hit in hits.items() if not hit and len(s) <= len(text)}
    if open_ and len(text) > len(start):
        automaton = ahocorasick.Automaton()
        for s in open_:
            automaton.add_word(s, s)
        automaton.make_automaton()
        # an end of a long string may be another one, so every hit is looked at
        for _, s in automaton.iter(text):
            if not hits[s]:
                hits[s] = True
                open_.discard(s)
                if not open_:
                    break
    return [s is not None and hits[s] for s in strings]


def _found(texts: pa.Array, lists: pa.Array) -> pa.Array:
    """Row by row, so that one text at a time is there beside the Arrow batch."""
    rows = ((t.as_py(), x.as_py()) for t, x in zip(texts, lists, strict=True))
    return pa.array((None if t is None or x is None else found(t, x) for t, x in rows), pa.list_(pa.bool_()))


def found_of(text: Column | str, strings: Column | str) -> Column:
    """found() as a column: an array of booleans, null without a text or strings."""
    return F.arrow_udf(_found, "array<boolean>")(text, strings)
