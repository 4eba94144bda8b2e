"""Operator 10: license scans by template-markup matching.

A template is a license text or notice in which `<<beginOptional>> ... <<endOptional>>` encloses
words that may be absent and `<<var;name=...;match=0-9>>` stands for a run of free words, so many
at least and at most. Templates are compiled into automata over tokens: a chain of mandatory
words with jumps over optional regions and bounded loops for replaceable ones. A text matches
where a run of its words leads through an automaton, that is, where all mandatory wording stands
in order and nothing else but what the markup allows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib.resources import files

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm.common import LOWER, slices, words

#: Phrases of the base and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Word bytes once A-Z are lower-cased: digits, a-z, and all of non-ASCII characters.
MEMBER = np.zeros(256, bool)
MEMBER[48:58] = MEMBER[97:123] = MEMBER[128:] = True

#: Short statements that name a license, and their labels. `match=a-b` bounds the free words.
NOTICES = [
    ("apache-2.0-notice", "licensed under the apache license version 2.0"),
    ("gpl-2.0-notice", "licensed under the <<beginOptional>>terms of the <<endOptional>>gnu general public license <<beginOptional>>as published by the free software foundation <<endOptional>><<beginOptional>>either <<endOptional>>version 2"),
    ("gpl-3.0-notice", "licensed under the <<beginOptional>>terms of the <<endOptional>>gnu general public license <<beginOptional>>as published by the free software foundation <<endOptional>><<beginOptional>>either <<endOptional>>version 3"),
    ("mit-notice", "<<beginOptional>>licensed <<endOptional>><<beginOptional>>released <<endOptional>>under the <<beginOptional>>terms of the <<endOptional>>mit license"),
    ("cc-by-4.0-notice", "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>><<beginOptional>>creative commons <<endOptional>>cc by <<beginOptional>>license <<endOptional>>4.0"),
    ("cc-by-nc-4.0-notice", "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>><<beginOptional>>creative commons <<endOptional>>cc by nc <<beginOptional>>license <<endOptional>>4.0"),
    ("cc-by-notice", "creative commons attribution <<var;name=version;match=0-2>> international license"),
    ("all-rights-reserved", "<<beginOptional>>copyright <<var;name=holder;match=0-12>> <<endOptional>>all rights reserved"),
]


def templates() -> list[tuple[str, str]]:
    """Labels and templates: the whole wording of the licenses and standard grants in `license_texts` (a file each, named by its label), and short notices, whose labels say so."""
    found = files("loomspark.llm").joinpath("license_texts")
    texts = sorted((f.name, f.read_text(encoding="utf-8")) for f in found.iterdir() if f.name.endswith(".txt"))
    return [*((name.removesuffix(".txt"), text) for name, text in texts), *NOTICES]


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """States are places in the list of parts; an edge reads one word or none."""

    def __init__(self, template: str):
        # parts: (word,) mandatory; ("any", low, high) free words; ("skip", place) a jump over an optional region
        self.parts: list[tuple] = []
        opened: list[int] = []
        for m in re.finditer(r"<<(.*?)>>|([^<]+)", template, re.S):
            if m[1] is None:
                self.parts += [("word", w) for w in _WORD.findall(m[2].lower().encode())]
            elif m[1] == "beginOptional":
                opened.append(len(self.parts))
                self.parts.append(())
            elif m[1] == "endOptional":
                self.parts[opened.pop()] = ("skip", len(self.parts))
            else:
                low, high = re.search(r"match=(\d+)-(\d+)", m[1]).groups()
                self.parts.append(("any", int(low), int(high)))
        if opened:
            raise ValueError("an optional region isn't closed")
        words_ = [p[1] for p in self.parts if p[0] == "word"]
        inside = {k for i, p in enumerate(self.parts) if p[0] == "skip" for k in range(i, p[1])}
        self.required = [p[1] for i, p in enumerate(self.parts) if p[0] == "word" and i not in inside]
        if not words_ or not self.required:
            raise ValueError("a template needs mandatory words")
        first = self._closure({(0, 0)})
        self.first = {self.parts[i][1] for i, _ in first if i < len(self.parts) and self.parts[i][0] == "word"}
        if any(i < len(self.parts) and self.parts[i][0] == "any" for i, _ in first):
            raise ValueError("a template can't begin with free words")

    def _closure(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        todo, out = list(states), set()
        while todo:
            s = todo.pop()
            if s in out:
                continue
            out.add(s)
            i, used = s
            if i < len(self.parts):
                p = self.parts[i]
                if p[0] == "skip":
                    todo += [(i + 1, 0), (p[1], 0)]
                elif p[0] == "any" and used >= p[1]:
                    todo.append((i + 1, 0))
        return out

    def match(self, text: list[bytes], at: int) -> int:
        """End of the longest run of words from `at` that the automaton accepts, or -1."""
        states, end, n = self._closure({(0, 0)}), -1, len(self.parts)
        k = at
        while states:
            if any(i == n for i, _ in states):
                end = k
            if k == len(text):
                break
            step = set()
            for i, used in states:
                if i < n:
                    p = self.parts[i]
                    if p[0] == "word" and p[1] == text[k]:
                        step.add((i + 1, 0))
                    elif p[0] == "any" and used < p[2]:
                        step.add((i, used + 1))
            states, k = self._closure(step), k + 1
        return end


class Scanner:
    """Phrases and templates over many texts at once."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(p.lower().encode().split(), label) for p, label in phrases.items()]
        self.automata = [(label, Automaton(t)) for label, t in templates]
        gap = rb"[^0-9a-z\x80-\xff]+"
        self.places = [(re.compile(gap.join(map(re.escape, p)) + rb"(?![0-9a-z\x80-\xff])"), label) for p, label in self.phrases]
        # A phrase can only stand where its first word does, a template where its rarest mandatory
        # word does; the longest serves as that. One automaton finds all these words.
        keys: dict[bytes, tuple[list[int], list[int]]] = {}
        for i, (p, _) in enumerate(self.phrases):
            keys.setdefault(p[0], ([], []))[0].append(i)
        for i, (_, a) in enumerate(self.automata):
            keys.setdefault(max(a.required, key=len), ([], []))[1].append(i)
        self.keys = ahocorasick.Automaton()
        for w, found in keys.items():
            self.keys.add_word(w.decode("latin-1"), (len(w), *found))
        self.keys.make_automaton()

    def __call__(self, data: np.ndarray, off: np.ndarray) -> list[tuple]:
        """For each text: n_words, base places as (word, label), template labels with mandatory words matched."""
        low = LOWER[data]
        starts, _ = words(low, off, MEMBER)
        first = np.searchsorted(starts, off)
        buf = low.tobytes()
        out = [(int(n), [], {}) for n in np.diff(first)]
        nonempty = np.flatnonzero(np.diff(off) > 0)

        def row(pos: int) -> int:
            return int(nonempty[np.searchsorted(off[nonempty], pos, "right") - 1])

        tried: dict[int, set[int]] = {}
        for end, (n, phrases, templates_) in self.keys.iter(buf.decode("latin-1")):
            at = end - n + 1
            if (at and MEMBER[low[at - 1]]) or (end + 1 < len(low) and MEMBER[low[end + 1]]):
                continue  # part of a longer word
            k = row(at)
            for i in phrases:
                pattern, label = self.places[i]
                if (m := pattern.match(buf, at)) and m.end() <= off[k + 1]:  # else it would cross texts
                    out[k][1].append((int(np.searchsorted(starts, at)) - int(first[k]), label))
            if templates_:
                tried.setdefault(k, set()).update(templates_)
        for k, which in tried.items():
            text = _WORD.findall(buf, int(off[k]), int(off[k + 1]))
            places: dict[bytes, list[int]] = {}
            for i in which:
                label, a = self.automata[i]
                if not places:
                    for j, w in enumerate(text):
                        places.setdefault(w, []).append(j)
                if any(a.match(text, j) >= 0 for w in a.first for j in places.get(w, ())):
                    out[k][2][label] = max(out[k][2].get(label, 0), len(a.required))
        return out


def scan(documents: DataFrame, phrases: dict[str, str] | None = None, markup: list[tuple[str, str]] | None = None) -> DataFrame:
    """License labels of every row of documents, by `markup`, else by templates().

    doc_id; n_words; n_base: places of base phrases; first_word, last_word: their smallest and
    largest start, null without any; base_labels; labels: the templates' too (both distinct,
    sorted, joined by commas); score: 0 without a label, 0.5 with base phrases alone, else n / (n
    + 1) of the most mandatory words that a template matched, at least 0.75; places: array of
    (word, label). Reads doc_id and text. Null and empty texts have no words. Repeated rows each
    give a row; other columns are ignored; nothing is shuffled.
    """
    scanner_of = (phrases or PHRASES, markup or templates())
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*scanner_of)
        for batch, data, off in slices(batches):
            # an end of line between texts, so that no run of words crosses their border
            n = len(off) - 1
            spaced, shifted = np.full(len(data) + n, 10, np.uint8), off + np.arange(n + 1)
            keep = np.ones(len(spaced), bool)
            keep[shifted[1:] - 1] = False
            spaced[keep] = data
            rows = scanner(spaced, shifted)
            at = [sorted(x[1]) for x in rows]
            base = [sorted({y[1] for y in x}) for x in at]
            both = [sorted({*b, *x[2]}) for b, x in zip(base, rows, strict=True)]
            score = [max(0.75, (s := max(x[2].values())) / (s + 1)) if x[2] else 0.5 if b else 0.0 for b, x in zip(base, rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x[0] for x in rows], pa.int64()),
                    pa.array([len(x) for x in at], pa.int64()),
                    pa.array([x[0][0] if x else None for x in at], pa.int64()),
                    pa.array([x[-1][0] if x else None for x in at], pa.int64()),
                    pa.array([",".join(x) for x in base], pa.string()),
                    pa.array([",".join(x) for x in both], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array([[{"word": w, "label": y} for w, y in x] for x in at], pa.list_(place)),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"],
            )

    return documents.select(documents["doc_id"].cast("long"), documents["text"].cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<word: long, label: string>>"
    )
