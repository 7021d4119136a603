"""Counting many words and patterns in one pass over a text.

An Aho-Corasick automaton holds all words, and for every pattern the literal pieces that any match of it must hold. One walk over
the text finds which words stand between word boundaries and which pieces occur at all; a pattern's own regular expression is
tried only on a text that holds all of its pieces. The count of words and patterns no longer multiplies the passes over a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import resident

_LOWER = {c: c + 32 for c in range(65, 91)}


def pieces(pattern: str) -> list[list[str]]:
    """For each alternative of a pattern the literal runs, in lower case, that every match of it holds.

    Only what is plain in the pattern counts: groups, classes and optional characters end a run, so the answer may name too few
    pieces but never one that a match can lack.
    """
    alternatives, depth, start = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")") if not i or pattern[i - 1] != "\\" else 0
        if c == "|" and not depth:
            alternatives.append(pattern[start:i])
            start = i + 1
    found = []
    for own in [*alternatives, pattern[start:]]:
        plain = re.sub(r"\((?:[^()\\]|\\.)*\)|\[(?:[^\]\\]|\\.)*\]", "\0", own)  # groups and classes
        plain = re.sub(r"(?:\\\\[sSwWdDbB]|\\[sSwWdDbB]|\0|.)[*?]", "\0", plain)  # what may be missing
        plain = re.sub(r"\\[sSwWdDbB]\+?|[.^$]", "\0", plain.replace("\\.", "\1").replace("\\(", "\2"))
        runs = [r.replace("\1", ".").replace("\2", "(") for r in re.split("\0+", plain.replace("+", "\0"))]
        found.append([r.lower() for r in runs if len(r) > 1])
    return found


class Finder:
    """Counts of words between word boundaries and of patterns that occur, ASCII case aside; each counts once."""

    def __init__(self, words: list[str], patterns: list[str]):
        self.words = [w.translate(_LOWER) for w in words]
        self.rules = [(re.compile(p, re.ASCII | re.IGNORECASE), pieces(p)) for p in patterns]
        self.automaton = ahocorasick.Automaton()
        for piece in {*self.words, *(x for _, alternatives in self.rules for own in alternatives for x in own)}:
            self.automaton.add_word(piece, piece)
        self.number: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.number.setdefault(w, []).append(i)
        if len(self.automaton):
            self.automaton.make_automaton()

    @staticmethod
    def boundary(text: str, at: int) -> bool:
        word = lambda i: 0 <= i < len(text) and (text[i] == "_" or text[i].isalnum())
        return word(at - 1) != word(at)

    def count(self, text: str) -> tuple[int, int]:
        low = text.translate(_LOWER)
        held, seen = set(), set()
        for end, piece in self.automaton.iter(low) if len(self.automaton) else ():
            held.add(piece)
            if piece in self.number and piece not in seen and self.boundary(low, end + 1) and self.boundary(low, end + 1 - len(piece)):
                seen.add(piece)
        words = sum(len(self.number[w]) for w in seen)
        high = sum(1 for rule, alternatives in self.rules if any(all(p in held for p in own) for own in alternatives) and rule.search(text))
        return words, high


def with_counts(docs: DataFrame, words: list[str], patterns: list[str], text: str = "text") -> DataFrame:
    """``docs`` with ``words`` and ``high``: how many of the words and of the patterns occur in its text. A null text has none."""
    kept = docs.columns
    names = [*kept, "words", "high"]
    at, key = kept.index(text), (tuple(words), tuple(patterns))

    def run(parts: Iterator[pa.RecordBatch]):
        finder = resident("finder", key, lambda: Finder(words, patterns))
        for part in parts:
            found = [finder.count(t or "") for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([w for w, _ in found], pa.int32()), pa.array([h for _, h in found], pa.int32())], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, words int, high int")


def scored(docs: DataFrame, words: list[str], patterns: list[str], text: str = "text") -> DataFrame:
    """``docs`` with ``words``, ``high`` and ``score``: a word scores one, a pattern two."""
    return with_counts(docs, words, patterns, text).withColumn("score", F.col("words") + 2 * F.col("high"))
