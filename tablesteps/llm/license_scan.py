"""Licence scans with ordered signature rules.

A text becomes lower-case words; hundreds of signature patterns
(``license_rules``) are gated by keywords, so most texts run none.
Overlapping detections are resolved by priority, then length, then place:
a detection inside or across a stronger one is suppressed.

Base phrases are counted at every place where their words stand
consecutively; their labels always stay beside the method's.

Defined results: null and empty texts have no words, no labels and score 0.
``score`` is the strongest detection's priority over 100 (a base phrase
counts as 50).  Repeated rows have equal results, and extra columns of any
name pass through.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField

from .common import map_text, texts_of
from .license_rules import Rule, compiled

# Base phrases and their labels (fixed by the contract).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
BASE_PRIORITY = 50

# Characters of words: digits, letters (lower-cased), all beyond ASCII; the rest separates.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

FIELDS = [
    StructField("n_words", LongType()),
    StructField("n_base", LongType()),
    StructField("first_word", LongType()),
    StructField("last_word", LongType()),
    StructField("base_labels", ArrayType(StringType())),
    StructField("labels", ArrayType(StringType())),
    StructField("detected", ArrayType(StringType())),
    StructField("score", DoubleType()),
]


def base_places(flat: bytes) -> list[tuple[int, str]]:
    """Character place (of the space before) and label of every base phrase."""
    found = []
    for phrase, label in BASE.items():
        needle, at = b" " + phrase.encode() + b" ", -1
        while (at := flat.find(needle, at + 1)) >= 0:
            found.append((at, label))
    return sorted(found)


def resolve(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Detections (priority, start, end, label) left when stronger ones suppress what lies in or across them."""
    kept: list[tuple[int, int, int, str]] = []  # disjoint, by start
    for priority, start, end, label in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
        at = bisect_left(kept, (start, end, 0, ""))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
            insort(kept, (start, end, priority, label))
    return kept


class Scanner:
    def __init__(self) -> None:
        by_word: dict[bytes, list[Rule]] = defaultdict(list)
        for rule in compiled():
            by_word[rule.keyword].append(rule)
        self.by_word = dict(by_word)
        self.keywords = frozenset({*by_word, *(p.split()[0].encode() for p in BASE)})

    def scan(self, text: bytes) -> tuple:
        words = text.translate(_WORDS).split()
        if self.keywords.isdisjoint(words):  # every base phrase holds a keyword, too
            return len(words), 0, None, None, [], [], [], 0.0
        present = self.keywords.intersection(words)
        flat = b" " + b" ".join(words) + b" "
        base = base_places(flat)
        found = [
            (rule.priority, m.start(), m.end(), rule.label)
            for word in present
            for rule in self.by_word.get(word, [])
            for m in rule.pattern.finditer(flat)
        ]
        kept = resolve(found)
        gaps = np.flatnonzero(np.frombuffer(flat, dtype=np.uint8) == 32) if base or kept else None
        places = [int(np.searchsorted(gaps, at)) for at, _ in base]
        detected = []
        for start, end, priority, label in kept:
            first = int(np.searchsorted(gaps, start - 1))
            detected.append(f"{label}:{first}:{int(np.searchsorted(gaps, end))}:{priority}")
        own = sorted({label for _, label in base})
        labels = sorted({*own, *(d[3] for d in kept)})
        score = max([p for _, _, p, _ in kept] + [BASE_PRIORITY] * bool(base), default=0) / 100
        first, last = (min(places), max(places)) if places else (None, None)
        return len(words), len(base), first, last, own, labels, detected, score


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, word and phrase counts, labels, ``detected`` (``label:first:end:priority`` in words) and score."""

    def make():
        scanner = Scanner()

        def run(texts: pa.Array) -> list[pa.Array]:
            rows = [scanner.scan(t) for t in texts_of(texts)]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 3 + [pa.float64()]
            return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

        return run

    return map_text(docs, text_col, keep, FIELDS, make)
