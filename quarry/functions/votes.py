"""Votes of a text on genres, formats and station type by counted words, in one pass of the text for all words.

A word counts as often as it stands without overlapping itself, three times at most, as part of a longer word too.
The automaton of all words is built once in each Python worker; texts come in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import FORMATS, GENRES, STATION_TYPES

MOST = 3  # times that a word counts
MOST_GENRES, MOST_FORMATS, MOST_EVIDENCE = 8, 4, 10
_NAMED = "array<struct<name:string,hits:int,evidence:array<string>>>"
VOTES = f"genres {_NAMED}, formats {_NAMED}, station_type string, confidence double, evidence array<string>"


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for vocabulary in (GENRES, FORMATS, STATION_TYPES):
        for _, words in vocabulary:
            for w in words:
                found.add_word(w, w)
    found.make_automaton()
    return found


def word_counts(text: str) -> dict[str, int]:
    """How often each word of the vocabularies counts in a lower-cased text."""
    count: dict[str, int] = {}
    free: dict[str, int] = {}  # where a word may begin again
    for end, word in _automaton().iter(text):
        start = end - len(word) + 1
        if start >= free.get(word, 0):
            free[word] = end + 1
            count[word] = count.get(word, 0) + 1
    return count


def _ranked(count: dict[str, int], vocabulary: list, most: int) -> list[dict]:
    """Names with hits: most hits first, ties by name; evidence: their words found, in order of the words."""
    found = []
    for name, words in vocabulary:
        said = [w for w in words if w in count]
        if said:
            found.append({"name": name, "hits": sum(min(count[w], MOST) for w in said), "evidence": sorted(set(said))})
    return sorted(found, key=lambda x: (-x["hits"], x["name"]))[:most]


def _station(count: dict[str, int]) -> tuple[str, float, list[str]]:
    """The type with most hits, the first of equals; each hit adds to its confidence and is its evidence."""
    best: tuple[int, str, list[str]] = (0, "unknown", [])
    for name, words in STATION_TYPES:
        hits = [w for w in words for _ in range(min(count.get(w, 0), MOST))]
        if len(hits) > best[0]:
            best = len(hits), name, hits
    return best[1], round(min(0.4 + 0.15 * best[0], 0.9), 2) if best[0] else 0.1, best[2][:MOST_EVIDENCE]


def votes(text: Column) -> Column:
    """(genres, formats, station_type, confidence, evidence) of a text; a null text votes for nothing."""

    def vote(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for t in part:
                count = word_counts(t.lower()) if t else {}
                rows.append((_ranked(count, GENRES, MOST_GENRES), _ranked(count, FORMATS, MOST_FORMATS), *_station(count)))
            yield pd.DataFrame(rows, columns=["genres", "formats", "station_type", "confidence", "evidence"])

    return F.pandas_udf(vote, VOTES)(text)
