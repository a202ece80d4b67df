"""Many phrases looked for at once: an automaton over all of them reads each text once, whatever their number."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .wording import plain, stem

#: Letters from which a phrase of one word counts, as a whole word.
SINGLE_WORD = 5
#: The share of a label's stems that a text must have to speak of it.
STEM_SHARE = 0.8


class LabelIndex:
    """Which labels a text speaks of: by a phrase, or by enough of a label's stems.

    Phrases of several words count anywhere in the plain text, single words of SINGLE_WORD letters as whole words: all
    are strings of one automaton. Stems point to their labels, so a text meets only the labels that share one with it.
    """

    def __init__(self, labels: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]) -> None:
        """labels: for each its plain phrases and its stems."""
        import ahocorasick

        said: dict[str, list[int]] = defaultdict(list)
        self.of_stem: dict[str, list[int]] = defaultdict(list)
        self.least = [STEM_SHARE * len(own) for _, own in labels]
        for i, (phrases, own) in enumerate(labels):
            for p in phrases:
                if " " in p or len(p) >= SINGLE_WORD:
                    said[p if " " in p else f" {p} "].append(i)
            for s in own:
                self.of_stem[s].append(i)
        self.automaton = ahocorasick.Automaton()
        for p, at in said.items():
            self.automaton.add_word(p, tuple(at))
        if said:
            self.automaton.make_automaton()
        self.any_phrase = bool(said)

    def by_phrase(self, text: str) -> list[int]:
        """Labels with a phrase in the plain text."""
        return sorted({i for _, at in self.automaton.iter(f" {text} ") for i in at}) if self.any_phrase else []

    def by_stems(self, text: str) -> list[int]:
        """Labels with enough of their stems in the plain text."""
        met: dict[int, int] = defaultdict(int)
        for s in {_stem(w) for w in set(text.split())}:
            for i in self.of_stem.get(s, ()):
                met[i] += 1
        return sorted(i for i, n in met.items() if n >= self.least[i])


@lru_cache(maxsize=200_000)
def _stem(word: str) -> str:
    return stem(word)


@lru_cache(maxsize=8)
def label_index(labels: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]) -> LabelIndex:
    """The index of some labels, built once in each Python worker."""
    return LabelIndex(labels)


def label_entry(label: str, aliases: list[str] | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """A label's plain phrases and stems, as LabelIndex takes them."""
    phrases = tuple(dict.fromkeys(p for p in map(plain, (label, *(aliases or []))) if p))
    return phrases, tuple(sorted({stem(w) for w in plain(label).split() if len(w) > 1}))


def plain_text(text: Column) -> Column:
    """wording.plain() as a column function."""
    return F.array_join(F.regexp_extract_all(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("’"), F.lit("'")), F.lit("([a-z0-9']+)"), F.lit(1)), " ")


def _one_by_one(texts: pa.Array) -> Iterator[str | None]:
    return (t.as_py() for t in texts)


def labels_said(text: Column, labels: list[tuple[tuple[str, ...], tuple[str, ...]]]) -> Column:
    """An array of (label, by_phrase) for each label, by its number, that a plain text speaks of. Each distinct text of an Arrow batch is read once."""
    known = tuple(labels)

    @F.pandas_udf("array<struct<label:int,by_phrase:boolean>>")
    def said(texts: pd.Series) -> pd.Series:
        index, seen = label_index(known), {}
        for t in texts:
            if t not in seen:
                phrases = index.by_phrase(t)
                seen[t] = [{"label": i, "by_phrase": True} for i in phrases] + [{"label": i, "by_phrase": False} for i in index.by_stems(t) if i not in set(phrases)]
        return texts.map(seen)

    return said(text)


def phrases_said(text: Column, phrases: list[str]) -> Column:
    """The numbers of the phrases that a text holds anywhere, as they stand."""
    known = tuple(phrases)

    @F.arrow_udf("array<int>")
    def said(texts: pa.Array) -> pa.Array:
        automaton = _automaton(known)
        return pa.array([sorted({i for _, at in automaton.iter(t) for i in at}) if len(automaton) and t is not None else [] for t in _one_by_one(texts)], pa.list_(pa.int32()))

    return said(text)


@lru_cache(maxsize=8)
def _automaton(phrases: tuple[str, ...]):  # noqa: ANN202
    import ahocorasick

    at: dict[str, list[int]] = defaultdict(list)
    for i, p in enumerate(phrases):
        if p:
            at[p].append(i)
    out = ahocorasick.Automaton()
    for p, ids in at.items():
        out.add_word(p, tuple(ids))
    if at:
        out.make_automaton()
    return out
