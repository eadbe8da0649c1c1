"""Text cleaning and in-row token counting as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pathlib import Path

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]

# Unicode punctuation, symbols, separators and control characters. The leading [^a-z] is a
# short cut: the letters that make up most of a text leave the class after one comparison.
SEPARATORS = r"[[^a-z]&&[\p{P}\p{S}\p{Z}\p{Cc}]]+"

# Fixed values of the cleaning contract: shortest term, and fewest documents of a term.
MIN_LENGTH = 3
MIN_DOCS = 5


def lower_case(text: Column) -> Column:
    return F.lower(text)


def remove_digits(text: Column) -> Column:
    """Delete digit runs; no space is left behind, so ``12bis`` becomes ``bis``."""
    return F.regexp_replace(text, "[0-9]+", "")


def separators_to_space(text: Column) -> Column:
    """Turn each run of separators into one space, so ``dell'atto`` becomes ``dell atto``."""
    return F.regexp_replace(text, SEPARATORS, " ")


DEFAULT_STEPS: tuple[Step, ...] = (lower_case, remove_digits, separators_to_space)


def clean(text: Column | str, steps: Sequence[Step] = DEFAULT_STEPS) -> Column:
    """Apply ``steps`` in order; callers may pass their own column-to-column functions."""
    out = F.col(text) if isinstance(text, str) else text
    for step in steps:
        out = step(out)
    return F.trim(out)


# Spark's lists of five languages, kept here so that they can be read without a session.
LISTS = Path(__file__).parent / "stopword_lists"


def stopwords(*languages: str) -> list[str]:
    """Lower-cased union of Spark's stopword lists for the named languages."""
    words: set[str] = set()
    for language in languages:
        own = LISTS / f"{language}.txt"
        if own.exists():
            found = own.read_text(encoding="utf-8").splitlines()
        else:
            found = StopWordsRemover.loadDefaultStopWords(language)
        words.update(w.lower() for w in found if w)
    return sorted(words)


def tokens(cleaned: Column, min_length: int = MIN_LENGTH) -> Column:
    """Split cleaned text at spaces, keeping tokens of at least ``min_length`` characters."""
    return F.filter(F.split(cleaned, " "), lambda token: F.length(token) >= min_length)


def run_starts(ordered: Column) -> Column:
    """Positions (from 0) where a new value begins in a sorted array, then its size."""
    size = F.size(ordered)
    return F.filter(
        F.sequence(F.lit(0), size),
        lambda i: (i == 0) | (i == size) | (F.get(ordered, i) != F.get(ordered, i - 1)),
    )


def run_lengths(ordered: Column, starts: Column) -> Column:
    """Array of ``(term, tf)`` for the runs of a sorted token array.

    Linear in the number of tokens and confined to the row: a document's term frequencies
    need no shuffle, because the whole document already sits in one row.
    """
    return F.transform(
        F.slice(starts, 1, F.size(starts) - 1),
        lambda start, i: F.struct(
            F.get(ordered, start).alias("term"),
            (F.get(starts, i + 1) - start).cast("long").alias("tf"),
        ),
    )
