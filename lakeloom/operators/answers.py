"""Checks of answers against what they were made from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.text import shingle_overlap, words

#: An answer is grounded by a run of so many characters that a source holds; the words of a draft's shingles, and its shares of them and of the topic at least.
RUN = 20
SHINGLE, OVERLAP, ALIKE = 6, 0.80, 0.70
CITATION = r"\[[a-zA-Z0-9_\-]{1,64}\]"


def shares_run(answer: Column, sources: Column, least: int = RUN) -> Column:
    """Whether any run of so many characters of the answer stands in a source; an answer shorter than that shares none, nor does null."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(answer) - least + 1, F.lit(1)))
    held = F.exists(starts, lambda i: F.exists(sources, lambda s: F.contains(s, F.substring(answer, i, F.lit(least)))))
    return F.coalesce((F.length(answer) >= least) & held, F.lit(False))


def digit_runs(text: Column, least: int = 2) -> Column:
    """Distinct runs of digits."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\d{{{least},}}"), 0))


def grounded(answer: Column, sources: Column, least: int = RUN) -> Column:
    """How an answer is grounded: citation (a mark in brackets), quote (a run of a source), numbers (it has some and all are in sources), or else none."""
    mine = digit_runs(answer)
    known = F.flatten(F.transform(sources, lambda s: digit_runs(s)))
    numbers = (F.size(mine) > 0) & (F.size(F.array_except(mine, known)) == 0)
    return F.when(F.rlike(answer, F.lit(CITATION)), "citation").when(shares_run(answer, sources, least), "quote").when(numbers, "numbers").otherwise("none")


def verdict(draft: Column, main: Column, cosine: Column, size: int = SHINGLE, overlap: float = OVERLAP, alike: float = ALIKE) -> Column:
    """Whether a draft may be shown before the main answer: empty, wait (the main answer is too short), overlap, numbers or topic if it fails there, or safe."""
    number = r"\d+(?:[.,]\d+)*"
    bare = lambda x: F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(number), 0), lambda t: F.regexp_replace(t, "[.,]", ""))
    mine, known = bare(draft), bare(main)
    return (
        F.when(F.trim(F.coalesce(draft, F.lit(""))) == "", "empty")
        .when(F.size(words(main)) < size, "wait")
        .when(shingle_overlap(draft, main, size) < overlap, "overlap")
        .when(F.size(F.array_except(mine, known)) > 0, "numbers")
        .when(F.coalesce(cosine, F.lit(1.0)) < alike, "topic")
        .otherwise("safe")
    )
