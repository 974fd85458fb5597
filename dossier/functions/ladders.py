"""First-match ladders of conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(steps: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The value of the first step whose condition is true; null conditions count as false."""
    out = F.lit(otherwise).cast("string")
    for condition, value in reversed(steps):
        out = F.when(F.coalesce(condition, F.lit(False)), value).otherwise(out)
    return out


def all_matches(steps: Sequence[tuple[Column, str]]) -> Column:
    """The values of all steps whose condition is true, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), v) for c, v in steps)))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found
