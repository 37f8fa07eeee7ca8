"""Which terms of a bounded list stand in a text, as whole words in order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflux.functions.let import let


def words_between(text: Column) -> Column:
    """The text's letter runs in lower case with one space around each: ``' a few words '``."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"\P{L}+", " "), F.lit(" "))


def bounded_list(df: DataFrame, column: str, limit: int = 5000) -> list[str]:
    """The distinct non-null values of a small reference column; raises beyond ``limit``, so that no large list reaches the driver."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} values of {column}: not a reference list")
    return sorted(r[0] for r in rows)


def found_terms(text: Column, terms: list[str]) -> Column:
    """``array<string>`` of those ``terms`` whose words stand in the text with only non-letters between them."""
    words = {t: w for t in terms if (w := re.findall(r"[^\W\d_]+", t.lower()))}
    if not words:
        return F.array().cast("array<string>")
    hits = lambda spaced: F.array(*(F.when(F.contains(spaced, F.lit(f" {' '.join(w)} ")), F.lit(t)) for t, w in words.items()))
    return F.filter(let(words_between(text), hits), lambda x: x.isNotNull())
