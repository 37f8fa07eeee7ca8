"""Weighted word frequencies of abstracts and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflux.functions.blank import is_blank
from bibflux.functions.lexicon import FREQUENCY_STOP_WORDS
from bibflux.functions.text import frequency_tokens, keyword_phrases


def word_frequencies(df: DataFrame, top: int = 150, abstracts: bool = True, keywords: bool = True, extra_stop: frozenset[str] = frozenset(), weight: int = 3) -> DataFrame:
    """Rows ``(term, freq)``: words of abstracts count once, whole keywords ``weight`` times; the ``top`` most frequent, ties by term.

    Abstracts are blank in lower case only, keywords in any case, as the reference has it.
    """
    stop = FREQUENCY_STOP_WORDS | {w.strip().lower() for w in extra_stop if w.strip()}
    parts = []
    if abstracts:
        shown = F.trim(F.coalesce("abstract", F.lit("")))
        parts.append(df.filter(~shown.isin("", "nan", "none")).select(F.explode(frequency_tokens(F.col("abstract"), stop)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq")))
    if keywords:
        parts.append(df.filter(~is_blank(F.col("keywords"))).select(F.explode(keyword_phrases(F.col("keywords"), stop)).alias("term")).groupBy("term").agg((F.count(F.lit(1)) * weight).alias("freq")))
    if not parts:
        raise ValueError("neither abstracts nor keywords")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("term").agg(F.sum("freq").alias("freq")).orderBy(F.desc("freq"), "term").limit(top)


def leading_mean(freqs: DataFrame, n: int = 5) -> DataFrame:
    """One row: the most frequent term and the mean frequency of the first ``n``."""
    first = freqs.orderBy(F.desc("freq"), "term").limit(n)
    return first.agg(F.min_by("term", F.struct((-F.col("freq")).alias("f"), "term")).alias("top_term"), F.avg("freq").alias("mean_freq"))
