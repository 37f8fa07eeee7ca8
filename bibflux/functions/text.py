"""Tokenisers, stemmer, n-grams and extractors as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from bibflux.functions.fold import fold_ascii
from bibflux.functions.lexicon import CLUSTER_STOP_WORDS, FREQUENCY_STOP_WORDS, SUFFIXES, TERM_STOP_WORDS
from bibflux.functions.let import let


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def normalize_title(c: Column) -> Column:
    """Lower-case ASCII letters and digits with single spaces; empty for null."""
    ascii_only = F.octet_length(c) == F.length(c)  # these are not folded
    return F.coalesce(F.trim(F.regexp_replace(F.when(ascii_only, F.lower(c)).otherwise(fold_ascii(c)), "[^a-z0-9]+", " ")), F.lit(""))


def word_tokens(c: Column) -> Column:
    """All runs of letters, digits and underscores of any script, lower case."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array().cast("array<string>"))


def raw_tokens(c: Column) -> Column:
    """Words of a-z after everything else has become a blank."""
    return F.coalesce(_words(F.regexp_replace(F.lower(c), r"[^a-z\s]", " ")), F.array().cast("array<string>"))


def is_unigram(w: Column, stop: frozenset[str] = TERM_STOP_WORDS, least: int = 3) -> Column:
    """Whether a raw word counts as a term."""
    return (F.length(w) >= least) & ~w.isin(*sorted(stop))


def is_bigram(a: Column, b: Column, stop: frozenset[str] = TERM_STOP_WORDS) -> Column:
    """Whether two neighbours among all raw words count as a term: both of two letters or more, one of three or more, not both stop words."""
    both_stop = a.isin(*sorted(stop)) & b.isin(*sorted(stop))
    return (F.length(a) >= 2) & (F.length(b) >= 2) & (F.greatest(F.length(a), F.length(b)) >= 3) & ~both_stop


def unigrams(c: Column, stop: frozenset[str] = TERM_STOP_WORDS, least: int = 3) -> Column:
    return F.filter(raw_tokens(c), lambda w: is_unigram(w, stop, least))


def bigrams(c: Column, stop: frozenset[str] = TERM_STOP_WORDS) -> Column:
    def pairs(t: Column) -> Column:
        return F.transform(F.slice(t, 2, F.size(t)), lambda b, i: F.when(is_bigram(F.get(t, i), b, stop), F.concat_ws(" ", F.get(t, i), b)))

    return F.filter(let(raw_tokens(c), pairs), lambda x: x.isNotNull())


def words_and_pairs(c: Column) -> Column:
    """All raw words of a text and all neighbours among them, whether they count as terms or not."""
    return let(raw_tokens(c), lambda t: F.concat(t, F.transform(F.slice(t, 2, F.size(t)), lambda b, i: F.concat_ws(" ", F.get(t, i), b))))


def stem(w: Column) -> Column:
    """The word without the first listed suffix that leaves three letters; words of up to four letters stay."""
    return F.when(F.length(w) > 4, F.regexp_replace(w, rf"^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})$", "$1")).otherwise(w)


def cluster_tokens(c: Column, stop_words: bool = True, stemming: bool = True, least: int = 3) -> Column:
    tokens = F.filter(raw_tokens(c), lambda w: F.length(w) >= least)
    if stop_words:
        tokens = F.filter(tokens, lambda w: ~w.isin(*sorted(CLUSTER_STOP_WORDS)))
    return F.transform(tokens, stem) if stemming else tokens


def frequency_tokens(c: Column, stop: frozenset[str] = FREQUENCY_STOP_WORDS) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(c), r"https?://\S+", ""), r"\b\d+\b", "")
    tokens = F.transform(_words(F.regexp_replace(text, r"[^a-z\s\-]", " ")), lambda w: F.regexp_replace(w, "^-+|-+$", ""))
    return F.filter(tokens, lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(stop)))


def keyword_phrases(c: Column, stop: frozenset[str] = FREQUENCY_STOP_WORDS) -> Column:
    phrases = F.transform(F.split(c, "[;,]"), lambda w: F.lower(F.trim(w)))
    return F.filter(phrases, lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(stop)))


def merge_keywords(a: Column, b: Column) -> Column:
    """The sorted union of two ``;`` lists, lower case, joined with ``; ``."""
    parts = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda w: F.lower(F.trim(w)))
    return F.array_join(F.array_sort(F.filter(F.array_union(parts(a), parts(b)), lambda w: w != "")), "; ")


def extract_year(c: Column) -> Column:
    """A free-standing year from 1900 to 2099, else the first four digits, else empty."""
    standing = F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1)
    return F.coalesce(F.nullif(standing, F.lit("")), F.regexp_extract(c, r"(\d{4})", 1), F.lit(""))


def term_pattern(term: str) -> str:
    """A regular expression for a term as whole words, its hyphens optional or blanks, case ignored (for ``rlike``)."""
    body = r"[\-\s]?".join(re.escape(part) for part in term.lower().split("-"))
    return rf"(?iU)\b{body}\b"


def shorten(c: Column, n: int = 45) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def counted(items: Column) -> Column:
    """``array<struct<item,k>>`` of an array without nulls: each different item and how often it stands there; null for an empty array.

    Equal items are runs of the sorted array, so the cost after the sort is linear and no shuffle is needed to count inside a row.
    """

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(first, lambda at: F.transform(at, lambda s, k: F.struct(F.get(ordered, s).alias("item"), (F.coalesce(F.get(at, k + 1), n) - s).cast("long").alias("k"))))

    return F.when(F.size(items) > 0, let(F.sort_array(items), runs))
