"""Countries of publications, from affiliations, subject terms and texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibflux.functions.blank import is_blank
from bibflux.functions.lexicon import ADJECTIVES, SUBJECT_ALIASES, SUBJECT_COUNTRIES, affiliation_table


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def affiliation_country(c: Column) -> Column:
    """The country whose longest name stands in an affiliation as whole words; null if none does.

    Punctuation is read as blanks, so names with dots never match. The longest name anywhere wins, the first listed of equal length.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[,;.()\[\]]", " "), r"\s+", " "))
    rows = affiliation_table()
    longest_first = sorted((alias for alias, *_ in rows), key=lambda a: -len(a))
    # one pattern that gives the longest name at every place; it looks ahead, so that names may overlap
    names = F.regexp_extract_all(text, F.lit(rf"(?U)\b(?=({'|'.join(map(re.escape, longest_first))})\b)"), F.lit(1))
    ranks = F.create_map(*(x for alias, country, _, k in rows for x in (F.lit(alias), F.struct(F.lit(len(alias)).alias("n"), F.lit(-k).alias("k"), F.lit(country).alias("country")))))
    return F.array_max(F.transform(names, lambda n: F.element_at(ranks, n)))["country"]


def first_author_countries(df: DataFrame, column: str = "country") -> DataFrame:
    """Rows ``(country, n)`` of first authors' countries: the first place of a ``;`` list; blank and unknown places do not count."""
    place = F.substring_index(F.trim(F.col(column)), ";", 1)
    found = df.filter(~is_blank(F.col(column))).select(affiliation_country(place).alias("country")).filter("country is not null")
    return found.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


def iso_table(spark: SparkSession) -> DataFrame:
    """``(country, iso_a3)``."""
    return spark.createDataFrame(sorted({(c, iso) for _, c, iso, _ in affiliation_table()}), "country string, iso_a3 string")


def geography(df: DataFrame, column: str = "country") -> DataFrame:
    """Rows ``(country, iso_a3, n)``; countries without a code have an empty one."""
    codes = _map({c: iso for _, c, iso, _ in affiliation_table()})
    return first_author_countries(df, column).select("country", F.coalesce(codes[F.col("country")], F.lit("")).alias("iso_a3"), "n")


def geography_figures(df: DataFrame, column: str = "country") -> DataFrame:
    """One row: countries, publications and the leading country (of equals, the first by name)."""
    leader = F.min_by("country", F.struct((-F.col("n")).alias("n"), "country"))
    return geography(df, column).agg(F.count(F.lit(1)).alias("n_countries"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), leader.alias("leader"))


def subject_country(c: Column) -> Column:
    """The first term of a ``;`` list that is a country or another name of one, any case; empty if none is."""
    known = {n.lower(): n for n in SUBJECT_COUNTRIES}
    names = _map({**{a.lower(): n for a, n in SUBJECT_ALIASES.items()}, **known})
    terms = F.transform(F.split(c, ";"), lambda t: names[F.lower(F.trim(t))])
    return F.when(is_blank(c), F.lit("")).otherwise(F.coalesce(F.get(F.filter(terms, lambda t: t.isNotNull()), F.lit(0)), F.lit("")))


def text_country(c: Column) -> Column:
    """The country of the first national adjective of a text, else its first one-word country name; empty if there is neither."""
    words = F.regexp_extract_all(c, F.lit(r"\b[A-Za-z]+\b"), F.lit(0))
    by_adjective = F.filter(F.transform(words, lambda w: _map(ADJECTIVES)[F.lower(w)]), lambda x: x.isNotNull())
    by_name = F.filter(words, lambda w: w.isin(*SUBJECT_COUNTRIES))
    return F.when(is_blank(c), F.lit("")).otherwise(F.coalesce(F.get(by_adjective, F.lit(0)), F.get(by_name, F.lit(0)), F.lit("")))


# Parts of the names of columns that say where a record is from, in the order in which they are tried.
PLACE_COLUMNS = ("country", "authorlocation", "location", "affili", "institution", "organization", "address")


def country_column(df: DataFrame, parts: tuple[str, ...] = PLACE_COLUMNS) -> str | None:
    """The first column, by the order of ``parts``, whose name holds a part and that is not empty in every row; one scan for all candidates."""
    candidates = list(dict.fromkeys(c for p in parts for c in df.columns if p in c.lower()))
    if not candidates:
        return None
    filled = df.agg(*(F.max(F.trim(F.col(f"`{c}`")) != "").alias(f"_{i}") for i, c in enumerate(candidates))).first()
    return next((c for c, ok in zip(candidates, filled) if ok), None)


def split_by_code(places: DataFrame, code: str = "iso_a3") -> tuple[DataFrame, DataFrame]:
    """The rows with a country code, which a map can show, and those without."""
    has = F.coalesce(F.trim(F.col(code)) != "", F.lit(False))
    return places.filter(has), places.filter(~has)
