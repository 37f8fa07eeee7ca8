"""Profiles of a record table: completeness, counts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflux.functions.blank import is_blank


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``(column_name, pct)``: per cent of rows with something but blanks in a column, to one place, one scan for all columns; no row for an empty table."""
    filled = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.trim(F.col(f"`{c}`")) != "").alias(f"_{i}") for i, c in enumerate(columns)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"_{i}").alias("k")) for i, c in enumerate(columns))))
    return filled.filter("_n > 0").select("_n", rows.alias("_r")).select(F.col("_r.c").alias("column_name"), F.round(F.col("_r.k") / F.col("_n") * 100, 1).alias("pct"))


def preview_figures(df: DataFrame) -> DataFrame:
    """One row ``(total, with_abstract, with_country, with_doi)`` of fetched records, before they join the others."""
    have = lambda c: F.count_if(F.trim(F.col(c)) != "").alias(f"with_{c}")
    return df.agg(F.count(F.lit(1)).alias("total"), have("abstract"), have("country"), have("doi"))


def year_counts(df: DataFrame, year: str = "year") -> DataFrame:
    """Rows ``(year, n)`` in order of the years as they are written; empty ones do not count."""
    return df.filter(F.trim(F.col(year)) != "").groupBy(F.col(year).alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy("year")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows ``(column, n)``; nulls count as empty."""
    return df.groupBy(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, year: str = "year") -> DataFrame:
    """One row: records, those with abstract, keywords, country and doi, first and last year."""
    have = lambda c: F.count_if(~is_blank(F.col(c)))
    y = numeric_year(year)
    return df.agg(F.count(F.lit(1)).alias("n_records"), have("abstract").alias("with_abstract"), have("keywords").alias("with_keywords"), have("country").alias("with_country"), have("doi").alias("with_doi"), F.min(y).alias("min_year"), F.max(y).alias("max_year"))


def numeric_year(column: str):
    """A year column read as a number and cut to an integer; null if it is none."""
    number = F.expr(f"try_cast(trim(`{column}`) as double)")
    return F.when(~F.isnan(number) & (F.abs(number) < 1e9), number.cast("int"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in a random but repeatable order."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
