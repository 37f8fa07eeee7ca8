"""Publications over time: by year, by year and source, leading sources, key figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflux.functions.text import shorten
from bibflux.operators.records import numeric_year


def dated(df: DataFrame, min_year: int = 2000) -> DataFrame:
    """``(year, source_short)`` of rows with a numeric year of at least ``min_year``; a null source reads as empty."""
    rows = df.select(numeric_year("year").alias("year"), shorten(F.coalesce("source", F.lit(""))).alias("source_short"))
    return rows.filter(F.col("year") >= min_year)


def by_year(df: DataFrame, min_year: int = 2000) -> DataFrame:
    return dated(df, min_year).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def by_year_and_source(df: DataFrame, min_year: int = 2000) -> DataFrame:
    return dated(df, min_year).groupBy("year", "source_short").agg(F.count(F.lit(1)).alias("n"))


def top_sources(df: DataFrame, n: int = 8, min_year: int = 2000) -> DataFrame:
    """The ``n`` sources with most publications; ties by name."""
    totals = dated(df, min_year).groupBy("source_short").agg(F.count(F.lit(1)).alias("total"))
    return totals.orderBy(F.desc("total"), "source_short").limit(n)


def pivot(df: DataFrame, n: int = 8, min_year: int = 2000) -> DataFrame:
    """``(year, source_short, n)`` of the leading sources for every year that has publications, 0 where a source has none."""
    top = F.broadcast(top_sources(df, n, min_year).select("source_short"))  # n rows
    years = by_year(df, min_year).select("year")
    grid = years.select("year", F.lit(1).alias("_one")).join(top.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return grid.join(by_year_and_source(df, min_year), ["year", "source_short"], "left").select("year", "source_short", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def key_figures(df: DataFrame, min_year: int = 2000) -> DataFrame:
    """One row: publications, years, first year with most of them, and different sources."""
    years = by_year(df, min_year).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n_years"), F.max_by("year", F.struct("n", -F.col("year"))).alias("peak_year"))
    sources = dated(df, min_year).agg(F.count_distinct("source_short").alias("n_sources"))
    return years.select("*", sources.scalar().alias("n_sources"))
