"""CSV exports of bibliographic databases, read into the canonical table."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibflux.functions.text import extract_year, merge_keywords
from bibflux.operators.geography import subject_country, text_country
from bibflux.schema import CANONICAL_SCHEMA, canonical, cleaned

# The headers of each export and the columns they fill, synonyms after the usual name.
HEADERS = {
    "ACM": {"title": ["Title"], "authors": ["Author", "Authors"], "year": ["Publication Year", "Year"], "source": ["Source", "Venue"], "doi": ["DOI"], "abstract": ["Abstract"], "document_type": ["Document Type"], "url": ["URL"], "issn": ["ISBN/ISSN"], "keywords": ["Keywords"]},
    "ScienceDirect": {"title": ["Title"], "authors": ["Authors", "Author(s)"], "year": ["Year", "Publication Year"], "source": ["Source title", "Source"], "doi": ["DOI"], "abstract": ["Abstract"], "document_type": ["Document Type"], "url": ["Link"], "issn": ["ISSN"], "keywords": ["Author Keywords"], "index_keywords": ["Index Keywords"]},
    "EBSCO": {"title": ["title"], "abstract": ["abstract"], "source": ["source"], "doi": ["doi"], "authors": ["contributors"], "document_type": ["docTypes", "doctypes"], "url": ["plink"], "issn": ["issns"], "isbn": ["isbns"], "keywords": ["subjects"], "country": ["authorLocations", "authorlocations", "Author Locations", "authorAffiliations", "affiliations"], "pub_date_raw": ["publicationDate", "publicationdate"], "cover_date": ["coverDate", "coverdate"]},
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, header names without outer blanks; quoted line breaks and doubled quotes are understood, a byte-order mark is dropped.

    Raises FileNotFoundError for a missing path.
    """
    try:
        df = spark.read.options(header=True, multiLine=True, escape='"', quote='"', encoding="UTF-8").csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    return df.toDF(*(c.strip().lstrip("﻿") for c in df.columns))


def _named(df: DataFrame, source_db: str) -> DataFrame:
    """One column per target: the first of its synonyms that is there; later ones are left out."""
    have = set(df.columns)
    cols = []
    for target, names in HEADERS[source_db].items():
        found = [F.nullif(cleaned(F.col(f"`{n}`")), F.lit("")) for n in names if n in have]
        if found:
            cols.append(F.coalesce(found[0], F.lit("")).alias(target))
    return df.select(*cols)


def parse_acm(df: DataFrame) -> DataFrame:
    return canonical(_named(df, "ACM"), "ACM", ("nan",))


def parse_sciencedirect(df: DataFrame) -> DataFrame:
    """Author and index keywords become one sorted list."""
    named = _named(df, "ScienceDirect")
    if "index_keywords" in named.columns:
        own = F.col("keywords") if "keywords" in named.columns else F.lit("")
        merged = merge_keywords(own, F.col("index_keywords")) if "keywords" in named.columns else F.col("index_keywords")
        named = named.withColumn("keywords", merged).drop("index_keywords")
    return canonical(named, "ScienceDirect", ("nan",))


def parse_ebsco(df: DataFrame) -> DataFrame:
    """The year comes from the publication date, else the cover date; if no row has a country, subjects and then abstracts give it."""
    named = _named(df, "EBSCO")
    if "year" not in named.columns:
        dates = [c for c in ("pub_date_raw", "cover_date") if c in named.columns]
        named = named.withColumn("year", extract_year(F.col(dates[0])) if dates else F.lit(""))
    if "country" not in named.columns or named.filter("country <> ''").isEmpty():
        named = named.withColumn("country", derived_country(*(F.col(c) if c in named.columns else F.lit("") for c in ("keywords", "abstract"))))
    return canonical(named, "EBSCO")


def derived_country(subjects: Column, abstract: Column) -> Column:
    return F.coalesce(F.nullif(subject_country(subjects), F.lit("")), text_country(abstract))


PARSERS = {"ACM": parse_acm, "ScienceDirect": parse_sciencedirect, "EBSCO": parse_ebsco}


def read_export(spark: SparkSession, path: str, source_db: str, tolerant: bool = False) -> DataFrame:
    """An export as canonical records; ``tolerant`` gives an empty table for one that cannot be read."""
    try:
        return PARSERS[source_db](read_csv(spark, path))
    except Exception:
        if tolerant:
            return spark.createDataFrame([], CANONICAL_SCHEMA)
        raise


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV files with header, one per partition; each begins with a byte-order mark, as spreadsheet programs expect."""
    first, *rest = df.columns
    marked = df.select(F.col(first).alias("﻿" + first), *rest)
    marked.write.mode(mode).options(header=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def csv_chunks(df: DataFrame) -> Iterator[bytes]:
    """A table of any size as the pieces of one CSV download, fetched partition by partition, so that the driver never holds more than one."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    mark = "\ufeff"
    for row in df.toLocalIterator(prefetchPartitions=True):
        writer.writerow(["" if v is None else v for v in row])
        if out.tell() > 1 << 20:
            yield (mark + out.getvalue()).encode()
            mark = ""
            out.seek(0)
            out.truncate()
    yield (mark + out.getvalue()).encode()


def csv_bytes(df: DataFrame) -> bytes:
    """The whole download at once, for tables that a browser would take; larger ones go through ``csv_chunks``."""
    return b"".join(csv_chunks(df))


def read_unified(spark: SparkSession, path: str) -> DataFrame:
    """A written unified table, with nan and none cleaned."""
    return canonical(read_csv(spark, path))
