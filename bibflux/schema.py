"""The canonical record and the nested record of the works API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANONICAL = ("title", "authors", "year", "source", "doi", "abstract", "document_type", "url", "issn", "keywords", "country", "source_db")
CANONICAL_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CANONICAL])

WORK_DDL = (
    "title string, publication_year int, doi string, type string,"
    " authorships array<struct<author:struct<display_name:string>,institutions:array<struct<country_code:string,display_name:string>>>>,"
    " primary_location struct<source:struct<display_name:string,issn_l:string,issn:array<string>>,landing_page_url:string>, open_access struct<oa_url:string>,"
    " abstract_inverted_index map<string,array<string>>, keywords array<struct<keyword:string>>, topics array<struct<display_name:string>>"
)


def cleaned(c: Column, words: tuple[str, ...] = ("nan", "none")) -> Column:
    """Trimmed; empty for null and for the given words in any case."""
    t = F.trim(c.cast("string"))
    return F.when(t.isNull() | F.lower(t).isin(*words), F.lit("")).otherwise(t)


def canonical(df: DataFrame, source_db: str | None = None, words: tuple[str, ...] = ("nan", "none")) -> DataFrame:
    """The twelve columns in order, cleaned, missing ones empty, rows without a title dropped; repeated rows stay."""
    cols = [cleaned(F.col(f"`{c}`"), words).alias(c) if c in df.columns else F.lit("").alias(c) for c in CANONICAL[:-1]]
    db = F.lit(source_db) if source_db is not None else cleaned(F.col("source_db"), words) if "source_db" in df.columns else F.lit("")
    return df.select(*cols, db.alias("source_db")).filter("title <> ''")


def unioned(frames: list[DataFrame]) -> DataFrame:
    """All frames by column name; what a frame lacks, or all lack of the canonical columns, is empty."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumns({c: F.lit("") for c in CANONICAL if c not in out.columns}).fillna("")
