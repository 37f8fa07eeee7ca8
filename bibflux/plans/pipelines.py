"""The chains that a user runs: unify sources, extract terms, cluster abstracts, and the tables of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibflux.functions.lexicon import CATEGORY_TERMS
from bibflux.functions.text import cluster_tokens
from bibflux.operators import category, clustering, dedup, geography, timeline, vectors, words
from bibflux.schema import CANONICAL, CANONICAL_SCHEMA, unioned
from bibflux.session import written


def with_record_ids(df: DataFrame) -> DataFrame:
    """``record_id`` from 0 in the order of the canonical columns, so that it does not depend on partitions.

    The sort is distributed by range; a row's number is its place in its partition plus the sizes of the partitions before it, and only those reach the driver.
    """
    at = F.monotonically_increasing_id()
    rows = written(df.select(*CANONICAL).orderBy(*CANONICAL).select(F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at"), *CANONICAL))
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("_part").agg(F.count(F.lit(1))).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    return rows.join(F.broadcast(offsets), "_part").select((F.col("_before") + F.col("_at")).alias("record_id"), *CANONICAL)  # as many rows as partitions


def unify_sources(spark: SparkSession, frames: list[DataFrame], threshold: float = dedup.DEFAULT_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All canonical frames as one table without duplicates, and the duplicates; no frame at all gives two empty tables."""
    all_records = unioned(frames) if frames else spark.createDataFrame([], CANONICAL_SCHEMA)
    return dedup.unify(written(with_record_ids(all_records)), "record_id", threshold)


def terms_report(df: DataFrame, text: str = "abstract", terms: tuple[str, ...] = CATEGORY_TERMS, max_terms: int = 15, min_doc_freq: int = 2) -> dict[str, DataFrame]:
    """``coverage``, ``frequencies`` and ``new_terms`` (with precision) of one corpus."""
    found = written(category.associated_terms(df, text, max_terms, min_doc_freq, terms))
    return {"coverage": category.coverage(df, text, terms), "frequencies": category.term_counts(df, text, terms), "new_terms": category.precision(df, text, found, terms)}


def cluster_documents(docs: DataFrame, key: str, text: str, set_id: str | None = None, max_docs: int = 2000) -> dict[str, DataFrame]:
    """``distances`` and ``merges`` of documents; ``set_id`` names the sets that are clustered apart, side by side in one plan (default: one set)."""
    rows = written(docs.filter(F.trim(text) != "").select(F.col(key).alias("id"), F.col(text).alias("_t"), (F.col(set_id) if set_id else F.lit(0)).cast("long").alias("set_id")))
    biggest = rows.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if biggest > max_docs:
        raise ValueError(f"a set of {biggest} documents; at most {max_docs} can be clustered together")
    weights = vectors.tfidf(rows, "id", cluster_tokens(F.col("_t")), ("set_id",))
    distances = written(vectors.cosine_distances(weights, rows, "id", ("set_id",)))
    return {"distances": distances, "merges": clustering.hierarchical(distances, max_docs)}


def report_tables(df: DataFrame, min_year: int = 2000) -> dict[str, DataFrame]:
    """The tables behind the report's cover and its three pages."""
    return {
        "summary": timeline.key_figures(df, min_year),
        "geography": geography.geography(df).orderBy(F.desc("n"), "country").limit(20),
        "words": words.word_frequencies(df, top=150),
        "leading_words": words.word_frequencies(df, top=30),
        "by_year": timeline.by_year(df, min_year),
        "by_year_and_source": timeline.by_year_and_source(df, min_year),
        "top_sources": timeline.top_sources(df, 8, min_year),
    }
