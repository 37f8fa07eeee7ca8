"""Sparse TF-IDF vectors and distances between documents: never a dense matrix, only pairs that share a term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflux.functions.text import counted
from bibflux.session import written


def term_frequencies(docs: DataFrame, key: str, tokens: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(*within, key, term, tf)``: share of the document's tokens, counted inside its row; documents without tokens have no row."""
    rows = docs.select(*within, F.col(key), tokens.alias("_t")).filter(F.size("_t") > 0)
    rows = rows.select(*within, key, F.size("_t").alias("_n"), F.explode(counted(F.col("_t"))).alias("_c"))
    return rows.select(*within, key, F.col("_c.item").alias("term"), (F.col("_c.k") / F.col("_n")).alias("tf"))


def inverse_frequencies(tf: DataFrame, n_docs: int) -> DataFrame:
    """Rows ``(term, df, idf)`` with idf = ln((N + 1) / (df + 1)) + 1; ``n_docs`` is N, documents without tokens included."""
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", _idf(F.lit(n_docs)).alias("idf"))


def _idf(n: Column) -> Column:
    return F.log((n + 1) / (F.col("df") + 1)) + 1


def tfidf(docs: DataFrame, key: str, tokens: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``(*within, key, term, weight)``. The frequencies are written once, so that no text is read twice.

    ``within`` names columns of sets of documents that are weighed apart, all in one pass.
    """
    tf = written(term_frequencies(docs, key, tokens, within))
    if within:
        df = tf.groupBy(*within, "term").agg(F.count(F.lit(1)).alias("df")).join(docs.groupBy(*within).agg(F.count(F.lit(1)).alias("_N")), list(within))
        idf = df.select(*within, "term", _idf(F.col("_N")).alias("idf"))
    else:
        idf = inverse_frequencies(tf, docs.count())
    return tf.join(idf, [*within, "term"]).select(*within, key, "term", (F.col("tf") * F.col("idf")).alias("weight"))


def cosine_distances(vectors: DataFrame, docs: DataFrame, key: str, within: tuple[str, ...] = (), fill: bool = True) -> DataFrame:
    """Rows ``(*within, id_a, id_b, distance)`` for every two of ``docs`` (of one set), id_a < id_b: 1 - cosine, 1 if they share no term or one has none.

    The products are made by an equality join on terms. ``fill`` adds the pairs without a common term, whose distance is 1: that is a row for every two
    documents, meant for the bounded sets that are clustered; without it only pairs that share a term are given, whatever the size of the corpus.
    """
    norms = vectors.groupBy(*within, key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    unit = vectors.join(norms, [*within, key]).select(*within, key, "term", (F.col("weight") / F.col("_norm")).alias("w"))
    a = unit.select(*within, F.col(key).alias("id_a"), "term", F.col("w").alias("_wa"))
    b = unit.select(*within, F.col(key).alias("id_b"), "term", F.col("w").alias("_wb"))
    dots = a.join(b, [*within, "term"]).filter("id_a < id_b").groupBy(*within, "id_a", "id_b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("_dot"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("_dot", F.lit(0.0))))
    if fill:
        left, right = docs.select(*within, F.col(key).alias("id_a")), docs.select(*within, F.col(key).alias("id_b"))
        every = left.join(right, list(within)).filter("id_a < id_b") if within else left.join(right, F.col("id_a") < F.col("id_b"))
        dots = every.join(dots, [*within, "id_a", "id_b"], "left")
    return dots.select(*within, "id_a", "id_b", (1 - cosine).alias("distance"))


def distance_statistics(distances: DataFrame) -> DataFrame:
    """One row: least, greatest, mean and population deviation of the distances."""
    d = F.col("distance")
    return distances.agg(F.min(d).alias("min_d"), F.max(d).alias("max_d"), F.avg(d).alias("mean_d"), F.stddev_pop(d).alias("std_d"))
