"""How distinctive a term is for a record: residuals of correspondence analysis.

For a term that occurs o times in a record of r tokens and t times among all n tokens, e = r * t / n is
expected. The standardised residual (o - e) / sqrt(e) has the variance (1 - r/n) * (1 - t/n);
the score is the residual divided by the square root of that (the adjusted residual).
Everything is DataFrame arithmetic. A record's own counts are made inside its row and written once, so the only
shuffles are the one of the vocabulary (combined before it moves) and the one that brings each term's totals back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflux.functions.blank import is_blank
from bibflux.functions.text import counted
from bibflux.session import written


def terms_of(text: Column, min_letters: int = 5) -> Column:
    """Lower-cased maximal runs of at least ``min_letters`` letters, in order, repeats kept; empty for a null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{min_letters},}}"), F.lit(0)), F.array().cast("array<string>"))


def term_scores(df: DataFrame, key: str, text: str, min_letters: int = 5) -> DataFrame:
    """Rows ``(key, term, tf, df, score)`` for each term of each record's text.

    Every row of ``df`` counts as a record of its own, exact copies included; ``key`` must tell the rows apart.
    Blank and null texts give no row and do not count. ``df`` is the number of records with the term. If the table holds a
    single distinct term or a single record, the variance is 0 and the score is 0. Columns other than ``key`` and
    ``text`` are ignored; an empty table gives an empty result.
    """
    rows = df.filter(~is_blank(F.col(f"`{text}`"))).select(F.col(f"`{key}`").alias("_key"), terms_of(F.col(f"`{text}`"), min_letters).alias("_terms"))
    # one row per record with its counts, written once: the texts are read and cut into terms a single time
    counts = written(rows.select("_key", F.size("_terms").cast("double").alias("_row"), counted(F.col("_terms")).alias("_t")).filter("_t is not null"))
    rows = counts.select("_key", "_row", F.explode("_t").alias("_t")).select("_key", "_row", F.col("_t.item").alias("term"), F.col("_t.k").alias("tf"))
    totals = written(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("double").alias("_col")))
    n = totals.agg(F.coalesce(F.sum("_col"), F.lit(0.0))).first()[0]
    totals = totals.withColumn("_n", F.lit(n))
    expected = F.col("_row") * F.col("_col") / F.col("_n")
    variance = (1 - F.col("_row") / F.col("_n")) * (1 - F.col("_col") / F.col("_n"))
    score = F.when(variance <= 0, F.lit(0.0)).otherwise((F.col("tf") - expected) / F.sqrt(expected * variance))
    return rows.join(totals, "term").select(F.col("_key").alias(key), "term", "tf", "df", score.alias("score"))
