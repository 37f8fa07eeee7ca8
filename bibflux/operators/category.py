"""Category concepts in abstracts, terms associated with them (NPMI), and how precise these are."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflux.functions.lexicon import CATEGORY_TERMS
from bibflux.functions.text import counted, is_bigram, is_unigram, raw_tokens, term_pattern, words_and_pairs
from bibflux.session import written


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.trim(F.col(text)) != "")


def in_category(text: Column, terms: tuple[str, ...] = CATEGORY_TERMS) -> Column:
    """Whether any term stands in the text; one pattern for all, which only looks where a word begins."""
    return text.rlike(rf"(?iU)\b(?:{_bodies(terms)})\b") if terms else F.lit(False)


def _bodies(terms: tuple[str, ...]) -> str:
    """The alternatives of all terms, the longest first, without the word boundaries around them."""
    return "|".join(term_pattern(t).removeprefix(r"(?iU)\b").removesuffix(r"\b") for t in sorted(terms, key=len, reverse=True))


def _plain(term: str) -> str:
    """A term as it is in a text once hyphens and blanks are gone."""
    return re.sub(r"[-\s]", "", term.lower())


def _one_scan(terms: tuple[str, ...]) -> bool:
    """Whether one pattern can find all terms: none begins another, overlaps itself or reads like another without its blanks."""
    words = [re.split(r"[-\s]+", t.lower()) for t in terms]
    begins = any(x is not y and y[: len(x)] == x for x in words for y in words)
    return not begins and not any(len(w) > 1 and w[0] == w[-1] for w in words) and len({_plain(t) for t in terms}) == len(terms)


def _found(text: Column, terms: tuple[str, ...]) -> Column:
    """``array<struct<item,k>>``: the number of each term that stands in the text and how often; null if none does."""
    if _one_scan(terms):
        # a look ahead, so that terms may overlap
        hits = F.regexp_extract_all(text, F.lit(rf"(?iU)\b(?=({_bodies(terms)})\b)"), F.lit(1))
        number = F.create_map(*(x for i, t in enumerate(terms) for x in (F.lit(_plain(t)), F.lit(i))))
        return counted(F.filter(F.transform(hits, lambda h: F.element_at(number, F.regexp_replace(F.lower(h), r"(?U)[-\s]", ""))), lambda i: i.isNotNull()))
    counts = F.array(*(F.struct(F.lit(i).alias("item"), F.regexp_count(text, F.lit(term_pattern(t))).cast("long").alias("k")) for i, t in enumerate(terms)))
    return F.filter(counts, lambda c: c["k"] > 0)


def term_counts(df: DataFrame, text: str, terms: tuple[str, ...] = CATEGORY_TERMS) -> DataFrame:
    """Rows ``(term, doc_frequency, total_occurrences, doc_frequency_pct)`` for every term, all counted in one scan, the most frequent first, of equals in the given order.

    Texts of blanks and nulls do not count; an empty table gives zeros.
    """
    none = F.array(F.struct(F.lit(-1).alias("item"), F.lit(0).cast("long").alias("k")))
    found = F.coalesce(_found(F.col(text), terms), F.array().cast("array<struct<item:int,k:bigint>>"))
    # a text also counts as one without any term, so that the same pass counts all texts
    rows = _texts(df, text).select(F.explode(F.concat(none, found)).alias("_c")).groupBy("_c.item").agg(F.count(F.lit(1)).alias("d"), F.sum("_c.k").alias("t"))
    by_item = rows.agg(F.map_from_entries(F.collect_list(F.struct("item", F.struct("d", "t")))).alias("_m"))  # as many entries as terms
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("term"), F.element_at("_m", F.lit(i)).alias("c")) for i, t in enumerate(terms)))
    flat = by_item.select(F.coalesce(F.element_at("_m", F.lit(-1))["d"], F.lit(0)).alias("n"), F.explode(cells).alias("_c"))
    known = flat.select("n", "_c.i", "_c.term", F.coalesce("_c.c.d", F.lit(0)).alias("doc_frequency"), F.coalesce("_c.c.t", F.lit(0)).alias("total_occurrences"))
    pct = F.round(F.col("doc_frequency") / F.greatest(F.col("n"), F.lit(1)) * 100, 2)
    return known.orderBy(F.desc("doc_frequency"), "i").select("term", "doc_frequency", "total_occurrences", pct.alias("doc_frequency_pct"))


def coverage(df: DataFrame, text: str, terms: tuple[str, ...] = CATEGORY_TERMS) -> DataFrame:
    """One row ``(n_abstracts, n_category_docs, category_coverage_pct)``."""
    row = _texts(df, text).agg(F.count(F.lit(1)).alias("n_abstracts"), F.count_if(in_category(F.col(text), terms)).alias("n_category_docs"))
    return row.withColumn("category_coverage_pct", F.round(F.col("n_category_docs") / F.greatest(F.col("n_abstracts"), F.lit(1)) * 100, 2))


def term_statistics(counts: DataFrame) -> DataFrame:
    """One row: the middle of the document frequencies (the upper one of two) and how many terms occur."""
    ordered = F.sort_array(F.collect_list("doc_frequency"))  # one entry per category term
    return counts.agg(F.get(ordered, (F.count(F.lit(1)) / 2).cast("int")).alias("median_doc_frequency"), F.count_if(F.col("doc_frequency") > 0).alias("n_present"))


def npmi(n: Column, w: Column, cat: Column, both: Column) -> Column:
    """Normalised pointwise mutual information, to four places, from document counts."""
    joint = both / n
    score = F.log2(joint / ((w / n) * (cat / n))) / -F.log2(joint)
    return F.when((both == 0) | (w == 0) | (cat == 0) | (n == 0), -1.0).when(both == n, 1.0).otherwise(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)), 4))


def _excluded(terms: tuple[str, ...]) -> list[str]:
    return sorted({form for t in terms for form in (t.lower(), t.lower().replace("-", " "), t.lower().replace("-", ""))})


def candidates(df: DataFrame, text: str, terms: tuple[str, ...] = CATEGORY_TERMS, with_bigrams: bool = True) -> DataFrame:
    """Rows ``(term, doc_frequency, total_occurrences, docs_with_category, n, n_cat)`` for every uni- and bigram outside the category.

    A text's repeats are counted inside its row, so the only shuffle is the one by term, which is combined before it moves.
    """
    t = F.col(text)
    grams = words_and_pairs(t) if with_bigrams else raw_tokens(t)
    texts = _texts(df, text).select(in_category(t, terms).alias("_cat"), counted(grams).alias("_g"))
    # each text also counts once under an empty term, so that the same pass counts texts and those of the category
    whole = F.array(F.struct(F.lit("").alias("item"), F.lit(0).cast("long").alias("k")))
    rows = texts.select("_cat", F.explode(F.concat(whole, F.coalesce("_g", F.array().cast("array<struct<item:string,k:bigint>>")))).alias("_t"))
    rows = rows.groupBy(F.col("_t.item").alias("term")).agg(F.count(F.lit(1)).alias("doc_frequency"), F.sum("_t.k").alias("total_occurrences"), F.count_if("_cat").alias("docs_with_category"))
    # what counts as a term depends on its words alone, so that is asked once per term and not once per word of a text
    pair = F.split("term", " ")
    a, b = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
    rows = written(rows.filter((F.col("term") == "") | F.when(b.isNull(), is_unigram(a)).otherwise(is_bigram(a, b))))
    all_texts = rows.filter("term = ''").first()
    n, n_cat = (all_texts["doc_frequency"], all_texts["docs_with_category"]) if all_texts else (0, 0)
    return rows.filter((F.col("term") != "") & ~F.col("term").isin(*_excluded(terms))).withColumns({"n": F.lit(n), "n_cat": F.lit(n_cat)})


def associated_terms(df: DataFrame, text: str, max_terms: int = 15, min_doc_freq: int = 2, terms: tuple[str, ...] = CATEGORY_TERMS, with_bigrams: bool = True) -> DataFrame:
    """Rows ``(npmi_rank, term, doc_frequency, total_occurrences, doc_frequency_pct, npmi, docs_with_category)`` of the terms most tied to the category.

    Ordered by NPMI, then document frequency, then term (ties have no other defined order).
    """
    rows = candidates(df, text, terms, with_bigrams).filter(F.col("doc_frequency") >= min_doc_freq)
    rows = rows.withColumn("npmi", npmi(F.col("n"), F.col("doc_frequency"), F.col("n_cat"), F.col("docs_with_category"))).filter("npmi > 0")
    top = rows.orderBy(F.desc("npmi"), F.desc("doc_frequency"), "term").limit(max_terms)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("npmi")).alias("a"), (-F.col("doc_frequency")).alias("b"), "term", "doc_frequency", "total_occurrences", F.round(F.col("doc_frequency") / F.col("n") * 100, 2).alias("doc_frequency_pct"), "npmi", "docs_with_category")))
    ranked = top.agg(listed.alias("_l")).select(F.posexplode("_l").alias("_p", "_r"))  # max_terms rows
    fields = ("term", "doc_frequency", "total_occurrences", "doc_frequency_pct", "npmi", "docs_with_category")
    return ranked.select((F.col("_p") + 1).alias("npmi_rank"), *(F.col(f"_r.{f}").alias(f) for f in fields))


def precision_label(p: Column) -> Column:
    return F.when(p >= 0.75, "very relevant").when(p >= 0.5, "moderately relevant").when(p >= 0.25, "weakly relevant").otherwise("hardly relevant")


def precision(df: DataFrame, text: str, found: DataFrame, terms: tuple[str, ...] = CATEGORY_TERMS) -> DataFrame:
    """``found`` with ``precision_rank, precision, precision_pct, precision_label``, best first: of the texts that hold a term as whole words, the share in the category.

    Of equal precision the higher NPMI comes first, then the lower NPMI rank. ``found`` has at most a few terms, which become patterns of one scan; the texts are
    raw, so terms that only exist after cleaning get 0.
    """
    found = written(found)
    names = [r[0] for r in found.select("term").collect()]
    if not names:
        return found.select(F.lit(0).alias("precision_rank"), "*", F.lit(0.0).alias("precision"), F.lit(0.0).alias("precision_pct"), F.lit("").alias("precision_label"))
    t = F.col(text)
    hits = F.filter(F.array(*(F.when(t.rlike(rf"(?iU)\b{re.escape(w)}\b"), F.lit(w)) for w in names)), lambda w: w.isNotNull())
    counts = _texts(df, text).select(in_category(t, terms).alias("_cat"), F.explode(hits).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("d"), F.count_if("_cat").alias("b"))
    share = F.coalesce(F.col("b") / F.col("d"), F.lit(0.0))
    rated = found.join(F.broadcast(counts), "term", "left")  # as many rows as found
    fields = [*found.columns, F.round(share, 4).alias("precision"), F.round(share * 100, 1).alias("precision_pct"), precision_label(share).alias("precision_label")]
    listed = F.sort_array(F.collect_list(F.struct((-F.col("precision")).alias("_p"), (-F.col("npmi")).alias("_s"), "npmi_rank", F.struct("*").alias("r"))))
    ranked = rated.select(*fields).agg(listed.alias("_l")).select(F.posexplode("_l").alias("_p", "_r"))
    return ranked.select((F.col("_p") + 1).alias("precision_rank"), "_r.r.*")


def precision_figures(rated: DataFrame) -> DataFrame:
    """One row: mean precision, terms of 0.75 and more, one- and two-word terms."""
    two = F.contains(F.col("term"), F.lit(" "))
    mean = F.avg("precision")
    return rated.agg(F.round(mean, 4).alias("mean_precision"), F.count_if(F.col("precision") >= 0.75).alias("n_high"), F.count_if(~two).alias("n_unigrams"), F.count_if(two).alias("n_bigrams"), precision_label(mean).alias("quality"))
