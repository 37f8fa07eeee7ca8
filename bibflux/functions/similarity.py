"""Similarity of two texts: edit, set, TF-IDF, positional and vector measures, with their traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflux.functions.let import let
from bibflux.functions.text import word_tokens


def _empty_rule(a: Column, b: Column, otherwise: Column) -> Column:
    """Both empty is 1, one empty is 0."""
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(otherwise)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(_empty_rule(F.length(a), F.length(b), 1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1))))


def levenshtein_trace(a: Column, b: Column) -> Column:
    """``struct<matrix,distance,similarity>``: the whole table of prefix distances, built row by row inside the JVM."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    numbers = lambda n: F.transform(F.sequence(F.lit(0), n), lambda i: i.cast("int"))

    def next_row(row: Column, x: Column, y: Column) -> Column:
        start = F.array(F.get(row, F.lit(0)) + 1)
        step = lambda acc, c, j: F.concat(acc, F.array(F.least(F.get(acc, j) + 1, F.get(row, j + 1) + 1, F.get(row, j) + (c != x).cast("int"))))
        indexed = F.transform(y, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
        return F.aggregate(indexed, start, lambda acc, s: step(acc, s["c"], s["j"]))

    def table(y: Column) -> Column:
        first = F.array(numbers(F.size(y)))
        return F.aggregate(letters(a), first, lambda rows, x: F.concat(rows, F.array(next_row(F.element_at(rows, -1), x, y))))

    distance = F.levenshtein(a, b)
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.struct(let(letters(b), table).alias("matrix"), distance.alias("distance"), F.round(1 - distance / longest, 4).alias("similarity"))


def jaccard_similarity(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(word_tokens(c)) for c in (a, b))
    return let(F.struct(x.alias("x"), y.alias("y")), lambda s: _empty_rule(F.size(s["x"]), F.size(s["y"]), F.size(F.array_intersect(s["x"], s["y"])) / F.greatest(F.size(F.array_union(s["x"], s["y"])), F.lit(1))))


def jaccard_trace(a: Column, b: Column) -> Column:
    x, y = (F.array_sort(F.array_distinct(word_tokens(c))) for c in (a, b))
    both, either = F.array_sort(F.array_intersect(x, y)), F.array_sort(F.array_union(x, y))
    share = F.when(F.size(either) == 0, 1.0).otherwise(F.size(both) / F.greatest(F.size(either), F.lit(1)))
    return F.struct(x.alias("tokens_a"), y.alias("tokens_b"), both.alias("intersection"), either.alias("union"), F.size(both).alias("intersection_size"), F.size(either).alias("union_size"), F.round(share, 4).alias("similarity"))


def _weights(tokens: Column, vocabulary: Column, other: Column, digits: int | None) -> Column:
    """TF-IDF of each vocabulary word; with two documents the IDF is 1 for shared words and ln(1.5) + 1 for others."""
    idf = lambda w: F.when(F.array_contains(tokens, w) & F.array_contains(other, w), 1.0).otherwise(F.log(F.lit(1.5)) + 1)
    weight = lambda w: F.size(F.filter(tokens, lambda t: t == w)) / F.greatest(F.size(tokens), F.lit(1)) * idf(w)
    return F.transform(vocabulary, lambda w: F.round(weight(w), digits) if digits is not None else weight(w))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _cosine(x: Column, y: Column) -> Column:
    dot = _sum(F.zip_with(x, y, lambda a, b: (a * b).cast("double")))
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda a: (a * a).cast("double"))))
    return F.when((norm(x) == 0) | (norm(y) == 0), 0.0).otherwise(dot / (norm(x) * norm(y)))


def _tokens_and_vocabulary(a: Column, b: Column) -> Column:
    x, y = word_tokens(a), word_tokens(b)
    return F.struct(x.alias("x"), y.alias("y"), F.array_sort(F.array_union(x, y)).alias("v"))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of TF-IDF vectors over the two texts alone."""

    def score(s: Column) -> Column:
        vectors = F.struct(_weights(s["x"], s["v"], s["y"], None).alias("p"), _weights(s["y"], s["v"], s["x"], None).alias("q"))
        return _empty_rule(F.size(s["x"]), F.size(s["y"]), let(vectors, lambda w: _cosine(w["p"], w["q"])))

    return let(_tokens_and_vocabulary(a, b), score)


def cosine_trace(a: Column, b: Column) -> Column:
    """As ``cosine_similarity``, with weights rounded to four places before the product, and 0 for two empty texts."""

    def trace(s: Column) -> Column:
        vectors = F.struct(_weights(s["x"], s["v"], s["y"], 4).alias("p"), _weights(s["y"], s["v"], s["x"], 4).alias("q"))
        return let(vectors, lambda w: F.struct(s["x"].alias("tokens_a"), s["y"].alias("tokens_b"), s["v"].alias("vocabulary"), w["p"].alias("tfidf_vector_a"), w["q"].alias("tfidf_vector_b"), F.round(_cosine(w["p"], w["q"]), 4).alias("similarity")))

    return let(_tokens_and_vocabulary(a, b), trace)


def _padded(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    pad = lambda c: F.filter(F.split(F.rpad(F.lower(c), n, " "), ""), lambda x: x != "")
    return F.zip_with(pad(a), pad(b), lambda x, y: F.struct(x.alias("char_a"), y.alias("char_b"), (x == y).alias("match")))


def hamming_similarity(a: Column, b: Column) -> Column:
    """Share of equal positions of the lower-cased texts, the shorter one padded with blanks."""
    score = lambda p: 1 - F.size(F.filter(p, lambda s: ~s["match"])) / F.greatest(F.size(p), F.lit(1))
    return F.when(F.lower(a) == F.lower(b), 1.0).otherwise(let(_padded(a, b), score))


def hamming_trace(a: Column, b: Column, sample: int = 50) -> Column:
    def trace(p: Column) -> Column:
        distance = F.size(F.filter(p, lambda s: ~s["match"]))
        return F.struct(F.slice(p, 1, sample).alias("comparisons_sample"), distance.alias("distance"), F.size(p).alias("total_positions"), F.round(1 - distance / F.greatest(F.size(p), F.lit(1)), 4).alias("similarity"))

    return let(_padded(a, b), trace)


def vector_cosine(x: Column, y: Column) -> Column:
    """Cosine of two numeric arrays, never negative; 0 if either has no length."""
    return F.greatest(F.lit(0.0), _cosine(x, y))


def encoded_similarity(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Cosine of the vectors ``x`` and ``y`` of two texts, never negative; 1 for two blank texts, 0 for one."""
    blank = lambda c: F.trim(c) == ""
    return F.when(blank(a) & blank(b), 1.0).when(blank(a) | blank(b), 0.0).otherwise(vector_cosine(x, y))


#: The registry of measures over texts.
MEASURES = {"levenshtein": levenshtein_similarity, "jaccard": jaccard_similarity, "cosine_tfidf": cosine_similarity, "hamming": hamming_similarity}


def score_table(pairs: DataFrame, a: str, b: str, measures: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """The columns of ``pairs`` but the two texts, with a row ``(measure, similarity)`` for each chosen measure, to four places; null where a measure gives none."""
    chosen = MEASURES if measures is None else measures
    keys = [c for c in pairs.columns if c not in (a, b)]
    scores = F.array(*(F.struct(F.lit(name).alias("measure"), F.round(f(F.col(a), F.col(b)), 4).alias("similarity")) for name, f in chosen.items()))
    return pairs.select(*keys, F.explode(scores).alias("_s")).select(*keys, "_s.measure", "_s.similarity")


def similarity_matrix(docs: DataFrame, key: str, text: str, measure: str = "levenshtein") -> DataFrame:
    """Rows ``(id_a, id_b, similarity)`` of the whole square matrix of a small set, to four places: 1 on the diagonal, each other pair measured once."""
    left, right = docs.select(F.col(key).alias("id_a"), F.col(text).alias("_a")), docs.select(F.col(key).alias("id_b"), F.col(text).alias("_b"))
    half = left.join(right, F.col("id_a") < F.col("id_b")).select("id_a", "id_b", F.round(MEASURES[measure](F.col("_a"), F.col("_b")), 4).alias("similarity"))
    both = F.explode(F.array(F.struct("id_a", "id_b"), F.struct(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))).alias("_p")
    return half.select(both, "similarity").select("_p.*", "similarity").unionByName(docs.select(F.col(key).alias("id_a"), F.col(key).alias("id_b"), F.lit(1.0).alias("similarity")))
