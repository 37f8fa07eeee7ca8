import pytest
from pyspark.sql import functions as F

from bibflux.functions import similarity as S
from bibflux.functions.text import bigrams, cluster_tokens, extract_year, frequency_tokens, merge_keywords, normalize_title, shorten, stem, unigrams


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


L = F.lit


def test_normalize_title(spark):
    assert value(spark, normalize_title(L("Análisis  de Algoritmos!"))) == "analisis de algoritmos"
    assert value(spark, normalize_title(L(None).cast("string"))) == ""
    assert value(spark, normalize_title(L("ﬁne Ｔuning"))) == "fine tuning"


@pytest.mark.parametrize("text,year", [("20260326", "2026"), ("Mar2026", "2026"), ("2025-09-15", "2025"), ("", ""), ("15092025", "1509"), ("12 in 1999", "1999")])
def test_extract_year(spark, text, year):
    assert value(spark, extract_year(L(text))) == year


def test_stem(spark):
    words = {"learning": "learn", "proposed": "propos", "generation": "gener", "algorithms": "algorithms", "used": "used"}
    got = value(spark, F.transform(F.array(*map(L, words)), stem))
    assert got == list(words.values())


def test_tokens(spark):
    assert value(spark, unigrams(L("The model, of AI 2.0 learns"))) == ["model", "learns"]
    assert value(spark, bigrams(L("of learning is the a deep"))) == ["of learning", "learning is"]
    assert value(spark, cluster_tokens(L("Models are learning"))) == ["learn"]
    assert value(spark, frequency_tokens(L("AI models learn; models at https://x.y 2024"))) == ["models", "learn", "models"]
    assert value(spark, merge_keywords(L("B; a"), L("c;A; "))) == "a; b; c"
    assert value(spark, shorten(L("x" * 46))) == "x" * 45 + "…"


CASES = [
    (S.levenshtein_similarity, "hello", "helo", 0.8), (S.levenshtein_similarity, "", "", 1.0), (S.levenshtein_similarity, "abc", "", 0.0),
    (S.jaccard_similarity, "hello world", "hello foo", 1 / 3), (S.jaccard_similarity, "", "", 1.0), (S.jaccard_similarity, "hello", "", 0.0),
    (S.cosine_similarity, "a b c", "a b c", 1.0), (S.cosine_similarity, "a b", "c d", 0.0), (S.cosine_similarity, "", "", 1.0), (S.cosine_similarity, "hello", "", 0.0),
    (S.hamming_similarity, "hello", "hallo", 0.8), (S.hamming_similarity, "abc", "abcd", 0.75), (S.hamming_similarity, "", "", 1.0),
]


@pytest.mark.parametrize("measure,a,b,want", CASES)
def test_measures(spark, measure, a, b, want):
    assert value(spark, measure(L(a), L(b))) == pytest.approx(want)
    assert value(spark, measure(L(b), L(a))) == pytest.approx(want)


def test_traces(spark):
    t = value(spark, S.levenshtein_trace(L("ab"), L("ac")))
    assert t.matrix == [[0, 1, 2], [1, 0, 1], [2, 1, 1]] and t.distance == 1 and t.similarity == 0.5
    j = value(spark, S.jaccard_trace(L("a b"), L("b c")))
    assert (j.tokens_a, j.intersection, j.union, j.similarity) == (["a", "b"], ["b"], ["a", "b", "c"], 0.3333)
    h = value(spark, S.hamming_trace(L("ab"), L("abcd")))
    assert (h.distance, h.total_positions, len(h.comparisons_sample)) == (2, 4, 4)
    c = value(spark, S.cosine_trace(L(""), L("")))
    assert c.similarity == 0.0


def test_tables_of_measures(spark):
    from bibflux.functions import embedding, similarity
    from bibflux.operators.dedup import titles_are_duplicate

    docs = spark.createDataFrame([(1, "abcd"), (2, "abxd"), (3, "")], "id int, t string")
    m = {(r.id_a, r.id_b): r.similarity for r in similarity.similarity_matrix(docs, "id", "t").collect()}
    assert len(m) == 9 and m[1, 1] == m[3, 3] == 1.0 and m[1, 2] == m[2, 1] == 0.75 and m[1, 3] == 0.0
    pairs = spark.createDataFrame([(7, "abcd", "abxd")], "id int, a string, b string")
    failing = {"levenshtein": similarity.levenshtein_similarity, "none": lambda a, b: F.lit(None).cast("double")}
    assert {(r.id, r.measure, r.similarity) for r in similarity.score_table(pairs, "a", "b", failing).collect()} == {(7, "levenshtein", 0.75), (7, "none", None)}
    titles = spark.createDataFrame([("A title, of some length here", "a TITLE of some length here!"), ("a", "b"), ("", ""), (None, "x")], "a string, b string")
    assert [r[0] for r in titles.select(titles_are_duplicate(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
    encoded = spark.createDataFrame([("a", "b", [1.0, 0.0], [1.0, 1.0]), (" ", "", [1.0], [1.0]), ("a", "", [1.0], [1.0]), ("a", "b", [1.0], [-1.0])], "a string, b string, x array<double>, y array<double>")
    got = [r[0] for r in encoded.select(similarity.encoded_similarity(*map(F.col, "abxy"))).collect()]
    assert [round(g, 6) for g in got] == [0.707107, 1.0, 0.0, 0.0]
    words = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (1, "?"), (2, "?")], "id int, w string")
    vectors = spark.createDataFrame([("x", [3.0, 0.0]), ("y", [0.0, 3.0])], "w string, v array<double>")
    assert [(r.id, r.v) for r in embedding.text_vectors(words, "id", "w", vectors, "v").collect()] == [(1, [1.0, 2.0])]
