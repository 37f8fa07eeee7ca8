from pyspark.sql import functions as F

from bibflux import explain
from bibflux.functions import similarity as S


def test_explanations(spark):
    a, b = "kitten", "sitting"
    t = spark.range(1).select(S.levenshtein_trace(F.lit(a), F.lit(b)).alias("l"), S.jaccard_trace(F.lit(a), F.lit(b)).alias("j"), S.cosine_trace(F.lit(a), F.lit(b)).alias("c"), S.hamming_trace(F.lit(a), F.lit(b)).alias("h")).first()
    assert "**3** edits" in explain.explain_levenshtein(a, b, t.l) and "∅" in explain.explain_levenshtein(a, b, t.l)
    assert "∅" not in explain.explain_levenshtein("x" * 16, b, t.l)
    assert "0 of 2" in explain.explain_jaccard(t.j) and "kitten" in explain.explain_cosine(t.c) and "3 of 7" in explain.explain_hamming(t.h)
    assert "not available" in explain.explain_embedding("Sentence encoder", 384, None)
