"""Terms, co-occurrence, packing, leaks and residue."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibflux.llm.concepts import bounded_list, found_terms
from bibflux.llm.cooccur import pair_associations
from bibflux.llm.distinctive import term_scores
from bibflux.llm.leakage import _numbers, banded_passages, find_leaks, plain_words
from bibflux.llm.packing import best_fit_decreasing, certificate, lower_bound, pack_documents
from bibflux.llm.residue import PHRASES, find_residue, masked, messages
from tests.conftest import rows


def test_term_scores_against_the_formula(spark):
    texts = {1: "Alpha alpha ALPHA gamma delta, beta1beta omega", 2: "gammas gamma gamma", 3: None, 4: "nan", 5: "naïveté naïveté abcd"}
    df = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()], "record_id long, abstract string, term string")
    counts = {1: {"alpha": 3, "gamma": 1, "delta": 1, "omega": 1}, 2: {"gammas": 1, "gamma": 2}, 5: {"naïveté": 2}}
    n = sum(sum(c.values()) for c in counts.values())
    got = {(r.record_id, r.term): r for r in term_scores(df, "record_id", "abstract").collect()}
    assert {(k, t): c for k, ts in counts.items() for t, c in ts.items()} == {k: r.tf for k, r in got.items()}
    for (k, t), r in got.items():
        row, col = sum(counts[k].values()), sum(c.get(t, 0) for c in counts.values())
        e = row * col / n
        assert r.score == pytest.approx((r.tf - e) / math.sqrt(e * (1 - row / n) * (1 - col / n)))
        assert r.df == sum(t in c for c in counts.values())
    assert term_scores(df.limit(0), "record_id", "abstract").count() == 0
    assert [r.score for r in term_scores(df.filter("record_id = 5"), "record_id", "abstract").collect()] == [0.0]


def test_huge_baskets(spark):
    """Baskets far beyond a chunk, one of them repeated, through the chunk joins."""
    rng = random.Random(6)
    names = [f"i{k:03}" for k in range(300)]
    sets = [set(names), set(names), set(rng.sample(names, 200)), set(rng.sample(names, 70)), set(names[:3])]
    df = spark.createDataFrame([(sorted(s),) for s in sets], "items array<string>")
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in pair_associations(df).collect()}
    count = {i: sum(i in s for s in sets) for i in names}
    assert got == {(a, b): (sum({a, b} <= s for s in sets), count[a], count[b], 5) for a, b in itertools.combinations(names, 2)}


@pytest.mark.parametrize("chunk", [2, 3, 64])
def test_pairs_against_brute_force(spark, chunk):
    rng = random.Random(2)
    baskets = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for _ in range(60)] + [list("abcdefgh")] * 30 + [None, [], [None]]
    df = spark.createDataFrame([(b, 1) for b in baskets], "items array<string>, n_ab int")
    sets = [set(b) - {None} for b in baskets if b and set(b) - {None}]
    want = {}
    for a, b in itertools.combinations("abcdefgh", 2):
        if (n_ab := sum({a, b} <= s for s in sets)) >= 2:
            n_a, n_b = sum(a in s for s in sets), sum(b in s for s in sets)
            want[a, b] = (n_ab, n_a, n_b, len(sets), n_ab * len(sets) / (n_a * n_b))
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n, r.lift) for r in pair_associations(df, min_pairs=2, chunk=chunk).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert pair_associations(df.limit(0)).count() == 0


def test_found_terms(spark):
    terms = ["few-shot exemplars", "co-writing", "bias"]
    df = spark.createDataFrame([("FEW (shot) 2\nexemplars; cowriting biased",), ("bias co writing",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(found_terms(F.col("t"), terms)).collect()] == [["few-shot exemplars"], ["co-writing", "bias"], [], []]
    with pytest.raises(ValueError):
        bounded_list(df, "t", limit=1)


def test_bins():
    rng = np.random.default_rng(5)
    for _ in range(40):
        capacity = int(rng.integers(5, 60))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(0, 80)))
        bins = best_fit_decreasing(sizes, capacity)
        assert all(sizes[bins == b].sum() <= capacity for b in set(bins.tolist()))
        assert lower_bound(sizes, capacity) <= len(set(bins.tolist()))
    assert lower_bound(np.array([6, 6, 6]), 10) == 3 and lower_bound(np.array([4, 4, 4, 4]), 10) == 2
    assert lower_bound(np.array([5, 5, 5]), 10) == 2


@pytest.mark.parametrize("per_partition", [10_000, 40])
def test_packing(spark, per_partition):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["story", "machine", "essay", "überall", "z"]) for _ in range(rng.randint(1, 130))) for _ in range(200)]
    texts += ["word " * 900, "x" * 30000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("piece", F.lit("clash"))
    out = pack_documents(df, "doc_id", "text", capacity=128, per_partition=per_partition)
    got = out.collect()
    fill, pieces = {}, {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
    assert max(fill.values()) <= 128 and set(pieces) == set(range(202))
    for p in pieces.values():
        p.sort()
        assert [s for s, _ in p] == [128 * k for k in range(len(p))] and all(n == 128 for _, n in p[:-1])
    assert sum(fill.values()) / 128 / len(fill) > 0.95
    assert rows(out) == rows(pack_documents(df, "doc_id", "text", capacity=128, per_partition=per_partition))
    proof = certificate(out, 128).first()
    assert proof.n_containers == len(fill) and proof.gap == proof.n_containers - proof.bound >= 0 and proof.fill == pytest.approx(sum(fill.values()) / 128 / len(fill))
    assert all(r.certified for r in got if r.n_tokens == 128)
    empty = pack_documents(df.limit(0), "doc_id", "text")
    assert empty.count() == 0 and certificate(empty).first().n_containers == 0


WORDS = "according to lunizuphase group talk among design undergraduates in zivumudar depends on rehearsals and never on code companions alone".split()


def test_plain_words():
    assert plain_words("Caf&#233; <b>naïve</b> re-\n  tried zero​width so­ft A1&amp;b") == ["cafe", "naive", "retried", "zerowidth", "soft", "a1", "b"]
    assert plain_words(None) == plain_words("") == []


def longest_run(item, doc, least=1):
    """Words of the longest run of equal words, the slow way."""
    best = 0
    for i in range(len(item)):
        for j in range(len(doc)):
            n = 0
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                n += 1
            best = max(best, n)
    return best if best >= least else 0


def edited_passage(item, doc, edits):
    """Words of the longest passage of the item that the document holds with so many word edits, beginning and ending with equal words, by trying all."""
    best = 0

    def go(i, j, n, left, ends):
        nonlocal best
        if ends:
            best = max(best, n)
        if i < len(item) and j < len(doc) and item[i] == doc[j]:
            go(i + 1, j + 1, n + 1, left, True)
        if left and n:
            if i < len(item) and j < len(doc):
                go(i + 1, j + 1, n + 1, left - 1, False)
            if i < len(item):
                go(i + 1, j, n + 1, left - 1, False)
            if j < len(doc):
                go(i, j + 1, n, left - 1, False)

    for i in range(len(item)):
        for j in range(len(doc)):
            if item[i] == doc[j]:
                go(i, j, 0, edits, False)
    return best


def test_banded_passages():
    rng = random.Random(3)
    for _ in range(150):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 8))] for _ in range(2))
        got = banded_passages(_numbers(" ".join(a)), _numbers(" ".join(b)), -9, 9, 2)
        assert got == [longest_run(a, b), edited_passage(a, b, 1), edited_passage(a, b, 2)], (a, b)
    assert banded_passages(_numbers("a b c"), _numbers("x a b c"), 0, 0, 0) == [0]


def test_leaks(spark):
    item = " ".join(WORDS)
    docs = {
        1: f"Before it. {item.upper()} After it.",
        2: "pre " + " ".join(WORDS[3:15]) + " post",
        3: "pre " + " ".join(WORDS[3:14]) + " post",
        4: "Accor-\nding to <i>Lunizuphase</i>, gro­up talk&nbsp;among désign undergraduates in zivumudar depends; on rehearsals and",
        5: " ".join(w for w in WORDS if w != "among"),
        6: " ".join(reversed(WORDS)),
        7: None,
        8: "",
        9: "filler words here " * 4000 + item,
        10: item,
        11: item,
        12: " ".join(w.replace("rehearsals", "rehearsels") for w in WORDS),
    }
    df = spark.createDataFrame([(k, v, "clash") for k, v in docs.items()], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, item), (2, item), (3, "too short"), (4, None)], "item_id long, text string")
    leaks = find_leaks(df, "doc_id", "text", items, "item_id", "text").collect()
    got = {(r.doc_id, r.item_id): r.n_equal for r in leaks}
    want = {d: longest_run(WORDS, plain_words(docs[d])) for d in (1, 2, 4, 5, 9, 10, 11, 12)}
    assert want[1] == len(WORDS) and want[2] == 12
    assert got == {(d, i): n for d, n in want.items() for i in (1, 2)}
    n_words = {r.doc_id: r.n_words for r in leaks}
    assert n_words[12] == n_words[5] == len(WORDS) and n_words[2] == 12  # an edit inside, a word left out
    assert find_leaks(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert find_leaks(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 40))] for _ in range(12)]
    docs = []
    for _ in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        it = rng.choice(items)
        k = rng.randint(0, max(0, len(it) - 10))
        words[len(words) // 2 : len(words) // 2] = it[k : k + rng.randint(8, 16)]
        docs.append(words)
    want = {(d, i) for d, w in enumerate(docs) for i, it in enumerate(items) if longest_run(it, w) >= 12}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    ev = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(df, "doc_id", "text", ev, "item_id", "text").filter("n_equal >= 12").collect()} == want


def test_residue(spark):
    bad = [
        "We thank {{institution}} of {{journal}} for access.", "Dear %FIRSTNAME%, hello", "[Insert title here]", "__title__ / __city__", "«date» «journal»", "In this course, <year> joined <city>.", "Title: {% topic %}", "[author_name] - [abstract]",
        "Good text first. TODO write this part. Good text after.", "blah blah blah.", "Lorem ipsum tempus codex doctus", "test test 123", "Hier steht der Text.", "- no content - - no content -",
        "Error 500: la página solicitada no existe", "Bad gateway (502) while contacting", "Traceback (most recent call last): KeyError: 'x'", "Your session has timed out.",
        "PLEASE ENABLE JAVASCRIPT TO READ THIS ARTICLE.", "Checking  that you are human.", "<html><body><p>Scripting is disabled.</p></body></html>", "Veuillez activer JavaScript pour lire.",
    ]
    good = [
        "Shell exercises use ${HOME} and similar variables as teaching examples.", "Students learn why an HTTP 500 error is raised and how to read a traceback.", "Layouts were first tested with lorem ipsum paragraphs.",
        "The course teaches JavaScript to novices and asks them to enable scripts step by step.", 'Our template, written as "Explain {{concept}} to a {{grade}} pupil", was used.', "About 32% of the cited links returned a 404 page.",
        "The word list contains [name], [place] and [date] tags that annotators assigned.", 'Reviewers called placeholder text such as "insert title here" a sign of haste.', "Grew by 5% of x and 6% of y.", "Cut off [truncated]", "No abstract available.", "", None, "word " * 30000,
    ]
    # each text from three sources, with numbers of its own
    data = [(100 * k + i, t and t.replace("500", f"50{k}"), f"s{k}", "clash") for k in range(3) for i, t in enumerate([*bad, *good])]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, kind string")
    found = {r.doc_id for r in find_residue(df, "doc_id", "text", "source").collect()}
    assert {d % 100 for d in found} == set(range(len(bad))) and len(found) == 3 * len(bad)
    assert find_residue(df.limit(0), "doc_id", "text", "source").count() == 0


def test_only_what_recurs(spark):
    page = lambda sources: spark.createDataFrame([(i, f"Page not found. {i}", s) for i, s in enumerate(sources)], "doc_id long, text string, source string")
    count = lambda df: find_residue(df, "doc_id", "text", "source").count()
    assert [count(page(s)) for s in (["a", "b", None], ["a", "b"], ["a", "a", "a"], ["a", "a", "b"])] == [3, 0, 0, 3]


def test_random_filler(spark):
    """Words that only filler has are learned from messages that begin with the known one; texts of other words stay."""
    rng = random.Random(9)
    latin = [f"{a}{b}um" for a in "bcdfg" for b in ("ala", "era", "ilo")]
    say = lambda n: " ".join(rng.choice(latin) for _ in range(n)).capitalize() + "."
    data = [(i, f"Lorem ipsum {say(30)}", f"s{i % 4}") for i in range(6)] + [(10 + i, say(8), f"s{i % 3}") for i in range(5)]
    data += [(20 + i, f"We taught {rng.choice(latin)} and measured it again.", f"s{i}") for i in range(3)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    assert {r.doc_id for r in find_residue(df, "doc_id", "text", "source").collect()} == {*range(6), *range(10, 15)}


def test_masks_and_messages(spark):
    one = lambda f, t: spark.range(1).select(f(F.lit(t))).first()[0]
    assert one(masked, "  See  https://a.org/x on 2024-03-01,\tcode 5ab0f0ef0c, or 17.5") == "see ⟨address⟩ on 0, code 0, or 0"
    assert one(masked, "Dear {{first name}}") == "dear ⟨slot⟩" and one(masked, "asdf qwer asdf qwer") == "asdf qwer asdf qwer asdf qwer"
    assert one(messages, "<p>One.</p>Two <b>bold</b>\nthree") == ["", "One.", "Two  bold", "three"]
    rules = "|".join(f"(?:{p})" for patterns in PHRASES.values() for p in patterns)
    texts = [
        "connection timed out", "connection refused", "stack trace:", "access to this article is restricted", "no forwarding address", "page non trouvée", "abstract to be provided", "please try again later", "digite o texto", "introduzca el resumen",
        "ihr text hier", "votre résumé ici", "test 1 test 2", "text. text, text", "this is some example text", "stand-in until the real", "réessayez plus tard", "o serviço está indisponível", "uncaught typeerror", "object moved", "loading…", "oops!", "error 404.",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.t for r in df.filter(~masked(F.col("t")).rlike(rules)).collect()] == []


def test_scores_are_a_query(spark):
    import __spark_entry__ as entry

    scores = entry.queries()["p6_scores"](spark, "/root/testdata/sf0.001")
    assert scores.columns == ["record_id", "term", "tf", "df", "score"] and "p6_scores" in entry.oracle_sql()
    assert scores.filter("tf < 3").count() > 0 and scores.filter("score is null").count() == 0


def test_rare_pairs_are_in_a_query(spark):
    import __spark_entry__ as entry

    pairs = entry.queries()["p7_pairs"](spark, "/root/testdata/sf0.001")
    assert {r[0] for r in pairs.groupBy("field").agg(F.min("n_ab").alias("n")).select("n").collect()} == {1}
