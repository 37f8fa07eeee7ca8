import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bibflux.operators import category, clustering, components, dedup, geography, records, timeline, vectors, words
from bibflux.operators.components import connected_components
from bibflux.schema import CANONICAL
from tests.conftest import rows


def frame(spark, data, **fixed):
    cols = ["record_id", *CANONICAL]
    full = [tuple({**{c: "" for c in CANONICAL}, **fixed, "record_id": i, **d}[c] for c in cols) for i, d in enumerate(data)]
    return spark.createDataFrame(full, "record_id long, " + ", ".join(f"{c} string" for c in CANONICAL))


def test_timeline(spark):
    df = frame(spark, [{"year": y, "source": "S"} for y in ("2023", "2023.0", "x", "", "1999", "2024", "nan", None)])
    assert rows(timeline.by_year(df)) == [(2023, 2), (2024, 1)]
    figures = timeline.key_figures(df).first()
    assert (figures.total, figures.n_years, figures.peak_year, figures.n_sources) == (3, 2, 2023, 1)
    assert rows(timeline.pivot(df)) == [(2023, "S", 2), (2024, "S", 1)]
    assert timeline.key_figures(df.limit(0)).first().total == 0


def test_geography(spark):
    df = frame(spark, [{"country": c} for c in ("MIT, USA; Oxford, UK", "DE", "North Korea", None, "nan", "Univ., The Netherlands")])
    assert rows(geography.geography(df)) == [("Netherlands", "NLD", 1), ("South Korea", "KOR", 1), ("United States", "USA", 1)]
    assert geography.geography_figures(df).first().leader == "Netherlands"
    assert geography.country_column(df) == "country"
    t = spark.createDataFrame([("AI ; Pakistan ; China", "Chinese firms in Japan"), ("usa", "in Japan and Peru"), (None, None), ("türkiye", "nothing")], "s string, t string")
    assert [tuple(r) for r in t.select(geography.subject_country(F.col("s")), geography.text_country(F.col("t"))).collect()] == [("Pakistan", "China"), ("United States", "Japan"), ("", ""), ("Türkiye", "")]


def test_words(spark):
    df = frame(spark, [{"abstract": "AI models learn; models at https://x.y 2024", "keywords": "Models; deep learning"}])
    assert rows(words.word_frequencies(df)) == [("deep learning", 3), ("learn", 1), ("models", 5)]
    assert tuple(words.leading_mean(words.word_frequencies(df)).first()) == ("models", 3.0)


@pytest.mark.parametrize("counts,want", [((4, 2, 2, 2), 1.0), ((4, 3, 2, 2), 0.415), ((4, 2, 2, 1), 0.0), ((4, 2, 2, 0), -1.0), ((4, 4, 4, 4), 1.0)])
def test_npmi(spark, counts, want):
    assert spark.range(1).select(category.npmi(*map(F.lit, counts))).first()[0] == pytest.approx(want)


def test_category(spark):
    df = frame(spark, [{"abstract": a} for a in ("Fine tuning of large tokens", "finetuning with large tokens", "other large words", "", None)])
    terms = ("fine-tuning",)
    counts = category.term_counts(df, "abstract", terms).first()
    assert (counts.doc_frequency, counts.total_occurrences, counts.doc_frequency_pct) == (2, 2, 66.67)
    assert tuple(category.coverage(df, "abstract", terms).first()) == (3, 2, 66.67)
    found = category.associated_terms(df, "abstract", terms=terms)
    assert [(r.npmi_rank, r.term, r.npmi) for r in found.orderBy("npmi_rank").collect()] == [(1, "large tokens", 1.0), (2, "tokens", 1.0)]
    rated = category.precision(df, "abstract", found, terms)
    assert {r.precision_label for r in rated.collect()} == {"very relevant"}
    assert category.associated_terms(df.limit(0), "abstract").count() == 0


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    assert rows(connected_components(df, "u", "v")) == sorted(((x, find(x)) for x in list(parent)), key=repr)
    assert connected_components(df.limit(0), "u", "v").count() == 0


def test_components_of_few_edges_in_three_tables(spark, monkeypatch):
    """A chain that crosses many tasks took a table for each round; so few edges are left to one task, and more give the same."""
    tables, write, setting = [], components.written, "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(components, "written", lambda df: tables.append(df) or write(df))
    rng = np.random.default_rng(5)
    chain = spark.createDataFrame([(int(i), int(i) + 1) for i in rng.permutation(3000)], "u long, v long").repartition(8)
    spark.conf.set(setting, "false")  # or all edges are soon in one task
    try:
        assert rows(connected_components(chain, "u", "v")) == sorted(((i, 0) for i in range(3001)), key=repr)
        assert len(tables) == 3
        assert rows(connected_components(chain, "u", "v", few=0)) == sorted(((i, 0) for i in range(3001)), key=repr)
    finally:
        spark.conf.unset(setting)


def test_near_titles_lose_none(spark):
    """Titles of several blocks of rows and columns: what the letters allow is found whichever tile holds it, each pair once."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [f"{word()} and {word()} in {word()}" for _ in range(1500)]
    near = [t[:k] + "xyz"[k % 3] * (k % 2) + t[k + 1 :] for t, k in zip(base, rng.integers(0, 20, 1500))]
    tiles = [pa.array(base), pa.array(near)]
    a = dedup._Tile(tiles[0], tiles[0])
    b = dedup._Tile(tiles[1], tiles[1], a.axis)
    found = Counter()
    for x, y, strict in ((a, b, False), (b, a, True)):
        for i, j in dedup._near(x, y, 0.92, strict):
            found.update(frozenset(p) for p in zip(x.titles.take(pa.array(i)).to_pylist(), y.titles.take(pa.array(j)).to_pylist()))
    assert max(found.values()) == 1
    assert {frozenset(p) for p in zip(base, near)} <= found.keys()
    both = pa.array(base + near)
    own = Counter(frozenset((i, j)) for t in [dedup._Tile(both, pa.array(range(3000)))] for i, j in dedup._near(t, t, 0.92, False) for i, j in zip(t.ids.take(pa.array(i)).to_pylist(), t.ids.take(pa.array(j)).to_pylist()))
    assert max(own.values()) == 1 and {frozenset((i, i + 1500)) for i in range(1500)} <= own.keys()


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.92, 0.8])
def test_similar_titles_against_all_pairs(spark, threshold):
    rng = np.random.default_rng(1)
    base = ["".join(rng.choice(list("abc d"), n)) for n in rng.integers(3, 40, 25)]
    titles = set(base)
    for t in base:
        for _ in range(4):
            s = list(t)
            for _ in range(rng.integers(1, 4)):
                k = int(rng.integers(0, len(s)))
                s[k : k + 1] = [[], ["x"], [s[k], "y"]][int(rng.integers(0, 3))]
                if not s:
                    break
            if s:
                titles.add("".join(s))
    got = {frozenset((r.title_a, r.title_b)) for r in dedup.similar_titles(spark.createDataFrame([(t,) for t in titles], "title string"), threshold).collect()}
    want = {frozenset((a, b)) for a in titles for b in titles if a < b and 1.0 - levenshtein(a, b) / max(len(a), len(b)) >= threshold}
    assert got == want


def test_similar_titles_made_alike(spark):
    """Titles that share most of their words, so that parts of them are no selective index."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 14))
    titles = [f"supporting {word()} through writing assistants and {word()} in a regional network of schools" for _ in range(12_000)]
    planted = {(t.replace("network of", "network"), t) for t in titles[:50]} | {tuple(sorted((t, t.replace("writing", "reading")))) for t in titles[50:100]}
    df = spark.createDataFrame([(t,) for t in {*titles, *(t for pair in planted for t in pair)}], "title string")
    began = time.time()
    got = {(r.title_a, r.title_b) for r in dedup.similar_titles(df).collect()}
    assert got == planted
    assert time.time() - began < 60


def records_made_alike(spark):
    """12,000 records whose titles share most of their words; of each of the first 50, an OpenAlex copy with one letter less and an abstract, 20,000 further."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 14))
    data = [(i, f"Supporting {word()} through writing assistants and {word()} in a regional network of schools", "ACM", None) for i in range(12_000)]
    copies = [(i + 20_000, t.replace("network", "networ"), "OpenAlex", f"about {i}") for i, t, _, _ in data[:50]]
    df = spark.createDataFrame(data + copies, "record_id long, title string, source_db string, abstract string")
    return df.select("record_id", *(F.col(c) if c in df.columns else F.lit("").alias(c) for c in CANONICAL))


def test_discarded_made_alike(spark):
    df, began = records_made_alike(spark), time.time()
    lost = {(r.record_id, r.kept_record_id) for r in dedup.unify(df)[1].collect()}
    assert lost == {(i + 20_000, i) for i in range(50)}
    assert time.time() - began < 90


def test_kept_made_alike(spark):
    df, began = records_made_alike(spark), time.time()
    kept = {r.record_id: r.abstract for r in dedup.unify(df)[0].collect()}
    assert kept == {i: f"about {i}" if i < 50 else "" for i in range(12_000)}
    assert time.time() - began < 90


def test_groups_and_representatives_made_alike(spark):
    df, began = records_made_alike(spark), time.time()
    groups = dedup.written(dedup.duplicate_groups(df))
    assert {(r.record_id, r.group_id) for r in groups.collect()} == {(j, i) for i in range(50) for j in (i, i + 20_000)}
    assert {tuple(r) for r in dedup.representatives(df, groups).collect()} == {(i, i) for i in range(50)}
    assert time.time() - began < 90


def test_unify(spark):
    long_title = "A study of generative models in higher education"
    df = frame(
        spark,
        [
            {"title": long_title, "source_db": "ACM"},
            {"title": long_title + ".", "source_db": "OpenAlex", "abstract": "from the open catalogue"},
            {"title": "Something else entirely", "source_db": "ACM"},
            {"title": "数据", "source_db": "ACM"},
            {"title": "模型", "source_db": "ACM"},
        ],
    )
    kept, lost = dedup.unify(df)
    assert [(r.record_id, r.abstract) for r in kept.orderBy("record_id").collect()] == [(0, "from the open catalogue"), (2, ""), (3, ""), (4, "")]
    assert [(r.record_id, r.kept_record_id, r.kept_db) for r in lost.collect()] == [(1, 0, "ACM")]
    assert dedup.duplicate_groups(df, strict_empty=True).count() == 4
    richer = frame(spark, [{"title": "Same", "source_db": "ACM"}, {"title": "same", "source_db": "OpenAlex", "abstract": "x" * 1500}])
    assert dedup.unify(richer)[0].first().record_id == 1
    assert dedup.unify(df.limit(0))[0].count() == 0


@pytest.mark.parametrize("method,height", [("complete", 0.8), ("average", 0.7), ("ward", 0.80829)])
def test_linkage(method, height):
    d = np.array([[0, 0.2, 0.6], [0.2, 0, 0.8], [0.6, 0.8, 0]])
    merges = clustering.linkage(d, method)
    assert merges[0][:2] == (0, 1) and merges[0][2] == pytest.approx(0.2) and merges[1][2] == pytest.approx(height, abs=1e-5) and merges[1][3] == 3
    upper = np.triu_indices(3, 1)
    assert clustering.correlation(d[upper], clustering.cophenetic(merges, 3)[upper]) == pytest.approx(0.94491, abs=1e-5)


@pytest.mark.parametrize("method", clustering.METHODS)
def test_linkage_against_members(method):
    rng = np.random.default_rng(0)
    x = rng.random((12, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    members = {i: [i] for i in range(12)}
    for k, (a, b, height, _) in enumerate(clustering.linkage(d, method)):
        block = d[np.ix_(members[a], members[b])]
        if method == "ward":
            ca, cb = x[members[a]].mean(0), x[members[b]].mean(0)
            na, nb = len(members[a]), len(members[b])
            want = np.sqrt(2 * na * nb / (na + nb) * ((ca - cb) ** 2).sum())
        else:
            want = block.max() if method == "complete" else block.mean()
        assert height == pytest.approx(want)
        members[12 + k] = members.pop(a) + members.pop(b)


def test_monotone_and_pipeline(spark):
    assert clustering.monotone([1.0, 0.5, 2.0]) == [1.0, 1.0 + 1e-10, 2.0]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["apple banana", "apple banana", "cherry grape", "cherry grape plum", ""])], "id long, t string")
    from bibflux.plans.pipelines import cluster_documents

    out = cluster_documents(docs, "id", "t")
    assert out["distances"].count() == 6
    flat = clustering.flat_clusters(out["merges"]).filter("method = 'average'").orderBy("doc")
    assert [r.cluster for r in flat.collect()] == [0, 0, 2, 2]
    assert clustering.best_method(out["merges"]).first().quality == "excellent"
    assert clustering.last_merges(out["merges"], 1).count() == 3


def test_distances_and_idf(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "id long, t array<string>")
    d = vectors.cosine_distances(vectors.tfidf(docs, "id", F.col("t")), docs, "id")
    got = {(r.id_a, r.id_b): r.distance for r in d.collect()}
    assert got[1, 3] == got[2, 3] == 1.0 and 0 < got[1, 2] < 1


def test_records(spark):
    df = frame(spark, [{"title": "t", "year": "2020"}, {"title": "nan", "year": None}])
    assert dict(rows(records.completeness(df, ["title", "year", "doi"]))) == {"title": 100.0, "year": 50.0, "doi": 0.0}
    assert records.completeness(df.limit(0), ["title"]).count() == 0
    assert records.sample_rows(df, "record_id", 1).count() == 1


def test_places_and_previews(spark):
    df = spark.createDataFrame([("x", " ", "Oslo", "2020"), ("x", None, None, "")], "title string, country string, authorLocations string, year string")
    assert geography.country_column(df) == "authorLocations" and geography.country_column(df.select("title")) is None
    assert geography.country_column(df.select("title", "country")) is None
    shown, other = geography.split_by_code(spark.createDataFrame([("A", "AAA"), ("B", ""), ("C", None)], "country string, iso_a3 string"))
    assert shown.count() == 1 and other.count() == 2
    names = spark.createDataFrame([("Dept, Hong Kong and China",), ("north korea",), ("nowhere",), (None,), ("usa. us",)], "c string")
    assert [r[0] for r in names.select(geography.affiliation_country(F.col("c"))).collect()] == ["Hong Kong", "South Korea", None, None, "United States"]
    p = spark.createDataFrame([("a", "", "10.1", "2021"), ("", "DE", None, "2020"), ("b", "FR", "", "")], "abstract string, country string, doi string, year string")
    assert tuple(records.preview_figures(p).first()) == (3, 2, 2, 1)
    assert [tuple(r) for r in records.year_counts(p).collect()] == [("2020", 1), ("2021", 1)]


def test_order_of_precision(spark):
    texts = [("prompting alpha beta",), ("prompting alpha gamma",), ("alpha plain words",), ("gamma gamma text",), ("prompting gamma",)]
    df = spark.createDataFrame(texts, "abstract string")
    found = category.associated_terms(df, "abstract", terms=("prompting",), min_doc_freq=1)
    rated = category.precision(df, "abstract", found, ("prompting",)).collect()
    assert [r.precision_rank for r in rated] == list(range(1, len(rated) + 1))
    assert [(-r.precision, -r.npmi) for r in rated] == sorted((-r.precision, -r.npmi) for r in rated)
    counts = category.term_counts(df, "abstract", ("gamma", "prompting", "never", "co-writing")).collect()
    assert [(r.term, r.doc_frequency, r.total_occurrences) for r in counts] == [("gamma", 3, 4), ("prompting", 3, 3), ("never", 0, 0), ("co-writing", 0, 0)]
    # terms that begin one another or overlap are counted one by one
    nested = spark.createDataFrame([("machine learning machine learning",)], "abstract string")
    assert {r.term: r.total_occurrences for r in category.term_counts(nested, "abstract", ("machine", "machine learning")).collect()} == {"machine": 2, "machine learning": 2}
    assert [r.doc_frequency for r in category.term_counts(df.limit(0), "abstract", ("gamma",)).collect()] == [0]


def test_titles_against_brute_force(spark):
    """The join loses no pair, whatever the lengths and the places of the edits."""
    import random

    rng = random.Random(7)
    titles = {"".join(rng.choice("abcd ") for _ in range(rng.randint(1, 40))).strip() or "a" for _ in range(60)}
    for t in list(titles):
        for _ in range(3):
            x = t
            for _ in range(rng.randint(1, 4)):
                k = rng.randrange(len(x) + 1)
                x = rng.choice([x[:k] + "z" + x[k:], x[:k] + x[k + 1 :], x[:k] + "z" + x[k + 1 :]])
            titles.add(x or "a")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    every = sorted(titles, key=lambda t: (len(t), t))
    want = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if 1.0 - distance(a, b) / len(b) >= 0.85}
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    assert {(r.title_a, r.title_b) for r in dedup.similar_titles(df, 0.85).collect()} == want and len(want) > 50
