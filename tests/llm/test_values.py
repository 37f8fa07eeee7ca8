"""Values and names: canonical entries, variants, linkage and survivors."""

import random
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibflux.functions.blank import is_blank
from bibflux.llm.canonical import Canonical, _deletions, canonical_udf, map_places, osa_distance, plain, token_set_similarity
from bibflux.llm.countries import country_names
from bibflux.llm.linkage import DOI_ODDS, PROFILE, calibrated, link_between, link_within, plain_doi, plain_title, plain_year, profile, rising, scored
from bibflux.llm.survivors import survivors
from bibflux.llm.variants import person_variants, venue_variants
from tests.conftest import rows

REF = [(1, "United States", "US", "USA"), (2, "United Kingdom", "GB", "GBR"), (3, "China", "CN", "CHN"), (4, "Germany", "DE", "DEU"), (11, "South Korea", "KR", "KOR"), (29, "Chile", "CL", "CHL"), (33, "New Zealand", "NZ", "NZL"), (36, "Iran", "IR", "IRN"), (39, "Nigeria", "NG", "NGA"), (57, "Ireland", "IE", "IRL")]


@pytest.mark.parametrize(
    "value,entry",
    [("U.S.A.", 1), ("EE. UU.", 1), ("(United Kingdom)", 2), ("Univ. Cigubo, Scotland", 2), ("Univ. X - de", 4), ("Fed. Rep. of Germany", 4), ("People's Republic of China", 3), ("Chna", 3), ("Chike", 29), ("Chie", 29)]
    + [("Ne wZealand", 33), ("Unietd  States", 1), ("Academy, Ieland", 57), ("Niger", -1), ("Iraq", -1), ("Iceland", -1), ("North Korea", -1), ("Korea", 11), ("Northern Ireland", 2), ("EU", -1), ("Institute of Tarvel", -1), ("", -1), (" ", -1), ("-", -1), ("99", -1), (None, -1)],
)
def test_countries(value, entry):
    assert Canonical(*country_names(REF))(value) == entry


def test_canonical_parts():
    assert plain("U.K.") == "uk" and plain("P.R. China") == "pr china" and plain("Côte d'Ivoire") == "cote divoire"
    assert osa_distance("abcd", "acbd", 2) == 1 and osa_distance("abcd", "xyzw", 2) == 3
    assert token_set_similarity("hong kong", "hongkong") == 1.0
    began = time.time()
    long = Canonical([(1, "x" * 5000), (2, "ab"), (3, "y" * 4999 + "z")], [], [])
    assert long("x" * 4999) == 1 and long("y" * 5000) == 3 and long("z" * 5000) == -1
    assert time.time() - began < 1
    far = Canonical([(1, "a" * 30 + " " + "b" * 40), (2, "Germany"), (3, "United Kingdom")], [], [])
    assert far("a" * 30 + "c " + "b" * 40) == 1  # values of any length
    assert far("Kingdom Unitd") == 3 and far("Univ of Munich Germny") == 2 and far("Campus Norte") == -1


@given(st.text("abcd", max_size=8), st.text("abcd", max_size=8))
def test_canonical_edits(a, b):
    """The banded distance equals the whole table, and near words share a deletion of their beginnings."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    assert osa_distance(a, b, 2) == min(rows[-1][-1], 3)
    if rows[-1][-1] <= 2:
        assert _deletions(a + "qrstuvwxyz", 2) & _deletions(b + "qrstuvwxyz", 2)


def test_places(spark):
    df = spark.createDataFrame([(1, "CN ;Germany;;", "a"), (2, None, "b"), (3, "nan", "c"), (1, "CN", "d")], "record_id long, country string, pos string")
    resolve = canonical_udf(*country_names(REF))
    got = rows(map_places(df, "record_id", "country", is_blank(F.col("country")), resolve, "country_id"))
    assert got == sorted([(1, 1, 3), (1, 2, 4), (1, 3, -1), (1, 4, -1), (1, 1, 3)], key=repr)
    assert map_places(df.limit(0), "record_id", "country", is_blank(F.col("country")), resolve, "country_id").count() == 0
    with pytest.raises(ValueError):
        canonical_udf([(i, str(i)) for i in range(10)], [], [], max_names=5)


def test_persons(spark):
    same = ["Nalenévost, J.", "J. Nalenévost", "Jonas Nalenevost", "JONAS NALENÉVOST", "Nalenévost Jonas", "Nalenévost, Jon.", "Jonas B. Nalenévost", "Nalenévoost, Jonas", "van Nalenévost, Jonas", "Nalneévost, J."]
    other = ["Nalenévost, Ana", "A. Nalenévost"]
    nick = ["Robert Zerecoza", "Bob Zerecoza", "Zerecoza, R."]
    middle = ["Nora C. Mibusobe", "Nora D. Mibusobe"]
    short = ["Wang, Xiulan", "Wnag, Xiulan"]
    lone = ["Umar", "", None, "Zerecoza, Elizabeth", "Bibodujes, Ximena", "x" * 3000 + ", Y."]
    df = spark.createDataFrame([(n,) for n in [*same, *other, *nick, *middle, *short, *lone, *same]], "name string")
    got = {tuple(r) for r in person_variants(df).collect()}
    pairs = lambda names: {(a, b) for a in names for b in names if a < b}
    assert got == pairs(same) | pairs(other) | pairs(nick) | pairs(short)
    assert person_variants(df.limit(0)).count() == 0


def test_venues(spark):
    same = ["Quarterly of Policy and Automation", "QUARTERLY OF POLICY & AUTOMATION", "Q. Policy Autom.", "Policy and Automation, Quarterly of", "Quarteky of Policy and Automation", "The Quarterly of Policy and Automation (QPA)", "QPA", "Quarterly of Policy and Automation : an open forum"]
    other = ["Annals of Policy and Automation", "Ann Policy Autom"]
    df = spark.createDataFrame([(n,) for n in [*same, *other, "Q", "", None]], "name string")
    got = {tuple(r) for r in venue_variants(df).collect()}
    assert got == {(a, b) for g in (same, other) for a in g for b in g if a < b}
    assert venue_variants(df.limit(0)).count() == 0


def record(spark, data, key="id"):
    df = spark.createDataFrame(data, f"{key} long, title string, names array<string>, year string, doi string, venue string, abstract string, vector string")
    return profile(df, key, F.col("title"), F.col("names"), F.col("year"), F.col("doi"), F.col("venue"), {"extra": F.col("vector")})


TITLE = "How story machines shape essay quality in a regional network of schools"


def test_parts_of_a_profile(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(plain_title(F.lit("<i>A</i> b &amp; C: d…"))) == "a b and c d"
    assert [one(plain_year(F.lit(y))) for y in ("c2019", "2019.0", "in press", "")] == [2019, 2019, None, None]
    assert one(plain_doi(F.lit("https://doi.example.org/10.0133/JX.2025.1."))) == "10.0133/jx.2025.1"


def test_links(spark):
    data = [
        (1, TITLE, ["bozivenur, julia"], "2020", "10.1/a", "Journal A", None, "x"),
        (2, TITLE.upper() + ".", ["j. bozivenur"], "2021", None, None, None, "x"),
        (3, TITLE.replace("machines", "machiens"), ["bozivenur, j."], "2021.0", None, "Journal A", None, "x"),
        (4, TITLE, ["cavizisest, samantha"], "2020", None, "Journal B", None, "x"),
        (5, TITLE + " - Reply", ["bozivenur, julia"], "2020", "10.1/a", "Journal A", None, "x"),
        (6, TITLE, ["bozivenur, julia"], "2014", None, "Journal A", None, "x"),
        (7, "Editorial", ["vogilivord, isabella"], "2020", None, "Journal A", None, "x"),
        (8, "Editorial", ["tesada, maria"], "2020", None, "Journal A", None, "x"),
        (9, None, None, None, None, None, None, None),
        (10, "", [], "", "", "", "", ""),
        (11, TITLE, ["bozivenur, julia"], "2020", "10.1/a", "Journal A", None, "x"),
        (12, "z " * 20000, ["lang, o."], "2020", None, None, "w " * 50000, "x"),
    ]
    p = record(spark, data)
    pairs, rep = link_within(p)
    found = {(r.id_a, r.id_b) for r in pairs.collect()}
    assert found == {(1, 2), (1, 3), (2, 3)}
    own = dict(rows(p.join(rep, "class").select("id", "rep")))
    assert own[11] == 1 and len(own) == len(data) and "extra" in p.columns
    q = record(spark, [(100, *data[0][1:]), (101, *data[6][1:]), (102, *data[8][1:])])
    between = link_between(p, q)
    assert {(r.id_a, r.id_b) for r in between.collect()} == {(1, 100), (2, 100), (3, 100), (11, 100), (7, 101)}
    assert between.filter("confidence <= 0.5 or confidence > 1").count() == 0
    assert link_between(p.limit(0), q).count() == 0
    assert link_within(p.limit(0))[0].count() == 0


def test_index_recall(spark):
    """The index against all pairs: titles misspelt in several words, authors missing or misspelt, years missing, subtitles."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("bcdfglmnrstv") + rng.choice("aeiou") for _ in range(n))

    def typo(t):
        k = rng.randrange(1, len(t) - 1)
        return t[:k] + t[k + 1] + t[k] + t[k + 2 :] if rng.random() < 0.5 else t[:k] + t[k + 1 :]

    data = []
    for i in range(150):
        title, authors = " ".join(word(rng.randint(2, 4)) for _ in range(rng.randint(6, 11))), [word(rng.randint(3, 4)) for _ in range(rng.randint(1, 3))]
        near = [a[:k] + "x" + a[k + 1 :] for a in authors for k in [rng.randrange(len(a))]]
        venue = f"Journal {word(3)}"
        for k, (t, a, y) in enumerate([(title, authors, "2020"), (typo(title), [], "2020"), (typo(title), near, "2021"), (typo(title), near, None), (title + " a study of many schools", authors, "2020")]):
            data.append((5 * i + k, t, a, y, None, venue, None, None))
    p = record(spark, data)
    x, y = (p.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", *PROFILE))) for s in "ab")
    every = scored(x.crossJoin(y).filter("id_a < id_b"))
    want = {(r.id_a, r.id_b) for r in every.filter(F.col("score") + F.when(F.coalesce("same_doi", F.lit(False)), DOI_ODDS).otherwise(0.0) >= 0).select("id_a", "id_b").collect()}
    got = {(r.id_a, r.id_b) for r in link_within(p)[0].collect()}
    assert len(want) > 600 and got <= want
    # outside the tables lie pairs of which every surname and more than half of the title's segments differ
    assert len(want - got) <= 0.2 * len(want), (len(want), len(got))
    easy = {(a, b) for a, b in want if {a % 5, b % 5} <= {0, 4} or data[b][1] == data[a][1]}
    assert len(easy) >= 150 and easy <= got


def test_confidence(spark):
    """Calibrated on identifiers: the share of true pairs among those of like score is found again, also where the score itself promises too much."""
    assert rising([3, 1, 2, 5], [1, 1, 2, 1]) == [1.75 + 0.0, 1.75, 2, 5] or rising([3, 1, 2, 5], [1, 1, 2, 1]) == [2, 2, 2, 5]
    rng = random.Random(5)
    truth = {-4.0: 0.02, 0.0: 0.3, 2.0: 0.6, 6.0: 1.0}
    data = [(i, i, s, rng.random() < (0.97 if rng.random() < t else 0.001)) for i, (s, t) in enumerate(list(truth.items()) * 3000)]
    data += [(9_000_000 + k, k, s, None) for k, s in enumerate(truth)]
    df = spark.createDataFrame(data, "id_a long, id_b long, score double, same_doi boolean")
    got = {r.score: r.confidence for r in calibrated(df).filter("same_doi is null").collect()}
    assert all(abs(got[s] - t) < 0.06 for s, t in truth.items()), got
    seen = {(r.score, r.same_doi): r.confidence for r in calibrated(df).collect()}
    assert seen[0.0, True] > 0.9 and seen[0.0, False] < 0.1
    assert calibrated(df.limit(0)).count() == 0
    few = calibrated(spark.createDataFrame([(1, 2, 4.0, None), (1, 3, -4.0, None)], df.schema)).collect()
    assert few[0].confidence > 0.9 and few[1].confidence < 0.1


def test_survivors(spark):
    df = spark.createDataFrame([(1, 10, "ab", 1, "2024-01-01"), (1, 11, "abc", 0, None), (1, 12, "xyz", 2, "2024-01-01"), (1, 13, "uvw", 2, "2024-02-01"), (1, 14, "rst", 2, "2024-02-01"), (2, 20, None, 1, None)], "g long, r long, v string, t int, h string")
    fields = {"v": (is_blank(F.col("v")), F.length("v")), "w": (F.lit(True), F.lit(0))}
    assert rows(survivors(df, "g", "r", fields, F.col("t"), F.col("h"))) == [(1, "v", 13)]
    assert survivors(df.limit(0), "g", "r", fields, F.col("t"), F.col("h")).count() == 0
