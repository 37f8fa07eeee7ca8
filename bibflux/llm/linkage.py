"""Records of one publication found without a common key, in one table or across two.

Each record gets a profile: the q-grams of its title in a vector of 4 x 64 bits (the words are dealt to the four segments by hash, so that a
misspelling changes one or two of them), those of its surnames in 2 x 64 bits, its surnames, year, identifier and venue. The segments are the tables
of a multi-index: vectors that agree in all four segments meet, and those that agree in fewer where another attribute agrees too: in one segment with a
surname, in two with the venue, whatever their distance in the others. What changes most words of a title at once, a subtitle that is left out, is met by
the title's beginning or end with a surname. Equal identifiers meet alone. Within these bounds the search is exact; ``test_index_recall`` counts
against comparing all pairs what lies outside them.

What meets is scored by weighted Dice coefficients of the vectors. The score becomes a confidence by comparison with the identifiers: among the pairs of
like score of which both have one, the share whose identifiers agree tells how many are true (``calibrated``).

Records with equal profiles are one class throughout: a hot group of copies is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibflux.functions.blank import clean
from bibflux.functions.fold import fold_accents
from bibflux.functions.let import let
from bibflux.llm.variants import _one_edit
from bibflux.operators.packed import PARTICLES
from bibflux.session import written

SEGMENTS = 4
#: Words of 64 bits for the surnames.
NAME_SEGMENTS = 2
#: Endings that make a title another publication's.
SEQUELS = r"^(?:a )?(?:reply|response|rejoinder|comment|commentary|correction|corrigendum|erratum|retraction|addendum|part|vol|volume|second|supplement)\b"


def _words(texts: pd.Series) -> tuple[np.ndarray, ...]:
    """(text, word, letter, 3-gram) of every letter of texts of lower-case words; blanks are the ends of a word's grams."""
    joined = (" " + " \n ".join(texts) + " ").encode("ascii", "ignore")
    b = np.frombuffer(joined, np.uint8).astype(np.uint64)
    row = np.cumsum(b == 10)
    letter = (b != 32) & (b != 10)
    at = np.flatnonzero(letter)
    starts = at[np.append(True, np.diff(at) > 1)[: len(at)]]
    word = np.searchsorted(starts, at, side="right") - 1
    b = np.where(letter, b, np.uint64(32))
    gram = (b[at - 1] << np.uint64(16)) | (b[at] << np.uint64(8)) | b[at + 1]
    return row[at], word, b[at], gram, at - starts[word]


def _vectors(titles: pd.Series, names: pd.Series) -> np.ndarray:
    """Bits of the 3-grams of each title word in the word's segment, then those of all surnames; shape (n, SEGMENTS + NAME_SEGMENTS), int64."""
    n, mix = len(titles), np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros((n, (SEGMENTS + NAME_SEGMENTS) * 64), bool)
    row, word, letter, gram, place = _words(titles)
    if len(row):
        # a polynomial hash of the word decides its segment
        first = np.flatnonzero(np.append(True, np.diff(word) > 0))
        h = np.add.reduceat((letter + np.uint64(7)) * np.uint64(1099511628211) ** place.astype(np.uint64), first)
        h ^= h >> np.uint64(29)
        segment = ((h * mix) >> np.uint64(62))[word]
        bits[row, (segment * np.uint64(64) + ((gram * mix) >> np.uint64(58))).astype(np.int64)] = True
    row, _, _, gram, _ = _words(names)
    if len(row):
        bits[row, SEGMENTS * 64 + ((gram * mix) >> np.uint64(57)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def qgram_vector(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The bit vector of a title and of joined surnames, both lower-case ASCII words."""
    for titles, names in batches:
        yield pd.Series(list(_vectors(titles.fillna(""), names.fillna("")))) if len(titles) else pd.Series([], dtype=object)


def plain_title(c: Column) -> Column:
    """Lower-case ASCII words of a title without markup; ``&`` and its entity are ``and``; empty for null."""

    def marked(x: Column) -> Column:
        x = F.when(F.contains(x, F.lit("<")), F.regexp_replace(x, r"</?[A-Za-z][^<>]*>", "")).otherwise(x)
        entities = F.regexp_replace(F.regexp_replace(x, r"(?i)&amp;|&#0*38;", " and "), r"(?i)&(?:nbsp|#160|#xa0);", " ")
        return F.when(F.contains(x, F.lit("&")), F.replace(entities, F.lit("&"), F.lit(" and "))).otherwise(x)

    return F.coalesce(F.trim(F.regexp_replace(F.lower(fold_accents(let(c, marked))), r"[^a-z0-9]+", " ")), F.lit(""))


def plain_year(c: Column) -> Column:
    """The year from 1500 to 2099 in a text, else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(c.cast("string"), r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)", 1), F.lit("")), F.lit("9999")).cast("int")


def plain_doi(c: Column) -> Column:
    """The identifier without resolver or prefix, in lower case, else null."""
    return F.nullif(F.regexp_extract(F.lower(c), r"(10\.\d{4,9}/[^\s\"<>]*[^\s\"<>.,;])", 1), F.lit(""))


def _name_words(name: Column) -> Column:
    return F.filter(F.split(F.translate(name, "'’`-", ""), r"[^a-z.]+"), lambda w: (w != "") & ~w.isin(*PARTICLES))


def _full(w: Column) -> Column:
    return (F.length(w) > 2) & ~F.endswith(w, F.lit("."))


def surnames(names: Column) -> Column:
    """A surname for each folded name of an array: before a comma, or last, or first where the last part is an initial."""
    one = lambda name: let(F.filter(_name_words(F.substring_index(name, ",", 1)), _full), lambda w: F.get(w, F.size(w) - 1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, one), lambda s: s.isNotNull())))


def name_tokens(names: Column) -> Column:
    """All words of the folded names of an array with three letters or more, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(names, _name_words)), _full)))


def venue_mark(c: Column) -> Column:
    """The sorted initials of a venue's significant words, or the letters of an acronym; null for a blank."""

    def initials(x: Column) -> Column:
        plain = F.translate(F.lower(fold_accents(F.regexp_replace(x, r"\s*[(\[][^)\]]*[)\]]|\s:.*$|,?\s+new series\s*$", ""))), "-", "")
        words = F.filter(F.split(plain, r"[^a-z]+"), lambda w: (w != "") & ~w.isin("of", "on", "in", "and", "for", "the", "de", "y", "la"))
        return F.array_join(F.array_sort(F.transform(words, lambda w: F.substring(w, 1, 1))), "")

    letters = lambda x: F.array_join(F.array_sort(F.split(F.lower(x), "")), "")
    return let(clean(c), lambda x: F.nullif(F.when(x.rlike(r"^\p{Lu}{2,8}$"), letters(x)).otherwise(initials(x)), F.lit("")))


PROFILE = ("title", "vector", "authors", "names", "year", "doi", "venue")


def profile(df: DataFrame, key: str, title: Column, names: Column, year: Column, doi: Column, venue: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """``(id, title, vector, authors, names, year, doi, venue, class)`` of records, written once; any attribute may be null or empty.

    ``names`` are folded and in lower case (``fold_accents``, ``lower``). ``extra`` are further columns to carry, which do not count for the class.
    """
    names = F.coalesce(names, F.array().cast("array<string>"))
    both = let(names, lambda n: F.struct(surnames(n).alias("authors"), name_tokens(n).alias("names")))
    rows = df.select(
        F.col(f"`{key}`").alias("id"), plain_title(title).alias("title"), both.alias("_n"), plain_year(year).alias("year"), plain_doi(doi).alias("doi"), venue_mark(venue).alias("venue"), *(c.alias(n) for n, c in (extra or {}).items())
    )
    same = F.xxhash64("title", F.array_join("_n.authors", " "), F.array_join("_n.names", " "), "year", "doi", "venue")
    return written(rows.select("id", "title", qgram_vector("title", F.array_join("_n.authors", " ")).alias("vector"), "_n.authors", "_n.names", "year", "doi", "venue", same.alias("class"), *(extra or {})))


def classes(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profiles of one record (the smallest id) per set of equal ones, and ``(class, rep)``.

    A set of any size is only ever aggregated; no task holds it.
    """
    rep = profiles.groupBy("class").agg(F.min("id").alias("rep"))
    return profiles.join(rep.select(F.col("rep").alias("id")), "id", "left_semi").select("id", *PROFILE), rep


def _keys(p: DataFrame) -> DataFrame:
    """``(key, id, year)``: the tables of the index in which each record stands. Records with an empty title stand in none."""
    none = F.array().cast("array<bigint>")
    given = lambda c, keys: F.when(c, keys).otherwise(none)
    specific = F.size(F.split("title", " ")) > 5
    marked = lambda j: F.when(F.get("vector", F.lit(j)) != 0, F.xxhash64(F.lit(j), F.get("vector", F.lit(j))))
    segments = F.array(*map(marked, range(SEGMENTS)))
    ends = F.array(F.xxhash64(F.lit("b"), F.substring("title", 1, 16)), F.xxhash64(F.lit("e"), F.substring("title", -20, 20)))
    p = p.filter("title <> ''").select("id", "year", "authors", "venue", "doi", specific.alias("_specific"), segments.alias("_segments"), ends.alias("_ends"))
    found = F.filter("_segments", lambda x: x.isNotNull())
    by_surname = F.flatten(F.transform("authors", lambda s: F.transform(F.concat(found, F.col("_ends")), lambda x: F.xxhash64(x, s))))
    by_title = given(F.col("_specific"), F.array(F.xxhash64(F.lit("m"), "_segments")))
    two = [F.xxhash64(F.lit("v"), "venue", F.get("_segments", F.lit(i)), F.get("_segments", F.lit(j)), F.lit(i * SEGMENTS + j)) for i in range(SEGMENTS) for j in range(i)]
    by_venue = given(F.col("venue").isNotNull() & F.col("_specific"), F.array(*two))
    by_doi = given(F.col("doi").isNotNull(), F.array(F.xxhash64(F.lit("d"), F.col("doi"))))
    every = F.array_distinct(F.concat(by_surname, by_title, by_venue, by_doi))
    return p.select("id", "year", F.explode(every).alias("key"))


def _dice(a: str, b: str, first: int, n: int) -> Column:
    """Dice coefficient of the words ``first`` to ``first + n - 1`` of two vectors."""
    both = lambda f: sum((f(j) for j in range(first + 1, first + n)), f(first))
    shared = both(lambda j: F.bit_count(F.get(a, F.lit(j)).bitwiseAND(F.get(b, F.lit(j)))))
    return 2 * shared / F.greatest(both(lambda j: F.bit_count(F.get(a, F.lit(j))) + F.bit_count(F.get(b, F.lit(j)))), F.lit(1))


def scored(pairs: DataFrame) -> DataFrame:
    """Adds ``score``, the log-odds of what titles, authors, venue and year say, and ``same_doi`` (null where one has none); no score for pairs that contradict each other.

    The weights are fixed: a shared title alone says little, least of all a generic one.
    """
    ta, tb = F.col("title_a"), F.col("title_b")
    longer, shorter = F.when(F.length(ta) >= F.length(tb), ta).otherwise(tb), F.when(F.length(ta) >= F.length(tb), tb).otherwise(ta)
    rest = F.trim(F.substring(longer, F.length(shorter) + 1, F.length(longer)))
    same = lambda c: F.coalesce((F.col(f"{c}_a") == F.col(f"{c}_b")).cast("int"), F.lit(0))
    doi, venue = same("doi"), same("venue")
    # more misspellings are believed where another attribute agrees
    share = F.when(doi + venue > 0, 0.12).otherwise(0.07)
    allowed = F.greatest(F.lit(3), F.floor(F.length(shorter) * share).cast("int"))
    distance = F.call_function("levenshtein", ta, tb, allowed)
    close = (ta == tb) | (distance >= 0) & ~rest.rlike(SEQUELS)
    without_subtitle = (F.length(shorter) >= 25) & F.startswith(longer, F.concat(shorter, F.lit(" "))) & ~rest.rlike(SEQUELS) & (F.length(rest) >= 8)
    title = F.when(close, _dice("vector_a", "vector_b", 0, SEGMENTS)).when(without_subtitle, F.lit(0.75)).otherwise(F.lit(0.0))
    missing = (F.size("authors_a") == 0) | (F.size("authors_b") == 0)
    common = F.greatest(F.size(F.array_intersect("authors_a", "names_b")), F.size(F.array_intersect("authors_b", "names_a")))
    near = F.exists("authors_a", lambda s: F.exists("authors_b", lambda t: (F.length(s) >= 5) & _near(s, t)))
    fewer = F.least(F.size("authors_a"), F.size("authors_b"))
    alike = F.greatest(_dice("vector_a", "vector_b", SEGMENTS, NAME_SEGMENTS), 0.8 / fewer)
    authors = F.when(missing, F.lit(None)).when(common > 0, F.least(F.lit(1.0), common / fewer)).when(near, alike).otherwise(F.lit(0.0))
    years = F.coalesce(F.abs(F.col("year_a") - F.col("year_b")) <= 1, F.lit(True))
    generic = F.size(F.split(shorter, " ")) <= 5
    odds = F.lit(-6.0) + 5.0 * title + F.coalesce(5.0 * authors, F.lit(0.0)) + 2.0 * venue
    odds = odds - F.when(generic, 3.0).otherwise(0.0) - F.when(F.coalesce(authors == 0, F.lit(False)), 3.0).otherwise(0.0)
    odds = odds + F.when(F.coalesce(F.col("year_a") == F.col("year_b"), F.lit(False)), 0.5).otherwise(0.0)
    return pairs.withColumn("score", F.when((title > 0) & years, odds)).withColumn("same_doi", F.col("doi_a") == F.col("doi_b"))


#: What an equal identifier adds to the score of a pair.
DOI_ODDS = 4.0


def _near(s: Column, t: Column) -> Column:
    d = F.levenshtein(s, t, 3)
    return (d >= 0) & ((d <= 2) | _one_edit(s, t)) & (d * 4 <= F.length(s))


def _met(keys_a: DataFrame, keys_b: DataFrame, within: bool) -> DataFrame:
    a = keys_a.select("key", F.col("id").alias("id_a"), F.col("year").alias("_ya"))
    b = keys_b.select("key", F.col("id").alias("id_b"), F.col("year").alias("_yb"))
    met = a.join(b, "key").filter(F.coalesce(F.abs(F.col("_ya") - F.col("_yb")) <= 1, F.lit(True)))
    return (met.filter("id_a < id_b") if within else met).select("id_a", "id_b").distinct()


def _rated(met: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = (p.select(F.col("id").alias(f"id_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in PROFILE)) for p, s in ((a, "a"), (b, "b")))
    rated = scored(met.join(x, "id_a").join(y, "id_b")).filter(F.col("score").isNotNull())
    return rated.select("id_a", "id_b", "score", "same_doi")


def _believed() -> Column:
    """A pair is one publication where what it shares outweighs what is expected of two."""
    return F.col("score") + F.when(F.coalesce("same_doi", F.lit(False)), DOI_ODDS).otherwise(0.0) >= 0


def rising(values: list[float], weights: list[float]) -> list[float]:
    """The values nearest to ``values`` (weighted least squares) that never fall."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [v for v, _, n in blocks for _ in range(int(n))]


#: Bounds and width of the classes of score for which agreement is counted.
SCORE_FROM, SCORE_TO, SCORE_STEP = -12.0, 8.0, 0.5


def calibrated(rated: DataFrame, prior: float = 4.0) -> DataFrame:
    """Adds ``confidence`` to rated pairs: the probability that a pair of this score, with what its identifiers say, is one publication.

    Identifiers do not enter the score. For each class of score the share of equal ones among pairs that have two is counted; how often true pairs differ
    (an identifier may belong to another publication) is taken from the best class with pairs enough, how often false ones agree from the worst. Between these two rates the share tells how
    many pairs of the class are true. It is made rising, and tempered by ``prior`` pairs of the logistic of the score, which is all there is where no identifier is known.
    Only the few counts reach the driver.
    """
    n = int((SCORE_TO - SCORE_FROM) / SCORE_STEP)
    cls = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((c - SCORE_FROM) / SCORE_STEP).cast("int")))
    counts = {r[0]: (r[1], r[2]) for r in rated.filter(F.col("same_doi").isNotNull()).groupBy(cls(F.col("score")).alias("c")).agg(F.count_if("same_doi"), F.count(F.lit(1))).collect()}
    equal, total = ([counts.get(c, (0, 0))[k] for c in range(n)] for k in (0, 1))
    known = [c for c in range(n) if total[c] >= 20]
    agree = (equal[known[-1]] + 1) / (total[known[-1]] + 1.05) if known else 0.95
    chance = min((equal[known[0]] + 0.01) / (total[known[0]] + 1) if len(known) > 1 else 0.01, agree / 2)
    logistic = [1 / (1 + np.exp(-(SCORE_FROM + (c + 0.5) * SCORE_STEP))) for c in range(n)]
    shares = [((equal[c] - chance * total[c]) / (agree - chance) + prior * logistic[c]) / (total[c] + prior) for c in range(n)]
    shares = [min(0.9999, max(0.0001, s)) for s in rising(shares, [t + prior for t in total])]
    odds = F.element_at(F.array(*(F.lit(float(s / (1 - s))) for s in shares)), cls(F.col("score")) + 1)
    seen = F.when(F.col("same_doi"), agree / chance).when(~F.col("same_doi"), (1 - min(agree, 0.999)) / (1 - chance)).otherwise(1.0)
    return rated.withColumn("confidence", odds * seen / (1 + odds * seen))


def link_within(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(id_a, id_b, score, same_doi)`` of class representatives, and ``(class, rep)`` for every class."""
    reps, rep = classes(profiles)
    keys = _keys(reps)
    return _rated(_met(keys, keys, True), reps, reps).filter(_believed()), rep


def link_between(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows ``(id_a, id_b, confidence)`` for each record of ``left`` and record of ``right`` of the same publication.

    Records with an empty title have no pair. Repeated records each have theirs.
    """
    (ra, a), (rb, b) = classes(left), classes(right)
    rated = written(_rated(_met(_keys(ra), _keys(rb), False), ra, rb))
    members = lambda p, rep, s: p.select("class", F.col("id").alias(f"id_{s}")).join(rep, "class").select(F.col("rep").alias(f"_r{s}"), f"id_{s}")
    pairs = calibrated(rated).filter(_believed()).withColumnsRenamed({"id_a": "_ra", "id_b": "_rb"})
    pairs = pairs.join(members(left, a, "a"), "_ra").join(members(right, b, "b"), "_rb")
    return pairs.select("id_a", "id_b", "confidence")
