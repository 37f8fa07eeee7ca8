"""The queries of this subpackage over the project's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibflux.functions.blank import clean, is_blank, strip
from bibflux.functions.fold import fold_accents
from bibflux.llm.canonical import canonical_udf, map_places, named_places_udf
from bibflux.llm.concepts import bounded_list, found_terms
from bibflux.llm.cooccur import pair_associations
from bibflux.llm.countries import country_names
from bibflux.llm.distinctive import term_scores
from bibflux.llm.leakage import find_leaks
from bibflux.llm.linkage import link_between, link_within, profile
from bibflux.llm.packing import certificate, pack_documents
from bibflux.llm.residue import find_residue
from bibflux.llm.survivors import survivors
from bibflux.llm.variants import person_variants, venue_variants
from bibflux.operators.components import connected_components
from bibflux.operators.packed import explode_packed, packed_values
from bibflux.queries import sql_blank, sql_packed
from bibflux.session import table, written

#: Rows a country list may have to be sent to every task.
MAX_REFERENCE = 20_000


def _countries(spark: SparkSession, sf_dir: str):
    """Names, codes and other entities of the country list, whose size is checked before it is sent anywhere."""
    rows = table(spark, sf_dir, "country_ref").select("country_id", "country", "iso2", "iso3").limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError("country_ref is too large to send to every task")
    return country_names([tuple(r) for r in rows])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    unified = table(spark, sf_dir, "unified")
    return map_places(unified, "record_id", "country", is_blank(F.col("country")), canonical_udf(*_countries(spark, sf_dir)), "country_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    unified = table(spark, sf_dir, "unified")
    people = person_variants(explode_packed(unified, "record_id", {"authors": True}).select(F.col("value").alias("name")))
    seen = written(unified.filter(~is_blank(F.col("source"))).select(F.col("source").alias("name"), F.nullif(clean(F.col("issn")), F.lit("")).alias("mark")).distinct())
    venues = venue_variants(seen.select("name"), seen)
    cols = ("field", "name_a", "name_b")
    return people.withColumn("field", F.lit("authors")).select(*cols).unionByName(venues.withColumn("field", F.lit("source")).select(*cols))


def unified_profile(unified: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    return profile(unified, "record_id", F.col("title"), packed_values(F.lower(fold_accents(F.col("authors"))), names=True), F.col("year"), F.col("doi"), F.col("source"), extra)


def works_profile(works: DataFrame) -> DataFrame:
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull())
    folded = F.transform(names, lambda n: F.lower(fold_accents(n)))
    return profile(works, "work_id", F.col("title"), folded, F.col("publication_year"), F.col("doi"), F.col("primary_location.source.display_name"))


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = link_between(unified_profile(table(spark, sf_dir, "unified")), works_profile(table(spark, sf_dir, "openalex_works")))
    return pairs.withColumnsRenamed({"id_a": "record_id", "id_b": "work_id"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).select("record_id", "work_id")


#: The reference's order of trust.
TRUST = {"ScienceDirect": 4, "EBSCO": 3, "ACM": 2, "OpenAlex": 1}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    col = F.col
    trust = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TRUST.items() for x in kv)), col("source_db")), F.lit(0))
    # what decides between values is measured in the one scan; the values themselves need not move
    measures = {
        "_source_db": F.when(~is_blank(col("source_db")), F.lit(0)),
        "_abstract": F.when(~is_blank(col("abstract")), F.length(strip(col("abstract")))),
        "_country": F.when(~is_blank(col("country")), named_places_udf(*_countries(spark, sf_dir))("country")),
        "_keywords": F.when(~is_blank(col("keywords")), F.size(packed_values(col("keywords")))),
        "_trust": trust,
        "_time": col("harvested_at"),
    }
    profiles = unified_profile(table(spark, sf_dir, "unified"), measures)
    pairs, rep = link_within(profiles)
    component = connected_components(pairs, "id_a", "id_b").withColumnRenamed("id", "rep")
    of_class = rep.join(component, "rep", "left").select("class", F.coalesce("component", "rep").alias("group_id"))
    members = profiles.select(col("id").alias("record_id"), "class", *measures).join(of_class, "class")
    fields = {f: (col(f"_{f}").isNull(), col(f"_{f}")) for f in ("source_db", "abstract", "country", "keywords")}
    return survivors(members, "group_id", "record_id", fields, col("_trust"), col("_time"), least_records=2).select("group_id", "field", "record_id")


def _p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scores(table(spark, sf_dir, "unified"), "record_id", "abstract")


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6_scores(spark, sf_dir).withColumn("score", F.round("score", 6))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rare terms that a record repeats, each with a score, which is what makes it a case's evidence."""
    return _p6_scores(spark, sf_dir).filter("tf >= 3 and df between 2 and 8 and score is not null").select("record_id", "term")


def p7_pairs(spark: SparkSession, sf_dir: str, min_pairs: int = 1) -> DataFrame:
    """Every pair that occurs together, from one record on."""
    unified = table(spark, sf_dir, "unified")
    keywords = unified.select(F.transform(packed_values(F.col("keywords")), F.lower).alias("items"))
    terms = bounded_list(table(spark, sf_dir, "concept_terms"), "term")
    abstracts = unified.filter(~is_blank(F.col("abstract")))
    concepts = abstracts.select(found_terms(F.col("abstract"), terms).alias("items"))
    by_keyword = pair_associations(keywords, min_pairs=min_pairs)
    by_concept = pair_associations(concepts, n_records=abstracts.agg(F.count(F.lit(1)).alias("n")), min_pairs=min_pairs)
    both = by_keyword.withColumn("field", F.lit("keywords")).unionByName(by_concept.withColumn("field", F.lit("abstract")))
    return both.withColumns({"lift": F.round("lift", 9), "pmi": F.round("pmi", 9)})


def p7_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of four records or more, as its SQL has them; ``p7_pairs`` has all."""
    return p7_pairs(spark, sf_dir, min_pairs=4)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = F.col("n_ab") * F.col("n") >= 4 * F.col("n_a") * F.col("n_b")
    return p7_associations(spark, sf_dir).filter(strong).select("field", "item_a", "item_b")


def p7_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that evaluation sets share: few baskets, each of many hundred items, which go through chunks."""
    words = table(spark, sf_dir, "eval_items").select("item_set", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{5,}"), F.lit(0))).alias("w"))
    baskets = words.groupBy("item_set").agg(F.collect_set("w").alias("items"))
    return pair_associations(baskets, min_pairs=2).withColumns({"lift": F.round("lift", 9), "pmi": F.round("pmi", 9)})


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return certificate(written(p8_pack(spark, sf_dir)))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with edits inside count too."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    return leaks.withColumn("coverage", F.round("coverage", 6))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).filter("n_equal >= 12").select("doc_id", "item_id")


def p10_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_residue(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_residue(spark, sf_dir).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p3_found, p4_found, p4_matches, p5_found, p6_found, p6_scores, p7_found, p7_associations, p7_pairs, p7_wide, p8_pack, p8_certificate, p9_found, p9_leaks, p10_found, p10_residue)
}


def _pairs_sql(items: str, n: str, least: int = 4) -> str:
    """Pair counts of ``items(r, item)``; ``n`` counts the records."""
    return (
        f"i as materialized ({items}), c as (select item, count(*) as k from i group by 1), n as ({n}), p as (select a.item as item_a, b.item as item_b, count(*) as n_ab from i a join i b on a.r = b.r and a.item < b.item group by 1, 2 having count(*) >= {least})"
        " select item_a, item_b, n_ab, x.k as n_a, y.k as n_b, n.n, round(n_ab::double * n.n / (x.k::double * y.k), 9) as lift, round(log2(n_ab::double * n.n / (x.k::double * y.k)), 9) as pmi from p join c x on x.item = item_a join c y on y.item = item_b, n"
    )


_KEYWORD_ITEMS = f"select distinct record_id as r, lower(unnest({sql_packed('keywords', False)})) as item from unified where not {sql_blank('keywords')}"
_SPACED = "' ' || regexp_replace(lower({c}), '\\P{{L}}+', ' ', 'g') || ' '"
_CONCEPT_ITEMS = f"select record_id as r, term as item from unified join concept_terms on contains({_SPACED.format(c='abstract')}, ' ' || trim({_SPACED.format(c='term')}, ' ') || ' ') where not {sql_blank('abstract')}"
_N_ABSTRACTS = f"select count(*) as n from unified where not {sql_blank('abstract')}"
_SET_WORDS = "select distinct item_set as r, unnest(regexp_extract_all(lower(text), '\\p{L}{5,}')) as item from eval_items"


def _every(least: int) -> str:
    return (
        f"select 'keywords' as field, * from (with {_pairs_sql(_KEYWORD_ITEMS, 'select count(distinct r) as n from i', least)})"
        f" union all select 'abstract', * from (with {_pairs_sql(_CONCEPT_ITEMS, _N_ABSTRACTS, least)})"
    )


_ASSOCIATIONS = _every(4)

ORACLE: dict[str, str] = {
    "p6_found": (
        f"with c as (select record_id, term, count(*) as tf from (select record_id, unnest(regexp_extract_all(lower(abstract), '\\p{{L}}{{5,}}')) as term from unified where not {sql_blank('abstract')}) group by 1, 2)"
        " select record_id, term from c join (select term, count(*) as df from c group by 1) using (term) where tf >= 3 and df between 2 and 8"
    ),
    "p6_scores": (
        f"with c as (select record_id, term, count(*) as tf from (select record_id, unnest(regexp_extract_all(lower(abstract), '\\p{{L}}{{5,}}')) as term from unified where not {sql_blank('abstract')}) group by 1, 2),"
        " r as (select record_id, sum(tf)::double as k from c group by 1), t as (select term, count(*) as df, sum(tf)::double as m from c group by 1), n as (select sum(tf)::double as n from c)"
        " select record_id, term, tf, df, case when k = n or m = n then 0.0 else round((tf - k * m / n) / sqrt(k * m / n * ((1 - k / n) * (1 - m / n))), 6) end as score from c join r using (record_id) join t using (term), n"
    ),
    "p7_found": f"select field, item_a, item_b from ({_ASSOCIATIONS}) where n_ab * n >= 4 * n_a * n_b",
    "p7_associations": _ASSOCIATIONS,
    "p7_pairs": _every(1),
    "p7_wide": f"with {_pairs_sql(_SET_WORDS, 'select count(distinct r) as n from i', 2)}",
}
