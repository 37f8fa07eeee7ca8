"""The queries of the core over the project's tables, and the SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibflux.functions import embedding, similarity
from bibflux.functions.fold import fold_accents
from bibflux.functions.lexicon import ADJECTIVES, CLUSTER_STOP_WORDS, FREQUENCY_STOP_WORDS, SUBJECT_ALIASES, SUBJECT_COUNTRIES, SUFFIXES, TERM_STOP_WORDS, affiliation_table
from bibflux.functions.text import bigrams, cluster_tokens, extract_year, frequency_tokens, normalize_title, shorten, unigrams, word_tokens
from bibflux.operators import category, clustering, dedup, geography, records, timeline, vectors, words
from bibflux.operators.packed import HARD, explode_packed
from bibflux.plans.pipelines import cluster_documents, with_record_ids
from bibflux.schema import CANONICAL, canonical, unioned
from bibflux.session import scratch_path, table
from bibflux.sources.exports import parse_ebsco, read_export, read_unified, write_csv
from bibflux.sources.works import map_works, read_jsonl, read_jsonl_slice, save_jsonl
from bibflux.streaming.ingest import append_records, for_each_batch, session_counts, stream_works, window_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "timeline_by_year"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: White space as the column functions see it, for the other engine's regular expressions.
_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def sql_blank(c: str) -> str:
    return f"coalesce(lower({sql_strip(c)}) in ('', 'nan', 'none'), true)"


def sql_clean(c: str) -> str:
    return f"(case when {c} is null or lower(trim({c}, ' ')) in ('nan', 'none') then '' else trim({c}, ' ') end)"


def sql_title(c: str) -> str:
    return f"coalesce(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '')"


def sql_packed(field: str, names: bool) -> str:
    """``list<varchar>`` of a packed field; the same steps as ``packed_values`` in the other engine's list functions."""
    hard = HARD.replace(r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", _WS)
    if names:
        hard = rf",?{_WS}+(?:and|&|y){_WS}+|{hard}"
    text = f"regexp_replace({field}, '(?s)^{_WS}*\\[{_WS}*(\".*\"){_WS}*\\]{_WS}*$', '\\1')"
    outside = f"translate(regexp_replace(p, '{hard}', chr(1), 'g'), ',，', chr(2) || chr(2))"
    pieces = f"string_split({text}, '\"')"
    unpaired = f"(len({pieces}) - (case when len({pieces}) % 2 = 0 then 1 else 0 end))"
    joined = f"array_to_string(list_transform({pieces}, lambda p, i: case when (i - 1) % 2 = 1 and i - 1 < {unpaired} then p else {outside} end), '\"')"
    if names:
        particles = "von|van|de|del|della|di|da|dos|du|la|le|der|den|ter|ten|zu|bin|al|el"
        surname = f"{_WS}*(?:(?i:{particles}){_WS}+)*[^\\s\\x01\\x02\"]+{_WS}*"
        joined = f"regexp_replace({joined}, '(^|[\\x01\\x02])({surname})\\x02({_WS}*[^\\s\\x01\\x02])', '\\1\\2,\\3', 'g')"
    else:
        joined = f"(case when contains({joined}, chr(1)) then replace({joined}, chr(2), ',') else {joined} end)"
    bare = sql_strip("v")
    inner = sql_strip(f"replace(substr({bare}, 2, length({bare}) - 2), '\"\"', '\"')")
    value = f"case when regexp_full_match({bare}, '(?s)\"(?:[^\"]|\"\")*\"') and length({bare}) > 1 then {inner} else {bare} end"
    return f"list_filter(list_transform(string_split_regex({joined}, '[\\x01\\x02]'), lambda v: {value}), lambda v: v <> '')"


def _p1_sql() -> str:
    def one(field: str, names: bool) -> str:
        vals = f"select record_id, {sql_packed(field, names)} as vals from unified where not {sql_blank(field)}"
        return f"select record_id, '{field}' as field, unnest(range(1, len(vals) + 1))::int as pos, unnest(vals) as value from ({vals})"

    return f"{one('authors', True)} union all {one('keywords', False)}"


@query(_p1_sql())
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_packed(table(spark, sf_dir, "unified"), "record_id", {"authors": True, "keywords": False})


# --- records ---------------------------------------------------------------------------------------------------------------------

_CANON = ", ".join(f"{sql_clean(c)} as {c}" for c in CANONICAL)


@query(f"select * from (select record_id, {_CANON} from unified) where title <> ''")
def canonical_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "unified")
    from bibflux.schema import cleaned

    return u.select("record_id", *(cleaned(F.col(c)).alias(c) for c in CANONICAL)).filter("title <> ''")


@query(
    " union all ".join(f"select '{c}' as column_name, round(count(*) filter (where trim({c}, ' ') <> '') / count(*)::double * 100, 1) as pct from unified" for c in CANONICAL)
)
def column_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.completeness(table(spark, sf_dir, "unified"), list(CANONICAL))


@query("select coalesce(source_db, '') as source_db, count(*) as n from unified group by 1")
def source_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.value_counts(table(spark, sf_dir, "unified"), "source_db")


_YEAR = "case when isfinite(try_cast(trim(year, ' ') as double)) and abs(try_cast(trim(year, ' ') as double)) < 1e9 then trunc(try_cast(trim(year, ' ') as double))::int end"


@query(
    f"select count(*) as n_records, count(*) filter (where not {sql_blank('abstract')}) as with_abstract, count(*) filter (where not {sql_blank('keywords')}) as with_keywords,"
    f" count(*) filter (where not {sql_blank('country')}) as with_country, count(*) filter (where not {sql_blank('doi')}) as with_doi, min({_YEAR}) as min_year, max({_YEAR}) as max_year from unified"
)
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.summary(table(spark, sf_dir, "unified"))


_WORKS_ROWS = "(select * from openalex_works where trim(coalesce(title, ''), ' ') <> '' and lower(trim(title, ' ')) not in ('nan', 'none'))"


@query(
    f"select count(*) as total, count(*) filter (where len(map_keys(abstract_inverted_index)) > 0 and exists(select 1 from (select unnest(flatten(map_values(abstract_inverted_index))) as p) where p is not null)) as with_abstract,"
    f" count(*) filter (where len(list_filter(flatten(list_transform(authorships, lambda a: list_transform(coalesce(a.institutions, []), lambda i: upper(trim(i.country_code, ' '))))), lambda c: c is not null and c <> '')) > 0) as with_country,"
    f" count(*) filter (where {sql_clean('doi')} <> '') as with_doi from {_WORKS_ROWS}"
)
def works_preview_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.preview_figures(map_works(table(spark, sf_dir, "openalex_works")))


@query(f"select publication_year::varchar as year, count(*) as n from {_WORKS_ROWS} where publication_year is not null group by 1")
def works_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.year_counts(map_works(table(spark, sf_dir, "openalex_works")))


@query(
    "select source_db, count(*) as n from (select coalesce(source_db, '') as source_db from unified where trim(coalesce(title, ''), ' ') <> '' and lower(trim(title, ' ')) not in ('nan', 'none')"
    " union all select 'EBSCO' from ebsco_raw where trim(coalesce(title, ''), ' ') <> '' and lower(trim(title, ' ')) not in ('nan', 'none')"
    " union all select 'OpenAlex' from openalex_works where trim(coalesce(title, ''), ' ') <> '' and lower(trim(title, ' ')) not in ('nan', 'none')) group by 1"
)
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [canonical(table(spark, sf_dir, "unified")), parse_ebsco(table(spark, sf_dir, "ebsco_raw")), map_works(table(spark, sf_dir, "openalex_works"))]
    return records.value_counts(unioned(frames), "source_db")


# --- sources ---------------------------------------------------------------------------------------------------------------------

_EY = "case when regexp_extract({d}, '\\b((?:19|20)\\d{{2}})\\b', 1) <> '' then regexp_extract({d}, '\\b((?:19|20)\\d{{2}})\\b', 1) else regexp_extract({d}, '(\\d{{4}})', 1) end"


_EBSCO_COLS = {
    "title": sql_clean("title"), "authors": sql_clean("contributors"), "year": _EY.format(d=sql_clean("publicationdate")), "source": sql_clean("source"), "doi": sql_clean("doi"), "abstract": sql_clean("abstract"), "document_type": sql_clean("doctypes"),
    "url": sql_clean("plink"), "issn": sql_clean("issns"), "keywords": sql_clean("subjects"), "country": sql_clean("authorlocations"), "source_db": "'EBSCO'",
}
_EBSCO = "select " + ", ".join(f"{e} as {c}" for c, e in _EBSCO_COLS.items()) + " from ebsco_raw"


@query(f"select * from ({_EBSCO}) where title <> ''")
def ebsco_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_ebsco(table(spark, sf_dir, "ebsco_raw"))


@query(f"select * from ({_EBSCO}) where title <> ''")
def ebsco_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as an export with a byte-order mark, then read as one."""
    path = scratch_path(spark)
    write_csv(table(spark, sf_dir, "ebsco_raw").drop("ebsco_row", "loaded_at"), path)
    return read_export(spark, path, "EBSCO")


@query(f"select * from (select {_CANON} from unified) where title <> ''")
def unified_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified table written as CSV and read again."""
    path = scratch_path(spark)
    write_csv(canonical(table(spark, sf_dir, "unified")), path)
    return read_unified(spark, path)


@query(f"select row_number() over (order by {', '.join(CANONICAL)}) - 1 as record_id, title from (select {_CANON} from unified) where title <> ''")
def numbered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_record_ids(canonical(table(spark, sf_dir, "unified"))).select("record_id", "title")


_CODES = "list_filter(flatten(list_transform(authorships, lambda a: list_transform(coalesce(a.institutions, []), lambda i: upper(trim(i.country_code, ' '))))), lambda c: c is not null and c <> '')"


@query(
    "select work_id, " + ", ".join(f"{sql_clean(c)} as {c}" for c in ("title", "authors", "year", "source", "doi", "url", "issn", "keywords", "country")) + " from (select work_id, title,"
    " array_to_string(list_filter(list_transform(authorships, lambda a: a.author.display_name), lambda n: n is not null and n <> ''), ', ') as authors, publication_year::varchar as year,"
    " primary_location.source.display_name as source, regexp_replace(doi, 'https?://doi\\.org/', '', 'g') as doi, coalesce(nullif(primary_location.landing_page_url, ''), open_access.oa_url) as url,"
    " coalesce(nullif(primary_location.source.issn_l, ''), primary_location.source.issn[1]) as issn,"
    " array_to_string(case when len(list_filter(list_transform(keywords, lambda k: k.keyword), lambda n: n is not null and n <> '')) > 0 then list_filter(list_transform(keywords, lambda k: k.keyword), lambda n: n is not null and n <> '')"
    f" else list_filter(list_transform(topics, lambda t: t.display_name), lambda n: n is not null and n <> '') end, ', ') as keywords, {_CODES}[1] as country from openalex_works) where {sql_clean('title')} <> ''"
)
def works_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_works(table(spark, sf_dir, "openalex_works"), ("work_id",)).select("work_id", "title", "authors", "year", "source", "doi", "url", "issn", "keywords", "country")


@query(
    "select work_id, coalesce(string_agg(w, ' ' order by p), '') as abstract from (select work_id, abstract_inverted_index as m from openalex_works where trim(coalesce(title, ''), ' ') <> '' and lower(trim(title, ' ')) not in ('nan', 'none'))"
    " left join lateral (select p, last(w order by i) as w from (select e.key as w, unnest(e.value) as p, i from (select unnest(map_entries(m)) as e, unnest(range(len(map_entries(m)))) as i)) group by p) on true group by work_id"
)
def works_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_works(table(spark, sf_dir, "openalex_works"), ("work_id",)).select("work_id", "abstract")


def _jsonl(spark: SparkSession, sf_dir: str, extra: str = "") -> str:
    """The works as a folder of JSON lines, as the fetching of the API leaves them."""
    path = scratch_path(spark)
    works = table(spark, sf_dir, "openalex_works").drop("harvested_at")
    save_jsonl(works.select(F.to_json(F.struct("*")).alias("value")), path, overwrite=True)
    return path


_WORKS_COLS = "title, authors, year, source, doi, url, issn, keywords, country"


@query(ORACLE["works_mapped"].replace("select work_id, ", "select ", 1))
def works_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_works(read_jsonl(spark, _jsonl(spark, sf_dir))).select(*_WORKS_COLS.split(", "))


@query(ORACLE["works_mapped"].replace("select work_id, ", "select ", 1))
def works_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON lines read as a stream that appends canonical records."""
    target = scratch_path(spark)
    append_records(stream_works(spark, _jsonl(spark, sf_dir)), target, scratch_path(spark)).awaitTermination()
    return spark.read.parquet(target).select(*_WORKS_COLS.split(", "))


@query("select work_id, title, (select count(*) from openalex_works) as total from openalex_works order by work_id limit 50 offset 100")
def works_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 100 to 150 and the number of all: the slice is the feature."""
    rows, total = read_jsonl_slice(spark, _jsonl(spark, sf_dir), 100, 50, "work_id long, title string", "work_id")
    return rows.withColumn("total", F.lit(total).cast("long"))


# --- timeline --------------------------------------------------------------------------------------------------------------------

_DATED = f"(select y as year, case when length(s) > 45 then left(s, 45) || '…' else s end as source_short from (select {_YEAR} as y, coalesce(source, '') as s from unified) where y >= 2000)"
_TOP = f"(select source_short, count(*) as total from {_DATED} group by 1 order by total desc, source_short limit 8)"


@query(f"select year, count(*) as n from {_DATED} group by 1")
def timeline_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.by_year(table(spark, sf_dir, "unified"))


@query(f"select year, source_short, count(*) as n from {_DATED} group by 1, 2")
def timeline_by_year_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.by_year_and_source(table(spark, sf_dir, "unified"))


@query(f"select source_short, total from {_TOP}")
def timeline_top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.top_sources(table(spark, sf_dir, "unified"))


@query(
    f"select y.year, t.source_short, count(d.year) as n from (select distinct year from {_DATED}) y cross join {_TOP} t left join {_DATED} d on d.year = y.year and d.source_short = t.source_short group by 1, 2"
)
def timeline_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.pivot(table(spark, sf_dir, "unified"))


@query(
    f"select (select count(*) from {_DATED}) as total, (select count(distinct year) from {_DATED}) as n_years, (select year from {_DATED} group by 1 order by count(*) desc, year limit 1) as peak_year, (select count(distinct source_short) from {_DATED}) as n_sources"
)
def timeline_key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.key_figures(table(spark, sf_dir, "unified"))


# --- geography -------------------------------------------------------------------------------------------------------------------


def _geo_sql() -> str:
    aliases = ", ".join(f"('{a.replace(chr(39), chr(39) * 2)}', '{c}', '{iso}', {k})" for a, c, iso, k in affiliation_table())
    text = "trim(regexp_replace(regexp_replace(lower(split_part(trim(country, ' '), ';', 1)), '[,;.()\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g'))"
    quoted = "regexp_replace(alias, '([.])', '\\\\\\1', 'g')"
    return (
        f"with a(alias, country, iso_a3, k) as (values {aliases}), t as materialized (select record_id, {text} as t from unified where not {sql_blank('country')}),"
        " u as (select distinct t from t),"
        f" h as materialized (select u.t, arg_min(struct_pack(c := a.country, i := a.iso_a3), -length(alias) * 1000 + k) as best from u join a on case when contains(u.t, alias) then regexp_matches(u.t, '(^|[^\\p{{L}}\\p{{N}}_])' || {quoted} || '($|[^\\p{{L}}\\p{{N}}_])') else false end group by 1)"
    )


@query(_geo_sql() + " select best.c as country, best.i as iso_a3, count(*) as n from t join h using (t) group by 1, 2")
def geo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geography.geography(table(spark, sf_dir, "unified"))


@query(_geo_sql() + " select best.c as country, count(*) as n from t join h using (t) where trim(best.i, ' ') <> '' group by 1 order by n desc, country limit 20")
def geo_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty leading countries that a map can show."""
    shown, _ = geography.split_by_code(geography.geography(table(spark, sf_dir, "unified")))
    return shown.select("country", "n").orderBy(F.desc("n"), "country").limit(20)


@query(
    _geo_sql()
    + ", g as (select best.c as country, count(*) as n from t join h using (t) group by 1) select count(*) as n_countries, coalesce(sum(n), 0)::bigint as total, (select country from g order by n desc, country limit 1) as leader from g"
)
def geo_key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geography.geography_figures(table(spark, sf_dir, "unified"))


def _sql_map(pairs: dict[str, str]) -> str:
    return "map {" + ", ".join(f"{_quoted([k])}: {_quoted([v])}" for k, v in pairs.items()) + "}"


_SUBJECTS = _sql_map({**{a.lower(): n for a, n in SUBJECT_ALIASES.items()}, **{n.lower(): n for n in SUBJECT_COUNTRIES}})
_FOUND = "coalesce(list_filter({l}, lambda x: x is not null)[1], '')"


@query(
    f"select ebsco_row, case when {sql_blank('subjects')} then '' else {_FOUND.format(l=f"list_transform(string_split(subjects, ';'), lambda t: {_SUBJECTS}[lower(trim(t, ' '))])")} end as subject_country,"
    f" case when {sql_blank('abstract')} then '' when len(list_filter(list_transform(w, lambda x: {_sql_map(ADJECTIVES)}[lower(x)]), lambda x: x is not null)) > 0 then {_FOUND.format(l=f'list_transform(w, lambda x: {_sql_map(ADJECTIVES)}[lower(x)])')}"
    f" else coalesce(list_filter(w, lambda x: x in ({_quoted(SUBJECT_COUNTRIES)}))[1], '') end as text_country from (select *, regexp_extract_all(abstract, '\\b[A-Za-z]+\\b') as w from ebsco_raw)"
)
def ebsco_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "ebsco_raw")
    return raw.select("ebsco_row", geography.subject_country(F.col("subjects")).alias("subject_country"), geography.text_country(F.col("abstract")).alias("text_country"))


# --- words -----------------------------------------------------------------------------------------------------------------------

_FREQ_STOP = _quoted(sorted(FREQUENCY_STOP_WORDS))
_FREQ_TEXT = "regexp_replace(regexp_replace(regexp_replace(lower(abstract), 'https?://\\S+', '', 'g'), '\\b\\d+\\b', '', 'g'), '[^a-z\\s\\-]', ' ', 'g')"
_FREQ = (
    f"(select term, sum(f)::bigint as freq from (select trim(w, '-') as term, 1 as f from (select unnest(string_split_regex({_FREQ_TEXT}, '\\s+')) as w from unified where trim(coalesce(abstract, ''), ' ') not in ('', 'nan', 'none'))"
    f" union all select lower(trim(w, ' ')), 3 from (select unnest(string_split_regex(keywords, '[;,]')) as w from unified where not {sql_blank('keywords')})) where length(term) >= 3 and term not in ({_FREQ_STOP}) group by 1 order by freq desc, term limit 150)"
)


@query(f"select term, freq from {_FREQ}")
def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_frequencies(table(spark, sf_dir, "unified"))


@query(f"select (select term from {_FREQ} order by freq desc, term limit 1) as top_term, (select avg(freq) from (select freq from {_FREQ} order by freq desc, term limit 5)) as mean_freq")
def word_leading_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.leading_mean(words.word_frequencies(table(spark, sf_dir, "unified")))


# --- text kernel -----------------------------------------------------------------------------------------------------------------


@query("select w as token, count(*) as n, count(distinct record_id) as df from (select record_id, unnest(regexp_extract_all(lower(abstract), '[\\p{L}\\p{N}_]+')) as w from unified) group by 1")
def tokens_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "unified").select("record_id", F.explode(word_tokens(F.col("abstract"))).alias("token"))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("record_id").alias("df"))


_RAW = "list_filter(string_split_regex(regexp_replace(lower(abstract), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
_STEM_RE = "^(.{3,}?)(?:" + "|".join(SUFFIXES) + ")$"


@query(
    f"select stem, count(*) as n from (select case when length(w) > 4 then regexp_replace(w, '{_STEM_RE}', '\\1') else w end as stem from (select unnest({_RAW}) as w from unified) where length(w) >= 3 and w not in ({_quoted(sorted(CLUSTER_STOP_WORDS))})) group by 1"
)
def tokens_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "unified").select(F.explode(cluster_tokens(F.col("abstract"))).alias("stem"))
    return rows.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


_STOP = _quoted(sorted(TERM_STOP_WORDS))
_BIGRAM_OK = f"length(a) >= 2 and length(b) >= 2 and greatest(length(a), length(b)) >= 3 and not (a in ({_STOP}) and b in ({_STOP}))"
_BIGRAMS = f"(select record_id, r, a || ' ' || b as term from (select record_id, r, unnest(ws[:-2]) as a, unnest(ws[2:]) as b from (select record_id, record_id as r, {_RAW} as ws from unified)) where b is not null and {_BIGRAM_OK})"


@query(f"select term as bigram, count(*) as n from {_BIGRAMS} group by 1")
def tokens_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "unified").select(F.explode(bigrams(F.col("abstract"))).alias("bigram"))
    return rows.groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


@query(f"select record_id, {sql_title('title')} as norm_title, case when length(title) > 80 then left(title, 80) || '…' else title end as label, {_EY.format(d='coalesce(year, chr(32))')} as year4 from unified")
def titles_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "unified")
    return u.select("record_id", normalize_title(F.col("title")).alias("norm_title"), shorten(F.col("title"), 80).alias("label"), extract_year(F.coalesce("year", F.lit(" "))).alias("year4"))


# --- category terms --------------------------------------------------------------------------------------------------------------

#: The project's concept terms stand in for the category, whose own terms its texts hardly use.
CONCEPTS = (
    "prompt scaffolding", "feedback literacy", "few-shot exemplars", "model disclosure", "draft tracing", "rubric alignment", "co-writing", "hallucination audit",
    "consent records", "learner agency", "bias probing", "source attribution", "token budgets", "retrieval grounding", "persona drift", "human-in-loop review",
    "grade inflation", "peer critique", "synthetic cohorts", "reading ladders", "style mimicry", "oral defence", "plagiarism screens", "dialogic tutoring",
    "lesson planning", "code explanation", "image captioning", "voice cloning", "accessibility prompts", "red-team exercises", "policy templates", "temperature tuning",
    "chain prompting", "citation repair", "teacher workload", "metacognitive prompts", "misuse taxonomies", "trust calibration", "answer hedging", "domain glossaries",
    "item generation", "error taxonomies", "version histories", "guardrail fatigue", "translation aids", "worked examples", "curiosity gaps", "equity audits",
)


def _sql_pattern(term: str) -> str:
    return "(?i)\\b" + "[\\-\\s]?".join(term.lower().split("-")) + "\\b"


_TEXTS = "(select record_id, abstract from unified where trim(abstract, ' ') <> '')"
_ANY = "|".join(f"(?:{_sql_pattern(t)})" for t in CONCEPTS)
_CONCEPT_ROWS = ", ".join(f"({i}, '{t}', '{_sql_pattern(t)}')" for i, t in enumerate(CONCEPTS))
_COUNTS = (
    f"(select term, count(*) filter (where k > 0) as doc_frequency, coalesce(sum(k), 0)::bigint as total_occurrences, round(count(*) filter (where k > 0) / count(*)::double * 100, 2) as doc_frequency_pct"
    f" from (select term, len(regexp_extract_all(abstract, pattern)) as k from {_TEXTS} cross join (values {_CONCEPT_ROWS}) c(i, term, pattern)) group by 1)"
)


@query(f"select term, doc_frequency, total_occurrences, doc_frequency_pct from {_COUNTS}")
def category_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category.term_counts(table(spark, sf_dir, "unified"), "abstract", CONCEPTS)


@query(f"select list_sort(list(doc_frequency))[count(*) // 2 + 1] as median_doc_frequency, count(*) filter (where doc_frequency > 0) as n_present from {_COUNTS}")
def category_term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category.term_statistics(category.term_counts(table(spark, sf_dir, "unified"), "abstract", CONCEPTS))


@query(f"select count(*) as n_abstracts, count(*) filter (where c) as n_category_docs, round(count(*) filter (where c) / count(*)::double * 100, 2) as category_coverage_pct from (select regexp_matches(abstract, '{_ANY}') as c from {_TEXTS})")
def category_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category.coverage(table(spark, sf_dir, "unified"), "abstract", CONCEPTS)


_EXCLUDED = _quoted(sorted({f for t in CONCEPTS for f in (t, t.replace("-", " "), t.replace("-", ""))}))
_NPMI = (
    f"with texts as (select record_id, abstract, regexp_matches(abstract, '{_ANY}') as c from {_TEXTS}), tot as (select count(*) as n, count(*) filter (where c) as n_cat from texts),"
    f" grams as (select record_id, w as term from (select record_id, unnest({_RAW}) as w from texts) where length(w) >= 3 and w not in ({_STOP}) union all select record_id, term from {_BIGRAMS} where record_id in (select record_id from texts)),"
    f" s as (select term, count(distinct record_id) as doc_frequency, count(*) as total_occurrences, count(distinct record_id) filter (where c) as docs_with_category from grams join texts using (record_id) where term not in ({_EXCLUDED}) group by 1 having count(distinct record_id) >= 2),"
    " scored as (select s.*, n, case when docs_with_category = 0 or n_cat = 0 then -1.0 when docs_with_category = n then 1.0 else round(greatest(-1.0, least(1.0, log2((docs_with_category / n::double) / ((doc_frequency / n::double) * (n_cat / n::double))) / -log2(docs_with_category / n::double))), 4) end as npmi from s, tot),"
    " top as (select row_number() over (order by npmi desc, doc_frequency desc, term) as npmi_rank, term, doc_frequency, total_occurrences, round(doc_frequency / n::double * 100, 2) as doc_frequency_pct, npmi, docs_with_category from scored where npmi > 0 qualify npmi_rank <= 15)"
)


@query(_NPMI + " select npmi_rank::int as npmi_rank, term, doc_frequency, total_occurrences, doc_frequency_pct, npmi, docs_with_category from top")
def npmi_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category.associated_terms(table(spark, sf_dir, "unified"), "abstract", terms=CONCEPTS)


_LABEL = "case when {p} >= 0.75 then 'very relevant' when {p} >= 0.5 then 'moderately relevant' when {p} >= 0.25 then 'weakly relevant' else 'hardly relevant' end"
_PREC = (
    _NPMI
    + ", p as (select term, npmi, npmi_rank, case when count(*) filter (where h) > 0 then count(*) filter (where h and c) / (count(*) filter (where h))::double else 0.0 end as p from (select top.term, npmi, npmi_rank, c, regexp_matches(abstract, '(?i)\\b' || top.term || '\\b') as h from texts cross join top) group by 1, 2, 3)"
)


@query(_PREC + f" select (row_number() over (order by round(p, 4) desc, npmi desc, npmi_rank))::int as precision_rank, npmi_rank::int as npmi_rank, term, npmi, round(p, 4) as precision, round(p * 100, 1) as precision_pct, {_LABEL.format(p='p')} as precision_label from p")
def npmi_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "unified")
    found = category.associated_terms(u, "abstract", terms=CONCEPTS)
    return category.precision(u, "abstract", found, CONCEPTS).select("precision_rank", "npmi_rank", "term", "npmi", "precision", "precision_pct", "precision_label")


@query(
    _PREC
    + f" select round(avg(round(p, 4)), 4) as mean_precision, count(*) filter (where round(p, 4) >= 0.75) as n_high, count(*) filter (where not contains(term, ' ')) as n_unigrams, count(*) filter (where contains(term, ' ')) as n_bigrams, {_LABEL.format(p='avg(round(p, 4))')} as quality from p"
)
def npmi_key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "unified")
    found = category.associated_terms(u, "abstract", terms=CONCEPTS)
    return category.precision_figures(category.precision(u, "abstract", found, CONCEPTS))


# --- similarity ------------------------------------------------------------------------------------------------------------------

_ITEMS = "(select item_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') as t from eval_items)"
_ITEM_PAIRS = f"(select a.item_id as id_a, b.item_id as id_b, a.t as ta, b.t as tb from {_ITEMS} a join {_ITEMS} b on a.item_id < b.item_id)"


def _item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two evaluation texts, in ASCII: a fixed table, whose pairs are the matrix that is asked for."""
    items = table(spark, sf_dir, "eval_items").select("item_id", F.regexp_replace(fold_accents(F.col("text")), r"[^\x00-\x7F]", "").alias("t"))
    a, b = items.withColumnsRenamed({"item_id": "id_a", "t": "ta"}), items.withColumnsRenamed({"item_id": "id_b", "t": "tb"})
    return a.join(b, F.col("id_a") < F.col("id_b")).repartition(32, "id_a", "id_b")


def _measured(name: str) -> Query:
    measure = similarity.MEASURES[name]
    return lambda spark, sf_dir: _item_pairs(spark, sf_dir).select("id_a", "id_b", F.round(measure(F.col("ta"), F.col("tb")), 6).alias("similarity"))


_TOK = "list_distinct(regexp_extract_all(lower({t}), '[a-z0-9_]+'))"
QUERIES["sim_levenshtein"] = _measured("levenshtein")
ORACLE["sim_levenshtein"] = f"select id_a, id_b, round(case when ta = tb then 1.0 else 1 - levenshtein(ta, tb) / greatest(length(ta), length(tb))::double end, 6) as similarity from {_ITEM_PAIRS}"
QUERIES["sim_jaccard"] = _measured("jaccard")
ORACLE["sim_jaccard"] = f"select id_a, id_b, round(len(list_intersect({_TOK.format(t='ta')}, {_TOK.format(t='tb')})) / len(list_distinct(list_concat({_TOK.format(t='ta')}, {_TOK.format(t='tb')})))::double, 6) as similarity from {_ITEM_PAIRS}"
QUERIES["sim_hamming"] = _measured("hamming")
ORACLE["sim_hamming"] = f"select id_a, id_b, round(1 - hamming(rpad(lower(ta), m, ' '), rpad(lower(tb), m, ' ')) / m::double, 6) as similarity from (select *, greatest(length(ta), length(tb))::int as m from {_ITEM_PAIRS})"
QUERIES["sim_cosine"] = _measured("cosine_tfidf")
ORACLE["sim_cosine"] = (
    f"with w as (select item_id, word, count(*) as k, sum(count(*)) over (partition by item_id) as n from (select item_id, unnest(regexp_extract_all(lower(t), '[a-z0-9_]+')) as word from {_ITEMS}) group by 1, 2),"
    f" p as (select a.item_id as id_a, b.item_id as id_b from {_ITEMS} a join {_ITEMS} b on a.item_id < b.item_id), c as (select id_a, id_b, sum(x.k / x.n::double * y.k / y.n::double) as dot, sum(pow(x.k / x.n::double, 2)) as sa, sum(pow(y.k / y.n::double, 2)) as sb"
    " from p join w x on x.item_id = id_a join w y on y.item_id = id_b and y.word = x.word group by 1, 2), q as (select item_id, sum(pow(k / n::double, 2)) as s from w group by 1)"
    " select id_a, id_b, round(coalesce(dot, 0) / sqrt((coalesce(sa, 0) + (x.s - coalesce(sa, 0)) * pow(ln(1.5) + 1, 2)) * (coalesce(sb, 0) + (y.s - coalesce(sb, 0)) * pow(ln(1.5) + 1, 2))), 6) as similarity"
    " from p left join c using (id_a, id_b) join q x on x.item_id = id_a join q y on y.item_id = id_b"
)


_TRACE_TOK = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"
_TA, _TB = _TRACE_TOK.format(t="a"), _TRACE_TOK.format(t="b")


@query(
    f"select country_id, levenshtein(a, b)::int as lev_distance, round(1 - levenshtein(a, b) / greatest(length(a), length(b), 1)::double, 4) as lev_similarity, (length(a) + 1)::int as lev_rows, levenshtein(a, b)::int as lev_corner,"
    f" len(list_intersect(list_distinct({_TA}), list_distinct({_TB})))::int as jac_intersection, len(list_distinct(list_concat({_TA}, {_TB})))::int as jac_union,"
    f" round(len(list_intersect(list_distinct({_TA}), list_distinct({_TB}))) / len(list_distinct(list_concat({_TA}, {_TB})))::double, 4) as jac_similarity, len(list_distinct(list_concat({_TA}, {_TB})))::int as cos_vocabulary,"
    " hamming(rpad(lower(a), m, ' '), rpad(lower(b), m, ' '))::int as ham_distance, m as ham_positions, least(m, 50) as ham_sample, round(1 - hamming(rpad(lower(a), m, ' '), rpad(lower(b), m, ' ')) / m::double, 4) as ham_similarity"
    " from (select country_id, country as a, iso3 as b, greatest(length(country), length(iso3))::int as m from country_ref)"
)
def sim_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the four traces of each country's name against its code."""
    c = table(spark, sf_dir, "country_ref")
    a, b = F.col("country"), F.col("iso3")
    t = c.select("country_id", similarity.levenshtein_trace(a, b).alias("l"), similarity.jaccard_trace(a, b).alias("j"), similarity.cosine_trace(a, b).alias("c"), similarity.hamming_trace(a, b).alias("h"))
    corner = F.element_at(F.element_at("l.matrix", -1), -1)
    return t.select(
        "country_id", F.col("l.distance").alias("lev_distance"), F.col("l.similarity").alias("lev_similarity"), F.size("l.matrix").alias("lev_rows"), corner.alias("lev_corner"),
        F.col("j.intersection_size").alias("jac_intersection"), F.col("j.union_size").alias("jac_union"), F.col("j.similarity").alias("jac_similarity"), F.size("c.vocabulary").alias("cos_vocabulary"),
        F.col("h.distance").alias("ham_distance"), F.col("h.total_positions").alias("ham_positions"), F.size("h.comparisons_sample").alias("ham_sample"), F.col("h.similarity").alias("ham_similarity"),
    )


@query(
    f"select id_a, id_b, round(similarity, 4) as similarity from (select id_a, id_b, case when ta = tb then 1.0 else 1 - levenshtein(ta, tb) / greatest(length(ta), length(tb))::double end as similarity from {_ITEM_PAIRS}"
    f" union all select id_b, id_a, case when ta = tb then 1.0 else 1 - levenshtein(ta, tb) / greatest(length(ta), length(tb))::double end from {_ITEM_PAIRS} union all select item_id, item_id, 1.0 from eval_items)"
)
def sim_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items").select("item_id", F.regexp_replace(fold_accents(F.col("text")), r"[^\x00-\x7F]", "").alias("t"))
    return similarity.similarity_matrix(items, "item_id", "t", "levenshtein")


@query(
    "select country_id, unnest(['levenshtein', 'jaccard', 'hamming']) as measure, unnest([round(1 - levenshtein(a, b) / m::double, 4),"
    f" round(len(list_intersect(list_distinct({_TA}), list_distinct({_TB}))) / len(list_distinct(list_concat({_TA}, {_TB})))::double, 4), round(1 - hamming(rpad(lower(a), m, ' '), rpad(lower(b), m, ' ')) / m::double, 4)]) as similarity"
    " from (select country_id, country as a, iso3 as b, greatest(length(country), length(iso3))::int as m from country_ref)"
)
def sim_score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "country_ref").select("country_id", F.col("country").alias("a"), F.col("iso3").alias("b"))
    return similarity.score_table(pairs, "a", "b", {k: similarity.MEASURES[k] for k in ("levenshtein", "jaccard", "hamming")})


@query(
    f"select record_id, work_id, x <> '' and y <> '' and 1 - levenshtein(x, y) / greatest(length(x), length(y), 1)::double >= 0.92 as duplicate from (select record_id, work_id, {sql_title('u.title')} as x, {sql_title('w.title')} as y from unified u join openalex_works w on u.record_id = w.work_id)"
)
def title_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the record and the work of one number have duplicate titles."""
    u = table(spark, sf_dir, "unified").select("record_id", F.col("title").alias("_a"))
    w = table(spark, sf_dir, "openalex_works").select("work_id", F.col("title").alias("_b"))
    return u.join(w, u.record_id == w.work_id).select("record_id", "work_id", dedup.titles_are_duplicate(F.col("_a"), F.col("_b")).alias("duplicate"))


@query("select label, pos, round(avg(x), 6) as mean from (select label, unnest(range(1, len(embedding) + 1))::int as pos, unnest(embedding)::double as x from embeddings) group by 1, 2")
def embedding_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.mean_by(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 6))


@query(
    "select query_id, neighbour_id, round(c, 6) as cosine from (select q.vec_id as query_id, v.vec_id as neighbour_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as c from embeddings q join embeddings v on q.vec_id % 20 = 0 and v.vec_id <> q.vec_id)"
    " qualify row_number() over (partition by query_id order by c desc, neighbour_id) <= 5"
)
def embedding_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return embedding.nearest(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding").withColumn("cosine", F.round("cosine", 6))


# --- duplicates ------------------------------------------------------------------------------------------------------------------

_TITLES = f"(select distinct t from (select {sql_title('title')} as t from unified) where t <> '')"
_DUP_PAIRS = (
    f"(select a.t as title_a, b.t as title_b, 1.0::double - levenshtein(a.t, b.t) / length(b.t)::double as similarity from {_TITLES} a join {_TITLES} b on (length(a.t) < length(b.t) or length(a.t) = length(b.t) and a.t < b.t)"
    " and length(a.t) >= length(b.t) * 0.92 - 1 where 1.0::double - levenshtein(a.t, b.t) / length(b.t)::double >= 0.92)"
)


@query(f"select title_a, title_b, round(similarity, 6) as similarity from {_DUP_PAIRS}")
def dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "unified").select(normalize_title(F.col("title")).alias("title"))
    return dedup.similar_titles(titles).withColumn("similarity", F.round("similarity", 6))


_GROUPS = (
    f"with recursive rec as (select record_id, {sql_title('title')} as t from unified), e as materialized (select title_a as a, title_b as b from {_DUP_PAIRS} union all select title_b, title_a from {_DUP_PAIRS}),"
    " reach(a, b) as (select t, t from (select distinct t from rec where t <> '') union select r.a, e.b from reach r join e on r.b = e.a),"
    " comp as (select a as t, min(rr.record_id) as group_id from reach join (select t, min(record_id) as record_id from rec group by 1) rr on rr.t = reach.b group by 1),"
    " g as (select record_id, group_id from rec join comp using (t) qualify count(*) over (partition by group_id) > 1)"
)


@query(_GROUPS + " select record_id, group_id from g")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(table(spark, sf_dir, "unified"))


_FILLED = " + ".join(f"(case when trim(coalesce({c}, ''), ' ') <> '' then 1 else 0 end)" for c in CANONICAL)
_SCORE = f"(coalesce(case source_db when 'ScienceDirect' then 3 when 'EBSCO' then 2 when 'ACM' then 1 when 'OpenAlex' then 0 end, 0) * 1000 + {_FILLED} + (case when {sql_title('title')} <> '' then 1 else 0 end) + length(coalesce(abstract, '')))"
_KEPT = _GROUPS + f", k as (select group_id, arg_max(record_id, {_SCORE} * 1000000000 - record_id) as kept_id from g join unified using (record_id) group by 1)"


@query(_KEPT + " select group_id, kept_id from k")
def dup_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "unified")
    return dedup.representatives(u, dedup.duplicate_groups(u))


@query(_KEPT + " select g.record_id, kept_id as kept_record_id, coalesce(u.title, '') as kept_title, coalesce(u.source_db, '') as kept_db from g join k using (group_id) join unified u on u.record_id = kept_id where g.record_id <> kept_id")
def dup_discarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unify(table(spark, sf_dir, "unified"))[1].select("record_id", "kept_record_id", "kept_title", "kept_db")


@query(
    _KEPT
    + ", lost as (select g.record_id, kept_id from g join k using (group_id) where g.record_id <> kept_id), spare as (select kept_id as record_id, arg_max(trim(abstract, ' '), length(trim(abstract, ' ')) * 1000000000 - record_id) as s from lost join unified using (record_id) where source_db = 'OpenAlex' and trim(coalesce(abstract, ''), ' ') <> '' group by 1)"
    " select u.record_id, coalesce(title, '') as title, case when trim(coalesce(abstract, ''), ' ') = '' and s is not null then s else coalesce(abstract, '') end as abstract from unified u left join spare using (record_id) where u.record_id not in (select record_id from lost)"
)
def unify_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.unify(table(spark, sf_dir, "unified"))[0].select("record_id", "title", "abstract")


# --- vectors and clustering ------------------------------------------------------------------------------------------------------

_STEMS = f"(select record_id, case when length(w) > 4 then regexp_replace(w, '{_STEM_RE}', '\\1') else w end as term from (select record_id, unnest({_RAW}) as w from unified) where length(w) >= 3 and w not in ({_quoted(sorted(CLUSTER_STOP_WORDS))}))"


@query(f"select term, count(distinct record_id) as df, round(ln(((select count(*) from unified) + 1) / (count(distinct record_id) + 1)::double) + 1, 6) as idf from {_STEMS} group by 1")
def tfidf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "unified")
    tf = vectors.term_frequencies(u, "record_id", cluster_tokens(F.col("abstract")))
    return vectors.inverse_frequencies(tf, u.count()).withColumn("idf", F.round("idf", 6))


@query(
    f"with s as materialized {_STEMS}, i as (select term, ln(((select count(*) from unified) + 1) / (count(distinct record_id) + 1)::double) + 1 as idf from s group by 1)"
    " select record_id, term, round(k / n * idf, 6) as weight from (select record_id, term, count(*)::double as k, sum(count(*)) over (partition by record_id) as n from s group by 1, 2) join i using (term)"
)
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "unified")
    return vectors.tfidf(u, "record_id", cluster_tokens(F.col("abstract"))).withColumn("weight", F.round("weight", 6))


_ITEM_RAW = _RAW.replace("lower(abstract)", "lower(text)")
_DIST = (
    f"with s as materialized (select item_id, case when length(w) > 4 then regexp_replace(w, '{_STEM_RE}', '\\1') else w end as term from (select item_id, unnest({_ITEM_RAW}) as w from eval_items) where length(w) >= 3 and w not in ({_quoted(sorted(CLUSTER_STOP_WORDS))})),"
    " i as (select term, ln(((select count(*) from eval_items) + 1) / (count(distinct item_id) + 1)::double) + 1 as idf from s group by 1),"
    " v as materialized (select item_id, term, k / n * idf as w from (select item_id, term, count(*)::double as k, sum(count(*)) over (partition by item_id) as n from s group by 1, 2) join i using (term)), q as (select item_id, sqrt(sum(w * w)) as l from v group by 1),"
    " d as (select a.item_id as id_a, b.item_id as id_b, 1 - greatest(-1, least(1, coalesce(dot, 0))) as distance from eval_items a join eval_items b on a.item_id < b.item_id"
    " left join (select x.item_id as ia, y.item_id as ib, sum(x.w / qx.l * y.w / qy.l) as dot from v x join v y on x.term = y.term and x.item_id < y.item_id join q qx on qx.item_id = x.item_id join q qy on qy.item_id = y.item_id group by 1, 2) on ia = a.item_id and ib = b.item_id)"
)


def _item_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    return vectors.cosine_distances(vectors.tfidf(items, "item_id", cluster_tokens(F.col("text"))), items, "item_id")


@query(_DIST + " select id_a, id_b, round(distance, 6) as distance from d")
def cosine_distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _item_distances(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@query(_DIST + " select round(min(distance), 6) as min_d, round(max(distance), 6) as max_d, round(avg(distance), 6) as mean_d, round(stddev_pop(distance), 6) as std_d from d")
def distance_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = vectors.distance_statistics(_item_distances(spark, sf_dir))
    return stats.select(*(F.round(c, 6).alias(c) for c in stats.columns))


@query()
def linkage_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_documents(table(spark, sf_dir, "eval_items"), "item_id", "text")["merges"]


@query()
def cophenetic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.scores(cluster_documents(table(spark, sf_dir, "eval_items"), "item_id", "text")["merges"])


@query()
def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.best_method(cluster_documents(table(spark, sf_dir, "eval_items"), "item_id", "text")["merges"])


@query()
def flat_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.flat_clusters(cluster_documents(table(spark, sf_dir, "eval_items"), "item_id", "text")["merges"])


_SETS = "(select *, (item_id - 1) // 3 as s from eval_items)"
_TRIPLES = (
    f"with w as materialized (select s, item_id, case when length(w) > 4 then regexp_replace(w, '{_STEM_RE}', '\\1') else w end as term from (select s, item_id, unnest({_ITEM_RAW}) as w from {_SETS}) where length(w) >= 3 and w not in ({_quoted(sorted(CLUSTER_STOP_WORDS))})),"
    f" i as (select s, term, ln((n + 1) / (count(distinct item_id) + 1)::double) + 1 as idf from w join (select s, count(*) as n from {_SETS} group by 1) using (s) group by s, term, n),"
    " v as materialized (select s, item_id, term, k / n * idf as w from (select s, item_id, term, count(*)::double as k, sum(count(*)) over (partition by item_id) as n from w group by 1, 2, 3) join i using (s, term)), q as (select item_id, sqrt(sum(w * w)) as l from v group by 1),"
    f" d as (select a.s, a.item_id as id_a, b.item_id as id_b, 1 - greatest(-1, least(1, coalesce(dot, 0))) as d from {_SETS} a join {_SETS} b on a.s = b.s and a.item_id < b.item_id"
    " left join (select x.item_id as ia, y.item_id as ib, sum(x.w / qx.l * y.w / qy.l) as dot from v x join v y on x.s = y.s and x.term = y.term and x.item_id < y.item_id join q qx on qx.item_id = x.item_id join q qy on qy.item_id = y.item_id group by 1, 2) on ia = a.item_id and ib = b.item_id),"
    " t as (select s, list(d order by id_a, id_b) as ds from d group by 1 having count(*) = 3), f as (select s, ds, list_min(ds) as m, list_position(ds, list_min(ds)) as p from t),"
    " g as (select s, ds, m, p, ds[case when p = 1 then 2 else 1 end] as x, ds[case when p = 3 then 2 else 3 end] as y from f),"
    " h as (select s, ds, m, p, unnest(['complete', 'average', 'ward']) as method, unnest([greatest(x, y), (x + y) / 2, sqrt(greatest((2 * x * x + 2 * y * y - m * m) / 3, 0))]) as h0 from g), r as (select *, case when h0 >= m then h0 else m + 1e-10 end as h from h)"
)


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items").withColumn("s", F.floor((F.col("item_id") - 1) / 3))
    return cluster_documents(items, "item_id", "text", "s")["merges"]


@query(
    _TRIPLES
    + " select s as set_id, method, 0 as step, case p when 3 then 1 else 0 end as a, case p when 1 then 1 else 2 end as b, round(m, 6) as dist, 2 as size from r union all select s, method, 1, case p when 1 then 2 when 2 then 1 else 0 end, 3, round(h, 6), 3 from r"
)
def linkage_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three neighbouring evaluation texts as a set of its own, whose linkage has a closed form."""
    return _triples(spark, sf_dir).select("set_id", "method", "step", "a", "b", F.round("dist", 6).alias("dist"), "size")


@query(
    _TRIPLES
    + " select s as set_id, method, coalesce(round((select case when isfinite(corr(u.x, u.y)) then corr(u.x, u.y) else 0 end from (select unnest(ds) as x, unnest(list_transform(range(1, 4), lambda k: case when k = p then m else h end)) as y) u), 6), 0) as cophenetic from r"
)
def cophenetic_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.scores(_triples(spark, sf_dir)).select("set_id", "method", F.round("cophenetic", 6).alias("cophenetic"))


# --- events ----------------------------------------------------------------------------------------------------------------------


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_counts(table(spark, sf_dir, "events"))


@query(
    "select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from (select *, sum(s) over (partition by user_id order by ts, event_id) as g from"
    " (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as s from events)) group by user_id, g"
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_counts(table(spark, sf_dir, "events"))


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def event_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream over the table's files, whose whole state is written after its last batch."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    target = scratch_path(spark)
    # a stream's event time has a zone; the table's has none
    counts = window_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    for_each_batch(counts, lambda batch, _: batch.write.mode("overwrite").parquet(target), scratch_path(spark), "complete").awaitTermination()
    return spark.read.schema(counts.schema).parquet(target)
