"""Works of the open catalogue: nested records, JSON lines, and its web API as a Spark data source."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from bibflux.functions.let import let
from bibflux.schema import CANONICAL, WORK_DDL, canonical, cleaned

PER_PAGE, TIMEOUT, RETRIES, RETRY_STATUS = 200, 30, 3, (429, 500, 503)
DOI_PREFIXES = r"https?://doi\.org/"


def abstract_text(index: Column) -> Column:
    """The text of an inverted index: words by position, joined by blanks.

    Positions that are no number are skipped; of words on one position the last counts; empty for a null or empty index.
    """
    entries = F.map_entries(index)
    ranked = F.transform(entries, lambda e, i: F.transform(F.filter(e["value"], lambda p: p.try_cast("long").isNotNull()), lambda p: F.struct(p.try_cast("long").alias("p"), i.alias("i"), e["key"].alias("w"))))

    def words(o: Column) -> Column:
        return F.filter(F.transform(o, lambda s, k: F.when(F.coalesce(F.get(o, k + 1)["p"] != s["p"], F.lit(True)), s["w"])), lambda w: w.isNotNull())

    return F.coalesce(F.array_join(let(F.array_sort(F.flatten(ranked)), words), " "), F.lit(""))


def first_country(authorships: Column) -> Column:
    """The first institution's country code that is not empty, in capitals; else empty."""
    codes = F.flatten(F.transform(authorships, lambda a: F.transform(F.coalesce(a["institutions"], F.array()), lambda i: F.upper(F.trim(i["country_code"])))))
    return F.coalesce(F.get(F.filter(codes, lambda c: c.isNotNull() & (c != "")), F.lit(0)), F.lit(""))


def _names(items: Column, get: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(items, get), lambda n: n.isNotNull() & (n != ""))


def map_works(works: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Works as canonical records, after the columns ``keep``; any nested part may be null or empty. Works without a title are dropped."""
    filled = lambda c: F.nullif(c, F.lit(""))
    text = lambda *cs: F.coalesce(*(filled(c) for c in cs), F.lit(""))
    place = F.col("primary_location")
    keywords = _names(F.col("keywords"), lambda k: k["keyword"])
    topics = _names(F.col("topics"), lambda t: t["display_name"])
    has = F.coalesce(F.size(keywords) > 0, F.lit(False))
    rows = works.select(
        *keep,
        text(F.col("title")).alias("title"),
        F.coalesce(F.array_join(_names(F.col("authorships"), lambda a: a["author"]["display_name"]), ", "), F.lit("")).alias("authors"),
        F.coalesce(F.col("publication_year").cast("string"), F.lit("")).alias("year"),
        text(place["source"]["display_name"]).alias("source"),
        F.trim(F.regexp_replace(text(F.col("doi")), DOI_PREFIXES, "")).alias("doi"),
        abstract_text(F.col("abstract_inverted_index")).alias("abstract"),
        text(F.col("type")).alias("document_type"),
        text(place["landing_page_url"], F.col("open_access")["oa_url"]).alias("url"),
        text(place["source"]["issn_l"], F.get(place["source"]["issn"], F.lit(0))).alias("issn"),
        F.coalesce(F.array_join(F.when(has, keywords).otherwise(topics), ", "), F.lit("")).alias("keywords"),
        first_country(F.col("authorships")).alias("country"),
    )
    if not keep:
        return canonical(rows, "OpenAlex")
    kept = rows.select(*keep, F.struct(*rows.columns[len(keep) :]).alias("_r"))
    return kept.select(*keep, *(cleaned(F.col(f"_r.{c}")).alias(c) for c in CANONICAL[:-1]), F.lit("OpenAlex").alias("source_db")).filter("title <> ''")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Works of JSON lines; blank and malformed lines are skipped, a missing path gives an empty table."""
    try:
        return spark.read.schema(WORK_DDL).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], WORK_DDL)
        raise


def read_jsonl_slice(spark: SparkSession, path: str, offset: int, limit: int, schema: str, order: str) -> tuple[DataFrame, int]:
    """Rows ``offset`` to ``offset + limit`` by the column ``order``, and the number of all rows."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(order).offset(offset).limit(limit), rows.count()


def fetch_page(base_url: str, params: dict[str, str], opener=urllib.request.urlopen, pause: float = 2.0) -> dict:
    """One page of the API; tries again after 429, 500 and 503, waiting longer each time."""
    url = f"{base_url}?{urllib.parse.urlencode(params)}"
    for attempt in range(1, RETRIES + 1):
        try:
            with opener(url, timeout=TIMEOUT) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUS or attempt == RETRIES:
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == RETRIES:
                raise
        time.sleep(pause * attempt)
    raise AssertionError


def _pages(base_url: str, query: str, max_results: int, filters: str = "", mail: str = "", opener=urllib.request.urlopen, pause: float = 2.0, cursor: str = "*") -> Iterator[tuple[list[dict], int, int, str | None]]:
    """(works, works so far, works in all, next cursor) page by page from a cursor on; a page is never larger than what is still wanted."""
    done = 0
    while cursor and done < max_results:
        params = {"search": query, "per-page": str(min(PER_PAGE, max_results - done)), "cursor": cursor}
        params |= {k: v for k, v in (("filter", filters), ("mailto", mail)) if v}
        page = fetch_page(base_url, params, opener, pause)
        works = page.get("results") or []
        if not works:
            return
        works = works[: max_results - done]
        done += len(works)
        meta = page.get("meta") or {}
        cursor = meta.get("next_cursor")
        yield works, done, int(meta.get("count") or 0), cursor


def pages(base_url: str, query: str, max_results: int, filters: str = "", mail: str = "", opener=urllib.request.urlopen, pause: float = 2.0) -> Iterator[tuple[list[dict], int, int]]:
    """(works, works so far, works in all) page by page along the cursor."""
    for works, done, total, _ in _pages(base_url, query, max_results, filters, mail, opener, pause):
        yield works, done, total


class _WorksReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        # a cursor can only be followed in order: one partition per filter
        return [InputPartition(f) for f in self.options.get("filters", "").split("|")]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        o = self.options
        for works, _, _ in pages(o["url"], o.get("query", ""), int(o.get("max_results", "1000")), partition.value, o.get("mail", ""), pause=float(o.get("pause", "2"))):
            for work in works:
                yield (json.dumps(work, ensure_ascii=False),)


class _WorksStream(SimpleDataSourceStreamReader):
    """One page of the API per micro-batch; the offset is the cursor with the number of works so far, so a query that is started again goes on where it stopped."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"cursor": "*", "done": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        o = self.options
        left = int(o.get("max_results", "1000")) - start["done"]
        for works, _, _, cursor in _pages(o["url"], o.get("query", ""), left, o.get("filters", ""), o.get("mail", ""), pause=float(o.get("pause", "2")), cursor=start["cursor"]):
            return iter([(json.dumps(w, ensure_ascii=False),) for w in works]), {"cursor": cursor or "", "done": start["done"] + len(works)}
        return iter([]), start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        return self.read(start)[0] if start != end else iter([])


class WorksApi(DataSource):
    """``spark.read.format("works_api").options(url=…, query=…, filters="a:1|a:2", max_results=…)``: one JSON text per work.

    The filters go to the API, each to a task of its own; ``max_results`` bounds each of them. ``spark.readStream`` with the same options
    gives a page per micro-batch.
    """

    @classmethod
    def name(cls) -> str:
        return "works_api"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _WorksReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _WorksStream(self.options)


def read_api(spark: SparkSession, **options: str) -> DataFrame:
    """Works of the API with their nested schema."""
    spark.dataSource.register(WorksApi)
    raw = spark.read.format("works_api").options(**options).load()
    return raw.select(F.from_json("value", WORK_DDL).alias("w")).select("w.*")


def stream_api(spark: SparkSession, **options: str) -> DataFrame:
    """Works of the API as a stream, a page per micro-batch."""
    spark.dataSource.register(WorksApi)
    raw = spark.readStream.format("works_api").options(**options).load()
    return raw.select(F.from_json("value", WORK_DDL).alias("w")).select("w.*")


def save_jsonl(raw: DataFrame, path: str, overwrite: bool = False) -> None:
    """Appends (or writes anew) fetched works as JSON lines."""
    raw.write.mode("overwrite" if overwrite else "append").text(path)
