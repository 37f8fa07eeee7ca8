import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from bibflux.plans.pipelines import terms_report, unify_sources
from bibflux.schema import CANONICAL
from bibflux.sources import exports, works
from bibflux.streaming import ingest
from tests.conftest import rows

FULL = {
    "title": "A work", "publication_year": 2024, "doi": "https://doi.org/10.1/x", "type": "article",
    "authorships": [{"author": {"display_name": "Ann"}, "institutions": [{"country_code": ""}]}, {"author": {"display_name": ""}, "institutions": [{"country_code": "co"}]}, {"author": {"display_name": "Bo"}}],
    "primary_location": {"source": {"display_name": "J", "issn_l": None, "issn": ["1-2"]}, "landing_page_url": ""}, "open_access": {"oa_url": "u"},
    "abstract_inverted_index": {"AI": [0, 4], "is": [1], "great": [2], "and": [3], "awesome": [5]}, "keywords": [], "topics": [{"display_name": "T1"}, {"display_name": "T2"}],
}


def test_exports(spark, tmp_path):
    acm = tmp_path / "acm.csv"
    acm.write_text('﻿Title , Author,Year,Abstract\n"A ""quoted"" title",X,2020,"two\nlines"\n,Y,2021,z\nnan,Y,2021,z\nB,nan,,\n', encoding="utf-8")
    got = exports.read_export(spark, str(acm), "ACM")
    assert got.columns == list(CANONICAL)
    assert [(r.title, r.authors, r.abstract, r.source_db) for r in got.orderBy("title").collect()] == [('A "quoted" title', "X", "two\nlines", "ACM"), ("B", "", "", "ACM")]
    sd = tmp_path / "sd.csv"
    sd.write_text("Title,Author Keywords,Index Keywords\nT,B; a,c;A\nU,,x\n", encoding="utf-8")
    assert [r.keywords for r in exports.read_export(spark, str(sd), "ScienceDirect").orderBy("title").collect()] == ["a; b; c", "x"]
    eb = tmp_path / "eb.csv"
    eb.write_text("title,publicationDate,subjects,abstract,authorLocations\nT,20260326,AI ; Pakistan,\"x\",\nU,Mar2025,,Japanese firms,none\n", encoding="utf-8")
    assert [(r.year, r.country) for r in exports.read_export(spark, str(eb), "EBSCO").orderBy("title").collect()] == [("2026", "Pakistan"), ("2025", "Japan")]
    with pytest.raises(FileNotFoundError):
        exports.read_export(spark, str(tmp_path / "none.csv"), "ACM")
    assert exports.read_export(spark, str(tmp_path / "none.csv"), "ACM", tolerant=True).count() == 0
    exports.write_csv(got, str(tmp_path / "out"))
    assert rows(exports.read_unified(spark, str(tmp_path / "out"))) == rows(got)
    assert exports.csv_bytes(got).startswith("﻿title".encode())


def test_works(spark, tmp_path):
    path = tmp_path / "w.jsonl"
    minimal = {"title": "only"}
    nulls = {k: None for k in FULL} | {"title": "nulls"}
    odd = {"title": "odd", "abstract_inverted_index": {"word": ["bad"], "a": [1], "b": [1]}}
    path.write_text("\n".join([json.dumps(FULL), "", "{broken", json.dumps(minimal), json.dumps(nulls), json.dumps({"title": None}), json.dumps(odd)]))
    got = {r.title: r for r in works.map_works(works.read_jsonl(spark, str(path))).collect()}
    a = got["A work"]
    assert (a.authors, a.year, a.doi, a.source, a.url, a.issn, a.keywords, a.country, a.abstract) == ("Ann, Bo", "2024", "10.1/x", "J", "u", "1-2", "T1, T2", "CO", "AI is great and AI awesome")
    assert set(got) == {"A work", "only", "nulls", "odd"} and got["odd"].abstract == "b" and got["nulls"].country == ""
    assert works.read_jsonl(spark, str(tmp_path / "none.jsonl")).count() == 0
    lines = tmp_path / "i.jsonl"
    lines.write_text("\n".join(json.dumps({"i": i}) for i in range(10)))
    part, total = works.read_jsonl_slice(spark, str(lines), 2, 3, "i int", "i")
    assert [r.i for r in part.collect()] == [2, 3, 4] and total == 10
    works.save_jsonl(spark.createDataFrame([(json.dumps(FULL),)], "value string"), str(tmp_path / "saved"))
    assert works.read_jsonl(spark, str(tmp_path / "saved")).count() == 1


def test_pages_follow_the_cursor_and_try_again():
    calls = []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) == 1:
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        n = 2 if "per-page=3" in url else 1
        return io.BytesIO(json.dumps({"results": [{"i": 1}] * n, "meta": {"count": 9, "next_cursor": "c2"}}).encode())

    got = list(works.pages("http://x", "q", 3, "a:1", opener=opener, pause=0))
    assert [(len(w), done, total) for w, done, total in got] == [(2, 2, 9), (1, 3, 9)]
    assert "per-page=1" in calls[-1] and "cursor=c2" in calls[-1] and "filter=a%3A1" in calls[-1]
    with pytest.raises(urllib.error.HTTPError):
        works.fetch_page("http://x", {}, lambda u, timeout: (_ for _ in ()).throw(urllib.error.HTTPError(u, 404, "", {}, None)), 0)


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.jsonl").write_text(json.dumps(FULL))
    for _ in range(2):
        ingest.append_records(ingest.stream_works(spark, str(source)), str(out), str(tmp_path / "cp")).awaitTermination()
        (source / "b.jsonl").write_text(json.dumps(FULL | {"title": "Second"}))
    assert {r.title for r in spark.read.parquet(str(out)).collect()} == {"A work", "Second"}


def test_windows(spark):
    e = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:10:00"), (1, "2024-01-01 12:00:00"), (2, "2024-01-02 10:00:00")], "user_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in ingest.session_counts(e).collect()) == [1, 1, 2]
    assert sorted(r.n for r in ingest.window_counts(e, by="user_id").collect()) == [1, 3]
    r = spark.createDataFrame([("A b", 1), ("a B!", 2), ("", 3)], "title string, x int")
    assert ingest.distinct_records(r, "x").count() == 1


def test_pipelines(spark):
    a = spark.createDataFrame([("A long enough title of a record", "ACM")], "title string, source_db string")
    kept, lost = unify_sources(spark, [a, a])
    assert (kept.count(), lost.count()) == (1, 1)
    assert unify_sources(spark, [])[0].count() == 0
    texts = spark.createDataFrame([("prompting helps tokens",), ("prompting needs tokens",), ("nothing here",)], "abstract string")
    report = terms_report(texts)
    assert report["coverage"].first().n_category_docs == 2 and "tokens" in {r.term for r in report["new_terms"].collect()}


def test_api_as_table_and_stream(spark, tmp_path):
    """A server of five works, two to a page at most; one answer in between is busy."""
    import http.server
    import threading
    import urllib.parse

    asked = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            asked.append(q)
            if len(asked) == 2:
                self.send_response(503)
                self.end_headers()
                return
            at = 0 if q["cursor"] == "*" else int(q["cursor"])
            n = min(2, int(q["per-page"]), 5 - at)
            body = json.dumps({"results": [{"title": f"Work {at + k}"} for k in range(n)], "meta": {"count": 5, "next_cursor": str(at + n) if at + n < 5 else None}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        options = {"url": f"http://127.0.0.1:{server.server_port}", "query": "x", "pause": "0"}
        assert sorted(r.title for r in works.read_api(spark, **options).collect()) == [f"Work {k}" for k in range(5)]
        assert works.read_api(spark, **options, max_results="3").count() == 3 and asked[-1]["per-page"] == "1"
        out = str(tmp_path / "out")
        titles = works.stream_api(spark, **options, max_results="4").select("title")
        query = titles.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(out)
        try:
            for _ in range(60):
                query.awaitTermination(0.5)
                if spark.read.schema("title string").parquet(out).count() >= 4:
                    break
        finally:
            query.stop()
        assert sorted(r.title for r in spark.read.parquet(out).collect()) == [f"Work {k}" for k in range(4)]
    finally:
        server.shutdown()


def test_csv_chunks(spark):
    df = spark.createDataFrame([(k, 'a "quoted", text\n' if k % 2 else None) for k in range(90_000)], "k int, t string")
    pieces = list(exports.csv_chunks(df))
    whole = b"".join(pieces).decode("utf-8-sig")
    assert len(pieces) > 1 and whole.count("\ufeff") == 0
    import csv

    got = list(csv.reader(io.StringIO(whole)))
    assert got[0] == ["k", "t"] and len(got) == 90_001 and got[2] == ["1", 'a "quoted", text\n'] and got[1] == ["0", ""]
    assert exports.csv_bytes(df.limit(0)) == "\ufeffk,t\n".encode()
