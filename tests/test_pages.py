"""Page dumps: decoding, flattening, page runs, country audit."""

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from rolegrid import schemas
from rolegrid.sources import pages as P
from rolegrid.sources.archive import read_archive
from rolegrid.sources.feeds import FeedRegistry, error_text, union_feeds

BASE = "https://board.example"


def job(i, **more):
    row = dict(id=i, name="Dev", companyName="PT X", company={"code": "x"}, slug="dev", description="<p>d</p>",
               qualifications="<p>q</p>", baseSalary=5, maximumSalary=9, salaryCurrency="IDR",
               salaryInterval="month", salaryShown=True, isHybrid=False, isWorkFromHome=False,
               activationDate="2026-01-02T03:04:05.123456+07:00",
               googleLocation={"addressComponents": {"city": "Solo", "country": "Indonesia"}})
    row.update(more)
    return row


def html(count, jobs):
    payload = json.dumps({"props": {"pageProps": {"count": count, "jobs": jobs}}})
    return f'<html><script>x</script><script id="__NEXT_DATA__" type="application/json">{payload}</script></html>'


def parsed(spark, pages):
    rows = [(k, p, h) for k, p, h in pages]
    return P.parse_pages(spark.createDataFrame(rows, "keyword string, page int, html string"))


def test_postings_of_a_page(spark):
    jobs = [
        job(1),
        job(2, salaryShown=False, isHybrid=True, isWorkFromHome=True),
        job(3, baseSalary=None, salaryCurrency=None, salaryInterval=None, isHybrid=True),
        job(4, maximumSalary=None, salaryCurrency="", googleLocation=None, isWorkFromHome=True),
        job(5, baseSalary=None, maximumSalary=None, activationDate="soon",
            googleLocation={"addressComponents": {"city": "", "country": "Indonesia"}}),
        job(6, googleLocation={"addressComponents": {"city": "Solo", "country": ""}}, description=" ", qualifications=""),
    ]
    rows = P.raw_postings(parsed(spark, [("k", 1, html(6, jobs))]), BASE, "keyword", "page").orderBy("pos").collect()
    assert [r.salary_raw for r in rows] == ["IDR 5 - 9/month", "", "up to IDR 9", "from IDR 5/month", "", "IDR 5 - 9/month"]
    assert [r.location for r in rows] == ["Solo, Indonesia", "Solo, Indonesia (Remote)", "Solo, Indonesia (Hybrid)",
                                          "", "Indonesia", "Solo"]
    assert rows[0].source_url == BASE + "/c/x/jobs/1/dev" and rows[0].source_job_id == "1"
    assert rows[0].description == "<p>d</p>\n\n<p>q</p>" and rows[5].description == ""
    assert rows[0].posted_at == dt.datetime(2026, 1, 1, 20, 4, 5, 123456) and rows[4].posted_at is None


def test_bad_pages_are_errors_not_empty(spark):
    pages = [("k", 1, "<html></html>"), ("k", 2, html(1, [job(1)])[:-120] + "</script>"),
             ("k", 3, html(0, [])), ("k", 4, '<script id="__NEXT_DATA__">{}</script>'),
             ("k", 5, '<script id="__NEXT_DATA__"></script>')]
    rows = {r.page: r for r in parsed(spark, pages).collect()}
    assert rows[1].error == P.ERR_NO_PAYLOAD and rows[2].error == P.ERR_BAD_PAYLOAD
    assert rows[5].error == P.ERR_BAD_PAYLOAD
    assert rows[3].error is None and rows[3].jobs == [] and rows[4].error is None and rows[4]["count"] == 0
    assert {r.page for r in P.page_errors(parsed(spark, pages)).collect()} == {1, 2, 5}


def test_page_runs(spark):
    def page(total, *ids):
        return html(total, [job(i) for i in ids])
    feeds = {
        "empty": [page(99, 1), page(99), page(99, 3)],
        "repeat": [page(99, 1, 2), page(99, 2), page(99, 4)],
        "overlap": [page(99, 1, 2), page(99, 2, 3), page(99, 4)],
        "total": [page(3, 1, 2), page(3, 3), page(3, 4)],
        "error": [page(99, 1), "<html></html>", page(99, 3)],
        "again": [page(99, 1), page(99, 2), page(99, 1)],
    }
    pages = [(k, i + 1, h) for k, hs in feeds.items() for i, h in enumerate(hs)]
    kept = P.trim_page_runs(parsed(spark, pages)).groupBy("keyword").agg(
        F.sort_array(F.collect_list("page")).alias("p"))
    assert {r.keyword: r.p for r in kept.collect()} == {
        "empty": [1], "repeat": [1], "overlap": [1, 2, 3], "total": [1, 2], "error": [1], "again": [1, 2, 3]}
    # a dump holds what it holds: only a caller's own limit cuts it
    long = parsed(spark, [("k", i, page(999, i)) for i in range(1, 31)])
    assert {n: P.trim_page_runs(long, max_pages=n).count() for n in (None, 2, 30)} == {None: 30, 2: 2, 30: 30}


def test_two_crawls_of_a_keyword_do_not_mix(spark):
    pages = parsed(spark, [("k", i, html(99, [job(i)])) for i in (1, 2)])
    crawls = pages.crossJoin(spark.createDataFrame([(1,), (2,)], "crawl int"))
    kept = P.trim_page_runs(crawls, "crawl", "keyword")
    assert sorted((r.crawl, r.page) for r in kept.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_country_audit(spark):
    place = lambda c: {"addressComponents": {"city": "A", "country": c}}
    jobs = [job(1), job(2, googleLocation=place("Philippines")), job(3, googleLocation=None),
            job(4, googleLocation=place("")), job(5, googleLocation=place("Chile")), job(6, googleLocation=place("Chile"))]
    rows = P.country_audit(parsed(spark, [("k", 1, html(6, jobs)), ("k", 2, html(1, [job(1)]))]), "page").collect()
    assert [(r.page, r.total_jobs, r.wrong_country_jobs, r.countries_seen) for r in rows] == [
        (1, 6, 3, ["Chile", "Philippines"])]


def test_crawl_plan(spark):
    words = spark.createDataFrame([("data engineer", 0), ("a/b", 2), ("qa", 99)], "keyword string, max_pages int")
    plan = P.crawl_plan(words, BASE)
    assert {r.keyword: r.n for r in plan.groupBy("keyword").agg(F.count("*").alias("n")).collect()} == {
        "data engineer": 3, "a/b": 2, "qa": 20}
    urls = {r.url for r in plan.where("page = 1").collect()}
    assert urls == {f"{BASE}/id-ID/job-board/te/{w}/1" for w in ("data%20engineer", "a%2Fb", "qa")}


def test_one_failing_feed_keeps_the_others(spark):
    def broken():
        raise OSError("down")
    rows, errors = union_feeds(spark, {"a": lambda: spark.createDataFrame([("t",)], "title string"), "b": broken})
    assert [(r.title, r.feed) for r in rows.collect()] == [("t", "a")]
    assert [r.error for r in errors.collect()] == ['feed "b": down']
    unreadable = lambda: spark.createDataFrame([("t",)], "title string").select(
        F.raise_error(F.lit("bad file")).cast("string").alias("title"))
    rows, errors = union_feeds(spark, {"a": lambda: spark.createDataFrame([("t",)], "title string"), "c": unreadable})
    assert [r.feed for r in rows.collect()] == ["a"] and [r.feed for r in errors.collect()] == ["c"]
    both = union_feeds(spark, {"y": broken, "x": broken})[1]
    assert error_text(both).first().error == 'feed "x": down\nfeed "y": down'
    assert error_text(both.limit(0)).first().error is None
    rows, errors = union_feeds(spark, {"b": broken})
    assert rows.count() == 0 and errors.count() == 1


def test_an_archive_keeps_what_it_could_read(spark, tmp_path):
    lines = [json.dumps({"id": i, "title": f"Tïtle {i}", "more": [1]}) for i in range(600)]
    (tmp_path / "good.json").write_text("\n".join(lines) + "\n\n", encoding="utf-8")
    (tmp_path / "broken.json").write_text("\n".join([*lines[:300], "{\"id\": 1", *lines[301:]]), encoding="utf-8")
    (tmp_path / "typed.json").write_text("\n".join([lines[0], "{}", "{\"id\": \"x\"}", lines[1]]), encoding="utf-8")
    packed = gzip.compress("\n".join(lines).encode())
    (tmp_path / "cut.json.gz").write_bytes(packed[:len(packed) // 2])
    (tmp_path / "bytes.json").write_bytes(lines[0].encode() + b"\n\xff\xfe\n")
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "empty.json").write_text("")
    rows, errors = read_archive(spark, str(tmp_path), "id long, title string")
    kept = {}
    for r in rows.collect():
        kept.setdefault(r.part, []).append((r.line, r.id, r.title))
    assert kept["good.json"] == [(i + 1, i, f"Tïtle {i}") for i in range(600)]
    assert [k[1] for k in kept["broken.json"]] == list(range(300))
    assert kept["typed.json"] == [(1, 0, "Tïtle 0"), (2, None, None)]
    assert 0 < len(kept["cut.json.gz"]) < 600
    failed = {r.feed: r.error for r in errors.collect()}
    assert set(failed) == {"broken.json", "typed.json", "cut.json.gz", "bytes.json", "list.json"}
    assert failed["broken.json"].startswith("broken.json, line 301: JSONDecodeError")


def test_a_feed_that_breaks_keeps_its_good_part(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"source_url": f"u{i}", "title": "T"}) for i in range(5)) + "\n{")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.RAW_POSTINGS.fields if f.name not in (
        "ingest_seq", "source_id", "posted_at"))
    registry = FeedRegistry({"board": lambda s, pages: read_archive(s, str(tmp_path), columns)})
    rows, error = registry.collect(spark, "board")
    assert rows.count() == 5 and error.startswith("a.json, line ")
