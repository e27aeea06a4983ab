import json

import pytest
from pyspark.sql import functions as F

from webloom import schemas
from webloom.operators import articles, frontier, history, search
from webloom.plans import crawl
from webloom.sources import archive, legacy, settings
from webloom.sources import pages as page_sources

TASK = "url string, priority int, depth long, discovered_from string"


def empty(spark):
    return spark.createDataFrame([], schemas.FRONTIER)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_enqueue_keeps_status_and_merges(spark):
    state = frontier.enqueue(empty(spark), spark.createDataFrame([("http://a.com/x", 0, 3, None), ("http://a.com/x", 10, 5, "p"), ("http://a.com/y?page=2", 0, 0, None)], TASK))
    assert rows(state, "url", "priority", "depth", "status", "article_url") == [("http://a.com/x", 10, 3, "pending", "http://a.com/x"), ("http://a.com/y?page=2", 0, 0, "pending", "http://a.com/y")]
    state = frontier.mark(state, spark.createDataFrame([("http://a.com/x",)], "url string"))
    again = spark.createDataFrame([("http://a.com/x", 0, 1, "q")], TASK)
    assert rows(frontier.enqueue(state, again).where("url like '%x'"), "priority", "depth", "status") == [(10, 1, "complete")]
    assert rows(frontier.enqueue(state, again, force=True).where("url like '%x'"), "priority", "depth", "status") == [(0, 1, "complete")]


def test_claim_orders_and_recovers(spark):
    tasks = spark.createDataFrame([("http://a.com/1", 0, 0, None), ("http://a.com/2", 10, 3, None), ("http://a.com/3", 10, 1, None)], TASK)
    state = frontier.claim(frontier.enqueue(empty(spark), tasks), 2, 99)
    assert rows(state.where("status = 'in_progress'"), "url", "claimed_at") == [("http://a.com/2", 99), ("http://a.com/3", 99)]
    assert rows(frontier.progress(state), "fetched", "pending", "total") == [(0, 3, 3)]
    assert rows(frontier.reset(state), "status", "priority") == [("pending", 0)] * 3


def test_crawlable(spark):
    links = spark.createDataFrame([("http://a.com/x",), ("ftp://a.com/x",), ("http://b.com/",), ("http://sub.a.com/",), ("https://a.com/private/y",)], "url string")
    domains = spark.createDataFrame([("a.com",)], "domain string")
    robots = spark.createDataFrame([("a.com", "User-agent: *\nDisallow: /private")], "domain string, txt string")
    assert rows(frontier.crawlable(links, domains), "url") == [("http://a.com/x",), ("https://a.com/private/y",)]
    assert rows(frontier.crawlable(links, domains, robots), "url") == [("http://a.com/x",)]


@pytest.mark.parametrize("txt,path,want", [(None, "/x", True), ("User-agent: *\nDisallow: /", "/x", False), ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", True), ("User-agent: other\nDisallow: /", "/x", True), ("User-agent: webloom\nAllow: /\nUser-agent: *\nDisallow: /", "/x", True), ("User-agent: *\nDisallow: /*.html$", "/a.html", False), ("User-agent: *\nDisallow: /*.html$", "/a.html?x", True), ("<html>not robots</html>", "/x", True)])
def test_robots(txt, path, want):
    assert frontier.robots_allows(txt, "webloom/1.0", path) is want


def test_article_merge(spark):
    pages = spark.createDataFrame([("http://a.com/s?page=2", 5, "two", ["http://a.com/s?page=3"], "T2"), ("http://a.com/s", 5, "one", [], "T1"), ("http://a.com/s?page=1", 5, "dup", [], "TD")], "url string, fetch_time long, text string, links array<string>, title string")
    merged = articles.merge(pages)
    got = merged.first()
    assert [(p["page"], p["text"]) for p in got["pages"]] == [(1, "one"), (2, "two")]
    assert (got["title"], got["task_url"]) == ("T1", "http://a.com/s")
    assert articles.complete(merged).first()["done"] is False


def test_gate(spark):
    schema = "pages array<struct<page:long,text:string>>"
    cases = [([(2, "b" * 5000), (1, "a" * 5000)], "a" * 5000 + "b" * 5000), ([(1, "short")], None), ([(1, None)], None), ([], ""), ([(1, "é" * 2500)], "é" * 2500)]
    for value, want in cases:
        assert spark.createDataFrame([(value,)], schema).select(articles.indexable("pages").alias("r")).first()["r"] == want


SNAP = "url string, fetch_time long, pages array<struct<page:long,text:string>>, links array<string>"


def test_history(spark):
    a, b = [(1, "one")], [(1, "two")]
    snaps = spark.createDataFrame([("u", 1, a, ["http://x.com/?page=1"]), ("u", 2, a, []), ("u", 3, b, ["http://x.com/?page=2"]), ("u", 4, [(1, "two"), (2, "")], [])], SNAP)
    kept = history.compacted(snaps)
    assert rows(kept, "fetch_time", "is_current") == [(2, False), (4, True)]
    with_deltas = {r["fetch_time"]: r for r in history.with_deltas(kept).collect()}
    back = history.restored([x.asDict() for x in with_deltas[4]["pages"]], [[x.asDict() for x in with_deltas[2]["deltas"]]])
    assert back == [[{"page": 1, "text": "one"}]]
    assert history.history(snaps).first()["history"] == [4, 3, 2, 1]
    assert history.all_links(snaps).first()["all_links"] == ["http://x.com"]
    assert rows(history.late(snaps.where("fetch_time = 2"), snaps), "fetch_time") == [(2,)]
    merged = history.merge_into_archive(kept.select(*snaps.columns), spark.createDataFrame([("u", 3, a, []), ("u", 9, b, []), ("v", 1, a, [])], SNAP))
    assert rows(merged, "url", "fetch_time", "is_current") == [("u", 2, False), ("u", 9, True), ("v", 1, True)]


def test_distance(spark):
    df = spark.createDataFrame([([(1, "a"), (3, "c")], [(1, "a")])], "a array<struct<page:long,text:string>>, b array<struct<page:long,text:string>>")
    got = df.select(history.page_distances(F.col("a"), F.col("b")).alias("d"), history.max_distance(F.col("a"), F.col("b")).alias("m")).first()
    assert [tuple(x) for x in got["d"]] == [(1, 0), (2, 0), (3, 100)] and got["m"] == 100


def test_archive_round_trip(spark, tmp_path):
    doc = {"task": {"url": "http://a.com/x", "url_id": 1, "depth": 0, "priority": 10}, "current": {"content_markdown": [{"content": {"Literal": "hi"}, "page": 1}, {"content": "None", "page": 2}], "metadata": {"status_code": 200, "fetch_time": 7, "authors": ["A", "B"]}}, "historical_snapshots": [{"content_markdown": [{"content": {"Delta": "xx"}, "page": 1}], "metadata": {"status_code": 200, "fetch_time": 3}}], "all_links": []}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"task": {"url": "http://b.com/"}}))
    (tmp_path / "c.json").write_text("broken")
    (tmp_path / "d.txt").write_text("{}")
    files = archive.scan(spark, str(tmp_path))
    assert rows(archive.index(files), "url", "authors") == [("http://a.com/x", "A,B"), ("http://b.com/", "")]
    typed = archive.typed(files)
    assert typed.count() == 1
    snaps = archive.snapshots(typed).orderBy("fetch_time").collect()
    assert [(s["fetch_time"], s["is_current"], [(p["page"], p["kind"], p["text"]) for p in s["pages"]]) for s in snaps] == [(3, False, [(1, "Delta", None)]), (7, True, [(1, "Literal", "hi"), (2, "None", None)])]
    assert typed.select(archive.oldest_fetch_time()).first()[0] == 3
    archive.write_index(archive.index(files), str(tmp_path / "out"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out")).count() == 2
    written = archive.export(spark.createDataFrame([("p/q.json", "{}")], "target string, value string"), f"file://{tmp_path}/export").collect()
    assert written[0]["bytes"] == 2 and (tmp_path / "export/p/q.json").read_text() == "{}"


def test_path_collisions(spark):
    df = spark.createDataFrame([("x.json", "a"), ("x.json", "b"), ("x.json", "a"), ("y.json", "a")], "path string, url string")
    assert rows(archive.collisions(df, "path", "url"), "url", "target") == [("a", "x.json"), ("a", "x.json"), ("a", "y.json"), ("b", "x_1.json")]


def test_body_limit(spark):
    df = spark.createDataFrame([(b"abc",), (b"abcd",), (b"\xff",), (b"",)], "b binary")
    got = df.select(page_sources.limited("b", 3).alias("r")).select("r.text", "r.error").collect()
    assert [tuple(r) for r in got] == [("abc", None), (None, "too_large"), (None, "utf8"), ("", None)]


def test_legacy():
    text = "\n \t \nThe Grey Heron\n\nby R. Marsh\n\nStory URL: https://tales.example.org/heron\nDESC: a bird\n by the water\n at dusk\nA: 1\n\nIt stood still.\nThen it flew.\n"
    got = legacy.parse_story(text)
    assert (got["title"], got["author"], got["meta"]["DESC"], got["meta"]["A"]) == ("The Grey Heron", "R. Marsh", "a bird by the water at dusk", "1")
    assert got["body"] == "It stood still.\nThen it flew.\n"
    assert legacy.parse_story("no blank line first") is None and legacy.parse_story(None) is None


def test_settings(tmp_path):
    file = tmp_path / "c.yaml"
    file.write_text("workers: 4\nseed_urls: [http://a.com]\nhosts: [{name: a, domains: [a.com]}]\n")
    got = settings.layered(settings.Crawl, str(file), workers=8)
    assert (got.workers, got.seed_urls, got.hosts[0].domains, got.user_agent) == (8, ("http://a.com",), ("a.com",), "webloom")
    with pytest.raises(ValueError):
        settings.layered(settings.Search, nonsense=1)


def test_search(spark):
    points = spark.createDataFrame([("a", [1.0, 0.0], "x" * 250, 0, "s1"), ("b", [0.6, 0.8], None, 0, "s2"), ("c", [0.0, 0.0], "z", 0, None)], schemas.POINT)
    top = search.top_k(points, [1.0, 0.0], 5)
    assert rows(top, "id") == [("a",), ("b",)]
    assert [(r["rank"], len(r["text"])) for r in search.display(top).orderBy("rank").collect()] == [(1, 203), (2, 0)]
    assert rows(search.top_k(points, [1.0, 0.0], 5, where=search.source_filter("2")), "id") == [("b",)]
    assert search.upsert(points, points.where("id = 'a'").withColumn("text", F.lit("new"))).count() == 3


def test_crawl_to_search(spark):
    web = spark.createDataFrame([("http://a.com/", '<title>A</title><p>alpha beta</p><a href="/b?utm_x=1">b</a><a href="http://off.com/">o</a>'), ("http://a.com/b", "<title>B</title><p>gamma</p>")], "url string, body string")
    domains = spark.createDataFrame([("a.com",)], "domain string")
    state = frontier.enqueue(empty(spark), page_sources.seeds(spark, ["http://A.com#x", "nonsense"]), force=True)
    state, pages = crawl.crawl_round(state, web, domains, 5, 100)
    assert rows(state, "url", "status", "depth") == [("http://a.com/", "complete", 0), ("http://a.com/b", "pending", 1)]
    table = crawl.points(articles.merge(pages), least_bytes=1)
    assert crawl.find(table, "alpha beta").first()["rank"] == 1


def test_stream_waits_for_all_pages(spark, tmp_path):
    from webloom.streaming import articles as streams

    schema = "url string, fetch_time long, text string, links array<string>, title string"
    src = str(tmp_path / "in")
    first = [("http://a.com/s", 1, "one", ["http://a.com/s?page=2"], "T"), ("http://b.com/", 1, "b", [], "B")]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: streams.assemble(spark.readStream.schema(schema).parquet(src))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    assert rows(streams.run_to_table(stream(), out, check), "article_url") == [("http://b.com",)]
    spark.createDataFrame([("http://a.com/s?page=2", 1, "two", [], "T2")], schema).coalesce(1).write.mode("append").parquet(src)
    assert rows(streams.run_to_table(stream(), out, check), "article_url", "n_pages", "title") == [("http://a.com/s", 2, "T"), ("http://b.com", 1, "B")]


def test_tables(spark):
    from webloom.sources import tables

    for name in tables.TABLES:
        assert tables.ensure(spark, name, f"webloom_test_{name}").count() == 0
        assert tables.ensure(spark, name, f"webloom_test_{name}").count() == 0
        spark.sql(f"DROP TABLE webloom_test_{name}")


def test_fetch_and_rounds(spark):
    web = {"http://a.com/": b'<a href="/b">b</a>', "http://a.com/b": b"<a href='/c'>c</a>"}
    got = page_sources.fetch(spark.createDataFrame([("http://a.com/",), ("http://x.com/",)], "url string"), lambda u: web[u], 5)
    assert rows(got, "url", "status_code", "fetch_time") == [("http://a.com/", 200, 5)]
    source = spark.createDataFrame([(k, v) for k, v in web.items()], "url string, body binary")
    state, pages = crawl.run(spark, page_sources.seeds(spark, ["http://a.com"]), source, spark.createDataFrame([("a.com",)], "domain string"), 3, 5, 100)
    assert rows(state, "url", "status") == [("http://a.com/", "complete"), ("http://a.com/b", "complete"), ("http://a.com/c", "in_progress")]
    assert rows(pages, "url", "fetch_time") == [("http://a.com/", 100), ("http://a.com/b", 101)]


def test_stored_tables_can_be_forgotten(spark):
    from webloom.session import forget, stored

    forget(spark)
    table = stored(spark.range(5), "numbers")
    files = table.inputFiles()
    assert table.count() == 5 and files and forget(spark) == 1 and forget(spark) == 0
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
