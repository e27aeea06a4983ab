"""Jobs from folders to folders, streams into the archive, page accessors, and the encoder of a local model folder."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom import schemas
from webloom.functions import text
from webloom.operators import articles, bert, frontier, history, search
from webloom.plans import crawl, jobs
from webloom.sources import archive
from webloom.streaming import articles as streams

LONG = "prose of some length. " * 300


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def _document(url, *contents):
    pages = [{"content": c, "page": i + 1} for i, c in enumerate(contents)]
    return json.dumps({"task": {"url": url, "url_id": 1, "depth": 0, "priority": 0}, "current": {"content_markdown": pages, "metadata": {"status_code": 200, "fetch_time": 7, "authors": ["A"]}}, "historical_snapshots": [], "all_links": ["http://b.com/", "http://a.com/", "http://b.com/"], "history": [7]})


def test_index_jobs(spark, tmp_path):
    src = tmp_path / "in"
    (src / "deep").mkdir(parents=True)
    (src / "a.json").write_text(_document("http://a.com/x", {"Literal": LONG}))
    (src / "deep" / "b.txt").write_text(_document("http://b.com/x", {"Literal": LONG}, {"Literal": LONG}))
    (src / "short.json").write_text(_document("http://c.com/x", {"Literal": "short"}))
    (src / "delta.json").write_text(_document("http://d.com/x", {"Literal": LONG}, {"Delta": "xx"}))
    (src / "none.json").write_text("nothing")
    assert rows(jobs.index_archive(spark, str(src), str(tmp_path / "out")), "url", "authors") == [("http://a.com/x", "A"), ("http://c.com/x", "A"), ("http://d.com/x", "A")]
    points = jobs.index_points(spark, str(src))
    assert {r["source"] for r in points.collect()} == {"http://a.com/x", "http://b.com/x"}
    again = jobs.index_points(spark, str(src), points)
    assert rows(again, "id", "chunk_id") == rows(points, "id", "chunk_id")


@pytest.mark.parametrize("remove", [False, True])
def test_legacy_job(spark, tmp_path, remove):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "deep er").mkdir(parents=True)
    (src / "one.json").write_text(json.dumps({"_id": "1", "story_id": "s", "page": 3, "uri": "http://a.com/x", "story": ["p", "q"], "keywords": ["k"], "title": "T", "author": "U"}))
    (src / "deep er" / "two.story").write_text("\nTwo\n\nby U\n\nStory URL: http://b.com/y\nTAGS: One\n\nBody.\n")
    (src / "other.txt").write_text("no story")
    written = jobs.convert_legacy(spark, f"file://{src}", f"file://{out}", 1_700_000_000, remove_sources=remove)
    assert written.count() == 2
    got = archive.typed(archive.scan(spark, str(out)))
    assert rows(got.select(archive.url().alias("url")), "url") == [("http://a.com/x",), ("http://b.com/y",)]
    snaps = archive.snapshots(got)
    assert rows(snaps.select("url", F.get("pages", 0)["text"].alias("t")), "url", "t") == [("http://a.com/x", "p\n\nq"), ("http://b.com/y", "Body.\n")]
    assert sorted(p.name for p in src.rglob("*") if p.is_file()) == (["other.txt"] if remove else ["one.json", "other.txt", "two.story"])


def test_robots_job(spark):
    files = {"http://a.com/robots.txt": b"User-agent: *\nDisallow: /p", "http://b.com/robots.txt": b"\xff\xfe", "http://d.com/robots.txt": b"<html>"}
    domains = spark.createDataFrame([("a.com",), ("b.com",), ("c.com",), ("d.com",), ("a.com",)], "domain string")
    got = jobs.fetch_robots(domains, lambda u: files[u])
    assert rows(got, "domain", "txt") == [("a.com", files["http://a.com/robots.txt"].decode()), ("b.com", None), ("c.com", None), ("d.com", "<html>")]
    links = spark.createDataFrame([("http://a.com/p/1",), ("http://a.com/q",), ("http://c.com/p",), ("http://d.com/p",), ("http://e.com/",)], "url string")
    assert rows(frontier.crawlable(links, domains, got), "url") == [("http://a.com/q",), ("http://c.com/p",), ("http://d.com/p",)]


def test_page_accessors(spark):
    old = {"content_markdown": [], "metadata": {"fetch_time": 3}}
    doc = json.loads(_document("http://a.com/x", {"Literal": "t"}))
    df = archive.typed(spark.createDataFrame([(json.dumps({**doc, "historical_snapshots": [{**old, "metadata": {"fetch_time": 5}}, old]}),), (json.dumps({**doc, "current": None}),)], "value string"))
    got = df.select(archive.url().alias("u"), archive.task()["depth"].alias("d"), archive.current()["metadata"]["fetch_time"].alias("c"), F.size(archive.historical()).alias("n"), archive.all_links().alias("l"), archive.oldest_fetch_time().alias("o"), archive.latest_fetch_time().alias("t")).collect()
    links = ["http://a.com/", "http://b.com/"]
    assert [tuple(r) for r in got] == [("http://a.com/x", 0, 7, 2, links, 3, 7), ("http://a.com/x", 0, None, 0, links, 0, 0)]
    now = F.col("page.current").withField("metadata", F.col("page.current.metadata").withField("fetch_time", F.lit(9).cast("bigint")))
    assert archive.with_current(df, now).select(archive.latest_fetch_time().alias("t")).first()["t"] == 9
    assert rows(archive.tasks(df), "url", "depth") == [("http://a.com/x", 0)] * 2


def test_store_page(spark, tmp_path):
    page = F.struct(F.create_map(F.lit("Literal"), F.lit("hi")).alias("content"), F.lit(1).cast("bigint").alias("page"))
    df = spark.createDataFrame([("http://a.com/x", 5), ("http://a.com/y/z", 5)], "url string, fetch_time long").withColumns({"text": F.lit("hi"), "page": F.lit(1).cast("bigint"), "title": F.lit("T"), "keywords": F.lit("k"), "links": F.array(F.lit("http://q.com/"), F.lit("http://p.com/"), F.lit("http://q.com/")), "depth": F.lit(0).cast("bigint")})
    written = archive.store(jobs.story_documents(df), f"file://{tmp_path}/out", 1_700_000_000).collect()
    assert len(written) == 2 and all(r["path"].startswith("a.com/") and r["path"].endswith("2023-11.json") for r in written)
    back = archive.typed(archive.scan(spark, str(tmp_path / "out")))
    assert [r[0] for r in back.select(archive.all_links()).collect()] == [["http://p.com/", "http://q.com/"]] * 2
    assert page is not None


def test_metadata_of_the_first_page(spark):
    body = '<title>{0}</title><meta name="k" content="{0}"><script type="application/ld+json">{{"@type":"Article","author":{{"name":"{0}"}}}}</script><p>{0}</p><a href="/s?page=2">n</a>'
    raw = spark.createDataFrame([("http://a.com/s?page=2", 5, body.format("Two")), ("http://a.com/s", 5, body.format("One"))], "url string, fetch_time long, body string")
    got = articles.merge(crawl.extracted(raw)).first()
    assert (got["title"], got["authors"], [x["content"] for x in got["document_metadata"]], got["task_url"]) == ("One", ["One"], ["One"], "http://a.com/s")
    assert '"One"' in got["json_ld"][0] and [p["page"] for p in got["pages"]] == [1, 2]


PAGE = "url string, fetch_time long, text string, links array<string>, title string"


def test_stream_gives_late_pages_again(spark, tmp_path):
    """An article that was complete gets a later page in a later micro-batch: given again whole, as the merge has it."""
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    every = [("http://a.com/s", 1, "one", [], "T"), ("http://a.com/s?page=2", 1, "two", ["http://a.com/s"], "T2"), ("http://b.com/", 1, "b", ["http://b.com/?page=4"], "B"), ("http://a.com/s?page=3", 1, None, [], None)]
    stream = lambda: streams.assemble(spark.readStream.schema(PAGE).parquet(src))
    empty = spark.createDataFrame([], "url string, fetch_time long, pages array<struct<page:bigint,text:string>>, links array<string>")
    state = frontier.enqueue(spark.createDataFrame([], schemas.FRONTIER), spark.createDataFrame([(u, 0, 0, None) for u, *_ in every], "url string, priority int, depth long, discovered_from string"))
    kept = empty
    for i, row in enumerate(every):
        spark.createDataFrame([row], PAGE).coalesce(1).write.mode("append").parquet(src)
        given = streams.run_to_table(stream(), out, check)
        kept, state = streams.finalize(given, kept, state)
        kept.write.parquet(str(tmp_path / f"kept{i}"))
        state.write.parquet(str(tmp_path / f"state{i}"))
        kept, state = spark.read.parquet(str(tmp_path / f"kept{i}")), spark.read.parquet(str(tmp_path / f"state{i}"))
    want = articles.complete(articles.merge(spark.createDataFrame(every, PAGE))).where("done").first()
    got = streams.latest(given).collect()
    assert len(got) == 1 and [tuple(p) for p in got[0]["pages"]] == [tuple(p) for p in want["pages"]] and got[0]["title"] == want["title"] and got[0]["links"] == want["links"] and got[0]["task_url"] == want["task_url"]
    assert rows(kept.select("url", "fetch_time", F.size("pages").alias("n")), "url", "fetch_time", "n") == [("http://a.com/s", 1, 3)]
    assert rows(state, "url", "status") == [("http://a.com/s", "complete"), ("http://a.com/s?page=2", "complete"), ("http://a.com/s?page=3", "complete"), ("http://b.com/", "pending")]


def test_stream_state_times_out():
    """A key is forgotten after its time; an article that never became complete is given as it is."""

    class State:
        exists, hasTimedOut = False, False

        def update(self, value):
            self.exists, self.get = True, value

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, at):
            self.at = at

        def remove(self):
            self.exists = False

    import pandas as pd

    run = streams._assembler(1000)
    frame = lambda *r: [pd.DataFrame(r, columns=["page", "url", "text", "title", "links", "expected"])]
    for expected, first, last in (([1, 2], 0, 1), ([1], 1, 0)):
        state = State()
        assert len(list(run(("k", 1), frame((1, "u", "t", "T", ["u"], expected)), state))) == first and state.at == 2000
        state.hasTimedOut = True
        given = [x for f in run(("k", 1), [], state) for x in f.to_dict("records")]
        assert len(given) == last and not state.exists and all(x["done"] is False and x["n_pages"] == 1 for x in given)


def test_equal_contents_by_256_bits(spark):
    df = spark.createDataFrame([([(2, "b"), (1, "a")],), ([(1, "a"), (2, "b"), (3, "")],), ([(1, "ab")],), ([],), (None,), ([(1, None)],)], "p array<struct<page:long,text:string>>")
    got = [r[0] for r in df.select(history.content_hash("p")).collect()]
    assert got[0] == got[1] != got[2] and got[3] == got[4] == got[5] != got[2] and len(got[0]) == 64


def _native_blocks(x):
    """The definition, step by step, as expressions."""
    lines = F.split(F.regexp_replace(F.regexp_replace(x, "\\r\\n", "\n"), "\\n\\z", ""), "\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a, line):
        empty = a["open"].isNull()
        closed = F.when(empty, a["done"]).otherwise(F.array_append(a["done"], a["open"]))
        grown = F.when(empty, line).otherwise(F.concat(a["open"], F.lit("\n"), line))
        ends = line.rlike("(?U)^\\s*$") & ~empty
        return F.when(line.startswith("#"), F.struct(closed.alias("done"), line.alias("open"))).when(ends, F.struct(closed.alias("done"), F.lit(None).cast("string").alias("open"))).otherwise(F.struct(a["done"].alias("done"), grown.alias("open")))

    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.aggregate(lines, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"]))))


def _native_chunks(x, size, overlap):
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).cast("long").alias("n"))

    def step(a, block):
        n = text.estimate_tokens(block)
        full = (a["n"] + n > size) & a["open"].isNotNull()
        tail = text.take_overlap(a["open"], overlap)
        grown = F.when(a["open"].isNull(), block).otherwise(F.concat(a["open"], F.lit("\n\n"), block))
        return F.when(full, F.struct(F.array_append(a["done"], a["open"]).alias("done"), F.concat(tail, F.lit("\n\n"), block).alias("open"), (text.estimate_tokens(tail) + n).alias("n"))).otherwise(F.struct(a["done"].alias("done"), grown.alias("open"), (a["n"] + n).alias("n")))

    return F.aggregate(_native_blocks(x), start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))


def test_chunks_by_the_definition(spark):
    r = random.Random(3)
    parts = ["word", "two words", "", " ", "# head", " ", "a b c", "\x1c", "\r", "x " * 9]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(150)] + [None, "", "\n", "\n\n", "a\r\n\r\nb\r\n"]
    df = spark.createDataFrame([(x,) for x in texts], "x string").cache()
    for size, overlap in ((7, 2), (12, 30), (5, 0)):
        for got, want in df.select(text.chunk_markdown("x", size, overlap), _native_chunks(F.col("x"), size, overlap)).collect():
            assert got == want
    for got, want in df.select(text.markdown_blocks("x"), _native_blocks(F.col("x"))).collect():
        assert got == want


def test_long_stories_in_linear_time():
    import time

    from webloom.sources.legacy import parse_story

    story = "\nT\n\nby A\n\n" + "".join(f"K{chr(65 + i % 26)}: {i}\n more\n" for i in range(40_000)) + "\nbody\n"
    began = time.time()
    got = parse_story(story)
    assert got["body"] == "body\n" or got["meta"]
    assert time.time() - began < 5


def _save(folder, config, tensors, vocabulary):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    made = Tokenizer(models.WordLevel({x: i for i, x in enumerate(vocabulary)}, unk_token="[UNK]"))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.post_processor = processors.TemplateProcessing(single="[CLS] $A [SEP]", special_tokens=[("[CLS]", 1), ("[SEP]", 2)])
    made.save(f"{folder}/tokenizer.json")
    (folder / "config.json").write_text(json.dumps(config))
    head, at, data = {}, 0, b""
    for name, x in tensors.items():
        raw = np.asarray(x, dtype="<f4").tobytes()
        head[name] = {"dtype": "F32", "shape": list(np.shape(x)), "data_offsets": [at, at + len(raw)]}
        at, data = at + len(raw), data + raw
    raw = json.dumps(head).encode()
    (folder / "model.safetensors").write_bytes(struct.pack("<Q", len(raw)) + raw + data)


def _slowly(ids, config, w, gated):
    """The same encoder, number by number."""
    d, heads = config["hidden_size"], config["num_attention_heads"]
    linear = lambda v, n: [sum(a * b for a, b in zip(row, v, strict=True)) + (w[n + ".bias"][i] if n + ".bias" in w else 0) for i, row in enumerate(w[n + ".weight"])]

    def norm(v, n):
        mean = sum(v) / len(v)
        var = sum((x - mean) ** 2 for x in v) / len(v)
        return [(x - mean) / math.sqrt(var + config["layer_norm_eps"]) * a + b for x, a, b in zip(v, w[n + ".weight"], w[n + ".bias"], strict=True)]

    gelu = lambda x: x * 0.5 * (1 + math.erf(x / math.sqrt(2)))
    x = [[a + b + (0 if gated else c) for a, b, c in zip(w["embeddings.word_embeddings.weight"][i], w["embeddings.token_type_embeddings.weight"][0], w["embeddings.position_embeddings.weight"][p], strict=True)] for p, i in enumerate(ids)]
    x = [norm(v, "embeddings.LayerNorm") for v in x]
    for layer in range(config["num_hidden_layers"]):
        at = f"encoder.layer.{layer}."
        q, k, v = ([linear(y, f"{at}attention.self.{s}") for y in x] for s in ("query", "key", "value"))
        out = []
        for i in range(len(x)):
            row = []
            for h in range(heads):
                part = slice(h * d // heads, (h + 1) * d // heads)
                s = [sum(a * b for a, b in zip(q[i][part], k[j][part], strict=True)) / math.sqrt(d / heads) - (2.0 ** (-8 * (h + 1) / heads) * abs(i - j) if gated else 0) for j in range(len(x))]
                e = [math.exp(y) for y in s]
                row += [sum(e[j] / sum(e) * v[j][part][c] for j in range(len(x))) for c in range(d // heads)]
            out.append(row)
        x = [norm([a + b for a, b in zip(linear(o, at + "attention.output.dense"), y, strict=True)], at + "attention.output.LayerNorm") for o, y in zip(out, x, strict=True)]
        if gated:
            wide = [linear(y, at + "mlp.gated_layers") for y in x]
            wide = [[gelu(a) * b for a, b in zip(y[: len(y) // 2], y[len(y) // 2 :], strict=True)] for y in wide]
            x = [norm([a + b for a, b in zip(linear(o, at + "mlp.wo"), y, strict=True)], at + "mlp.layernorm") for o, y in zip(wide, x, strict=True)]
        else:
            wide = [[gelu(a) for a in linear(y, at + "intermediate.dense")] for y in x]
            x = [norm([a + b for a, b in zip(linear(o, at + "output.dense"), y, strict=True)], at + "output.LayerNorm") for o, y in zip(wide, x, strict=True)]
    pooled = [sum(v[c] for v in x) / len(x) for c in range(d)]
    return [y / math.sqrt(sum(z * z for z in pooled)) for y in pooled]


@pytest.mark.parametrize("gated", [False, True])
def test_encoder_of_a_local_folder(spark, tmp_path, gated):
    rng = np.random.default_rng(4)
    d, wide, n = 8, 12, 2
    words = ["[UNK]", "[CLS]", "[SEP]", "red", "green", "blue", "sea"]
    config = {"hidden_size": d, "num_attention_heads": 2, "num_hidden_layers": n, "max_position_embeddings": 10, "layer_norm_eps": 1e-12, "hidden_act": "gelu", "position_embedding_type": "alibi" if gated else "absolute"}
    shapes = {"embeddings.word_embeddings.weight": (len(words), d), "embeddings.token_type_embeddings.weight": (2, d), "embeddings.position_embeddings.weight": (10, d), "embeddings.LayerNorm.weight": (d,), "embeddings.LayerNorm.bias": (d,)}
    for i in range(n):
        for s in ("attention.self.query", "attention.self.key", "attention.self.value", "attention.output.dense"):
            shapes |= {f"encoder.layer.{i}.{s}.weight": (d, d), f"encoder.layer.{i}.{s}.bias": (d,)}
        for s in ("attention.output.LayerNorm", *(["mlp.layernorm"] if gated else ["output.LayerNorm"])):
            shapes |= {f"encoder.layer.{i}.{s}.weight": (d,), f"encoder.layer.{i}.{s}.bias": (d,)}
        if gated:
            shapes |= {f"encoder.layer.{i}.mlp.gated_layers.weight": (2 * wide, d), f"encoder.layer.{i}.mlp.wo.weight": (d, wide), f"encoder.layer.{i}.mlp.wo.bias": (d,)}
        else:
            shapes |= {f"encoder.layer.{i}.intermediate.dense.weight": (wide, d), f"encoder.layer.{i}.intermediate.dense.bias": (wide,), f"encoder.layer.{i}.output.dense.weight": (d, wide), f"encoder.layer.{i}.output.dense.bias": (d,)}
    w = {k: rng.normal(size=s).astype(np.float32) for k, s in shapes.items()}
    _save(tmp_path, config, w if gated else {f"bert.{k}": v for k, v in w.items()}, words)
    ids = [1, 3, 6, 0, 5, 2]
    got = bert.Encoder(str(tmp_path))(["red sea zzz blue", "", "green " * 50])
    assert np.allclose(got[0], _slowly(ids, config, {k: v.astype(float).tolist() for k, v in w.items()}, gated), atol=1e-4)
    assert all(abs(sum(x * x for x in v) - 1) < 1e-4 for v in got)
    assert np.allclose(got[2], _slowly([1, *[4] * 8, 2], config, {k: v.astype(float).tolist() for k, v in w.items()}, gated), atol=1e-4)
    df = spark.createDataFrame([("a", "red sea zzz blue")], "id string, text string")
    assert np.allclose(search.embedded(df, "text", bert.local_embedder(str(tmp_path))).first()["vector"], got[0], atol=1e-5)


def test_slopes():
    assert bert.slopes(4).tolist() == [0.25, 0.0625, 0.015625, 0.00390625]
    assert np.allclose(bert.slopes(6), [0.25, 0.0625, 0.015625, 0.00390625, 0.5, 0.125])


def test_display_query_by_brute_force(spark, data):
    """The results of a text query over all documents, ranked again in plain Python."""
    from webloom.plans import catalog

    docs = {r["doc_id"]: r["text"] for r in catalog.read(spark, data, "documents").collect()}
    points = {(r["source"], r["chunk_id"]): r for r in crawl.points(catalog._merged_documents(spark, data)).collect()}
    embed = search.hashing_embedder()
    q = np.array(embed(["the and of"])[0])
    ranked = sorted(points.values(), key=lambda r: (-float(np.dot(np.float32(embed([r["text"]])[0]).astype(float), q)), r["id"]))[:5]
    got = catalog.QUERIES["search_query"](spark, data).orderBy("rank").collect()
    assert [(r["rank"], r["source"]) for r in got] == [(i + 1, r["source"]) for i, r in enumerate(ranked)]
    assert all(r["text"] == (p["text"] if len(p["text"]) <= 200 else p["text"][:200] + "...") for r, p in zip(got, ranked, strict=True))
    assert {int(s[4:]) for s, _ in points} == {i for i, t in docs.items() if t and len(t.replace("\n", "\n\n").encode()) >= 5000}


GOLDEN = [
    ("<html><body><nav><a href='/x'>menu</a></nav><article><h1>Top</h1><p>One <b>two</b><br>three</p><ul><li>a</li><li>b</li></ul><script>x()</script></article><p>outside</p></body></html>", "# Top\n\nOne two\nthree\n\n* a\n\n* b"),
    ("<p>plain &amp; simple</p><div><a href='/1'>only</a> <a href='/2'>links</a></div><p>end <a href='/3'>here</a> with more text</p>", "plain & simple\n\nend here with more text"),
    ("<style>p{}</style><h2>Part</h2><p>text</p><footer>foot</footer>", "## Part\n\ntext"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page,want", GOLDEN)
def test_markdown(page, want):
    from webloom.functions import html

    assert html.parse(page)["markdown"] == want
