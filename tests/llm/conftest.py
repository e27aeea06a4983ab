import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, rank long, fp string, shard string, total long, epochs string, quality string, toxic long"


def _words(r, n):
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(n))


def make_rows(seed=1):
    """Plain, copied, nearly copied, repeated, null, empty and long texts, and repeated rows."""
    r = random.Random(seed)
    texts = [_words(r, r.randint(1, 300)) for _ in range(40)]
    texts += texts[:5]
    texts += [t + " tail" for t in texts[5:15]]
    passage = _words(r, 120)
    texts += [f"{_words(r, 30)} {passage} {_words(r, 30)}" for _ in range(8)]
    texts += [None, "", " \n\t", "one", "x" * 3000, "same line here now\n" * 40, _words(r, 20_000), "THE!! END!! " * 30]
    texts += ["und.34@mail7.example.com and +1 (974) 555-3436 or 4845168114407329 at 97.51.17.173 999.1.1.1", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "日本語のテキスト " * 30]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "w", 1, "f", "s", 5, "e", "good", 9) for i, t in enumerate(texts)]
    return rows + rows[-2:]  # two rows repeat whole


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder(docs, spark, tmp_path_factory):
    """A data folder with the documents and labels, for the queries."""
    path = str(tmp_path_factory.mktemp("data"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(3, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"http://e.com/{i}", f"<p>{'ab ' * (i % 5) * 20}</p>" if i % 9 else None) for i in range(60)] + [(7, None, "twice"), (61, "http://e.com/x", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="session")
def bare(none, spark, tmp_path_factory):
    """The same folder with empty tables."""
    path = str(tmp_path_factory.mktemp("bare"))
    none.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path
