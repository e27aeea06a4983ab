"""Operators do the whole job: spans and rows that earlier versions left out."""

import base64
import re

import pytest

from webloom.llm import pii, registry, semicrf, simhash_golay

LONG = [
    ("written_email", "first.last [at] example [dot] com"),
    ("written_email", "jane.doe (at) mail.example.co.uk"),
    ("written_email", "anna [at] mail [dot] example [dot] org"),
    ("written_email", "max.lee.kim ( at ) inbox ( dot ) dept ( dot ) example [dot] co [dot] uk"),
    ("written_email", "jo [at] " + " [dot] ".join(["mail"] * 30) + " [dot] org"),
    ("account", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"),
    ("secret", "-".join(base64.b64encode(bytes([i, 7 * i, 99 - i, 3, 200 - i, 5 * i])).decode().replace("/", "_").replace("+", "_") for i in range(1, 31))),
]


@pytest.mark.parametrize(("kind", "span"), LONG)
def test_long_spans_are_found_whole(kind, span):
    cue = {"written_email": "write to", "account": "iban", "secret": "token ="}[kind]
    text = f"the other on {cue} {span} and then"
    a = text.index(span)
    assert semicrf._MAYBE[kind].fullmatch(span)
    assert (a, a + len(span), kind) in semicrf.extra_spans(text, [], semicrf.trained())
    assert pii.redacted(text, pii.spans(text, semicrf.trained())[1]) == f"the other on {cue} [{kind.upper()}] and then"


def test_segments_are_all_that_may_be():
    """Every span of whole tokens that has the form of a kind is a possible segment, of any number of tokens."""
    for text in [s for _, s in LONG[:4]] + ["x_DE12 3456 7890 1234 99", "(12) /(345)-(67) .(89)./12 3", "a-b@c [at] d-e . f-g (dot) h. Then", "call 030/12345 or (030) 12-34 (at) a.b\nc", "k_-1234567890abcdef-x", "a (at) b.c [at] d.e"]:
        tokens = semicrf.TOKEN.findall(text)
        got = [(s.start, s.end, s.kind) for s in semicrf.segments(tokens)]
        n = range(len(tokens))
        want = {(i, j + 1, k) for i in n for j in n if i <= j for k in semicrf.TYPES if semicrf.possible(k, x := "".join(tokens[i : j + 1])) and "\n" not in x and not tokens[i].isspace() and not tokens[j].isspace()}
        assert len(got) == len(set(got)) and set(got) == want, text


def test_blocked_tokens_are_in_no_segment():
    tokens = semicrf.TOKEN.findall("ann.lee [at] mail [dot] example [dot] org")
    for k in range(len(tokens)):
        assert not any(s.start <= k < s.end for s in semicrf.segments(tokens, [i == k for i in range(len(tokens))]))


def test_hot_places_hold_all_phones():
    text = "tel (12) (345) (67)"
    assert semicrf.possible("local_phone", text[4:]) and re.search(semicrf.HOT, text)


def _nameless():
    near = " ".join(f"w{j}" for j in range(400))
    off = lambda t: (simhash_golay.fingerprint(near.encode()) ^ simhash_golay.fingerprint(t.encode())).bit_count()
    near = [near, next(t for n in range(1, 60) if 0 < off(t := near + " x" * n) <= 4)]
    far = [" ".join(f"{c}{j}" for j in range(60)) for c in "abcd"]
    big = 2**53 + 1
    return near, far, big, [(None, near[0], "p"), (None, near[1], "q"), (None, near[1], "r"), (None, far[0], "s"), (big, far[0], "t"), (big + 2, far[1], "u"), (None, far[2], "v"), (7, far[3], "w"), (7, far[3], "x"), (9, far[3], "y"), (None, None, "z")]


def test_null_ids_are_linked_by_text(spark):
    near, far, big, rows = _nameless()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    fp = lambda t: simhash_golay._signed(simhash_golay.fingerprint((t or "").encode()))
    least = {far[0]: big, far[1]: big + 2, far[3]: 7}
    got = [tuple(r) for r in simhash_golay.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(((i, fp(t), least.get(t)) for i, t, _ in rows), key=str)


def test_one_row_of_a_group_without_ids_stays(spark):
    near, far, big, rows = _nameless()
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")  # with a column that has a name of ours
    got = simhash_golay.one_of_each(spark, docs, "")
    assert got.columns == docs.columns
    kept = [tuple(r) for r in got.collect()]
    assert set(kept) <= set(rows)
    without = [r for r in kept if r[0] is None]
    assert len(without) == 3 and sorted(r[2] in "pqr" for r in without) == [False, False, True] and {r[2] for r in without} >= {"v", "z"}
    assert sorted(r[2] for r in kept if r[0] is not None) == ["t", "u", "w", "x"]


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", "é <|endoftext|> 日本 <|endoftext|>", "plain <|endoftext> text", ""])
def test_added_tokens_are_the_tokenizers(text):
    """Ids are those of an unmodified tokenizer."""
    import struct

    import public_tokenizers
    from tokenizers import Tokenizer

    from webloom.llm import packing

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert packing.Encoder("", 50).encode(text) == struct.pack(f"<{len(want)}I", *want)


def test_dictionary_samples_reach_the_end(monkeypatch):
    import zstandard

    from webloom.llm import warc

    p, seen = warc.Params(), []
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, taken, **_: seen.extend(taken))
    records = [i.to_bytes(4, "little") + bytes(10_000) for i in range(3200)]
    warc._dictionary(records, p)
    places = [int.from_bytes(x[:4], "little") for x in seen]
    assert places[-1] > 3100 and max(b - a for a, b in zip(places, places[1:], strict=False)) < 20
    assert p.sample_bytes // 2 < sum(map(len, seen)) <= p.sample_bytes


def _broadcasts(spark, run) -> list[str]:
    """The plans with a broadcast among those that ``run`` executes, with the default threshold."""
    log = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = log.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = log.executionsList()
    plans = [found.apply(i).physicalPlanDescription() for i in range(before, found.size())]
    assert plans
    return [x for x in plans if "BroadcastExchange" in x]


def test_op10_broadcasts_nothing_that_grows(spark, docs, folder):
    """Small stored tables are below the threshold, and still no side that grows with the corpus goes to the driver."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "-1b")
    assert not _broadcasts(spark, lambda: registry.queries()["op10_simhash_golay"](spark, folder).collect())


def test_pipeline_stage_broadcasts_nothing_that_grows(spark, docs, folder):
    assert not _broadcasts(spark, lambda: simhash_golay.one_of_each(spark, docs, folder).collect())
