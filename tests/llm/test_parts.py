import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webloom.llm import bwt, mixing, packing, quality_rules, semicrf, simhash_golay
from webloom.llm.boosting import boost, isotonic


def test_golay_keys_meet():
    """Fingerprints that differ in at most four bits share a key, whatever the bits."""
    golay, r = simhash_golay.Golay(), random.Random(3)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 4)):
            b ^= 1 << bit
        rows, keys = simhash_golay.keys_of(np.array([a, b], dtype=np.uint64), golay)
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_golay_corrects_three():
    golay, r = simhash_golay.Golay(), random.Random(4)
    words = np.array([r.getrandbits(23) for _ in range(200)], dtype=np.int64)
    own = golay.own(words)
    codeword = words ^ golay.error[golay.by_octet[0][words & 255] ^ golay.by_octet[1][words >> 8 & 255] ^ golay.by_octet[2][words >> 16 & 127]]
    for e in (0, 1, 1 << 22, 0b1011, 1 << 20 | 3):
        assert (golay.own(codeword ^ e) == own).all()


def test_links_in_large_keys(spark):
    """Many close fingerprints: a chain of single flips is one component, in blocks as well as in one."""
    from webloom.llm.components import components

    r = random.Random(5)
    fps = [r.getrandbits(64)]
    for _ in range(150):
        fps.append(fps[-1] ^ (1 << r.randrange(64)))
    fps = list(dict.fromkeys(fps))
    classes = spark.createDataFrame([(simhash_golay._signed(x), i + 10) for i, x in enumerate(fps)], "fp long, node long")
    for block in (8, 4096):
        found = components(simhash_golay.links(classes, simhash_golay.Params(block=block)), "a", "b").collect()
        assert {x["root"] for x in found} == {10} and len(found) == len(fps) - 1


def test_components(spark):
    from webloom.llm.components import components

    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (7, 7)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 1 for i in range(2, 61)} | {101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=4, max_size=40), st.integers(0, 40)), min_size=1, max_size=8), st.integers(8, 200))
def test_bwt_merge(drawn, shard_bytes):
    """Of two lengths at once, which starts are repeated among the starts asked for."""
    contexts = [t.encode() for t, _ in drawn]
    counts = [min(k, len(t) - 3) for t, k in drawn]
    n = {}
    for c, m in zip(contexts, counts, strict=True):
        for i in range(m):
            for size in (4, 8):
                if i + size <= len(c):
                    n[c[i : i + size]] = n.get(c[i : i + size], 0) + 1
    got = bwt.repeated_starts(contexts, counts, (4, 8), 2, shard_bytes)
    assert [g.tolist() for g in got] == [[[n.get(c[i : i + size], 0) > 1 if i + size <= len(c) else False for i in range(m)] for size in (4, 8)] for c, m in zip(contexts, counts, strict=True)]


def _transforms(texts, step, depth, n_shards):
    """Shards of whole strings, and the text ahead of each place, in symbols up to the depth or the end mark."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    offsets, full, previous = bwt.strings(sizes, step)
    known = sorted({t[i : i + step] for t in texts for i in range(len(t) - step + 1)})
    symbols = np.zeros(int(offsets[-1]), dtype=np.int32)
    ahead = []
    for t, at in zip(texts, offsets, strict=False):
        for i in range(len(t) + 1):
            chain = [known.index(t[j : j + step]) + 1 for j in range(i, len(t) - step + 1, step)][:depth]
            symbols[at + i] = chain[0] if chain else 0
            ahead.append(chain)
    assert full.tolist() == [len(x) > 0 for x in ahead]
    cut = [len(texts) * k // n_shards for k in range(n_shards + 1)]
    return [bwt.shard(symbols, previous, int(offsets[a]), int(offsets[b]), depth) for a, b in zip(cut, cut[1:], strict=False)], ahead, symbols, previous


def test_bwt_is_the_symbol_before():
    (one,), ahead, symbols, previous = _transforms([b"abcdefabcxyzabcdefabcdzz" * 2], 3, 4, 1)
    order = [ahead[i] for i in one.places]
    whole = [x for x in order if len(x) == 4]
    assert sorted(one.places.tolist()) == list(range(len(ahead))) and whole == sorted(whole)
    assert one.before.tolist() == symbols[previous[one.places]].tolist()


def test_bwt_common_prefixes():
    """The merge of three transforms is the transform of all: order, common prefixes and intervals."""
    texts = [b"abcdefabcxyzabcdefabcdzz", b"abcdefabcdzzabcabc", b"zzabcdefabcxyz", b"abcdefabcxyzabcdefabcdzy", b"xyzxyzxyzxyz", b"q"]
    shards, ahead, _, _ = _transforms(texts, 3, 4, 3)
    merged = bwt.merge(shards, 4)
    assert sorted(merged.places.tolist()) == list(range(len(ahead)))
    order = [ahead[i] for i in merged.places]
    for depth in (1, 2, 3, 4):
        prefixes = [tuple(x[:depth]) for x in order]
        assert [x for x in prefixes if len(x) == depth] == sorted(x for x in prefixes if len(x) == depth)
        intervals = merged.repeated(depth)
        inside = {i for a, b in intervals for i in range(a, b)}
        counts = {x: prefixes.count(x) for x in prefixes}
        assert all((i in inside) == (counts[x] > 1) for i, x in enumerate(prefixes) if len(x) == depth)
        assert all(len(set(prefixes[a:b])) == 1 for a, b in intervals if len(prefixes[a]) == depth)
    assert len(bwt.merge([], 4).places) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(lengths, 64)
    rooms = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((b for b, used in enumerate(rooms) if used + lengths[i] <= 64), len(rooms))
        if at == len(rooms):
            rooms.append(0)
        assert (bins[i], offsets[i]) == (at, rooms[at])
        rooms[at] += lengths[i]


def test_packing_wastes_little():
    r = random.Random(6)
    lengths = [r.randint(1, 2048) for _ in range(8192)]
    bins, _ = packing.first_fit_decreasing(lengths, 2048)
    assert sum(lengths) / (2048 * (max(bins) + 1)) > 0.97


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60) | st.text("ab \n\t'sé½日<|endoftext|>\x1c\xa0", max_size=60))
def test_encoder(text):
    import struct

    e = _encoder()
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert e.encode(text) == struct.pack(f"<{len(want)}I", *want)


_made = []


def _encoder():
    if not _made:
        _made.append(packing.Encoder("", 50))
    return _made[0]


def test_decision_list():
    r = random.Random(7)
    rows = [{"a": r.randrange(5), "b": r.randrange(5), "count": 1} for _ in range(3000)]
    for x in rows:
        x["quality"] = 0 if x["a"] > 2 and x["b"] <= 1 else 1
    rules = quality_rules.cover(rows[:2000], rows[2000:], {"a": 4, "b": 4}, quality_rules.Params())
    assert [sorted(x) for x in rules] == [[("a", ">", 2), ("b", "<=", 1)]]
    assert quality_rules.cover([], [], {"a": 4}, quality_rules.Params()) == []


def test_boosting_and_calibration():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boost(x[:2000], y[:2000])
    raw = trees.raw(x[2000:])
    assert ((raw > 0) == y[2000:]).mean() > 0.95
    curve = isotonic(raw, y[2000:])
    assert (np.diff(curve.y) >= 0).all() and (np.diff(curve.x) > 0).all()
    assert boost(np.zeros((0, 4)), np.zeros(0)).raw(np.zeros((2, 4))).tolist() == [0.0, 0.0]


def test_semi_markov_field():
    """Sums over all segmentations agree with enumeration, and the trained field finds made-up spans it has not seen."""
    import itertools
    import math

    text, _ = semicrf.examples(4, seed=1)[1]
    tokens = semicrf.TOKEN.findall(text)
    found = semicrf.segments(tokens)[:10]
    weights = {x: 0.3 * (i % 5) - 0.4 for i, x in enumerate(sorted({f for s in found for f in s.features}))}
    total = 0.0
    for k in range(len(found) + 1):
        for chosen in itertools.combinations(found, k):
            order = sorted(chosen, key=lambda s: s.start)
            if all(a.end <= b.start for a, b in zip(order, order[1:], strict=False)):
                total += math.exp(sum(semicrf.score(s, weights) for s in chosen))
    assert math.isclose(semicrf.expected(len(tokens), found, weights)[0], math.log(total), rel_tol=1e-9)
    weights = semicrf.trained()
    hit = miss = extra = 0
    for text, spans in semicrf.examples(200, seed=99):
        got = {(k, text[a:b]) for a, b, k in semicrf.extra_spans(text, [], weights)}
        hit += len(got & set(spans))
        miss += len(set(spans) - got)
        extra += len(got - set(spans))
    assert hit / (hit + miss) > 0.9 and extra / (hit + extra) < 0.1


def test_exponents(spark):
    assert mixing.repetition_exponent(100.0, 100.0, 2.0) == 0.0
    e = mixing.repetition_exponent(1000.0, 10.0, 2.0)
    assert abs((1000 / 10) ** (1 - e) - 2.0) < 1e-6
    sums = spark.createDataFrame([("a", 900.0), ("b", 90.0), ("c", 10.0)], "__s string, total double")
    e = mixing.entropy_exponent(sums, 0.8)
    p = np.array([0.9, 0.09, 0.01]) ** e
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() / np.log(3) - 0.8) < 1e-3


def test_luhn_and_long_runs():
    from webloom.llm.pii import base_spans, redacted

    assert base_spans("a" * 200_000 + "@" * 10 + "1" * 100_000 + "+1" + " " * 50_000) == []
    assert redacted("mail a@b.co now", base_spans("mail a@b.co now")) == "mail [EMAIL] now"


def test_shards_need_a_prime():
    from webloom.llm.sharding import fill

    with pytest.raises(ValueError):
        fill(("a", "b"), 100)
