"""Each query against a brute-force version on one small table that has nulls, empty and long texts, copies, repeated
rows and columns with names that the operators use inside; and on empty tables."""

import base64
import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

from webloom.llm import registry

Q = registry.queries()
WORD = re.compile("[^\x20\x09-\x0d]+")


def run(spark, name, folder):
    return [r.asDict() for r in Q[name](spark, folder).collect()]


def same(got, want):
    key = lambda x: repr(x)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, bare, name):
    assert Q[name](spark, bare).count() == 0


def test_op1(spark, folder, rows):
    def base(text):
        text = text or ""
        w = WORD.findall(text)
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(runs)
        covered = {i + k for i, x in enumerate(runs) if n[x] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)

    got = run(spark, "op1_quality_rules", folder)
    same([(g["doc_id"], g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) for g in got], [(r[0], *base(r[1])) for r in rows])
    assert all(g["kept"] == (not g["base_failed"] and g["rule_id"] == 0) for g in got)


def test_op2(spark, folder, rows):
    def plain(text):
        found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
                found.append((m.start(), 2, "card", m.end()))
        found += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]

    got = run(spark, "op2_pii", folder)
    texts = {r[0]: r[1] or "" for r in rows}
    for g in got:
        want = plain(texts[g["doc_id"]])
        assert g["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [g[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k + ":") for x in want) for k in ("email", "ip", "card", "phone")]
        assert set(want) <= set(filter(None, g["spans"].split(",")))
    assert any("secret:" in g["spans"] for g in got)


def _covered(texts, length):
    n = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        yield cover


def _removed(texts, length=400, passage=300):
    for t, cover, shared in zip(texts, _covered(texts, length), _covered(texts, passage), strict=True):
        kept = bytes(c for c, m in zip(t, cover, strict=True) if not m)
        yield len(t), sum(cover), sum(bool(cover[i]) and (i == 0 or not cover[i - 1]) for i in range(len(t))), hashlib.sha256(kept).hexdigest(), sum(shared)


def test_op3(spark, folder, rows):
    got = run(spark, "op3_suffix_dedup", folder)
    texts = [(r[1] or "").encode() for r in rows]
    same([tuple(g.values()) for g in got], [(r[0], *x) for r, x in zip(rows, _removed(texts), strict=True)])
    assert any(0 < g["n_removed"] < g["n_bytes"] for g in got) and any(0 == g["n_removed"] < g["n_shared"] for g in got)


def _near_copies(n):
    """Texts that share a passage of 330 bytes and lines about it, each with an edit of its own, and some with none."""
    import random

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(150)]
    out = []
    for i in range(n):
        w = list(common)
        if i % 5:
            w[r.randrange(150)] = word()
        out.append(" ".join([*(word() for _ in range(i % 7)), *w, *(word() for _ in range(20))]))
    return out


@pytest.mark.parametrize("group", [1, 4, 512])
def test_op3_common_anchors_go_in_blocks(spark, docs, rows, group):
    """Anchors, cores and windows with more different members than may meet."""
    from webloom.llm.suffix_dedup import Params, without_repeats

    more = [(1000 + i, t) for i, t in enumerate(_near_copies(40))]
    every = [(r[0], r[1]) for r in rows] + more
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = without_repeats(table, Params(group=group, merge_bytes=4096, shard_bytes=1024)).drop("kept").collect()
    same([tuple(g) for g in got], [(i, *x) for (i, _), x in zip(every, _removed([(t or "").encode() for _, t in every]), strict=True)])


def test_op3_one_row_many_times(spark):
    """A row that is repeated 10,000 times, beside near copies of it and a row without an id: as copies of one another."""
    from pyspark.sql import functions as F

    from webloom.llm.suffix_dedup import without_repeats

    text = "".join(f"{i * i:05d} word " for i in range(80))
    rows = [(1, text)] * 10_000 + [(2, text[:300] + "x" + text[300:]), (None, text[:500]), (None, "short"), (4, None)]
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).drop("kept").groupBy(*(f.split()[0] for f in "doc_id n_bytes n_removed n_spans kept_sha256 n_shared".split())).agg(F.count("*").alias("n")).collect()
    want = collections.Counter((r[0], *x) for r, x in zip([rows[0], rows[0], *rows[10_000:]], _removed([(r[1] or "").encode() for r in [rows[0], rows[0], *rows[10_000:]]]), strict=True))
    want[next(k for k in want if k[0] == 1)] = 10_000
    assert {tuple(g)[:-1]: g["n"] for g in got} == want


def test_op4(spark, folder, rows):
    from webloom.llm.sharding import Params, fill

    got = run(spark, "op4_sharding", folder)
    assert sorted(g["doc_id"] for g in got) == sorted(r[0] for r in rows)
    p = Params()
    table, names = fill(p.shards, p.size), sorted(p.shards)
    assert all(names[table[g["slot"]]] == g["shard"] for g in got)
    counts = collections.Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = fill(p.shards[:-1], p.size)
    gone = names.index(p.shards[-1])
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != gone) < 0.2 * p.size


def test_op5(spark, folder, rows):
    got = run(spark, "op5_winnowing", folder)
    first = {}
    for r in rows:
        first.setdefault(r[0], r[1] or "")
    ids = sorted(first, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    for g in got:
        t = first[g["doc_id"]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + first[after[g["doc_id"]]][:cut]
        assert g["n_chars"] == len(t)
        assert g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
    prints = {}
    for g in got:
        assert prints.setdefault(first[g["doc_id"]], g["fingerprint"]) == g["fingerprint"]
    long = [g["near_edited"] for g in got if 1000 < g["n_chars"] < 3000 and "x" * 50 not in first[g["doc_id"]]]
    assert 0.3 < sum(long) / len(long) < 0.7


def test_op5_matches_brute_force(spark):
    """Chosen places by the definition: of each window the rightmost least hash."""
    from pyspark.sql import functions as F

    from webloom.llm.winnowing import PLACE_BITS, PLACES, Params, chosen

    p = Params(k=3, window=4)
    text = " ".join("abcabdabcaebca"[i % 14] for i in range(200))
    df = spark.createDataFrame([(text,)], "text string")
    got = chosen(df, "text", "c", p).first()["c"]
    grams = _grams([xxhash.xxh64_intdigest(x, 42) for x in text.split()], 3)
    keys = [(x & ~PLACES & (2**63 - 1)) >> PLACE_BITS for x in grams]
    want = []
    for i in range(len(keys) - 3):
        at = max(range(i, i + 4), key=lambda j: (-keys[j], j))
        if not want or want[-1] != at:
            want.append(at)
    assert [PLACES - (x & PLACES) for x in got] == want
    assert [x >> PLACE_BITS for x in got] == [keys[i] for i in want]


def _grams(hashes, k):
    """The hash of each run of k tokens: every token's hash with the hash so far as its seed."""
    out = []
    for i in range(max(1, len(hashes) - k + 1)):
        value = 42
        for x in hashes[i : i + k]:
            value = xxhash.xxh64_intdigest(struct.pack("<Q", x), value)
        out.append(value)
    return out


def test_op5_by_brute_force(spark, folder, rows):
    """Fingerprints and likenesses of every row, from the definition."""
    got = run(spark, "op5_winnowing", folder)
    known = collections.defaultdict(list)
    for r in rows:
        known[r[0]].append(r[1] or "")
    ids = sorted(known, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))

    def fingerprint(text):
        from webloom.llm.winnowing import PLACE_BITS

        tokens = [t for w in WORD.findall(text) for t in re.findall(".{1,12}", w, re.S)]
        h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
        if not h:
            return []
        grams = _grams(h, 5)
        keys = [(g & (2**63 - 1)) >> PLACE_BITS for g in grams]
        out = []
        for i in range(max(1, len(keys) - 15)):
            at = max(range(i, min(i + 16, len(keys))), key=lambda j: (-keys[j], j))
            if not out or out[-1] != (keys[at], at):
                out.append((keys[at], at))
        return out

    def near(a, b):
        a, b = {x for x, _ in a}, {x for x, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    show = lambda f: ",".join(f"{h:x}@{at}" for h, at in f)
    made = {t: fingerprint(t) for texts in known.values() for t in texts}
    want = []
    for r in rows:
        t, follows = r[1] or "", min(known[after[r[0]]], key=lambda x: x)
        cut = len(t) // 3
        edited = fingerprint(t[: len(t) - cut] + follows[:cut])
        want.append((r[0], show(made[t]), show(edited), round(near(made[t], edited), 9), round(near(made[t], made[follows]), 9)))
    same([(g["doc_id"], g["fingerprint"], g["edited_fingerprint"], round(g["near_edited"], 9), round(g["near_next"], 9)) for g in got], want)


def test_op6(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    least = {}
    for r in pages:
        body = (r["html"] or "").encode()
        least[body] = min(least.get(body, r["page_id"]), r["page_id"])
    want = []
    for r in pages:
        body = (r["html"] or "").encode()
        back = least[body] != r["page_id"]
        want.append((r["page_id"], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if back else "response", least[body] if back else None))
    same([tuple(g.values()) for g in run(spark, "op6_warc", folder)], want)


def test_op6_archive_is_a_dictionary_archive():
    import io

    import zstandard

    from webloom.llm import warc

    records = [warc.record(i, f"http://e.com/{i}", f"<html><body>common words {i * 7919} and more common words</body></html>".encode() * 4, None, "2024-01-01T00:00:00Z") for i in range(400)]
    data, places = warc.archive(records, warc.Params())
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0
    assert list(warc.frames(io.BytesIO(data))) == records
    at, length = places[123]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    assert reader.decompressobj().decompress(data[at : at + length]) == records[123]


def test_op7(spark, folder, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = run(spark, "op7_packing", folder)
    want = []
    for r in rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(r[0], at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)) for at in range(0, len(ids), 2048)]
    same([(g["doc_id"], g["start"], g["length"], g["ids_crc32"], g["doc_tokens"]) for g in got], want)
    by = collections.defaultdict(list)
    for g in got:
        by[g["sequence_id"]].append((g["offset"], g["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_op8(spark, folder, rows):
    got = run(spark, "op8_toxicity", folder)
    assert sorted(g["doc_id"] for g in got) == sorted(r[0] for r in rows)
    for g in got:
        assert g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0)
        assert 0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.5)


def test_op8_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    score = {g["doc_id"]: g for g in run(spark, "op8_toxicity", sf)}
    labels = [(score[r["doc_id"]]["score"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if score[r["doc_id"]]["held_out"]]
    pos, neg = [s for s, t in labels if t], [s for s, t in labels if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.8


def test_op9(spark, folder, rows):
    got = run(spark, "op9_mixing", folder)
    n = collections.Counter((r[0], r[3]) for r in rows)
    first = collections.Counter((g["doc_id"], g["source"]) for g in got if g["epoch"] == 0)
    assert first == n  # all come once, repeated rows each
    tokens, total = collections.Counter(), collections.Counter()
    for r in rows:
        total[r[3]] += len(WORD.findall(r[1] or ""))
    for g in got:
        tokens[g["source"]] += g["tokens"]
        assert 0 <= g["at"] <= 1 and g["epoch"] < 2
    assert all(total[s] <= tokens[s] <= 2 * total[s] + 20_000 for s in total)


def test_op10(spark, folder, rows):
    import xxhash

    def bits(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [bits(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    same([tuple(g.values()) for g in run(spark, "op10_simhash_golay", folder)], [(r[0], f"{prints[i]:016x}", least[find(i)]) for i, r in enumerate(rows)])
