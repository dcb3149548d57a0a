"""Suffix arrays and SimHash against plain computations."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash

from speechloom.llm import simhash, suffix_dedup
from speechloom.llm.suffix_array import common_prefixes, suffix_array, words_at

LAST = (1 << 63) - 1


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for _ in range(200):
        n, top = rng.randint(0, 200), rng.choice([1, 2, 4, 250])
        block = bytes(rng.randint(1, top) for _ in range(n))
        array = np.frombuffer(block, np.uint8)
        order = suffix_array(array, 256)
        assert list(order) == sorted(range(n), key=lambda i: block[i:])
        shared = common_prefixes(order, words_at(array, 10), 10)
        for k in range(1, n):
            a, b = block[order[k - 1] :], block[order[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(same, 10)


def removed(rows, length):
    first = {}
    data = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(first.get(b[k : k + length], LAST), i)
    out = []
    for (i, b), (own, _) in zip(data, rows):
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((own, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length, sizes", [(10, None), (7, (1000, 500, 500, 3, 300)), (50, (2000, 700, 700, 64, 300))])
def test_repeats_equal_a_plain_search(spark, monkeypatch, length, sizes):
    names = ("BATCH_BYTES", "BUCKET_BYTES", "PLACE_BYTES", "COMMON", "PORTION")
    for name, value in zip(names, sizes or ()):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(length)
    base = "".join(rng.choice("abé ") for _ in range(300))
    rows = []
    for _ in range(80):
        joined = base[rng.randint(0, 200) :][: rng.randint(0, 150)] + "x" + base[rng.randint(0, 280) :]
        noise = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 90)))
        rows.append((rng.choice([None, rng.randint(0, 60), rng.randint(0, 60)]), rng.choice([None, "", noise, joined])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs, length)).collect()), key=str)
    assert got == removed(rows, length)


def test_strings_of_a_common_passage_are_spread_over_places():
    rng = random.Random(6)
    passage = "this passage stands in all of the documents, between words of their own that no other has"
    texts = [f"{rng.getrandbits(200):x}{passage}{rng.getrandbits(200):x}".encode() for _ in range(4000)]
    size, places, length, limit = 500, 64, 50, 1 << 14
    batches = [
        pa.table(
            {
                "_sd_batch": [b] * size,
                "_sd_id": list(range(b, len(texts), len(texts) // size)),
                "_sd_text": pa.array(texts[b :: len(texts) // size], pa.binary()),
            }
        )
        for b in range(len(texts) // size)
    ]
    anchors = pa.concat_tables([suffix_dedup._send_anchors(length, 1)(x) for x in batches])
    placed = suffix_dedup._assign_places(places, length, limit)(anchors)
    by_batch = [placed.filter(pc.equal(placed["_sd_batch"], b)) for b in range(len(batches))]
    pieces = pa.concat_tables(
        [suffix_dedup._cut_pieces(length, 1, places)(x, y) for x, y in zip(batches, by_batch)]
    )
    held = {}
    for place, own, seen in zip(*(pieces[c].to_pylist() for c in ("_sd_place", "pieces", "seen"))):
        if place >= 0:
            held[place] = held.get(place, 0) + sum(map(len, own)) + sum(map(len, seen))
    assert max(held.values()) < 0.05 * sum(held.values())
    found = {b: [np.zeros((0, 3), np.int64)] for b in range(len(batches))}
    for place in pieces["_sd_place"].unique().to_pylist():
        repeats = suffix_dedup._find_repeats(length, places)(pieces.filter(pc.equal(pieces["_sd_place"], place)))
        for b, spans in zip(repeats["_sd_batch"].to_pylist(), repeats["found"].to_pylist()):
            found[b].append(np.frombuffer(spans, np.int64).reshape(-1, 3))
    marked = {}
    for b, spans in found.items():
        for w, start, end in np.concatenate(spans).tolist():
            marked.setdefault(batches[b]["_sd_id"][w].as_py(), set()).update(range(start, end))
    first = {}
    for i, text in enumerate(texts):
        for k in range(len(text) - length + 1):
            first.setdefault(text[k : k + length], i)
    for i, text in enumerate(texts):
        starts = [k for k in range(len(text) - length + 1) if first[text[k : k + length]] < i]
        assert marked.get(i, set()) == {k + j for k in starts for j in range(length)}


def test_a_passage_whose_strings_fit_in_a_place_is_sent_in_pieces():
    """Strings are sent one by one only where the pieces would overfill a place."""
    rng = random.Random(7)
    passage = "this passage stands in many of the documents, between words of their own that no other has"
    texts = [f"{rng.getrandbits(200):x}{passage}{rng.getrandbits(200):x}".encode() for _ in range(3000)]
    batch = pa.table({"_sd_batch": [0] * 3000, "_sd_id": list(range(3000)), "_sd_text": pa.array(texts, pa.binary())})
    anchors = suffix_dedup._send_anchors(50, 1)(batch)
    sent = {}
    for limit in (suffix_dedup.PLACE_BYTES, 1 << 14):
        placed = suffix_dedup._assign_places(64, 50, limit)(anchors)
        pieces = suffix_dedup._cut_pieces(50, 1, 64)(batch, placed)
        assert pieces.schema.names == ["_sd_place", "_sd_batch", "pieces", "seen"]
        sent[limit] = [x for own in pieces["pieces"].to_pylist() for x in own]
    assert sum(map(len, sent[suffix_dedup.PLACE_BYTES])) < sum(map(len, texts))
    assert sum(map(len, sent[1 << 14])) > 2 * sum(map(len, texts))


def test_repeats_of_a_place_are_listed_by_batch_without_a_pass_over_pieces(monkeypatch):
    """Several occurrences of a piece, in several batches, each with the spans of its first one."""
    first = b"a" * 5 + b"bcdefghijk" + b"m" * 5
    other = b"bcdefghijk"
    seen = lambda *rows: np.array(rows, np.int64).tobytes()
    table = pa.table(
        {
            "_sd_place": [3, 3],
            "_sd_batch": [7, 9],
            "pieces": pa.array([[first, other], [first]], pa.list_(pa.binary())),
            "seen": pa.array([[seen((5, 0, 0), (5, 1, 30)), seen((4, 2, 8))], [seen((5, 3, 1), (6, 4, 2))]], pa.list_(pa.binary())),
        }
    )
    monkeypatch.setattr(suffix_dedup, "_table", lambda *_: pytest.fail("rows are made one by one"))
    repeats = suffix_dedup._find_repeats(10, 64)(table)
    got = {b: sorted(map(tuple, np.frombuffer(x, np.int64).reshape(-1, 3).tolist())) for b, x in zip(repeats["_sd_batch"].to_pylist(), repeats["found"].to_pylist())}
    assert got == {7: [(0, 5, 15), (1, 35, 45)], 9: [(3, 6, 16), (4, 2, 22)]}


def test_kept_texts_hold_whole_characters(spark):
    shared = "é" * 40
    rows = [(1, "a" + shared), (2, "ñ" + shared + "ü"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs).collect()}
    assert kept == {1: "a" + shared, 2: "ñü", 3: None}


def fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    codes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), 42) for k in range(len(words) - width + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(c >> bit & 1 for c in codes) > len(codes))


def near_classes(rows, shingle=3, bits=3):
    prints = [fingerprint(t, shingle) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in set(group)}
    return sorted(((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group)), key=str)


def near_rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(80):
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        rows.append((k, " ".join(text)))
        for j in range(rng.randint(0, 4)):
            text = list(text)
            text[rng.randrange(len(text))] = f"x{j}"
            rows.append((200 + k * 5 + j, " ".join(text)))
    return rows + [(9000, None), (9001, ""), (None, ""), (9003, "a b"), (9003, "a b"), (9004, "A  b"), (None, "zz zz zz zz")]


@pytest.mark.parametrize("bits", [0, 1, 3, 6])
def test_simhash_classes_equal_all_pairs(spark, bits):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs, max_bits=bits).collect()), key=str)
    assert got == near_classes(rows, bits=bits)


@pytest.mark.parametrize("bits, sent", [(3, 100_000), (3, 0), (5, 100_000)])
def test_fingerprints_with_a_common_half_are_filed_by_their_other_bits(spark, monkeypatch, bits, sent):
    monkeypatch.setattr(simhash, "HEAVY", 20)
    monkeypatch.setattr(simhash, "SENT_FILES", sent)
    rng = random.Random(bits)
    half, prints = 0xC0FFEE11, set()
    while len(prints) < 900:
        near = half ^ (1 << rng.randrange(32) if rng.random() < 0.4 else 0)
        value = rng.choice([near << 32 | rng.getrandbits(32), rng.getrandbits(32) << 32 | near])
        prints.add(value)
        for _ in range(rng.randrange(3)):
            for bit in rng.sample(range(64), rng.randint(1, bits + 1)):
                value ^= 1 << bit
            prints.add(value)
    prints = np.array(sorted(prints), np.uint64)
    group = np.arange(len(prints))
    for k, value in enumerate(prints):
        for g in np.unique(group[np.bitwise_count(prints ^ value) <= bits]):
            group[group == g] = group[k]
    rows = [(int(x),) for x in prints.view(np.int64)]
    table = spark.createDataFrame(rows, "print long")
    got = {r.vertex: r.root for r in simhash.components(simhash.linked(table, bits)).collect()}
    signed = prints.view(np.int64)
    want = {int(x): int(signed[group == g].min()) for x, g in zip(signed, group) if (group == g).sum() > 1}
    assert got == want and len(want) > 300
    files, count = simhash.filed(table, bits)
    largest = files.groupBy("segment", "file").count().agg({"count": "max"}).first()[0]
    assert largest < 200 and files.count() <= 2 * count


def test_one_of_each_class_stays(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, {c for _, _, c in near_classes(rows)}))


def test_components_without_an_id_or_with_the_same_one_stay_apart(spark):
    rng = random.Random(8)
    texts = [" ".join(f"t{k}w{rng.randint(0, 999)}" for _ in range(60)) for k in range(9)]
    rows = [(None, t) for t in texts[:5]] + [(None, texts[0]), (3, texts[5]), (3, texts[6]), (3, texts[5])]
    rows += [(4, texts[7]), (None, texts[7]), (5, texts[8]), (4, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    ids = [None] * 5 + [3, 3, 4, 4]
    assert kept == sorted(zip(ids, texts), key=str)


def test_fingerprints_use_the_hash_of_the_sql_function(spark):
    text = "One two  three\tFOUR"
    row = spark.sql("select xxhash64('one two three') a, xxhash64('two three four') b").first()
    codes = [row.a & (1 << 64) - 1, row.b & (1 << 64) - 1]
    assert simhash.text_fingerprint(text.encode(), 3) & (1 << 64) - 1 == codes[0] & codes[1]


def test_long_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r.vertex: r.root for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
