"""The conversation trie, token files and the Merkle manifest against plain computations."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_data import messy_documents, with_clashes

from speechloom.llm import merkle, prefix_trie, token_files
from speechloom.llm.perfect_hash import PerfectHash

MESSAGES = "conv_id long, turn long, role string, text string"


def test_perfect_hash_gives_every_key_a_slot():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64), axis=0)
        hashed = PerfectHash(keys)
        assert sorted(hashed.slots) == list(range(len(keys)))
        assert (hashed.lookup(keys) == hashed.slots).all()
        others = keys + np.uint64(1)
        assert (hashed.lookup(others) == -1).all()
    # keys that share one half
    keys = np.array([(0, k) for k in range(100)] + [(k, 0) for k in range(1, 100)], np.uint64)
    assert sorted(PerfectHash(keys).slots) == list(range(199))
    with pytest.raises(ValueError):
        PerfectHash(np.array([(1, 2), (1, 2)], np.uint64))


def plain_trie(rows, rebuild):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, code[:32]), (role, text)))
    own = {c: [m for _, m in sorted(turns)] for c, turns in own.items()}
    nodes = defaultdict(list)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
        for d in range(len(built[c]) + 1):
            nodes[tuple(built[c][:d])].append(c)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(o) == len(n) + 1 and o[: len(n)] == n for o in nodes)]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(members) if tuple(built[c]) == node)
        parent = min(nodes[node[:-1]]) if node else None
        out.append((min(members), len(node), parent, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(messages, rebuild):
    rows = prefix_trie.coded(messages)
    rows = prefix_trie.rebuilt(rows) if rebuild else prefix_trie.as_they_are(rows)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in prefix_trie.node_table(rows).select(*names).collect()), key=str)


def conversations():
    rng = random.Random(3)
    rows = [(c, t, rng.choice("ua"), rng.choice(["yes", "no", "é" * 3])) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(c, t, "u", f"copy {t}") for c in range(300, 340) for t in range(3)]
    rows += [(500, t, None, f"long {t}") for t in range(40)] + [(501, t, None, f"long {t}") for t in range(39)]
    rows += [(700, None, "u", None), (700, None, "u", None), (700, 0, None, ""), (None, 1, "u", "x"), (None, None, None, None)]
    rows += [(-7, 1, "u", "below zero"), (800, 5, "a", "b" * 100_000), (900, 1, "u1", ":x"), (901, 1, "u", "1:x")]
    return rows


@pytest.mark.parametrize("rebuild, sizes", [(False, (6, 1024, 1 << 16)), (True, (2, 4, 7)), (False, (1, 8, 3))])
def test_trie_equals_a_plain_one(spark, monkeypatch, rebuild, sizes):
    for name, value in zip(("TIER_BITS", "DEPTHS", "PIECE"), sizes):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = conversations()
    messages = with_clashes(spark.createDataFrame(rows, MESSAGES))
    assert trie_rows(messages.repartition(5), rebuild) == plain_trie(rows, rebuild)


def test_trie_of_nothing(spark):
    for rows in ([], [(None, 1, "u", "x")]):
        assert trie_rows(spark.createDataFrame(rows, MESSAGES), True) == []


def test_a_conversation_may_have_no_turns_left(spark):
    conv = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(conv, 0, "u", "only turn"), (conv, 1, "a", "second")]
    got = trie_rows(spark.createDataFrame(rows, MESSAGES), True)
    assert got == plain_trie(rows, True) and len(got) == 1 and got[0][5] == 1


# -------------------------------------------------------------- token files


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


UNTIDY = [
    "", " ", "\n\t ", "Hello  WORLD's don't", "a b c\u0085d", "é ́x", "x̣́ y", "ẞİ ΣΑΣ ΟΔΟΣ.",
    "<|endoftext|>", "a<|startoftext|>b c", "日本語 のテキスト 한국어", "x" * 5000, "1234 56,7 ½ ²", "😀😀 👩‍👩‍👧", "\x00a\x1cb\x1fc", "'s 't 're've",
]


def test_encoding_by_words_equals_encoding_of_whole_texts(vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    rng = random.Random(4)
    pieces = [*"abcéÀİſßªKÅǅ '.,!?0129-<|>\n\t \u2019\u00a0\u0301\u0327\u0331日", "ing", "the ", "'ll", "H", "T", "<|endoftext|>"]
    chars = [chr(c) for c in [*range(1, 0x3000), *range(0xA000, 0xA100), *range(0xF900, 0x10000)]]
    texts = UNTIDY + [f"a{c}b {c}, {c}{c}.x-{c}9" for c in chars] + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    monkeypatch.setattr(token_files, "KEPT_RUNS", 500)
    with open(vocabulary, encoding="utf-8") as file:
        encoder = token_files.Encoder(file.read())
    expected = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for size in (97, len(texts)):
        got = []
        for k in range(0, len(texts), size):
            # a slice of a longer array, as portions of a batch are
            got += encoder.encode_texts(pa.array(["z", *texts[k : k + size], None]).slice(1), 2).to_pylist()[:-1]
        assert got == expected
    assert encoder.encode_texts(pa.array([None, ""], pa.string()), None).to_pylist() == [[], []]


def test_portions_hold_every_row_once():
    rows = ["a" * k for k in (0, 5, 0, 30, 1, 1, 9, 9)]
    batch = pa.RecordBatch.from_pydict({"t": rows + [None]})
    parts = list(token_files.by_bytes(batch, "t", 10))
    assert [t for p in parts for t in p.column("t").to_pylist()] == rows + [None]
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("t").to_pylist()) <= 10 for p in parts)


def test_token_files_round_trip(spark, tmp_path, vocabulary):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    docs = with_clashes(messy_documents(spark)).repartition(5)
    path = f"{tmp_path}/tokens"
    token_files.write(docs, path, vocabulary, end=2, beside=("source", "odd name-1"))
    rows = token_files.read(spark, path).collect()
    ids = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 2]
    texts = [(r.doc_id, ids(r.text)) for r in docs.collect()]
    assert sorted(((r.doc_id, r.tokens) for r in rows), key=str) == sorted(texts, key=str)
    # Places: in the order of ids, each after all before it.
    got = sorted(token_files.digest(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in texts), key=lambda i: (i is None, i))
    at = 0
    left = defaultdict(list)
    for i, t in texts:
        left[i].append((len(t), zlib.crc32(np.array(t, "<u4").tobytes())))
    for r in got:
        assert r.start == at
        left[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    # Some documents or the columns beside the tokens are read without the rest.
    few = token_files.read(spark, path).where("doc_id = 7").select("n_tokens")
    plan = few._jdf.queryExecution().toString()
    assert few.count() == 1 and "EqualTo(doc_id,7)" in plan
    assert "tokens" not in plan.split("ReadSchema: ")[1].split("\n")[0].replace("n_tokens", "")


def test_token_files_have_small_pages_with_an_index(spark, tmp_path, vocabulary):
    import pyarrow.parquet as pq

    path = f"{tmp_path}/tokens"
    token_files.write(messy_documents(spark), path, vocabulary)
    for file in tmp_path.glob("tokens/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for k in range(meta.num_row_groups):
            columns = {meta.row_group(k).column(c).path_in_schema: meta.row_group(k).column(c) for c in range(meta.num_columns)}
            assert all(c.has_offset_index for c in columns.values())
            assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
            assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings


def test_token_files_of_nothing(spark, tmp_path, vocabulary):
    path = f"{tmp_path}/tokens"
    token_files.write(messy_documents(spark).limit(0), path, vocabulary)
    assert token_files.digest(spark, path).collect() == []


# ----------------------------------------------------------------- manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    fields = (r.doc_id, r.source, r.lang, r.n_chars, text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, at):
    path = []
    for level in levels[:-1]:
        run = at - at % 16
        path.append((level[run:at], level[at + 1 : run + 16]))
        at //= 16
    return path


def plain_manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append((r.doc_id is None, r.doc_id or 0, plain_leaf(r, r.text), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (rows := sorted(sources[s], key=lambda x: x[:3]), plain_tree([x[2] for x in rows])) for s in order}
    top = plain_tree([trees[s][1][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        rows, levels = trees[s]
        for at, (_, _, leaf, r) in enumerate(rows):
            path = plain_path(levels, at) + plain_path(top, place)
            change = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if change else r.text
            node = plain_leaf(r, lower)
            for left, right in path:
                node = digest(*left, node, *right)
            proof = digest(*(x for left, right in path for x in (*left, *right)))
            out.append((r.doc_id, leaf, levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(docs):
    return sorted((tuple(r) for r in merkle.verified(docs, claims={"text": merkle.tampered_text()}).collect()), key=str)


def test_manifest_equals_a_plain_one(spark):
    rng = random.Random(5)
    rows = []
    for source, n in (("a", 1), ("b", 16), ("c", 17), (None, 300), ("", 2), ("é", 40), ("Z", 5), *((f"s{k}", 1) for k in range(30))):
        rows += [(len(rows) + rng.choice([0, 0, 5]), "".join(rng.choice("aBcD é") for _ in range(9)), "en", source, 9) for _ in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest_rows(with_clashes(docs).repartition(7))
    assert got == plain_manifest(docs.collect())
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_untidy_rows(spark):
    docs = messy_documents(spark)
    assert manifest_rows(docs) == plain_manifest(docs.collect())
    one = docs.limit(1)
    assert manifest_rows(one) == plain_manifest(one.collect())
    assert manifest_rows(docs.limit(0)) == []


def test_nodes_cover_their_ranks(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "'s' as source", "1 as n_chars")
    below, top = merkle.manifest(merkle.leaves(docs))
    rows = sorted((r.level, r.lo, r.hi) for r in merkle.nodes(below).collect())
    expected = [(1, k, min(k + 16, 300)) for k in range(0, 300, 16)] + [(2, 0, 256), (2, 256, 300), (3, 0, 300)]
    assert rows == expected
    assert merkle.nodes(top).count() == 1
