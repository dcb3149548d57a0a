"""Tiling, rules, licences, URLs and quotes against plain computations."""

import random
import re
import textwrap
import time
from collections import Counter

import numpy as np
import pytest

from speechloom.llm import decontamination as dc
from speechloom.llm import license_scan, quality_rules, quotation, url_filter


def naive_tiles(a, b, least):
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = None
        for j in range(len(b)):
            for i in range(len(a)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return tiles
        tiles.append(best)
        used_a.update(range(best[0], best[0] + best[2]))
        used_b.update(range(best[1], best[1] + best[2]))


def test_tiling_equals_a_plain_search():
    rng = random.Random(2)
    for trial in range(300):
        letters = "abc" if trial % 2 else "abcdefgh"
        b = [rng.choice(letters) for _ in range(rng.randint(1, 25))]
        a = [rng.choice(letters + "z") for _ in range(rng.randint(0, 30))]
        if trial % 3 == 0 and len(b) > 6:
            a = [*a, *b[5:], "z", *b[:5]]
        tiles = naive_tiles(a, b, min(3, len(b)))
        got = dc.overlaps(" ".join(a), dc.Items([(1, " ".join(b))], 3))
        assert got == ([(0, len(tiles), sum(t[2] for t in tiles), len(b))] if tiles else [])


def test_tiles_of_many_items_at_once():
    rng = random.Random(5)
    for _ in range(60):
        items = [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 18))) for _ in range(6)]
        doc = " ".join(rng.choice(["a", "b", "c d", "x", rng.choice(items)]) for _ in range(12))
        for coverage in (0.0, 0.5, 0.8):
            want = []
            for number, item in enumerate(items):
                b = item.split()
                tiles = naive_tiles(doc.split(), b, min(4, len(b)))
                matched = sum(t[2] for t in tiles)
                if tiles and matched >= coverage * len(b):
                    want.append((number, len(tiles), matched, len(b)))
            assert dc.overlaps(doc, dc.Items(list(enumerate(items)), 4), coverage) == want


def test_hashes_that_collide_lay_no_tiles(monkeypatch):
    # Without the factor all codes spread alike: every window has the same hash.
    monkeypatch.setattr(dc, "SPREAD", np.uint64(0))
    a, b = "x a b c d e y f g h i j".split(), "f g h i j a b c d e".split()
    tiles = naive_tiles(a, b, 3)
    got = dc.overlaps(" ".join(a), dc.Items([(1, " ".join(b))], 3))
    assert got == [(0, len(tiles), sum(t[2] for t in tiles), len(b))]


def test_a_text_of_one_word_over_and_over():
    items = dc.Items([(1, "a " * 400)], 5)
    start = time.perf_counter()
    assert dc.overlaps("a " * 20_000, items, 0.8) == [(0, 1, 400, 400)]
    assert time.perf_counter() - start < 1


def test_rearranged_items_are_found_in_every_block(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 40)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(9)]
    turned = [(100 + k, f"Start, {' '.join(t.split()[6:])}! middle {' '.join(t.split()[:6]).upper()}.") for k, t in items]
    part = [(200, " ".join(items[0][1].split()[:8]))]
    docs = spark.createDataFrame(turned + part, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tiles, r.coverage) for r in dc.leaks(docs, bench).collect()}
    assert got == {(100 + k, k): (2, 1.0) for k in range(9)}
    assert [r.doc_id for r in dc.keep_clean(docs, bench).collect()] == [200]


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen, marked = Counter(windows), [0] * len(words)
    for k, window in enumerate(windows):
        if seen[window] > 1:
            marked[k : k + 5] = [1] * 5
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(marked))


def test_measures_equal_plain_ones(spark):
    rng = random.Random(3)
    texts = [None, "", "    ", "a\x0bb\x0cc\x1fd\u0085e", "x " * 12, "x " * 5]
    for _ in range(300):
        texts.append("".join(rng.choice(["a ", "b ", "é ", "#", "\n", "  ", "c\t", "A.", "|"]) for _ in range(rng.randint(0, 60))))
    for text in texts:
        assert quality_rules.measure(text)[:5] == tuple(plain_measures(text)), repr(text)
    rows = quality_rules.assess(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        n, _, _, _, repeated = plain_measures(texts[r.doc_id])
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (r.base_failed and r.kept)


def test_rules_tell_the_labels_apart(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = quality_rules.assess(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    known = [(labels[r.doc_id], r) for r in rows if r.doc_id in labels and not r.base_failed]
    good = [r.kept for q, r in known if q == 1]
    bad = [r.kept for q, r in known if q == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


@pytest.mark.parametrize("share", [0.05, 0.2, 0.5, 0.8, 0.97])
def test_estimation_recovers_the_rates(share):
    rng = random.Random(4)
    alarm, false_alarm, counts = (0.6, 0.5, 0.4, 0.5), (0.02, 0.01, 0.03, 0.02), Counter()
    for _ in range(20000):
        bad = rng.random() >= share
        counts["".join("b" if rng.random() < (x if bad else y) else "g" for x, y in zip(alarm, false_alarm))] += 1
    model = quality_rules.fit(counts, 4)
    assert model.prior == pytest.approx(share, abs=0.03)
    assert model.alarm == pytest.approx(alarm, abs=0.11 if share > 0.9 else 0.06)
    assert model.false_alarm == pytest.approx(false_alarm, abs=0.05 if share < 0.1 else 0.02)
    odds = share / (1 - share) * 0.02 / 0.6 * 0.99 / 0.5 * 0.97 / 0.6 * 0.98 / 0.5
    assert model.probability("bggg") == pytest.approx(odds / (1 + odds), abs=0.15)
    assert model.probability("bbbb") < 0.02 and model.probability("gggg") > model.probability("bggg")
    assert model.probability("----") == pytest.approx(model.prior)


def test_licence_families():
    model = license_scan.fit(["the quick brown fox jumps over the dog", "the terms of the contract"])

    def families(text):
        return [(n[3], n[6]) for n in license_scan.notices(text, model)]

    assert families("x\nLicensed under the Apache License, Version 2.0.\ny") == [("apache-2.0", True)]
    assert families("Released under the MIT License.") == [("mit", True)]
    assert families("Licensed under CC BY-SA 4.0.") == [("cc-by-sa-4.0", True)]
    assert families("This work is licensed under the GNU General Public License, version 3.") == [("gpl-3.0", True)]
    assert families("All rights reserved.\nThe license plate of the car") == []
    assert families(None) == families("") == []


def test_wrapped_and_several_licences():
    model = license_scan.fit(["the quick brown fox jumps over the dog", "the terms of the contract"])

    def found(text):
        return [(text[n[1] : n[2]], n[3]) for n in license_scan.notices(text, model) if n[6]]

    for family, templates in license_scan.TEMPLATES.items():
        for template in templates:
            for width, mark in ((72, ""), (40, " * ")):
                notice = textwrap.fill(template, width, initial_indent=mark, subsequent_indent=mark)
                text = f"Some code.\n\nCopyright 2020 by us.\n{notice}\nThe cat sat on the mat.\n\nIt went home."
                assert found(text) == [(notice, family)], (family, notice)
                assert len(license_scan.notices(text, model)) == 1
    lesser = (
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser"
        " General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License,"
        " or (at your option) any later version."
    )
    assert {family for _, family in found(lesser)} == {"lgpl"}
    for line, families in (
        ("SPDX-License-Identifier: MIT OR Apache-2.0", {"mit", "apache-2.0"}),
        ("Licensed under the MIT License or the Apache License, Version 2.0.", {"mit", "apache-2.0"}),
        ("Licensed under the BSD 3-Clause License. Licensed under CC BY 4.0.", {"bsd", "cc-by-4.0"}),
        ("word " * 500 + "Licensed under CC BY-SA 4.0. " + "word " * 500, {"cc-by-sa-4.0"}),
    ):
        assert {family for _, family in found(line)} == families, line[:60]


def test_near_misses_are_not_confirmed():
    model = license_scan.fit(["the quick brown fox jumps over the dog", "the terms of the contract"])
    wrapped = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version."
    planted = [
        ("SPDX-License-Identifier: ISC", {"isc"}),
        ("SPDX-License-Identifier: GPL-2.0-only", {"gpl-2.0"}),
        ("SPDX-License-Identifier: GPL-3.0-only", {"gpl-3.0"}),
        ("SPDX-License-Identifier: WTFPL", set()),
        ("SPDX-License-Identifier: MPL-1.1", set()),
        ("SPDX-License-Identifier: EPL-2.0", {"epl-2.0"}),
        (wrapped.format(2), {"gpl-2.0"}),
        (wrapped.format(3), {"gpl-3.0"}),
        (wrapped.format("two"), set()),
        ("the software is not licensed under the MIT License.", set()),
        ("It is no longer released under the Apache License, Version 2.0.", set()),
        ("Licensed under the Apache License, Version 1.1.", set()),
        ("Released under the MIT License, not under the GPL.", {"mit"}),
        ("Released under the ABC License.", set()),
        ("Released under the zlib License.", {"zlib"}),
        ("This is free and unencumbered software released into the public domain.", {"unlicense"}),
        ("We met at MIT and released the terms of the new license plate.", set()),
        ("He was granted permission, free of charge, to use the hall for any purpose.", set()),
    ]
    for text, families in planted:
        for around in ("{}", "Copyright 2020 by us.\n{}\nThe cat sat on the mat.", "first\n\n{}\n\nlast"):
            found = {n[3] for n in license_scan.notices(around.format(text), model) if n[6]}
            assert found == families, (text, found)


def test_licences_of_the_table_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {r.doc_id: len(re.findall(r"(?im)^.*licensed?\b.*$", r.text)) for r in docs.collect()}
    found = Counter(r.doc_id for r in license_scan.scanned(docs).where("confirmed").collect())
    assert found == Counter({k: n for k, n in lines.items() if n})


def plain_rule(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_rules_of_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in url_filter.judged(pages).collect():
        rest = urls[r.page_id].partition("://")[2]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        rule = plain_rule(host.lower(), path)
        assert (r.host, r.path, r.rule) == (host.lower(), path, rule and rule.text)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")


def test_labels_carry_over_to_like_templates(spark):
    blocked = [(k, f"http://a.com/de/x{k}/p{k}") for k in range(30)]
    rest = [(100 + k, f"http://b.org/q/{k}") for k in range(30)] + [(300 + k, f"http://a.com/xx/{k}") for k in range(5)]
    pages = spark.createDataFrame(blocked + rest, "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in url_filter.judged(pages).collect()}
    assert {verdicts[k] for k in range(30)} == {"block"} == {verdicts[300 + k] for k in range(5)}
    assert {verdicts[100 + k] for k in range(30)} == {"allow"}


def test_hosts_without_labels_are_allowed_however_many_others_are_blocked(spark):
    blocked = [(k, f"http://a.com/de/x{k}") for k in range(40)]
    rest = [(100 + k, f"http://b.net/en/{k}") for k in range(20)] + [(200, "http://c.net"), (201, None), (300, "http://a.com/xx")]
    pages = spark.createDataFrame(blocked + rest, "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judged(pages).collect()}
    assert rows[100].share >= url_filter.REJECT
    assert {rows[k].verdict for k, _ in rest} == {"allow", "block"}
    assert [k for k, _ in rest if rows[k].verdict == "block"] == [300]
    assert {rows[k].verdict for k, _ in blocked} == {"block"}


@pytest.mark.parametrize("depth", [0, 2, 5, 9])
def test_labels_that_differ_deep_in_a_path(spark, depth):
    """The segment that tells blocked from other pages may be at any depth."""
    rules = (url_filter.Rule("block", "s.com" + "/x" * depth + "/bad/"), url_filter.Rule("allow", "s.com" + "/x" * depth + "/good/"))
    start = "http://s.com" + "/x" * depth
    urls = [f"{start}/bad/{k}/a" for k in range(60)] + [f"{start}/good/{k}/a" for k in range(60)]
    urls += [f"{start}/fine/zz", f"{start}/good", f"{start}/bad", "http://s.com/" + "/".join(f"d{k}" for k in range(300))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {r.page_id: r for r in url_filter.judged(pages, rules).collect()}
    assert {rows[k].verdict for k in range(60)} == {"block"} and {rows[k].verdict for k in range(60, 120)} == {"allow"}
    assert [rows[k].verdict for k in (120, 121, 122)] == ["allow", "allow", "block"]
    assert rows[123].template.count("/") == 300


def test_filter_equals_its_sql_where_most_pages_are_blocked(spark, tmp_path):
    import duckdb
    from compare import differences, spark_rows, sql_rows

    from speechloom.llm.queries import ORACLE, QUERIES

    rng = random.Random(11)
    urls = [f"http://{h}.{t}/{l}/{'/'.join(rng.choice(['u', 'v', str(rng.randint(0, 99))]) for _ in range(rng.randint(0, 5)))}"
            for _ in range(900) for h, t, l in [(rng.choice("ab"), rng.choice(["com", "com", "com", "net", "org"]), rng.choice(["de", "de", "de", "xx", "fr"]))]]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = spark_rows(QUERIES["op4_url_filter"](spark, str(tmp_path)))
    assert differences(got, sql_rows(con, ORACLE["op4_url_filter"])) is None


def test_quotes_link_messages(spark):
    hello = "Hello there my friend, how are you?"
    rows = [
        (1, 0, hello + "\n\nSecond paragraph is here now."),
        (1, 1, f"> {hello}\nfine"),
        (1, 2, f"On Monday x wrote:\n> fine\n>> {hello}\n\ngood to hear"),
        (1, 3, ">second   PARAGRAPH is here now.\nyes"),
        (1, 4, "new topic"),
        (1, 5, "> not said\nok"),
        (1, 6, "> good to hear\n> > fine\nbye"),
        (2, 0, f"> {hello}\nother conversation"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "'u' as role")
    got = {(r.conv_id, r.turn): (r.thread, r.reply_to, r.depth, r.text) for r in quotation.formatted(messages).collect()}
    assert got == {
        (1, 0): (0, None, 0, rows[0][2]),
        (1, 1): (0, 0, 1, "fine"),
        (1, 2): (0, 1, 2, "good to hear"),
        (1, 3): (0, 0, 1, "yes"),
        (1, 4): (4, None, 0, "new topic"),
        (1, 5): (5, None, 0, "> not said\nok"),
        (1, 6): (0, 2, 3, "bye"),
        (2, 0): (0, None, 0, f"> {hello}\nother conversation"),
    }


def test_parts_of_paragraphs_and_deeper_quotes_link_messages(spark):
    long = "The train leaves at nine. We should meet in the hall before that, near the big clock. Bring your tickets and some water."
    rows = [
        (0, long),
        (1, "> We should meet in the hall before that, near the big clock.\na"),
        (2, "> The train leaves at nine. We should meet in the hall before that, near the big clock.\nb"),
        (3, "> hall before that, near the\n> big clock. Bring your\n> tickets and\nc"),
        (4, "Ships sail south\nvery slowly now\nbut they arrive at some time in the end"),
        (5, "> Ships sail south\n> very slowly now\nd"),
        (6, "> Bob wrote:\n>> Bring your tickets and some water.\ne"),
        (7, ">> but they arrive at some time in the end\nf"),
        (8, "> Nobody has ever said these words in the hall before that\ng"),
        (9, "> Sheep graze on hills and near ponds\n>\n> tickets and some water.\nh"),
    ]
    messages = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, text string").selectExpr("*", "'u' as role")
    got = {r.turn: r.reply_to for r in quotation.formatted(messages).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 0, 4: None, 5: 4, 6: 0, 7: 4, 8: None, 9: 0}


def test_marked_lines_that_quote_nothing_stay(spark):
    said = "The build fails on my machine since this morning."
    rows = [
        (0, said),
        (1, "Try this:\n>>> print(1)\n1\nworks"),
        (2, "Use\n> npm install\nthen run"),
        (3, f"On Monday x wrote:\n> {said}\n\nTry\n> npm install\n\nand\n>  {said}\nagain"),
        (3, f"> nobody said this here\nother row of the turn\n> {said}"),
        (4, "On Monday x wrote:\n> nobody has said these words\nodd"),
        (5, ""), (6, None), (7, "a > b"),
    ]
    messages = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, text string").selectExpr("*", "'u' as role")
    got = sorted(((r.turn, r.reply_to, r.text) for r in quotation.formatted(messages).collect() if r.text is not None), key=lambda x: (x[0], x[2]))
    assert got == [
        (0, None, said), (1, None, rows[1][1]), (2, None, rows[2][1]),
        (3, 0, "> nobody said this here\nother row of the turn"), (3, 0, "Try\n> npm install\n\nand\nagain"),
        (4, None, rows[5][1]), (5, None, ""), (7, None, "a > b"),
    ]


def test_planted_quotes_are_linked(spark):
    """Replies that quote an earlier message, whole or in part, wrapped or not."""
    rng = random.Random(12)
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows, planted = [], {}
    for conv in range(40):
        texts = []
        for turn in range(8):
            text = "\n\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(8, 30))).capitalize() + "." for _ in range(rng.randint(1, 3)))
            texts.append(text)
            if turn and rng.random() < 0.6:
                answered = rng.randrange(turn)
                quote = rng.choice(texts[answered].split("\n\n"))
                if rng.random() < 0.5:
                    quote = textwrap.fill(quote, 40)
                if rng.random() < 0.3:
                    quote = " ".join(quote.split()[2:])
                planted[conv, turn] = answered
                text = "\n".join("> " + line for line in quote.split("\n")) + "\n\n" + text
            rows.append((conv, turn, "u", text))
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotation.formatted(messages).collect()}
    linked = {k: r.reply_to for k, r in got.items() if r.reply_to is not None}
    assert linked == planted and len(planted) > 100
    assert not any(r.text.startswith(">") for r in got.values())


def test_long_chains_of_replies(spark):
    rows = [(1, 0, "message number zero says this")]
    rows += [(1, k, f"> message number {'zero' if k == 1 else k - 1} says this\nmessage number {k} says this") for k in range(1, 40)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "'u' as role")
    for r in quotation.formatted(messages).collect():
        assert (r.thread, r.depth) == (0, r.turn)
