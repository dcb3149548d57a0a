"""The pipeline against its stages, computed plainly on a small table."""

import random

import corpus_pipeline
from speechloom.llm import decontamination, quality_rules
from test_duplicates import near_classes


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules",
        "SimHash near-dedup",
        "suffix-array dedup",
        "benchmark decontamination",
        "mixing sources",
    ]


def plain_passages(rows, length=50):
    """Texts of ASCII letters without the bytes under a string of an earlier row."""
    first = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            first[t[k : k + length]] = min(first.get(t[k : k + length], i), i)
    out = []
    for i, t in rows:
        gone = set()
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone.update(range(k, k + length))
        out.append((i, "".join(c for k, c in enumerate(t) if k not in gone)))
    return out


def test_run_equals_plain_stages(spark, tmp_path):
    rng = random.Random(9)
    words = [f"word{a}{b}" for a in "abcdefgh" for b in "ijklmnop"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    item, passage = prose(20), prose(60)
    texts = [prose(rng.randint(60, 150)) for _ in range(40)]
    texts += [texts[0], texts[1].replace("worda", "wordz", 1), "too short", "x " * 40, "### " * 30 + prose(30)]
    texts += [prose(80) + " " + passage + " " + prose(80) for _ in range(4)]
    texts += [prose(60) + " " + item + " " + prose(60)]
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model_rows = quality_rules.assess(docs).collect()
    left = [(i, texts[i]) for i in sorted(r.doc_id for r in model_rows if r.kept)]
    assert not {42, 43} & {i for i, _ in left} and len(left) > 40
    roots = {c for _, _, c in near_classes(left)}
    left = plain_passages([(i, t) for i, t in left if i in roots])
    items = decontamination.Items([(1, item)], 5)
    left = [(i, t) for i, t in left if all(m < 0.8 * n for _, _, m, n in decontamination.overlaps(t, items))]
    assert {i: len(t.split()) for i, t in left} == {i: r.size for i, r in got.items()}
    assert 49 not in got and 40 not in got
    for source in {f"s{k}" for k in range(4)}:
        own = [r for r in got.values() if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3 * 128
        assert all(0 <= r.taken <= 3 * r.size for r in own)
