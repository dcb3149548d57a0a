"""Small tables with every kind of untidy row."""

import random

LONG = "lorem ipsum dolor sit amet " * 4000

# Extra columns that have names the operators use themselves.
CLASHES = {
    "size": "7L",
    "kept": "'mine'",
    "spans": "array(1)",
    "n_words": "1",
    "votes": "'x'",
    "fingerprint": "'f'",
    "component_id": "1",
    "score": "0.5D",
    "host": "'h'",
    "thread": "1",
    "number": "1",
    "block": "1",
    "row": "1",
    "label": "1",
    "odd name-1": "2",
}


def with_clashes(df):
    return df.selectExpr("*", *[f"{value} as `{name}`" for name, value in CLASHES.items()])


def messy_documents(spark):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(60)]
    rows = [
        (k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) + ".", "en", f"s{k % 3}")
        for k in range(40)
    ]
    rows += [
        (100, None, None, None),
        (101, "", "en", "s0"),
        (102, " \t\n", "en", None),
        (103, LONG, "en", "s1"),
        (104, LONG + "end", "en", "s1"),
        (None, "a text without an id that is long enough to be a passage of its own, of more than fifty bytes", "en", "s0"),
        (None, "a text without an id that is long enough to be a passage of its own, of more than fifty bytes", "en", "s0"),
        (None, None, None, None),
        (105, rows[0][1], "en", "s0"),
        (105, rows[0][1], "en", "s0"),
        (106, "éàü " * 30, "fr", "s2"),
        (3, "the same id as another row, and another text", "en", "s2"),
    ]
    return spark.createDataFrame(
        [(*r, None if r[1] is None else len(r[1])) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
