"""Chat formatting by quotation linking.

Messages are parsed into quote levels (leading ``>`` marks). What a message
quotes is hashed after normalising case and white space: as a whole, by
paragraph, by line, by sentence and by runs of words, which any line breaks and
any part of a paragraph leave alike. The hashes are joined to those of what
earlier messages of the conversation say themselves, which links each message to
the one it answers; deeper levels count only if the first has no original.
Following the links gives each message its thread; in the order of
thread and turn a message always comes after the one it answers. Quotes that have an
original, and the lines that announce them, are taken out of the texts; marked lines
that quote nothing that was said (a prompt, a command) stay.

A conversation is never gathered: hashes are counted and joined by conversation
and hash, and threads are found by following links in doubled steps.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.columns import batch_of, cut, portions, schema_of

MARKS = re.compile(r"^[ \t]*(?:>[ \t]?)+")
# How mail programs announce a quote.
ANNOUNCED = re.compile(
    r"^\s*(?:(?:On|Am|Le|El)\b.*\b(?:wrote|schrieb|écrit|escribió)\b.*:|-{2,}\s*Original Message\s*-{2,})\s*$",
    re.IGNORECASE,
)
# The same above a quote in a quote, where the rest may be lost.
ANNOUNCED_INSIDE = re.compile(r"\b(?:wrote|schrieb|écrit|escribió)\b.*:\s*$", re.IGNORECASE)
SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
PARAGRAPH_END = re.compile(r"\n\s*\n")
# A line or a sentence alone links messages only if it has so many words; runs
# have just so many.
LINE_WORDS = 4
# Units of a quote, from the strongest evidence to the weakest. Runs of words
# link if at least this share of a paragraph's was said before.
WHOLE, PARAGRAPH, LINE, SENTENCE, RUN = 0, 1, 2, 3, 4
RUN_SHARE = 0.5
# Hashes by which messages that nobody can quote are left out early.
BUCKETS = 1 << 20


def parsed(text: str | None) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of each line."""
    out = []
    for line in (text or "").split("\n"):
        marks = MARKS.match(line)
        level = marks.group().count(">") if marks else 0
        out.append((level, line[marks.end() :] if marks else line))
    return out


def blocks_of(lines: list[tuple[int, str]]) -> list[int]:
    """The quote each line belongs to: quotes are runs of marked lines, numbered from
    0; other lines have -1."""
    out, number = [], -1
    for k, (level, _) in enumerate(lines):
        number += bool(level) and (k == 0 or not lines[k - 1][0])
        out.append(number if level else -1)
    return out


def own_text(text: str | None, removed: set[int] | None = None) -> str | None:
    """A message without the quotes of these numbers (by default all) and the lines
    that announce them; blank lines that these leave at its ends are dropped. A null
    stays null, and a text none of whose quotes goes stays as it is."""
    lines = parsed(text)
    blocks = blocks_of(lines)
    gone = [block >= 0 and (removed is None or block in removed) for block in blocks]
    if not any(gone):
        return text
    kept = []
    for k, line in enumerate((text or "").split("\n")):
        if gone[k]:
            continue
        rest = (j for j in range(k + 1, len(lines)) if lines[j][0] or lines[j][1].strip())
        if not lines[k][0] and ANNOUNCED.match(line) and gone[next(rest, k)]:
            continue
        kept.append(line)
    return "\n".join(kept).strip("\n\r\t ")


def normalised(passage: str) -> str:
    return " ".join(passage.lower().split())


def units(lines: list[str], short: bool = False) -> list[tuple[int, str]]:
    """(kind, hash) of a passage as a whole, of its paragraphs, lines and
    sentences, each hash once with its strongest kind. Blank passages have none;
    those of lines and sentences with few words count only if ``short``."""
    found: dict[str, int] = {}

    def add(kind: int, passage: str) -> None:
        plain = normalised(passage)
        if plain and (short or kind < LINE or len(plain.split()) >= LINE_WORDS):
            found.setdefault(hashlib.md5(plain.encode()).hexdigest(), kind)

    add(WHOLE, "\n".join(lines))
    paragraphs = PARAGRAPH_END.split("\n".join(lines))
    for paragraph in paragraphs:
        add(PARAGRAPH, paragraph)
    for line in lines:
        add(LINE, line)
    for paragraph in paragraphs:
        for sentence in SENTENCE_END.split(paragraph):
            add(SENTENCE, sentence)
    return [(kind, code) for code, kind in found.items()]


def runs(passage: str) -> set[str]:
    """The runs of LINE_WORDS words of a normalised passage; long ones by hash."""
    words = normalised(passage).split()
    found = (" ".join(words[k : k + LINE_WORDS]) for k in range(len(words) - LINE_WORDS + 1))
    return {x if len(x) <= 64 else "run " + hashlib.md5(x.encode()).hexdigest() for x in found}


def said_codes(text: str | None) -> set[str]:
    """The hashes of what a message says itself."""
    own = own_text(text) or ""
    return {code for _, code in units(own.split("\n"), short=True)} | runs(own)


def quoted_units(text: str | None) -> list[tuple[int, int, int, int, int, str]]:
    """(level, kind, paragraph, its number of runs, quote, hash) of the units of every
    quote of a message. A quote of a level is made of lines with so many marks;
    those with more quote older messages, and do not part it. Paragraphs are
    numbered for runs of words only."""
    lines = parsed(text)
    told: list[tuple[int, str, int]] = []
    after = (0, "")
    for (level, line), block in zip(reversed(lines), reversed(blocks_of(lines))):
        inside = level and after[0] > level
        if not (inside and (ANNOUNCED.match(line) or ANNOUNCED_INSIDE.search(line))):
            told.append((level, line, block))
        if level and not line.strip():
            continue
        if level or line.strip():
            after = (level, line)
    told.reverse()
    out: list[tuple[int, int, int, int, int, str]] = []
    paragraphs = 0
    for own in sorted({level for level, _, _ in told if level}):
        found: dict[tuple[int, str], int] = {}
        run: list[str] = []
        quote = -1
        for level, line, block in [*told, (0, "", -1)]:
            if level == own:
                quote = block
                run.append(line)
            elif level < own and run:
                for kind, code in units(run):
                    found[quote, code] = min(kind, found.get((quote, code), kind))
                for paragraph in PARAGRAPH_END.split("\n".join(run)):
                    paragraphs += 1
                    codes = runs(paragraph)
                    out += [(own, RUN, paragraphs, len(codes), quote, code) for code in codes]
                run = []
        out += [(own, kind, 0, 0, quote, code) for (quote, code), kind in found.items()]
    return sorted(out)


def _parsed_rows(messages: DataFrame, values, kind: pa.DataType, ddl: str) -> DataFrame:
    """All columns but the text, and what a function of it gives, as ``found``."""
    kept = [c for c in messages.columns if c != "text"]

    def run(batches):
        for batch in portions(batches):
            found = [values(x) for x in batch.column("text").to_pylist()]
            table = pa.Table.from_batches([batch]).select(kept)
            yield from batch_of(table, {"found": pa.array(found, kind)}).to_batches()

    return messages.mapInArrow(run, schema_of(messages.select(*kept), f"found {ddl}"))


def _quoted(text: str | None) -> list[dict]:
    return [dict(zip(("level", "kind", "paragraph", "runs", "quote", "code"), x)) for x in quoted_units(text)]


def _said(text: str | None) -> list[str]:
    return sorted(said_codes(text))


def _bucket(*names: str):
    return F.pmod(F.xxhash64(*names), F.lit(BUCKETS))


def links(messages: DataFrame) -> DataFrame:
    """``conv``, ``turn`` and ``parent``, the turn it answers, of messages that
    quote an earlier one: the first level with an original decides, then the
    strongest unit, then the later original (for runs of words, that of most).
    What several messages say was first said by the earliest. ``quotes`` are those
    that have an original: hash of the message's text and number of the quote."""
    messages = messages.where("conv is not null and turn is not null")
    number = [(name, pa.int32()) for name in ("level", "kind", "paragraph", "runs", "quote")]
    quotes = _parsed_rows(
        messages.where(F.col("text").contains(">")).withColumn("own", F.xxhash64("text")),
        _quoted,
        pa.list_(pa.struct([*number, ("code", pa.string())])),
        "array<struct<level:int,kind:int,paragraph:int,runs:int,quote:int,code:string>>",
    )
    quotes = quotes.select("conv", "turn", "own", F.explode("found").alias("q"))
    quotes = cut(quotes.select("conv", "turn", "own", "q.*"))

    def only_quoted(rows: DataFrame, *names: str) -> DataFrame:
        known = quotes.select(_bucket(*names).alias("_bucket")).distinct()
        return rows.withColumn("_bucket", _bucket(*names)).join(
            F.broadcast(known), "_bucket", "left_semi"
        ).drop("_bucket")

    said = _parsed_rows(
        only_quoted(messages.select("conv", "turn", "text"), "conv"), _said, pa.list_(pa.string()), "array<string>"
    )
    said = said.select("conv", F.col("turn").alias("parent"), F.explode("found").alias("code"))
    first = only_quoted(said, "conv", "code").groupBy("conv", "code").agg(F.min("parent").alias("parent"))
    found = quotes.join(first, ["conv", "code"]).where("parent < turn")
    by = ["conv", "turn", "own", "quote", "level", "kind", "paragraph"]
    votes = found.groupBy(*by, "parent").agg(F.count("*").alias("n"), F.max("runs").alias("runs"))
    most = F.struct(F.when(F.col("kind") == RUN, F.col("n")).otherwise(F.lit(0)).alias("n"), "parent")
    units_found = votes.groupBy(*by).agg(
        F.sum("n").alias("all"), F.max("runs").alias("runs"), F.max(most).alias("most")
    )
    enough = (F.col("kind") != RUN) | (F.col("all") >= RUN_SHARE * F.col("runs"))
    rank = F.struct((-F.col("level")).alias("level"), (-F.col("kind")).alias("kind"), "most.n", "most.parent")
    # As many quotes as a message's text has.
    best = (
        units_found.where(enough)
        .groupBy("conv", "turn")
        .agg(F.max(rank).alias("best"), F.collect_set(F.struct("own", "quote")).alias("quotes"))
    )
    return best.select("conv", "turn", "best.parent", "quotes")


def threads(linked: DataFrame) -> DataFrame:
    """Adds to each link the ``thread`` (the turn that its chain of links ends
    at) and ``depth`` (how many links away it is)."""
    state = cut(linked.select("conv", "turn", F.col("parent").alias("up"), F.lit(1).alias("depth")))
    while True:
        above = state.select(
            "conv",
            F.col("turn").alias("up"),
            F.col("up").alias("next"),
            F.col("depth").alias("more"),
        )
        if state.join(above, ["conv", "up"], "left_semi").limit(1).count() == 0:
            break
        state = cut(
            state.join(above, ["conv", "up"], "left").select(
                "conv",
                "turn",
                F.coalesce("next", "up").alias("up"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            )
        )
    return linked.join(state.withColumnRenamed("up", "thread"), ["conv", "turn"])


def formatted(
    messages: DataFrame,
    conversation_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per message: conversation, turn, role, ``thread`` (turn of the
    first message of its thread), ``reply_to`` (turn it answers, or null),
    ``depth`` (0 for the first of a thread) and the text without the quotes that have
    an original.
    Conversations are in reply order by conversation, thread and turn.

    A message that quotes nothing that was said before starts a thread. A null
    conversation or turn links nothing; a null text says nothing and stays null.
    Rows that share conversation and turn are one message to the links: the best
    link of any of them holds for all. Other columns play no part. An empty table
    gives an empty table.
    """
    rows = messages.select(
        F.col(f"`{conversation_column}`").alias("conv"),
        F.col(f"`{turn_column}`").alias("turn"),
        F.col(f"`{role_column}`").alias("role"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
    )
    linked = cut(threads(links(rows.select("conv", "turn", "text"))))
    # Messages that cannot be one of these stay where they are, as they are.
    known = linked.select(_bucket("conv", "turn").alias("_bucket")).distinct().withColumn("_some", F.lit(True))
    marked = rows.withColumn("_bucket", _bucket("conv", "turn")).join(F.broadcast(known), "_bucket", "left")
    alone = marked.where("_some is null").select(
        *rows.columns, F.lit(None).cast(linked.schema["parent"].dataType).alias("parent"),
        F.col("turn").alias("thread"), F.lit(0).alias("depth"),
    )

    def strip(batches):
        for batch in portions(batches):
            texts = []
            columns = (batch.column(c).to_pylist() for c in ("text", "own", "quotes"))
            for text, own, quotes in zip(*columns):
                texts.append(own_text(text, {q["quote"] for q in quotes or () if q["own"] == own}))
            table = pa.Table.from_batches([batch])
            at = table.schema.get_field_index("text")
            yield from table.set_column(at, "text", pa.array(texts, pa.string())).drop(["own", "quotes"]).to_batches()

    some = (
        marked.where("_some")
        .drop("_bucket", "_some")
        .join(linked, ["conv", "turn"], "left")
        .select(*rows.columns, "parent", F.coalesce("thread", "turn").alias("thread"),
                F.coalesce("depth", F.lit(0)).alias("depth"), "quotes", F.xxhash64("text").alias("own"))
    )
    some = some.mapInArrow(strip, some.drop("quotes", "own").schema)
    return alone.unionByName(some).select(
        F.col("conv").alias(conversation_column),
        F.col("turn").alias(turn_column),
        F.col("role").alias(role_column),
        "thread",
        F.col("parent").alias("reply_to"),
        "depth",
        F.col("text").alias(text_column),
    )
