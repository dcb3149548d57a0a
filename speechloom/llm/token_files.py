"""Token ids in Parquet files: a row per document with a list of ids.

Documents are dealt by ranges of their id and encoded in order, so that files
follow one another by ``part`` and a document's ``first`` id in its part is known
when it is written. Ids go to disk through Spark's own writer, which commits a
task's files only when it is done. Token lists are dictionary coded, ids and counts
delta coded; row groups and pages are small, and pages are indexed, so that a few
documents or only the columns beside the tokens are read without the rest.

``start``, a document's place in the whole, comes from the sums of the parts before
its own: as many rows as there are files.

Texts are split at ASCII white space, which no token of this vocabulary crosses, and
every distinct word of a portion is given to the tokenizer library once
(``Encoder``); tests compare this with the library's encoding of whole texts.

A null text is empty. Documents without id come last; those with the same id stand
in the order of a hash of their texts. An empty table gives empty files.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from speechloom.llm.columns import schema_of

# Text that is split into words at a time, and runs of characters whose ids are kept.
PORTION_BYTES = 8 << 20
KEPT_RUNS, KEPT_CHARS = 400_000, 8 << 20

WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
}
DELTA = ("n_tokens", "first")


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(sizes.sum()) + np.repeat(starts - ends + sizes, sizes)


# The first character after the blocks of Latin letters.
LATIN = 0x250


class Encoder:
    """Token ids of texts, with the ids of words already seen.

    Of a word of Latin letters, digits and punctuation, the library's normalizer and
    pre-tokenizer make runs of letters in lower case, single digits and runs of
    punctuation, whatever stands beside them. Such runs go to the library's model,
    each once; all other words go through the library as they are.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        # Letters whose lower case is Python's, and what the library writes for their bytes.
        self.table, letters = {}, ""
        for code in range(0x21, LATIN):
            lower = self.tokenizer.normalizer.normalize_str(chr(code))
            alike = len(lower) == 1 and lower.isalpha() and ord(lower) < LATIN and lower == chr(code).lower()
            if chr(code).isalpha() and alike:
                letters += chr(code)
                self.table[ord(lower)] = self.tokenizer.pre_tokenizer.pre_tokenize_str(lower)[0][0]
        marks = re.escape("!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~")
        self.plain = f"^[{letters}0-9{marks}]+$"
        self.runs = re.compile(f"[{letters}]+|[0-9]|[{marks}]+|\n")
        self._forget()

    def _forget(self) -> None:
        # Words are put together with line ends between them, which have no ids.
        self.known, self.chars = {"\n": 0}, 0
        self.flat, self.bounds = np.zeros(0, np.int32), np.zeros(2, np.int64)

    def _slots(self, runs: list[str]) -> np.ndarray:
        """Where in ``bounds`` and ``flat`` the ids of each run stand."""
        distinct = set(runs)
        if len(self.known) + len(distinct) > KEPT_RUNS or self.chars > KEPT_CHARS:
            self._forget()
        new = list(distinct.difference(self.known))
        ids, sizes = [], []
        for run in new:
            found = self.model.tokenize(run.translate(self.table))
            ids += [t.id for t in found]
            sizes.append(len(found))
        self.known |= zip(new, range(len(self.known), len(self.known) + len(new)))
        self.chars += sum(map(len, new))
        self.flat = np.concatenate([self.flat, np.array(ids, np.int32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes, dtype=np.int64)])
        return np.fromiter(map(self.known.__getitem__, runs), np.int64, len(runs))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, and where each word's begin and how many there are."""
        plain = pc.match_substring_regex(words, self.plain)
        easy = words.filter(plain).to_numpy(zero_copy_only=False).tolist()
        slots = self._slots(self.runs.findall("\n".join([*easy, ""]).lower()))
        sizes = np.diff(self.bounds)[slots]
        ids = self.flat[_ranges(self.bounds[slots], sizes)]
        # Ids of a word are those between the line ends before and after it.
        upto = np.concatenate([[0], np.cumsum(sizes)[slots == 0]])
        rest = words.filter(pc.invert(plain)).to_pylist()
        own = [e.ids for e in self.tokenizer.encode_batch(rest, add_special_tokens=False)]
        plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        starts, counts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[plain], counts[plain] = upto[:-1], np.diff(upto)
        counts[~plain] = [len(i) for i in own]
        starts[~plain] = len(ids) + np.cumsum(counts[~plain]) - counts[~plain]
        return np.concatenate([ids, np.fromiter(chain.from_iterable(own), np.int32)]), starts, counts

    def encode_texts(self, texts: pa.Array, end: int | None = None) -> pa.ListArray:
        """The ids of every text, each with the id ``end`` after it. A null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        flat, starts, counts = self.words(coded.dictionary)
        word = coded.indices.to_numpy() if len(starts) else np.zeros(0, np.int64)
        size = counts[word]
        values = flat[_ranges(starts[word], size)]
        offsets = np.concatenate([[0], np.cumsum(size)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if end is not None:
            offsets = offsets + np.arange(len(offsets))
            own = np.ones(offsets[-1], bool)
            own[offsets[1:] - 1] = False
            ended = np.full(offsets[-1], end, np.int32)
            ended[own] = values
            values = ended
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def by_bytes(batch: pa.RecordBatch, column: str, limit: int):
    """The batch in portions of at most so many bytes of a text column, or a row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def _encoded(vocabulary, text: str, end: int | None):
    def encode(batches):
        if "encoder" not in vocabulary.value:
            vocabulary.value["encoder"] = Encoder(vocabulary.value["json"])
        encoder, first = vocabulary.value["encoder"], 0
        for batch in batches:
            for part in by_bytes(batch, text, PORTION_BYTES):
                tokens = encoder.encode_texts(part.column(text), end)
                sizes = np.diff(tokens.offsets.to_numpy()).astype(np.int64)
                firsts = first + np.cumsum(sizes) - sizes
                first += int(sizes.sum())
                rest = {n: part.column(n) for n in part.schema.names if n != text}
                yield pa.RecordBatch.from_pydict(rest | {"n_tokens": sizes, "first": firsts, "tokens": tokens})

    return encode


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end: int | None = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    beside: tuple[str, ...] = (),
) -> None:
    """Encode all documents and write them below ``path``, with the columns
    ``beside`` and ``part``, ``first`` and ``n_tokens``. ``tokenizer`` is the path of
    the library's file, which the driver reads and sends to the workers."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        # One object for all tasks of a worker process, which keeps its encoder there.
        vocabulary = spark.sparkContext.broadcast({"json": file.read()})
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    own = [F.col(f"`{c}`") for c in (id_column, *beside)]
    order = [F.asc_nulls_last(f"`{id_column}`"), F.xxhash64("_text")]
    rows = docs.select(*own, text.alias("_text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = schema_of(rows.drop("_text"), "n_tokens long, first long, tokens array<int>")
    encoded = rows.mapInArrow(_encoded(vocabulary, "_text", end), schema)
    options = WRITER | {f"parquet.enable.dictionary#{c}": "false" for c in (id_column, *DELTA)}
    encoded.withColumn("part", F.spark_partition_id()).write.options(**options).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written rows. Columns and documents that are not asked for stay unread."""
    return spark.read.parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``part`` and ``base``, the ids in all parts before it. Tokens are not read."""
    sums = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # A row per file.
    ahead = W.partitionBy(F.lit(1)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))


def _summed(batches):
    for batch in batches:
        tokens = batch.column("tokens")
        offsets = tokens.offsets.to_numpy()
        values = tokens.values.to_numpy(zero_copy_only=False).astype("<u4")
        sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        rest = {n: batch.column(n) for n in batch.schema.names if n != "tokens"}
        sizes = np.diff(offsets).astype(np.int64)
        yield pa.RecordBatch.from_pydict(rest | {"n_tokens": sizes, "ids_crc32": np.array(sums, np.int64)})


def digest(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """Per document, from the files: its id, ``start`` (ids of all before it),
    ``n_tokens`` and ``ids_crc32``, the checksum of its ids."""
    rows = read(spark, path).select(id_column, "part", "first", "tokens")
    schema = StructType([f for f in rows.schema.fields if f.name != "tokens"])
    summed = rows.mapInArrow(_summed, schema.add("n_tokens", "long").add("ids_crc32", "long"))
    return summed.join(starts(spark, path), "part").select(
        id_column, (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )
