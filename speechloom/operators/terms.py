"""Which words and phrases mark a group of speeches.

All functions group by a column (the party by default) that is limited to a
given list of values, and take stop words and vocabularies as parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.functions.text import (
    delete_numbers,
    delete_phrases,
    is_one_of,
    let,
    ngrams,
    space_tokens,
    squeeze_space,
    word_tokens,
)
from speechloom.operators.denoise import random_order
from speechloom.plans.bitmap import hash_bits, may_hold
from speechloom.plans.exploding import explode_array, explode_runs
from speechloom.plans.joins import CELL_ROWS, join_counted
from speechloom.plans.literals import literal_table
from speechloom.plans.ranking import top_per_group


# 4 MB: of ten million frequent terms, a quarter of the rare ones pass.
TERM_BITS = 1 << 25
# Cells for the rows of a term with more than CELL_ROWS of them.
CELLS = 64


def _of_groups(speeches: DataFrame, group: str, groups: Sequence[str]) -> DataFrame:
    return speeches.where(F.col(group).isin(list(groups)))


# ------------------------------------------------------------- word counts


def top_words(
    speeches: DataFrame,
    stop_words: Sequence[str] = tuple(fv.CONGRESS_STOPWORDS + fv.STANDARD_STOPWORDS),
    min_chars: int = 3,
    k: int = 10,
    group: str = "party",
    groups: Sequence[str] = fv.MAIN_PARTIES,
) -> DataFrame:
    """The most frequent words of each group. Ties go to the earlier word."""
    counts = (
        _of_groups(speeches, group, groups)
        .select(group, F.explode(word_tokens("speech", min_chars)).alias("word"))
        .where(~is_one_of("word", stop_words))
        .groupBy(group, "word")
        .agg(F.count("*").alias("n"))
    )
    return top_per_group(counts, [group], [F.desc("n"), F.asc("word")], k)


def top_words_strict(speeches: DataFrame, k: int = 15, **options) -> DataFrame:
    """:func:`top_words` with the second stop list and words of 4+ characters."""
    return top_words(speeches, fv.STRICT_STOPWORDS + fv.STRICT_PROCEDURAL, 4, k, **options)


def vocab_counts(
    speeches: DataFrame,
    vocabulary: Sequence[str] = fv.POLICY_VOCABULARY,
    stop_words: Sequence[str] = (),
    k: int = 15,
) -> DataFrame:
    """Occurrences of each vocabulary word per main party, zeros included, for
    the k words most used overall. Single words are counted, so a vocabulary
    entry of two words always counts zero."""
    listed = sorted(set(vocabulary) - set(stop_words))
    used = F.filter(word_tokens("speech", 2), lambda w: w.isin(listed))
    found = (
        explode_array(_of_groups(speeches, "party", fv.MAIN_PARTIES), ["party"], used, "word")
        .groupBy("word")
        .agg(*[F.count_if(F.col("party") == p).alias(p) for p in fv.MAIN_PARTIES])
    )
    wanted = literal_table(speeches.sparkSession, list(enumerate(vocabulary)), ["position", "word"])
    counts = [F.coalesce(p, F.lit(0)).alias(p) for p in fv.MAIN_PARTIES]
    return (
        wanted.join(found, "word", "left")
        .select("position", "word", *counts)
        .withColumn("total", F.col("D") + F.col("R"))
        .orderBy(F.desc("total"), "position")
        .limit(k)
        .drop("position")
    )


# ------------------------------------------------------------------ TF-IDF


def _often(rows: DataFrame, group: str, words: Sequence[str], min_df: int) -> tuple[Column, Column]:
    """Two conditions on rows of a group and the words of a term. The first holds for each
    term of ``min_df`` rows or more and for few others, the second for each of more than
    ``CELL_ROWS`` rows and for few others. Rows are counted, once for both, by hashes of
    their terms, so that rare terms, most of all there are, need not be shuffled as
    texts. Terms of equal hash are counted together: none is lost by that."""
    code = F.xxhash64(group, *words)
    often = rows.groupBy(code.alias("code")).agg(F.count("*").alias("n")).where(F.col("n") >= min_df)
    kept, heavy = hash_bits(often, "code", TERM_BITS, [F.lit(True), F.col("n") > CELL_ROWS])
    return may_hold(kept, code, TERM_BITS) if min_df > 1 else F.lit(True), may_hold(heavy, code, TERM_BITS)


def tfidf(
    documents: DataFrame, terms: Column, group: str, max_df: float = 1.0, min_df: int = 1, n: int = 1
) -> DataFrame:
    """Summed TF-IDF of every term of every group: (group, term, score).

    Every row is a document, whatever its id. ``terms`` is the array of its
    terms; where it is NULL there is no document. With ``n`` it is that of its
    words, none with a space in it, and a term is ``n`` neighbours, joined by
    spaces. Inverse document frequency
    is ln((1 + n) / (1 + df)) + 1, fitted per group over all its documents.
    Terms in fewer than ``min_df`` documents, or in more than ``max_df`` of
    them, are pruned; then each document's weights are scaled to length one.
    """
    # Words are made where a text is read; what is shuffled, once, is their array, by
    # a number of its own. All readings below use it, and all its columns. A term of
    # several words is put together only where it is not pruned by its hash.
    documents = (
        documents.select(group, terms.alias("terms"))
        .withColumn("document", F.monotonically_increasing_id())
        .repartition("document")
        .where(F.col("terms").isNotNull())
    )
    words = [f"word{k}" for k in range(n)]
    rows = explode_runs(documents, ["document", group], "terms", words)
    kept, heavy = _often(rows, group, words, min_df)
    # The partitions are those of the documents: no row moves to be counted. Then a
    # term's rows meet in one task, those of a heavy one in several cells.
    cell = F.coalesce(F.when(heavy, 1 + F.pmod(F.xxhash64("document"), F.lit(CELLS))), F.lit(0).cast("long"))
    place = [group, "term", "cell"]
    counts = (
        rows.where(kept)
        .groupBy("document", group, *words)
        .agg(F.count("*").alias("tf"))
        .select("document", group, F.concat_ws(" ", *words).alias("term"), "tf", cell.alias("cell"))
        .repartition(*place)
    )
    # Where the rows lie they are counted and find their weights. All readings use all
    # columns (both tests always hold) and filter nothing before they have counted, so
    # the rows are made and moved once.
    each = (F.col("tf") > 0) & (F.col("document") >= 0)
    frequencies = counts.groupBy(*place).agg(F.count_if(each).alias("df"))
    # At most one heavy term per CELL_ROWS rows, and a few that share a bit with one.
    spread = (
        counts.groupBy(group, F.coalesce(F.when(F.col("cell") > 0, F.col("term")), F.lit("")).alias("term"))
        .agg(F.count_if(each & (F.col("cell") > 0)).alias("total"))
        .where(F.col("total") > 0)
    )
    # one row per group; groups are limited to a given list
    sizes = documents.groupBy(group).agg(F.count_if(F.size("terms") >= 0).alias("n"))
    weighted = (
        frequencies.join(F.broadcast(sizes), group)
        .join(F.broadcast(spread), [group, "term"], "left")
        .withColumn("df", F.when(F.col("cell") > 0, F.col("total")).otherwise(F.col("df")))
        .where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
        .select(*place, (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    )
    weights = (
        join_counted(counts, weighted, place, placed=True)
        .select("document", group, "term", (F.col("tf") * F.col("idf")).alias("weight"))
        .repartition("document")
    )
    # Again all columns are read, so that the weights are moved once.
    each = (F.length(group) >= 0) & (F.length("term") >= 0)
    lengths = weights.groupBy("document").agg(F.sqrt(F.sum(F.when(each, F.col("weight") * F.col("weight")))).alias("length"))
    return (
        weights.join(lengths.hint("shuffle_hash"), "document")
        .groupBy(group, "term")
        .agg(F.round(F.sum(F.col("weight") / F.col("length")), 6).alias("score"))
    )


def _top_terms(scores: DataFrame, group: str, k: int) -> DataFrame:
    return top_per_group(scores, [group], [F.desc("score"), F.asc("term")], k)


def _kept_words(text: Column | str, stop_words: Sequence[str]) -> Column:
    stops = sorted(set(stop_words))
    words = word_tokens(text, 2)
    return F.filter(words, lambda w: ~w.isin(stops)) if stops else words


def tfidf_unigram(
    speeches: DataFrame,
    stop_words: Sequence[str],
    max_df: float = fv.UNIGRAM_MAX_DF,
    min_df: int = fv.UNIGRAM_MIN_DF,
    k: int = fv.UNIGRAM_TOP,
    group: str = "party",
    groups: Sequence[str] = fv.MAIN_PARTIES,
) -> DataFrame:
    """The single words that mark each group."""
    documents = _of_groups(speeches, group, groups).where(F.col("speech").isNotNull())
    documents = documents.select(group, "speech")
    scores = tfidf(documents, _kept_words("speech", stop_words), group, max_df, min_df)
    return _top_terms(scores, group, k)


def tfidf_bigram(
    speeches: DataFrame,
    stop_words: Sequence[str],
    max_df: float = fv.BIGRAM_MAX_DF,
    min_df: int = fv.BIGRAM_MIN_DF,
    k: int = fv.BIGRAM_TOP,
    group: str = "party",
    groups: Sequence[str] = fv.MAIN_PARTIES,
    noise_words: Sequence[str] = fv.BIGRAM_NOISE_WORDS,
) -> DataFrame:
    """The word pairs that mark each group. Stop words are taken out first, so
    a pair may span a removed word."""
    documents = _of_groups(speeches, group, groups).where(F.col("speech").isNotNull())
    documents = documents.select(group, "speech")
    words = _kept_words("speech", [*stop_words, *noise_words])
    return _top_terms(tfidf(documents, words, group, max_df, min_df, 2), group, k)


def tfidf_bigram_final(
    speeches: DataFrame,
    stop_words: Sequence[str],
    max_df: float = fv.BIGRAM_FINAL_MAX_DF,
    min_df: int = fv.BIGRAM_FINAL_MIN_DF,
    k: int = fv.BIGRAM_FINAL_TOP,
    **options,
) -> DataFrame:
    """:func:`tfidf_bigram` with boilerplate and state names as further stop
    words. Stop words are compared to single words, so of these lists only the
    one-word entries have an effect."""
    stops = [*stop_words, *fv.BOILERPLATE_BIGRAMS, *fv.STATE_STOPWORDS]
    return tfidf_bigram(speeches, stops, max_df, min_df, k, **options)


def deep_clean(text: Column | str, phrases: Sequence[str] = fv.DEEP_CLEAN_PHRASES) -> Column:
    """Lower-case text without the listed phrases and without bare numbers."""
    text = F.col(text) if isinstance(text, str) else text
    return squeeze_space(delete_numbers(delete_phrases(F.lower(text), phrases)))


def deep_clean_tfidf(
    speeches: DataFrame,
    stop_words: Sequence[str],
    max_df: float = fv.DEEP_CLEAN_MAX_DF,
    min_df: int = fv.DEEP_CLEAN_MIN_DF,
    k: int = fv.DEEP_CLEAN_TOP,
    group: str = "party",
    groups: Sequence[str] = fv.MAIN_PARTIES,
) -> DataFrame:
    """:func:`tfidf_bigram` over deeply cleaned texts; a speech with nothing
    left counts as no document."""
    documents = (
        _of_groups(speeches, group, groups)
        .where(F.col("speech").isNotNull())
        .select(group, deep_clean("speech").alias("speech"))
    )
    # as a filter this test would clean every text a second time
    words = F.when(F.col("speech") != "", _kept_words("speech", [*stop_words, *fv.DEEP_CLEAN_STOPWORDS]))
    return _top_terms(tfidf(documents, words, group, max_df, min_df, 2), group, k)


def vocab_scores(
    speeches: DataFrame,
    stop_words: Sequence[str],
    categories: dict[str, Sequence[str]] = fv.POLICY_CATEGORIES,
    group: str = "party",
    groups: Sequence[str] = fv.MAIN_PARTIES,
) -> DataFrame:
    """TF-IDF over a fixed vocabulary of one- and two-word terms, each with its
    category. No term is pruned; terms never used score zero."""
    vocabulary = [(term, c) for c, terms in categories.items() for term in terms]
    listed = sorted({term for term, _ in vocabulary})
    documents = _of_groups(speeches, group, groups).select(
        group, F.coalesce("speech", F.lit("")).alias("speech")
    )
    terms = let(
        _kept_words("speech", stop_words),
        lambda w: F.filter(F.concat(w, ngrams(w, 2)), lambda t: t.isin(listed)),
    )
    scores = tfidf(documents, terms, group)
    wanted = literal_table(
        speeches.sparkSession,
        [(g, i, t, c) for g in groups for i, (t, c) in enumerate(vocabulary)],
        [group, "position", "term", "category"],
    )
    return wanted.join(scores, [group, "term"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )


def vocab_tfidf(
    speeches: DataFrame,
    stop_words: Sequence[str],
    categories: dict[str, Sequence[str]] = fv.POLICY_CATEGORIES,
    k: int = 10,
    group: str = "party",
    groups: Sequence[str] = fv.MAIN_PARTIES,
) -> DataFrame:
    """The k terms of the vocabulary that mark each group."""
    filled = vocab_scores(speeches, stop_words, categories, group, groups)
    return top_per_group(filled, [group], [F.desc("score"), F.asc("position")], k).drop("position")


def vocab_tfidf_categories(
    speeches: DataFrame,
    stop_words: Sequence[str],
    categories: dict[str, Sequence[str]] = fv.POLICY_CATEGORIES,
    group: str = "party",
    groups: Sequence[str] = fv.MAIN_PARTIES,
) -> DataFrame:
    """The scores of the vocabulary summed by category."""
    filled = vocab_scores(speeches, stop_words, categories, group, groups)
    return filled.groupBy(group, "category").agg(
        F.count("*").alias("n_terms"), F.round(F.sum("score"), 4).alias("score")
    )


# ----------------------------------------------------------------- context


def context_words(
    hits: DataFrame,
    phrase: str,
    stop_words: Sequence[str] = (),
    window: int = fv.CONTEXT_WINDOW,
    sample: int | None = None,
    seed: int | str = 0,
    k: int = 10,
) -> DataFrame:
    """The words most often found within ``window`` words of a phrase, in all
    hits or, on request, in a random ``sample`` of them. The phrase must stand
    as whole whitespace-separated words."""
    wanted = phrase.lower().split()
    n = len(wanted)
    if sample is not None:
        hits = hits.orderBy(random_order(seed), "speech_id").limit(sample)
    words = F.col("words")
    starts = F.when(
        F.size(words) >= n,
        F.filter(
            F.sequence(F.lit(1), F.size(words) - (n - 1)),
            lambda i: (F.get(words, i - 1) == wanted[0])
            & (F.slice(words, i, n) == F.array(*map(F.lit, wanted))),
        ),
    )
    around = F.transform(
        starts,
        lambda i: F.concat(
            F.slice(words, F.greatest(i - window, F.lit(1)), F.least(F.lit(window), i - 1)),
            F.slice(words, i + n, window),
        ),
    )
    counts = (
        explode_array(
            hits.select(space_tokens(F.lower("speech")).alias("words")),
            [],
            F.flatten(around),
            "word",
        )
        .where(
            (F.length("word") >= fv.CONTEXT_MIN_CHARS)
            & ~is_one_of("word", [*stop_words, *fv.CONTEXT_STOPWORDS])
        )
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    return counts.orderBy(F.desc("n"), "word").limit(k)
