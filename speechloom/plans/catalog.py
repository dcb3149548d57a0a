"""The registered queries: every operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.functions import records
from speechloom.functions.cards import party_name, speech_cards
from speechloom.functions.text import word_tokens
from speechloom.operators import (
    classify,
    corpus,
    denoise,
    entities,
    granules,
    lexicon,
    profile,
    sessions,
    terms,
    updates,
)
from speechloom.plans import parameters as pm
from speechloom.plans.literals import literal_table
from speechloom.session import work_folder
from speechloom.sources import bucketed, delimited, landing, phrase_index, speech_table, views
from speechloom.streaming import ingest as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


# ------------------------------------------------- sources, sinks, sessions


@query
def session_read(spark, folder):
    path = f"{work_folder(spark)}/speeches_111.txt"
    views.write_lines(views.raw_lines(spark, folder)["speeches"].drop("congress_session"), path)
    return delimited.read_session(spark, path)


def _joined(spark, folder):
    return sessions.join_session(
        views.raw_speeches(spark, folder),
        views.raw_descr(spark, folder),
        views.raw_speaker_map(spark, folder),
    )


def _built(spark, folder):
    session = 43 + F.col("speech_id").cast("bigint") % 77
    return sessions.build_speakers(_joined(spark, folder), session)


@query
def session_join(spark, folder):
    return _joined(spark, folder)


@query
def session_join_repeated(spark, folder):
    """The join where a third of the speeches and some of the other rows share an id."""
    def shared(df, number, every):
        hot = F.when(number % every == 0, pm.HOT_ID).otherwise(F.col("speech_id"))
        return df.withColumn("speech_id", hot)

    number = F.col("speech_id").cast("bigint")
    return sessions.join_session(
        shared(views.raw_speeches(spark, folder), number, 3),
        shared(views.raw_descr(spark, folder), number, pm.REPEATED_DESCR),
        shared(views.raw_speaker_map(spark, folder), F.col("speakerid"), pm.REPEATED_SPEAKERS),
        repeated=True,
    )


@query
def speaker_build(spark, folder):
    return _built(spark, folder).select(
        "speech_id", "speakerid", "is_mapped", "speaker", "congress_session"
    )


@query
def standardize(spark, folder):
    return sessions.standardize(_built(spark, folder))


@query
def standardize_repair(spark, folder):
    return sessions.standardize(_built(spark, folder), fv.REPAIR_COLUMNS, fv.REPAIR_FILL)


@query
def match_rate(spark, folder):
    return sessions.match_rate(sessions.standardize(_built(spark, folder)))


def _archive(spark, folder):
    """An archive folder, one file per kind and session."""
    root = work_folder(spark)
    names = {
        "speeches": F.concat(F.lit("speeches_"), F.lpad("congress_session", 3, "0")),
        "descr": F.concat(F.lit("descr_"), F.lpad("congress_session", 3, "0")),
        "speaker_map": F.concat(F.lpad("congress_session", 3, "0"), F.lit("_SpeakerMap")),
    }
    for kind, lines in views.raw_lines(spark, folder).items():
        named = lines.withColumn("file", F.concat(names[kind], F.lit(".txt")))
        views.write_lines(named.drop("congress_session"), f"{root}/{kind}", partition="file")
    return root


@query
def load_sessions(spark, folder):
    return delimited.load_sessions(spark, f"{_archive(spark, folder)}/*")


def _kept_lines(spark, folder):
    """The lines of an archive's speeches as written by outcome, dropped ones included."""
    root = _archive(spark, folder)
    lines = delimited.read_lines(spark, f"{root}/speeches", r"speeches_(\d+)\.txt")
    delimited.keep_lines(lines, f"{root}/kept")
    return spark.read.parquet(f"{root}/kept")


@query
def session_account(spark, folder):
    """Per session, how many lines of its speeches were padded and dropped."""
    return delimited.line_account(_kept_lines(spark, folder), "congress_session")


@query
def dropped_lines(spark, folder):
    """The dropped lines themselves."""
    lines = _kept_lines(spark, folder).where(F.col("_outcome") == delimited.DROPPED)
    return lines.select("congress_session", F.col("_line").alias("line"))


@query
def replace_session(spark, folder):
    path = work_folder(spark)
    speech_table.append_speeches(views.speeches(spark, folder, labelled=True), path)
    repaired = sessions.standardize(_built(spark, folder), fv.REPAIR_COLUMNS, fv.REPAIR_FILL)
    speech_table.replace_sessions(
        repaired.where(F.col("congress_session") == pm.REPAIRED_SESSION), path
    )
    return speech_table.read_speeches(spark, path)


@query
def append_speeches(spark, folder):
    path = work_folder(spark)
    speeches = views.speeches(spark, folder, labelled=True)
    speech_table.append_speeches(speeches.where(F.col("is_procedure").isNull()), path)
    speech_table.append_speeches(speeches.where(F.col("is_procedure").isNotNull()), path)
    return (
        speech_table.read_speeches(spark, path)
        .groupBy("congress_session")
        .agg(
            F.count("*").alias("n_speeches"),
            F.count("is_procedure").alias("n_labelled"),
            F.sum(F.length("speech")).alias("n_chars"),
        )
    )


def _updates(spark, folder):
    role = F.col("role")
    return views.table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("speech_id"),
        F.col("text").alias("speech"),
        F.lit(20200101).alias("date"),
        role.alias("speaker"),
        F.when(role == "user", "D").when(role == "assistant", "R").otherwise("Unknown").alias(
            "party"
        ),
        F.lit(119).alias("congress_session"),
        "turn",
    )


@query
def upsert_speeches(spark, folder):
    return updates.upsert_speeches(
        views.speeches(spark, folder, labelled=True),
        _updates(spark, folder),
        ["turn", "speech"],
    )


@query
def upsert_without_id(spark, folder):
    """Updates of which some name no speech: those are added, all of them."""
    named = F.when(F.col("turn") % 3 != 0, F.col("speech_id"))
    return updates.upsert_speeches(
        views.speeches(spark, folder, labelled=True),
        _updates(spark, folder).withColumn("speech_id", named),
        ["turn", "speech"],
    )


@query
def upsert_table(spark, folder):
    """The upsert made to the table on disk, session folder by session folder."""
    path = work_folder(spark)
    speech_table.append_speeches(views.speeches(spark, folder, labelled=True), path)
    speech_table.upsert_sessions(spark, _updates(spark, folder), path, ["turn", "speech"])
    return speech_table.read_speeches(spark, path)


@query
def upsert_keep_labels(spark, folder):
    return updates.upsert_speeches(
        views.speeches(spark, folder, labelled=True),
        _updates(spark, folder),
        ["turn", "speech"],
        keep_labels=True,
    )


def _bucketed(spark, folder):
    """The speech table in buckets; a third of its rows share an id."""
    name, path = f"speeches_{uuid4().hex}", work_folder(spark)
    hot = F.when(F.col("speakerid") % 3 == 0, pm.HOT_ID).otherwise(F.col("speech_id"))
    speeches = views.speeches(spark, folder, labelled=True).withColumn("speech_id", hot)
    bucketed.lay_out(speeches, name, path, pm.BUCKETS)
    return name, path


def _replaced(spark, rows, name, path):
    bucketed.replace_table(spark, rows, name, f"{name}_next", f"{path}/next", pm.BUCKETS)
    return bucketed.read(spark, f"{name}_next")


@query
def upsert_bucketed(spark, folder):
    """An upsert into a table in buckets; some updates are without id, some are of the
    id that many rows share."""
    name, path = _bucketed(spark, folder)
    named = F.when(F.col("turn") % 3 != 0, F.col("speech_id"))
    new = _updates(spark, folder).withColumn("speech_id", named)
    rows = bucketed.upserted(spark, name, new, ["turn"], pm.BUCKETS, keep_labels=True)
    return _replaced(spark, rows, name, path)


@query
def label_bucketed(spark, folder):
    """New labels for a table in buckets."""
    name, path = _bucketed(spark, folder)
    rows = bucketed.labelled(spark, name, _embedding_labels(spark, folder), pm.BUCKETS)
    return _replaced(spark, rows, name, path).select("speakerid", "speech_id", "is_procedure")


@query
def csv_round_trip(spark, folder):
    path = work_folder(spark)
    joined = _joined(spark, folder)
    delimited.write_csv(joined, path)
    return delimited.read_csv(spark, path, ", ".join(f"{n} {t}" for n, t in joined.dtypes))


@query
def lexicon_load(spark, folder):
    """Every conversation turn holds a configuration: its role is a policy
    category and its word pairs are the category's terms."""
    words = F.col("words")
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit("_"), b),
    )
    turns = (
        views.table(spark, folder, "conversations")
        .withColumn("words", word_tokens("text", 2))
        .withColumn("terms", pairs)
    )
    entry = F.struct(F.col("role").alias("description"), F.col("terms").alias("historical_terms"))
    configs = turns.select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("config_id"),
        F.to_json(F.struct(F.create_map("role", entry).alias("policy_bridge"))).alias("config"),
    )
    return lexicon.policy_terms(lexicon.config_entries(configs))


def _config_files(spark, folder):
    """One configuration file per benchmark item: its words are the terms of a policy
    category, its word pairs a denoising list. A later item's file is the later one."""
    path, words = work_folder(spark), F.col("words")
    pairs = F.transform(
        F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)),
        lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)),
    )
    category = F.concat(F.lit("Category "), (F.col("item_id") % pm.CONFIG_CATEGORIES).cast("string"))
    policy = F.struct(F.lit("Words").alias("description"), words.alias("historical_terms"))
    lists = F.create_map(F.lit(pm.CONFIG_LIST), F.coalesce(pairs, F.array().cast("array<string>")))
    config = F.struct(
        F.create_map(category, policy).alias("policy_bridge"), lists.alias("denoising_lexicon")
    )
    items = views.table(spark, folder, "benchmark").withColumn("words", word_tokens("text"))
    files = items.select(F.lpad(F.col("item_id").cast("string"), 20, "0").alias("item"), F.to_json(config))
    files.write.partitionBy("item").text(path)
    return lexicon.read_config(spark, path, r"item=(\d+)")


@query
def config_terms(spark, folder):
    """The policy terms of configuration files."""
    return lexicon.policy_terms(lexicon.config_entries(_config_files(spark, folder)))


@query
def procedural_terms(spark, folder):
    lines = views.table(spark, folder, "documents").select(
        F.explode(F.split("text", "\n")).alias("line")
    )
    return delimited.procedural_terms(lines.select(F.concat("line", F.lit("|1")).alias("line")))


@query
def lexicon_merge(spark, folder):
    words = views.table(spark, folder, "documents").select(
        F.col("lang").alias("list_name"), F.explode(word_tokens("text", 2)).alias("term")
    )
    new = views.table(spark, folder, "benchmark").select(
        F.explode(word_tokens("text", 2)).alias("term")
    )
    return lexicon.merge_lexicon(words.distinct(), new, pm.MERGED_LIST)


@query
def lexicon_files(spark, folder):
    """One list replaced by the terms of a term file, all lists written back and
    read again."""
    path = work_folder(spark)
    lines = views.table(spark, folder, "benchmark").select(F.explode(word_tokens("text", 2)).alias("term"))
    lines.select(F.concat("term", F.lit("|1")).alias("value")).write.text(f"{path}/terms")
    new = delimited.procedural_terms(delimited.read_term_lines(spark, f"{path}/terms"))
    words = views.table(spark, folder, "documents").select(
        F.col("lang").alias("list_name"), F.explode(word_tokens("text", 2)).alias("term")
    )
    merged = lexicon.merge_lexicon(words.distinct(), new, pm.MERGED_LIST)
    lexicon.write_lexicon(merged, f"{path}/lexicon")
    return lexicon.read_lexicon(spark, f"{path}/lexicon")


def _entries(spark):
    return literal_table(
        spark, pm.LEXICON, ["section", "list_name", "description", "position", "term"]
    )


@query
def lexicon_summary(spark, folder):
    return lexicon.lexicon_summary(
        _entries(spark), views.speeches(spark, folder, spread_out=True)
    )


@query
def lexicon_hits(spark, folder):
    wanted = _entries(spark).select(F.lower("term").alias("term"))
    return lexicon.term_hits(wanted, views.speeches(spark, folder, spread_out=True))


@query
def table_profile(spark, folder):
    return profile.table_profile({n: views.table(spark, folder, n) for n in pm.PROFILED_TABLES})


@query
def table_distincts(spark, folder):
    return profile.distinct_counts({n: views.table(spark, folder, n) for n in pm.PROFILED_TABLES})


# ------------------------------------------------------------------ ingest


@query
def granule_filter(spark, folder):
    return granules.filter_granules(views.granules(spark, folder))


@query
def html_to_text(spark, folder):
    pages = views.spread(views.table(spark, folder, "pages"), "page_id")
    return pages.select("page_id", records.html_to_text("html").alias("text"))


@query
def clean_text(spark, folder):
    landed = views.granules(spark, folder)
    return landed.select(
        "granule_id", records.clean_text(records.html_to_text("html")).alias("text")
    )


@query
def ghost_filter(spark, folder):
    outcomes = granules.granule_outcomes(views.granules(spark, folder))
    return outcomes.where(F.col("text").isNotNull()).select(
        "granule_id", F.length("text").alias("n_chars"), "status", "reason"
    )


@query
def metadata_flatten(spark, folder):
    """Page addresses as plain text, lists and objects."""
    shape, url = F.col("page_id") % 8, F.to_json(F.struct(F.col("url").alias("u")))
    quoted = F.regexp_extract(url, r'^\{"u":(.*)\}$', 1)
    raw = (
        F.when(shape == 0, F.concat(F.lit(" "), "url", F.lit(" ")))
        .when(shape == 1, F.concat(F.lit("["), quoted, F.lit(', "other"]')))
        .when(shape == 2, F.concat(F.lit('{"authority-fnf":"","name":'), quoted, F.lit("}")))
        .when(shape == 3, F.concat(F.lit("[["), quoted, F.lit("]]")))
        .when(shape == 4, F.concat(F.lit('[{"#text":'), quoted, F.lit(',"value":"no"}]')))
        .when(shape == 5, "[]")
        .when(shape == 6, F.concat(F.lit('{"name":0,"value":'), quoted, F.lit("}")))
    )
    pages = views.table(spark, folder, "pages")
    return pages.select("page_id", records.flatten_metadata(raw).alias("flat"))


@query
def speaker_parse(spark, folder):
    shape = F.col("c_nationkey") % 4
    name = (
        F.when(shape == 0, F.replace("c_name", F.lit("#"), F.lit(", ")))
        .when(shape == 1, F.replace("c_name", F.lit("#"), F.lit(" of ")))
        .when(shape == 2, F.col("c_name"))
        .otherwise(F.replace("c_name", F.lit("#"), F.lit(" , Jr, ")))
    )
    customers = views.table(spark, folder, "customer")
    return customers.select("c_custkey", records.member_name(name).alias("n")).select(
        "c_custkey", "n.*"
    )


@query
def speaker_fallback(spark, folder):
    """Conversation turns that open with a speaker's name."""
    opening = (
        F.when(F.col("role") == "user", F.concat(F.lit("Mr. USER of "), "role", F.lit(". ")))
        .when(F.col("role") == "assistant", "The ASSISTANT pro tempore: ")
        .otherwise("")
    )
    turns = views.table(spark, folder, "conversations")
    named = records.opening_name(F.concat(opening, "text"))
    return turns.select("conv_id", "turn", named.alias("n")).select("conv_id", "turn", "n.*")


@query
def bioguide_num(spark, folder):
    identifier = F.when(F.col("c_nationkey") == 3, "Unknown").otherwise(F.col("c_name"))
    customers = views.table(spark, folder, "customer")
    return customers.select("c_custkey", records.digits_as_number(identifier).alias("number"))


@query
def package_date(spark, folder):
    landed = views.granules(spark, folder)
    cut = F.when(F.col("arrival_seq") % 11 == 0, F.substring("package_id", 1, 9)).otherwise(
        F.col("package_id")
    )
    return landed.select("granule_id", records.package_date(cut).alias("date"))


@query
def congress_coalesce(spark, folder):
    congress = records.congress_number(F.col("package_congress"), F.col("summary.congress"))
    return views.granules(spark, folder).select("granule_id", congress.alias("congress"))


@query
def resume_antijoin(spark, folder):
    landed = views.granules(spark, folder)
    done = landed.join(views.granule_urls(spark, folder), "arrival_seq").where(
        F.contains("url", F.lit(pm.DONE_URL_PART))
    )
    return updates.unprocessed(landed, done.select("package_id").distinct()).orderBy("package_id")


@query
def ingest_audit(spark, folder):
    return granules.ingest_audit(granules.granule_outcomes(views.granules(spark, folder)))


@query
def ingest_reasons(spark, folder):
    return granules.ingest_reasons(granules.granule_outcomes(views.granules(spark, folder)))


@query
def ingest_errors(spark, folder):
    return granules.ingest_errors(granules.granule_outcomes(views.granules(spark, folder)))


@query
def granule_speeches(spark, folder):
    return granules.granule_speeches(views.granules(spark, folder))


def _ingest_twice(spark, folder, write, **options):
    """Two runs over one landing folder; the second finds some granules again
    with a revised text. A repeated last run changes nothing."""
    root = work_folder(spark)
    landing, changes, checkpoint = f"{root}/landing", f"{root}/changes", f"{root}/checkpoint"
    landed = views.granules(spark, folder)
    write(landed, f"{landing}/first")
    stream.ingest(spark, f"{landing}/*", changes, checkpoint, files_per_batch=4, **options)
    again = (
        landed.join(views.granule_urls(spark, folder), "arrival_seq")
        .where(F.contains("url", F.lit(pm.REVISED_URL_PART)))
        .drop("url")
        .withColumn("html", F.concat("html", F.lit(pm.REVISED_TEXT)))
    )
    write(again, f"{landing}/second")
    stream.ingest(spark, f"{landing}/*", changes, checkpoint, **options)
    stream.ingest(spark, f"{landing}/*", changes, checkpoint, **options)
    return root, stream.current_speeches(spark, changes).select(*fv.PRODUCTION_COLUMNS)


@query
def ingest_stream(spark, folder):
    return _ingest_twice(spark, folder, lambda df, path: df.write.parquet(path))[1]


@query
def ingest_stream_json(spark, folder):
    """The same from JSON records in the service's shape, compacted at the end."""
    root, _ = _ingest_twice(
        spark,
        folder,
        lambda df, path: landing.to_api(df).write.json(path),
        file_format="json",
        api_shape=True,
    )
    stream.compact(spark, f"{root}/changes", f"{root}/table")
    return speech_table.read_speeches(spark, f"{root}/table").select(*fv.PRODUCTION_COLUMNS)


@query
def ingest_stream_folded(spark, folder):
    """The base that the stream keeps current by itself."""
    base = f"{work_folder(spark)}/base"
    _ingest_twice(spark, folder, lambda df, path: df.write.parquet(path), base=base)
    return speech_table.read_speeches(spark, base).select(*fv.PRODUCTION_COLUMNS)


# ---------------------------------------------------------------- denoising


@query
def keyword_purge(spark, folder):
    speeches = views.speeches(spark, folder, labelled=True)
    return speeches.select(
        "speech_id",
        F.col("is_procedure").alias("old_label"),
        denoise.purge_label(pm.PURGE_PHRASES).alias("new_label"),
    )


@query
def zero_shot_rule(spark, folder):
    events = views.table(spark, folder, "events")
    label = F.when(F.col("event_type") == "error", fv.PROCEDURE_LABEL).otherwise(fv.DEBATE_LABEL)
    scores = events.select(
        F.col("event_id").cast("string").alias("speech_id"),
        label.alias("top_label"),
        (F.col("value") / (F.col("value") + 5)).alias("score"),
    )
    return scores.select("speech_id", denoise.zero_shot_label().alias("is_procedure"))


@query
def score_batch(spark, folder):
    speeches = views.speeches(spark, folder, labelled=True)
    scores = classify.score_batch(speeches, classify.phrase_scorer(pm.PURGE_PHRASES))
    return scores.select(
        "speech_id",
        "top_label",
        F.round("score", 6).alias("score"),
        denoise.zero_shot_label().alias("is_procedure"),
    )


@query
def label_speeches(spark, folder):
    return classify.label_speeches(
        views.speeches(spark, folder, labelled=True),
        lambda rest: classify.phrase_scores(rest, pm.PURGE_PHRASES),
        pm.PURGE_PHRASES,
    ).select("speech_id", "party", "congress_session", "is_procedure")


def _trained(spark, folder):
    """Speeches with the labels that are given or follow from rules, and a model of them."""
    speeches = views.speeches(spark, folder, labelled=True, spread_out=True)
    weak = denoise.keyword_purge(speeches, pm.PURGE_PHRASES)
    return weak, classify.train_classifier(weak, pm.STOP_WORDS)


@query
def train_classifier(spark, folder):
    """The scores of all open speeches by a model fitted on the others."""
    weak, model = _trained(spark, folder)
    return classify.classify(weak, model, pm.STOP_WORDS)


@query
def classifier_terms(spark, folder):
    """The model itself: the words that speak most clearly for or against procedure."""
    _, model = _trained(spark, folder)
    return (
        model.where("term <> ''")
        .select("term", F.round("weight", 6).alias("weight"), "n")
        .orderBy(F.desc(F.abs("weight")), F.desc("n"), "term")
        .limit(pm.MODEL_TERMS)
    )


@query
def label_by_model(spark, folder):
    """The labelling job with the trained model: given labels, rules, then scores."""
    speeches = views.speeches(spark, folder, labelled=True)
    _, model = _trained(spark, folder)
    return classify.label_speeches(
        speeches, lambda rest: classify.classify(rest, model, pm.STOP_WORDS), pm.PURGE_PHRASES
    ).select("speech_id", "party", "congress_session", "is_procedure")


@query
def label_speeches_repeated(spark, folder):
    """The labelling job where many rows share an id, some of them labelled."""
    speeches = views.speeches(spark, folder, labelled=True)
    few = (F.col("speakerid") % pm.REPEATED_IDS).cast("string")
    return classify.label_speeches(
        speeches.withColumn("speech_id", F.when(few != "0", few)),
        lambda rest: classify.phrase_scores(rest, pm.PURGE_PHRASES),
        pm.PURGE_PHRASES,
    ).select("speakerid", "speech_id", "is_procedure")


def _embedding_labels(spark, folder):
    return views.table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("speech_id"),
        (F.col("label") % 2).alias("is_procedure"),
    )


@query
def apply_labels(spark, folder):
    speeches = views.speeches(spark, folder, labelled=True)
    labelled = updates.apply_labels(speeches, _embedding_labels(spark, folder))
    return labelled.select("speech_id", "congress_session", "party", "is_procedure")


@query
def label_progress(spark, folder):
    return denoise.label_progress(views.speeches(spark, folder, labelled=True))


@query
def intro_substantive(spark, folder):
    flag = denoise.intro_substantive(phrases=pm.INTRO_PHRASES)
    return views.speeches(spark, folder).select("speech_id", flag.alias("is_substantive"))


@query
def bigram_substantive(spark, folder):
    flag = denoise.bigram_substantive(pm.NOISE_BIGRAMS)
    return views.speeches(spark, folder, spread_out=True).select(
        "speech_id", flag.alias("is_substantive")
    )


def _benchmark_bigrams(spark, folder):
    """Noise bigrams: the word pairs of the benchmark texts."""
    words = F.col("words")
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)),
    )
    return (
        views.table(spark, folder, "benchmark")
        .select(word_tokens("text").alias("words"))
        .where(F.size("words") > 1)
        .select(F.explode(pairs).alias("bigram"))
    )


@query
def bigram_substantive_table(spark, folder):
    noise = _benchmark_bigrams(spark, folder)
    return denoise.bigram_substantive_table(_corpus(spark, folder), noise)


@query
def bigram_substantive_config(spark, folder):
    """Noise bigrams from configuration files."""
    entries = lexicon.config_entries(_config_files(spark, folder))
    noise = lexicon.lexicon_list(entries, pm.CONFIG_LIST).select(F.col("term").alias("bigram"))
    return denoise.bigram_substantive_table(_corpus(spark, folder), noise)


@query
def bigram_substantive_repeated(spark, folder):
    noise = _benchmark_bigrams(spark, folder)
    return denoise.bigram_substantive_table(_repeated(spark, folder), noise)


@query
def quality_sample(spark, folder):
    return denoise.quality_sample(views.speeches(spark, folder), pm.SEED).select(
        "speech_id", "speech", "party", "date", "congress_session"
    )


@query
def label_badge(spark, folder):
    return speech_cards(views.speeches(spark, folder, labelled=True))


# ------------------------------------------------------------------- corpus


@query
def speech_by_id(spark, folder):
    return corpus.speech_by_id(views.speeches(spark, folder, labelled=True), f" {pm.SPEECH_ID} ")


@query
def speeches_by_id(spark, folder):
    ids = views.table(spark, folder, "benchmark").select(
        F.concat(F.lit(" "), F.col("item_id").cast("string")).alias("speech_id")
    )
    return corpus.speeches_by_id(views.speeches(spark, folder, labelled=True), ids)


@query
def phrase_trend(spark, folder):
    return corpus.phrase_trend(views.speeches(spark, folder, labelled=True), pm.PHRASE)


@query
def phrase_trend_all(spark, folder):
    return corpus.phrase_trend(views.speeches(spark, folder), pm.PHRASE, debate_only=False)


@query
def phrase_trend_wildcard(spark, folder):
    return corpus.phrase_trend(views.speeches(spark, folder), pm.WILDCARD, debate_only=False)


def _indexed(spark, folder):
    path = work_folder(spark)
    phrase_index.append(views.speeches(spark, folder), path, pm.GROUPS)
    return path


@query
def phrase_trend_indexed(spark, folder):
    """A phrase that few speeches mention, by the index of its characters."""
    hits = phrase_index.mentioning(spark, _indexed(spark, folder), pm.RARE_PHRASE)
    return corpus.phrase_trend(hits, pm.RARE_PHRASE, debate_only=False)


@query
def phrase_trend_indexed_wildcard(spark, folder):
    hits = phrase_index.mentioning(spark, _indexed(spark, folder), pm.RARE_WILDCARD)
    return corpus.phrase_trend(hits, pm.RARE_WILDCARD, debate_only=False)


@query
def partisan_share(spark, folder):
    return corpus.partisan_share(views.speeches(spark, folder, labelled=True), pm.PHRASE)


@query
def session_browse(spark, folder):
    return corpus.session_browse(views.speeches(spark, folder, labelled=True), pm.SESSION)


@query
def any_phrase_trend(spark, folder):
    return corpus.any_phrase_trend(views.speeches(spark, folder), pm.ANY_PHRASES)


def _hits(spark, folder, phrase=pm.PHRASE):
    speeches = views.speeches(spark, folder, spread_out=True)
    return corpus.substantive_hits(speeches, phrase, pm.NOISE_BIGRAMS)


@query
def session_party_pivot(spark, folder):
    return corpus.session_party_pivot(_hits(spark, folder))


@query
def compare_phrases(spark, folder):
    speeches = views.speeches(spark, folder, spread_out=True)
    return corpus.compare_phrases(speeches, [pm.PHRASE, pm.OTHER_PHRASE], pm.NOISE_BIGRAMS)


@query
def polarized_sessions(spark, folder):
    return corpus.polarized_sessions(corpus.session_party_pivot(_hits(spark, folder)))


@query
def available_sessions(spark, folder):
    return corpus.available_sessions(_hits(spark, folder))


@query
def speech_gallery(spark, folder):
    speeches = views.speeches(spark, folder, spread_out=True)
    return corpus.speech_gallery(_hits(spark, folder), pm.PHRASE, speeches=speeches)


@query
def party_label(spark, folder):
    return views.speeches(spark, folder).select(
        "speech_id", "party", party_name("party").alias("party_name")
    )


# -------------------------------------------------------------------- terms


def _corpus(spark, folder):
    return views.speeches(spark, folder, spread_out=True)


@query
def top_words(spark, folder):
    return terms.top_words(_corpus(spark, folder))


@query
def top_words_strict(spark, folder):
    return terms.top_words_strict(_corpus(spark, folder))


@query
def top_words_by_role(spark, folder):
    """The same job on another text table, grouped by another column."""
    turns = views.table(spark, folder, "conversations").select(
        "role", F.col("text").alias("speech")
    )
    return terms.top_words(turns, group="role", groups=pm.ROLES)


@query
def vocab_counts(spark, folder):
    return terms.vocab_counts(_corpus(spark, folder), pm.VOCABULARY)


@query
def tfidf_unigram(spark, folder):
    return terms.tfidf_unigram(_corpus(spark, folder), pm.STOP_WORDS)


def _repeated(spark, folder):
    """Speeches whose ids repeat, across parties too, or are missing."""
    number = F.col("speakerid") % pm.REPEATED_IDS
    shared = F.when(number > 0, number.cast("string"))
    return _corpus(spark, folder).withColumn("speech_id", shared)


@query
def tfidf_unigram_repeated(spark, folder):
    return terms.tfidf_unigram(_repeated(spark, folder), pm.STOP_WORDS)


@query
def deep_clean_tfidf_repeated(spark, folder):
    return terms.deep_clean_tfidf(_repeated(spark, folder), pm.STOP_WORDS)


@query
def tfidf_bigram(spark, folder):
    return terms.tfidf_bigram(_corpus(spark, folder), pm.STOP_WORDS)


@query
def tfidf_bigram_final(spark, folder):
    return terms.tfidf_bigram_final(_corpus(spark, folder), pm.STOP_WORDS)


@query
def deep_clean_tfidf(spark, folder):
    return terms.deep_clean_tfidf(_corpus(spark, folder), pm.STOP_WORDS)


@query
def vocab_tfidf(spark, folder):
    return terms.vocab_tfidf(_corpus(spark, folder), pm.STOP_WORDS, pm.CATEGORIES)


@query
def vocab_tfidf_categories(spark, folder):
    return terms.vocab_tfidf_categories(_corpus(spark, folder), pm.STOP_WORDS, pm.CATEGORIES)


@query
def context_words(spark, folder):
    return terms.context_words(
        _hits(spark, folder), pm.PHRASE, pm.CONTEXT_STOP_WORDS,
        sample=fv.CONTEXT_SAMPLE, seed=pm.SEED,
    )


@query
def context_words_all(spark, folder):
    return terms.context_words(
        _hits(spark, folder), pm.PHRASE, pm.CONTEXT_STOP_WORDS
    )


# ----------------------------------------------------------------- entities


def _tagged(spark, folder):
    gazetteer = literal_table(spark, pm.GAZETTEER, ["term", "label"])
    return entities.tag_entities(_corpus(spark, folder), gazetteer)


def _judged(spark, folder):
    return entities.judge_entities(
        _tagged(spark, folder),
        literal_table(spark, [(t,) for t in pm.ENTITY_STOPS], ["term"]),
        literal_table(spark, pm.POLICY_TERMS, ["term", "category"]),
    )


@query
def entity_tag(spark, folder):
    return _tagged(spark, folder)


@query
def entity_denoise(spark, folder):
    return entities.denoise_entities(_judged(spark, folder))


@query
def entity_table(spark, folder):
    return entities.entity_table(_judged(spark, folder))


@query
def entity_stats(spark, folder):
    return entities.entity_stats(_judged(spark, folder))
