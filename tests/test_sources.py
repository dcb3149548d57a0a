import pytest
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.operators import lexicon, sessions
from speechloom.sources import delimited, speech_table


def test_session_file_keeps_short_lines_and_drops_long_ones(spark, tmp_path):
    path = tmp_path / "speeches_043.txt"
    path.write_bytes(b'speech_id|speech\n1|caf\xe9 "open quote\n2|ok|extra\n3\n\n4|fine\n5|NA\n06|x\\\n')
    rows = {r.speech_id: r.speech for r in delimited.read_session(spark, str(path)).collect()}
    assert rows == {
        "1": 'caf\xe9 "open quote',
        "3": None,
        "4": "fine",
        "5": None,
        "06": "x\\",
    }


def test_long_lines_are_dropped_whatever_is_selected(spark, tmp_path):
    path = tmp_path / "descr_043.txt"
    path.write_text("speech_id|date|state\n1|18730101|OH\n2|x|y|z\n3\n")
    df = delimited.read_session(spark, str(path))
    assert df.count() == 2
    assert [r[0] for r in df.select("speech_id").orderBy("speech_id").collect()] == ["1", "3"]
    assert [r[0] for r in df.select("state").collect()] == ["OH", None]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "descr_043.txt").write_text("speech_id|date\n1|18730101\n")
    (tmp_path / "descr_044.txt").write_text("date|speech_id|state\n18750101|2|OH\n")
    (tmp_path / "descr_045.txt").write_text("\nspeech_id|date\n3|18770101\n")
    (tmp_path / "descr 046.txt").write_text("")
    df = delimited.read_session(spark, f"{tmp_path}/descr*.txt", r"descr_(\d+)")
    rows = {(r.speech_id, r.date, r.state, r.congress_session) for r in df.collect()}
    assert rows == {("1", "18730101", None, 43), ("2", "18750101", "OH", 44), ("3", "18770101", None, 45)}
    with pytest.raises(ValueError):
        delimited.read_session(spark, f"{tmp_path}/descr 046.txt")


def _archive(folder, number, with_map=True):
    (folder / f"speeches_{number}.txt").write_text(
        f"speech_id|speech\n{number}1|Hello\n{number}2\n{number}3|Bye\n"
    )
    (folder / f"descr_{number}.txt").write_text(
        f"speech_id|date|state\n{number}1|18730101|OH\n{number}2|bad|NY\n"
    )
    if with_map:
        (folder / f"{number}_SpeakerMap.txt").write_text(
            "speakerid|speech_id|lastname|firstname|party|state\n"
            f"7|{number}1|FOXX|VIRGINIA|R|NC\n8|{number}1|SMITH|\xa0|D|TX\n"
        )


def test_load_sessions_takes_all_complete_ones_or_a_range(spark, tmp_path):
    _archive(tmp_path, "043")
    _archive(tmp_path, "044", with_map=False)
    _archive(tmp_path, "115")
    everything = delimited.load_sessions(spark, str(tmp_path))
    assert {r.congress_session for r in everything.collect()} == {43, 115}
    df = delimited.load_sessions(spark, str(tmp_path), fv.FIRST_SESSION, fv.LAST_SESSION)
    assert df.columns == fv.PRODUCTION_COLUMNS
    rows = sorted(df.collect(), key=lambda r: (r.speech_id, r.speakerid))
    assert [r.speech_id for r in rows] == ["0431", "0431", "0432", "0433"]  # two speakers map to 1
    mapped, unmapped = rows[0], rows[2]
    assert (mapped.speaker, mapped.is_mapped, mapped.date) == ("VIRGINIA FOXX", 1, 18730101)
    assert (mapped.state_x, mapped.congress_session) == ("OH", 43)
    assert (unmapped.speaker, unmapped.speakerid, unmapped.speech) == ("", -1, "[No Text]")
    assert unmapped.date is None and unmapped.lastname == "Unknown"
    assert rows[3].state_x == "Unknown"


def test_null_ids_match_nothing_but_stay(spark):
    left = spark.createDataFrame(
        [("1", "a"), (None, "b"), ("2", "c"), ("3", "d")], "speech_id string, speech string"
    )
    descr = spark.createDataFrame(
        [("1", 5, "OH"), (None, 6, "NY"), ("1", 7, "TX")], "speech_id string, date int, state string"
    )
    people = spark.createDataFrame(
        [("1", 8, "IA"), (None, 9, "UT"), ("2", 10, "ME")], "speech_id string, speakerid int, state string"
    )
    df = sessions.join_session(left, descr, people)
    assert df.columns == ["speech_id", "speech", "date", "state_x", "speakerid", "state_y"]
    assert sorted(map(tuple, df.drop("speech_id").collect())) == [
        ("a", 5, "OH", 8, "IA"),
        ("a", 7, "TX", 8, "IA"),
        ("b", None, None, None, None),
        ("c", None, None, 10, "ME"),
        ("d", None, None, None, None),
    ]


def test_repair_columns_and_zero_date(spark):
    df = spark.createDataFrame(
        [("1", None, None, None)], "speech_id string, speech string, date int, party string"
    )
    row = sessions.standardize(df, fv.REPAIR_COLUMNS, fv.REPAIR_FILL).first()
    assert tuple(row) == ("1", "[No Text]", 0, "Unknown")


def test_replacing_a_session_leaves_others_alone(spark, tmp_path):
    path = str(tmp_path / "speeches")
    old = spark.createDataFrame(
        [("1", "a", 81, 0), ("2", "b", 82, 1), ("3", "c", 81, 1)],
        "speech_id string, speech string, congress_session int, is_procedure int",
    )
    speech_table.append_speeches(old, path)
    speech_table.replace_sessions(
        spark.createDataFrame([("9", "new", 81)], "speech_id string, speech string, congress_session int"),
        path,
    )
    rows = speech_table.read_speeches(spark, path).orderBy("speech_id").collect()
    assert [(r.speech_id, r.is_procedure) for r in rows] == [("2", 1), ("9", None)]


def test_session_lookup_reads_one_folder(spark, tmp_path):
    path = str(tmp_path / "speeches")
    df = spark.range(100).select(
        F.col("id").cast("string").alias("speech_id"), (43 + F.col("id") % 5).cast("int").alias("congress_session")
    )
    speech_table.append_speeches(df, path)
    found = speech_table.read_speeches(spark, path).where(
        (F.col("congress_session") == 44) & (F.col("speech_id") == "6")
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(congress_session" in plan
    assert "EqualTo(speech_id,6)" in plan
    assert found.count() == 1


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'say "hi", ok\nnext | line', 3), ("2", "", None), ("3", None, 4), ("4", " pad\\", 5)]
    df = spark.createDataFrame(rows, "a string, b string, c int")
    delimited.write_csv(df, str(tmp_path / "csv"))
    back = {tuple(r) for r in delimited.read_csv(spark, str(tmp_path / "csv"), "a string, b string, c int").collect()}
    assert back == {rows[0], ("2", None, None), rows[2], rows[3]}


def test_term_file(spark, tmp_path):
    path = tmp_path / "procedural.txt"
    path.write_bytes(b"Phrase|code\n Mr Speaker \xa0|1\nmr speaker|2\n|3\nbad \xff byte|4\nplain\n")
    terms = {r.term for r in delimited.procedural_terms(delimited.read_term_lines(spark, str(path))).collect()}
    assert {"phrase", "plain", "bad � byte"} <= terms
    assert "" not in terms and sum(t.startswith("mr speaker") for t in terms) == 2


CONFIG = """{
  "policy_bridge": {
    "Money": {"description": "On money", "historical_terms": ["Free_Silver", "gold"]},
    "Army": {"historical_terms": ["gold", "a1","a2","a3","a4","a5","a6","a7","a8","a9","a10"]}
  },
  "denoising_lexicon": {"procedural_stopwords": ["b", "a"], "note": "no list"}
}"""


def test_config_file(spark, tmp_path):
    (tmp_path / "filters.json").write_text(CONFIG)
    entries = lexicon.config_entries(lexicon.read_config(spark, str(tmp_path / "filters.json")))
    lookup = {r.term: r.category for r in lexicon.policy_terms(entries).collect()}
    assert lookup["free silver"] == "Money" and lookup["gold"] == "Army"
    assert {r.term for r in lexicon.lexicon_list(entries, "procedural_stopwords").collect()} == {"a", "b"}

    speeches = spark.createDataFrame([("gold and Gold",), ("a A b",), (None,)], "speech string")
    report = {r.list_name: r for r in lexicon.lexicon_summary(entries, speeches).collect()}
    assert report["MONEY"].preview == "Free_Silver, gold" and report["MONEY"].description == "On money"
    assert report["ARMY"].preview == "gold, a1, a2, a3, a4 ... a6, a7, a8, a9, a10"
    assert report["ARMY"].description == "N/A" and report["ARMY"].n_terms == 11
    assert report["PROCEDURAL_STOPWORDS"].preview == "b, a"
    assert report["PROCEDURAL_STOPWORDS"].speech_hits == 2
    assert set(report) == {"MONEY", "ARMY", "PROCEDURAL_STOPWORDS"}


def test_merging_a_list_keeps_the_others(spark):
    old = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3")], "list_name string, term string")
    new = spark.createDataFrame([("9",), ("9",)], "term string")
    assert {tuple(r) for r in lexicon.merge_lexicon(old, new, "x").collect()} == {("y", "3"), ("x", "9")}


def test_lexicon_files_keep_every_list(spark, tmp_path):
    rows = {("x", "a b"), ("x", "é"), (None, "c"), ("y", None), ("y", 'say "no"')}
    lexicon.write_lexicon(spark.createDataFrame(list(rows), "list_name string, term string"), f"{tmp_path}/l")
    assert {tuple(r) for r in lexicon.read_lexicon(spark, f"{tmp_path}/l").collect()} == rows
    lines = [line for f in sorted(tmp_path.glob("l/part-*")) for line in f.read_text().splitlines()]
    assert len(lines) == 5


def test_upsert_writes_only_sessions_it_touches(spark, tmp_path):
    path = str(tmp_path / "speeches")
    columns = "speech_id string, speech string, congress_session int, is_procedure int"
    old = [("1", "a", 81, 0), ("2", "b", 82, 1), ("3", "c", 83, 1), ("4", "d", 84, 0), ("5", "e", None, 0), ("6", "f", 85, 1)]
    speech_table.append_speeches(spark.createDataFrame(old, columns), path)

    def files():
        return {f.name for f in (tmp_path / "speeches").glob("*/*.parquet")}

    before = {s: {f.name for f in (tmp_path / "speeches").glob(f"*={s}/*.parquet")} for s in (82, 84)}
    updates = [
        ("1", "old", 81, 1), ("1", "new", 81, 2),  # replaced
        ("3", "moved", 85, 1),  # the only one of its session
        ("5", "known", 86, 1), ("7", "more", 87, 1),
    ]
    new = spark.createDataFrame(updates, "speech_id string, speech string, congress_session int, seq int")
    for _ in range(2):
        speech_table.upsert_sessions(spark, new, path, ["seq"], keep_labels=True)
        rows = {(r.speech_id, r.speech, r.congress_session, r.is_procedure) for r in speech_table.read_speeches(spark, path).collect()}
        assert rows == {
            ("1", "new", 81, 0), ("2", "b", 82, 1), ("3", "moved", 85, 1), ("4", "d", 84, 0),
            ("5", "known", 86, 0), ("6", "f", 85, 1), ("7", "more", 87, None),
        }
        assert before[82] | before[84] <= files()
    speech_table.upsert_sessions(spark, new.limit(0), path, ["seq"])
    assert speech_table.read_speeches(spark, path).count() == 7


def test_distinct_counts_move_no_texts(spark):
    from speechloom.operators import profile

    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), (None, 2, None), ("", 3, None)], "t string, n int, z string")
    counts = profile.distinct_counts({"x": df, "none": df.limit(0)})
    got = {(r.table_name, r.column_name): r.n_distinct for r in counts.collect()}
    assert got == {("x", "t"): 2, ("x", "n"): 3, ("x", "z"): 0, ("none", "t"): 0, ("none", "n"): 0, ("none", "z"): 0}
    arrays = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],), ([2.0],), (None,)], "e array<float>")
    assert profile.distinct_counts({"e": arrays}).first().n_distinct == 2


def test_lines_are_kept_by_outcome(spark, tmp_path):
    (tmp_path / "speeches_043.txt").write_text("speech_id|speech\n1|a\n2|b|c\n3\n4|NA\n")
    (tmp_path / "speeches_044.txt").write_text("speech_id|speech|x\n5|d\n6|e|f|g|h\n")
    lines = delimited.read_lines(spark, f"{tmp_path}/speeches_*.txt", r"speeches_(\d+)")
    counts = delimited.keep_lines(lines, f"{tmp_path}/kept")
    assert counts == {"whole": 2, "padded": 2, "dropped": 2}
    kept = spark.read.parquet(f"{tmp_path}/kept")
    dropped = kept.where("_outcome = 'dropped'")
    assert {(r.congress_session, r._line) for r in dropped.collect()} == {(43, "2|b|c"), (44, "6|e|f|g|h")}
    rest = kept.where("_outcome <> 'dropped'").select("speech_id", "speech", "x", "_line")
    assert {tuple(r) for r in rest.collect()} == {("1", "a", None, None), ("3", None, None, None), ("4", None, None, None), ("5", "d", None, None)}
    account = {r.congress_session: tuple(r)[1:] for r in delimited.line_account(kept, "congress_session").collect()}
    assert account == {43: (4, 1, 1, 5), 44: (2, 1, 1, 9)}
    assert delimited.line_account(lines).count() == 2


def test_configuration_files_by_name_or_path(spark, tmp_path):
    for name, term in (("b", "gold"), ("a", "silver")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "c.json").write_text('{"policy_bridge": {"%s": {"historical_terms": ["x", "%s"]}}}' % (name, term))
    entries = lexicon.config_entries(lexicon.read_config(spark, str(tmp_path), r"/(\w)/c.json"))
    got = {tuple(r) for r in lexicon.policy_terms(entries).collect()}
    assert got == {("x", "b"), ("gold", "b"), ("silver", "a")}
    assert {r.config_id for r in lexicon.read_config(spark, str(tmp_path)).collect()} == {"c.json"}
