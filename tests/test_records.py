import html

import pytest
from pyspark.sql import functions as F

from speechloom import fixed_values as fv
from speechloom.functions import records
from speechloom.functions.cards import speech_cards
from speechloom.operators import granules
from speechloom.schema import GRANULES


@pytest.mark.parametrize(
    "raw, text",
    [
        ("a<br/>b", "a b"),
        ("<p>One</p><!-- two <b> --><script>var t='</p>';</script><style>p{}</style>Three", " One Three"),
        ("<a title='x'\nhref=y>z</a>", " z "),
        ("plain", "plain"),
    ],
)
def test_html_to_text(evaluate, raw, text):
    assert evaluate(records.html_to_text("x"), raw) == text


@pytest.mark.parametrize(
    "raw",
    [
        "a &amp; b",
        "&amp;lt; stays escaped",
        "&lt;b&gt; &quot;q&quot; &copy; &middot; &hellip;",
        "&#8212; &#x2014; &#X41; &#38;",
        "&unknown; & alone &;",
        "&#150;&#151; &#128; &#x93;q&#x94; &#129; &#0; &#xD800; &#99999999;",
        "a &amp; b &amp c &copy; d &copy e",
        "&amp &copy 2020 &eacutet &#38 x &#65B &notit; &copy2;",
        "no entity",
        "AT&amp;T &eacute;t&eacute;",
        "&#128512;",
    ],
)
def test_entities_as_the_standard_library(evaluate, raw):
    assert evaluate(records.unescape_entities(F.col("x")), raw) == html.unescape(raw)


HEADER = (
    "[Congressional Record Volume 164, Number 3 (Friday, January 5, 2018)]\n[Senate]\n"
    "[Pages S51-S52]\nFrom the Congressional Record Online through the Government Publishing "
    "Office [www.gpo.gov]\n\n"
)


@pytest.mark.parametrize(
    "raw, clean",
    [
        (HEADER + "  Mr. SMITH. Hello  there ] ] end", "Mr. SMITH. Hello there  end"),
        ("as I said on see page 5 today", "as I said on see  today"),
        ("held (Friday, January 5, 2018) and (friday, january 5, 2018)", "held  and (friday, january 5, 2018)"),
        (" ] ) text", "text"),
        ("[house] [EXTENSIONS of remarks] x", "x"),
        ("", ""),
    ],
)
def test_clean_text(evaluate, raw, clean):
    assert evaluate(records.clean_text("x"), raw) == clean


@pytest.mark.parametrize(
    "raw, flat",
    [
        ('["A"]', "A"),
        ('{"authority-fnf":"","name":"B"}', "B"),
        ("[]", "Unknown"),
        (None, "Unknown"),
        ('[["C"]]', "C"),
        ('[ [ [ {"value": 12} ] ], 5 ]', "12"),
        ('{"name":0,"#text":[],"value":"v"}', "v"),
        ('{"name":"0"}', "0"),
        ('{"other":1}', '{"other":1}'),
        ("[null]", "Unknown"),
        ("[not json", "[not json"),
        ("  plain ", "plain"),
        ("[7]", "7"),
    ],
)
def test_flatten_metadata(evaluate, raw, flat):
    assert evaluate(records.flatten_metadata("x"), raw) == flat


@pytest.mark.parametrize(
    "raw, parsed",
    [
        ("Foxx, Virginia", ("Virginia Foxx", "Foxx", "Virginia")),
        ("Virginia Ann Foxx", ("Virginia Ann Foxx", "Foxx", "Virginia")),
        ("Foxx", ("Foxx", "Unknown", "Unknown")),
        ("Foxx,", ("Foxx", "Foxx", "")),
        ("", ("", "Unknown", "Unknown")),
        ("Unknown Speaker", ("Unknown Speaker", "Speaker", "Unknown")),
    ],
)
def test_member_name(evaluate, raw, parsed):
    assert tuple(evaluate(records.member_name("x"), raw)) == parsed


@pytest.mark.parametrize(
    "raw, parsed",
    [
        ("Mr. SMITH of Texas. I rise", ("Mr. Smith", "Smith", "Unknown")),
        ("The SPEAKER pro tempore. Yes", ("The Speaker Pro Tempore", "Tempore", "Unknown")),
        ("Mrs. JONES: No", ("Mrs. Jones", "Jones", "Unknown")),
        ("I thank Mr. SMITH.", ("Unknown Speaker", "Unknown", "Unknown")),
        ("Mr. " + "A" * 60 + ".", ("Unknown Speaker", "Unknown", "Unknown")),
    ],
)
def test_opening_name(evaluate, raw, parsed):
    assert tuple(evaluate(records.opening_name("x"), raw)) == parsed


@pytest.mark.parametrize(
    "raw, date", [("CREC-2018-01-05", 20180105), ("BAD", 0), ("A-B-C-D", 0), ("CREC-2018-01-05-2", 20180105)]
)
def test_package_date(evaluate, raw, date):
    assert evaluate(records.package_date("x"), raw) == date


@pytest.mark.parametrize("raw, number", [("F000450", 450), ("Unknown", -1), ("", -1), ("A1B2", 12)])
def test_digits(evaluate, raw, number):
    assert evaluate(records.digits_as_number("x"), raw) == number


def _granule(name, html="<p>" + "word " * 20 + "</p>", members=(("Foxx, Virginia", "R", "NC", "F000450"),), **changes):
    row = {
        "package_id": "CREC-2018-01-05",
        "package_congress": "Unknown",
        "granule_id": name,
        "summary": {"txt_link": "t", "congress": "115", "members": [tuple(m) for m in members]},
        "html": html,
        "arrival_seq": 1,
    }
    row.update(changes)
    return row


def test_granule_outcomes_and_rows(spark):
    landed = spark.createDataFrame(
        [
            _granule("X-PgE1"),
            _granule("X-PgH2-FrontMatter"),
            _granule("X-PgH3", summary=None),
            _granule("X-PgH4", summary={"txt_link": None, "congress": None, "members": []}),
            _granule("X-PgS5", html=None),
            _granule("X-PgS6", html="<p>[Senate] Page 3</p>"),
            _granule("X-PgS7"),
            _granule("X-PGH8", html="Mr. SMITH of Texas. " + "word " * 20, members=()),
        ],
        GRANULES,
    )
    outcomes = granules.granule_outcomes(landed)
    reasons = {r.granule_id: (r.status, r.reason) for r in outcomes.collect()}
    assert reasons == {
        "X-PgE1": ("SKIP", fv.NOT_FLOOR),
        "X-PgH2-FrontMatter": ("SKIP", fv.MATTER),
        "X-PgH3": ("ERROR", fv.NO_METADATA),
        "X-PgH4": ("ERROR", fv.NO_LINK),
        "X-PgS5": ("ERROR", fv.NO_TEXT),
        "X-PgS6": ("SKIP", fv.EMPTY),
        "X-PgS7": ("SUCCESS", None),
        "X-PGH8": ("SUCCESS", None),
    }
    audit = granules.ingest_audit(outcomes).first()
    assert (audit.saved, audit.skipped, audit.errors) == (2, 3, 3)
    assert audit.saved + audit.skipped + audit.errors == landed.count()
    rows = {r.speech_id: r for r in granules.granule_speeches(landed).collect()}
    member, named = rows["X-PgS7"], rows["X-PGH8"]
    assert (member.speaker, member.speakerid, member.party, member.is_mapped) == ("Virginia Foxx", 450, "R", 1)
    assert (member.congress_session, member.date) == (115, 20180105)
    assert (named.speaker, named.speakerid, named.lastname, named.is_mapped) == ("Mr. Smith", -1, "Smith", 0)
    assert named.party == named.state_x == "Unknown"


def test_text_is_cleaned_once(spark):
    landed = spark.createDataFrame([_granule("X-PgS7")], GRANULES)
    for df in (granules.granule_speeches(landed), granules.ingest_audit(granules.granule_outcomes(landed))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("<!--") == 1


def test_cards_fill_absent_fields(spark):
    df = spark.createDataFrame([("1", None), ("2", 0), ("3", 1)], "speech_id string, is_procedure int")
    rows = {r.speech_id: r for r in speech_cards(df).collect()}
    assert [rows[i].badge for i in "123"] == ["UNCERTAIN", "DEBATE", "PROCEDURE"]
    assert (rows["1"].session, rows["1"].date, rows["1"].speaker) == ("N/Ath", "N/A", "Unknown Speaker")


def test_a_member_whose_name_is_null_is_unknown(spark):
    rows = [_granule("X-PgH1", members=((None, "R", "NC", "F1"),)), _granule("X-PgH2", members=(("Unknown Speaker", None, None, None),))]
    found = granules.granule_speeches(spark.createDataFrame(rows, GRANULES)).collect()
    assert {r.speech_id: (r.speaker, r.party) for r in found} == {
        "X-PgH1": ("Unknown", "R"), "X-PgH2": ("Unknown Speaker", "Unknown"),
    }
