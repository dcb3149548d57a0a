"""Landed records in the service's shape, with texts in files of their own."""

import json

from speechloom.sources import landing


def test_records_and_text_files(spark, tmp_path):
    (tmp_path / "records").mkdir()
    (tmp_path / "texts").mkdir()
    rows = [
        {
            "package": {"packageId": "CREC-2018-01-05", "congress": "115"},
            "granuleId": "CREC-2018-01-05-pt1-PgH1",
            "granuleLink": "x",
            "summary": {
                "download": {"txtLink": "text/1"},
                "congress": 115,
                "members": [{"name": ["Foxx, Virginia"], "party": {"name": "R"}, "bioguideId": "F1"}, {"party": "D"}, {"name": None}, None],
            },
            "arrivalSeq": 1,
        },
        {"package": {"packageId": "CREC-2018-01-05"}, "granuleId": "g2", "summary": None, "html": "own"},
        {"granuleId": "g3", "summary": {"members": []}},
    ]
    (tmp_path / "records" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "texts" / "CREC-2018-01-05-pt1-PgH1.htm").write_text("<p>one\ntwo</p>")
    (tmp_path / "texts" / "g2.html").write_text("from a file")
    df = landing.read_landed(spark, str(tmp_path / "records"), str(tmp_path / "texts"))
    got = {r.granule_id: r for r in df.collect()}
    first = got["CREC-2018-01-05-pt1-PgH1"]
    assert first.html == "<p>one\ntwo</p>" and first.package_congress == "115"
    assert first.summary.txt_link == "text/1" and first.summary.congress == "115"
    assert first.summary.members[0].name == '["Foxx, Virginia"]'
    unnamed, null_name, missing = first.summary.members[1:]
    assert (unnamed.name, unnamed.party) == ("Unknown Speaker", "D")
    assert null_name is not None and null_name.name is None and missing is None
    assert json.loads(first.summary.members[0].party) == {"name": "R"}
    assert got["g2"].html == "own" and got["g2"].summary is None
    assert got["g3"].html is None and got["g3"].summary.members == []
    again = landing.from_api(landing.to_api(df))
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
