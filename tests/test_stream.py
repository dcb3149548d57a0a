import pytest

from speechloom.schema import GRANULES
from speechloom.sources.speech_table import read_speeches
from speechloom.streaming import ingest as stream

BODY = "<p>" + "word " * 20 + "{}</p>"


def granule(number, mark, package="CREC-2018-01-05", text=True):
    return (
        package, "115", f"{package}-PgH{number}",
        {"txt_link": "t", "congress": "115", "members": []},
        BODY.format(mark) if text else None, number,
    )


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, GRANULES).coalesce(1).write.parquet(f"{folder}/{name}")


def texts(df):
    return {r.speech_id[-4:]: r.speech.split()[-1] for r in df.collect()}


def test_incremental_ingest(spark, tmp_path):
    landing, changes, checkpoint = (str(tmp_path / n) for n in ("landing", "changes", "checkpoint"))

    def run():
        stream.ingest(spark, f"{landing}/*", changes, checkpoint, files_per_batch=1)
        return texts(stream.current_speeches(spark, changes))

    land(spark, landing, "a", [granule(1, "one"), granule(2, "two"), granule(3, "no", text=False)])
    assert run() == {"PgH1": "one", "PgH2": "two"}
    assert run() == {"PgH1": "one", "PgH2": "two"}
    land(spark, landing, "b", [granule(2, "two-b"), granule(4, "four", "CREC-2018-01-06")])
    want = {"PgH1": "one", "PgH2": "two-b", "PgH4": "four"}
    assert run() == want
    assert sorted(r[0] for r in stream.processed_packages(spark, changes).collect()) == [
        "CREC-2018-01-05", "CREC-2018-01-06",
    ]
    audit = {r.package_id[-1]: (r.saved, r.skipped, r.errors) for r in stream.audit(spark, changes).collect()}
    assert audit == {"5": (3, 0, 1), "6": (1, 0, 0)}

    base = str(tmp_path / "base")
    stream.compact(spark, changes, base)
    assert texts(read_speeches(spark, base)) == want
    last = stream.read_changes(spark, changes).agg({"batch": "max"}).first()[0]
    land(spark, landing, "c", [granule(1, "one-c")])
    run()
    now = stream.current_speeches(spark, changes, base, after_batch=last)
    assert texts(now) == {**want, "PgH1": "one-c"}
    stream.fold(spark, changes, base, after_batch=last)
    assert texts(read_speeches(spark, base)) == {**want, "PgH1": "one-c"}


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    landing, changes = str(tmp_path / "landing"), str(tmp_path / "changes")
    land(spark, landing, "a", [granule(1, "one"), granule(2, "two", text=False)])
    for attempt in ("first", "second"):  # a lost checkpoint makes the batch run again
        stream.ingest(spark, f"{landing}/*", changes, str(tmp_path / attempt))
    assert stream.read_changes(spark, changes).count() == 2
    assert texts(stream.current_speeches(spark, changes)) == {"PgH1": "one"}


def test_stream_table_is_production_format(spark, tmp_path):
    landing, changes = str(tmp_path / "landing"), str(tmp_path / "changes")
    land(spark, landing, "a", [granule(1, "one")])
    stream.ingest(spark, f"{landing}/*", changes, str(tmp_path / "checkpoint"))
    row = stream.current_speeches(spark, changes).first()
    assert row.is_procedure is None and row.congress_session == 115 and row.date == 20180105


def test_the_stream_keeps_its_base(spark, tmp_path, monkeypatch):
    landing, changes, checkpoint, base = (str(tmp_path / n) for n in ("landing", "changes", "checkpoint", "base"))
    folded, fold_batch = [], stream._fold_batch
    fail = {"before": False, "after": False}

    def fold(spark_, batch, base_):
        if fail["before"]:
            raise RuntimeError("killed before the fold")
        fold_batch(spark_, batch, base_)
        folded.append(batch.rsplit("=", 1)[1])
        if fail["after"]:
            raise RuntimeError("killed after the fold, before its entry")

    monkeypatch.setattr(stream, "_fold_batch", fold)

    def run():
        stream.ingest(spark, f"{landing}/*", changes, checkpoint, files_per_batch=1, base=base)
        return texts(read_speeches(spark, base))

    land(spark, landing, "a", [granule(1, "one"), granule(2, "two"), granule(2, "two-a")])
    want = {"PgH1": "one", "PgH2": "two-a"}
    assert run() == run() == want and folded == ["0"]
    for moment, mark in (("before", "two-b"), ("after", "two-c")):
        land(spark, landing, moment, [granule(2, mark), granule(4, mark, "CREC-2018-01-06")])
        fail[moment] = True
        with pytest.raises(Exception, match="killed"):
            run()
        fail[moment] = False
        want = {"PgH1": "one", "PgH2": mark, "PgH4": mark}
        assert run() == run() == want
        assert texts(stream.current_speeches(spark, changes)) == want
    # the batch that was folded but not entered was folded again, no other twice
    assert folded == ["0", "1", "2", "2"]
    assert sorted(r.batch for r in stream.folded_batches(spark, base).collect()) == [0, 1, 2]
