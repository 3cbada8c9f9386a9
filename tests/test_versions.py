"""Versioned tables and the stream's state: replacement, deletion, conflicts, restarts, repeats."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from examina.operators import reports
from examina.operators.intake import counts
from examina.sources import readers, versions
from examina.streaming import intake as stream

ROWS = [("E", "S", 1), ("E", "S", 2), ("F", "T", 3), (None, "S", 4), ("E", None, 5), ("G", "U", 6)]


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/v"


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity_id string, submission_id string, n int")


def names(spark, *pairs):
    return spark.createDataFrame(list(pairs), "entity_id string, submission_id string")


def seen(spark, root, name, number=None):
    return sorted(r.n for r in versions.read(spark, root, name, number).collect())


def test_replace_with_less_and_with_nothing(spark, root):
    rows = frame(spark, ROWS)
    assert versions.versions(spark, root) == [] and versions.live(spark, root).count() == 0
    assert reports.write_submissions(root, names(spark, ("E", "S"), ("F", "T"), ("E", "S"), (None, "S")), raw=rows, issues=rows) == 1
    assert seen(spark, root, "raw") == seen(spark, root, "issues") == [1, 2, 3]  # unnamed submissions and null ids are never seen
    reports.write_submissions(root, names(spark, ("E", "S")), raw=rows.where("n = 2"))
    assert seen(spark, root, "raw") == [2, 3] and seen(spark, root, "issues") == [3]  # a table that isn't given loses the submission's rows too
    reports.write_submissions(root, names(spark, ("F", "T")), raw=rows.where("false"), issues=rows.where("false"))
    assert seen(spark, root, "raw") == [2] and seen(spark, root, "issues") == []
    assert [seen(spark, root, "raw", k) for k in (1, 2, 3)] == [[1, 2, 3], [2, 3], [2]] and seen(spark, root, "issues", 1) == [1, 2, 3]
    reports.write_submissions(root, names(spark), raw=rows)
    assert seen(spark, root, "raw") == [2] and versions.versions(spark, root) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        versions.read(spark, root, "raw", 9)
    gone = versions.vacuum(spark, root, ["raw", "issues"])
    assert gone and versions.versions(spark, root) == [4] and seen(spark, root, "raw") == [2]


def test_sealed_submissions_stay(spark, root):
    rows = frame(spark, ROWS)
    reports.write_submissions(root, names(spark, ("E", "S"), ("F", "T")), raw=rows)
    versions.seal(spark, root, names(spark, ("E", "S"), ("X", "Y")))
    with pytest.raises(ValueError, match="S"):
        reports.write_submissions(root, names(spark, ("E", "S"), ("F", "T")), raw=rows.where("false"))
    assert seen(spark, root, "raw") == [1, 2, 3] and versions.versions(spark, root) == [1, 2]
    reports.write_submissions(root, names(spark, ("F", "T")), raw=rows.where("false"))
    assert seen(spark, root, "raw") == [1, 2]


def test_two_writers_and_one_that_dies(spark, root, monkeypatch):
    rows = frame(spark, ROWS)
    reports.write_submissions(root, names(spark, ("E", "S"), ("F", "T")), raw=rows)
    publish, turns = versions._publish, []

    def second_comes_first(session, at, number, folder):
        if not turns:
            turns.append(number)
            reports.write_submissions(root, names(spark, ("F", "T")), raw=rows.where("false"))
        return publish(session, at, number, folder)

    monkeypatch.setattr(versions, "_publish", second_comes_first)
    assert reports.write_submissions(root, names(spark, ("E", "S")), raw=rows.where("n = 1")) == 3  # on top of the other's version
    assert seen(spark, root, "raw") == [1] and seen(spark, root, "raw", 2) == [1, 2]

    def dies(*args):
        raise OSError("lost")

    monkeypatch.setattr(versions, "_publish", dies)
    with pytest.raises(OSError):
        reports.write_submissions(root, names(spark, ("E", "S")), raw=rows)
    assert seen(spark, root, "raw") == [1] and versions.versions(spark, root) == [1, 2, 3]


HEAD = "native_id,case_id,escalation_level,notified_party,timestamp\n"
BATCHES = [
    {"a.csv": "1,c1,L2,lead,1995-02-01T00:00:00Z\n2,c1,L2,lead,1995-02-01T00:00:00Z\n,c9,L1,x,1995-02-01T00:00:00Z\n3,c2,,lead,1995-02-01T00:00:00Z\n1,c1,L2,lead,1995-02-01T00:00:00Z\n"},
    {"b.csv": "2,c1,L3,lead,1995-02-01T00:00:00Z\n3,c2,L2,lead,1995-02-01T00:00:00Z\n4,c1,L2,lead,1995-02-02T00:00:00Z\n", "b2.csv": "4,c1,L2,lead,1995-02-03T00:00:00Z\n,c9,L1,x,1995-02-01T00:00:00Z\n"},
    {"c.csv": "1,c1,L2,lead,1995-02-01T00:00:00Z\n2,c1,L2,lead,1995-02-01T00:00:00Z\n,c9,L1,x,1995-02-01T00:00:00Z\n3,c2,,lead,1995-02-01T00:00:00Z\n1,c1,L2,lead,1995-02-01T00:00:00Z\n", "d.csv": "5,c1,L2,lead,1996-02-02T00:00:00Z\n3,c2,L1,lead,1995-02-01T00:00:00Z\n"},
]


def test_identity_across_batches_equals_one_batch(spark, tmp_path):
    """A duplicate, a conflict and a resend, each in another batch than the first; every batch is a start of its own."""
    (tmp_path / "in").mkdir()
    args = (str(tmp_path / "in"), "escalations", "CSE-1", ("1995-01-01", "1996-01-01"), str(tmp_path / "out"), str(tmp_path / "cp"))
    for files in BATCHES:
        for name, text in files.items():
            (tmp_path / "in" / name).write_text(HEAD + text)
        stream.intake_stream(spark, *args).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/rows")
    rows = stream.identified(stream.batch_rows(readers.records(spark, str(tmp_path / "in")), *args[1:4]))  # all files at once, in the order of their names
    columns = ["native_id", "escalation_level", "timestamp", "is_quarantined", "identity"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, rows.select(columns).collect()))
    of = {(r.native_id, r.identity): r["count"] for r in got.groupBy("native_id", "identity").count().collect()}
    assert of == {("1", "NEW"): 1, ("1", "DUPLICATE_RECORD"): 3, ("2", "NEW"): 1, ("2", "CONFLICTING_IDENTITY"): 1, ("2", "DUPLICATE_RECORD"): 1, ("3", None): 2, ("3", "NEW"): 1, ("3", "CONFLICTING_IDENTITY"): 1,
                  ("4", "NEW"): 1, ("4", "CONFLICTING_IDENTITY"): 1, ("5", "NEW"): 1, (None, None): 3}
    summed = stream.stream_counts(spark, str(tmp_path / "out")).first().asDict()
    whole = counts(rows.select(F.lit("escalations").alias("record_type"), "issues", "is_quarantined", "identity", F.lit(False).alias("is_orphan"))).drop("orphans").first().asDict()
    assert summed == whole and (summed["duplicates"], summed["conflicts"], summed["quarantined"]) == (4, 3, 5)


def test_a_batch_that_is_tried_again_replaces_itself(spark, tmp_path):
    """The state of a batch isn't held against itself."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEAD + BATCHES[0]["a.csv"])
    for checkpoint in ("cp", "cp2"):  # the second forgets that batch 0 was done, as after a crash before its commit
        stream.intake_stream(spark, str(tmp_path / "in"), "escalations", "CSE-1", ("1995-01-01", "1996-01-01"), str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
    assert {(r.native_id, r.identity): r["count"] for r in spark.read.parquet(f"{tmp_path}/out/rows").groupBy("native_id", "identity").count().collect()} == {("1", "NEW"): 1, ("1", "DUPLICATE_RECORD"): 1, ("2", "NEW"): 1, ("3", None): 1, (None, None): 1}
    assert stream.stream_counts(spark, str(tmp_path / "out")).first().parsed == 5
