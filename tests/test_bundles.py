"""The bundle source on good, bad and cut records, and imports that are run again."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, Not

from strandline.sources import bundles

A, B, C = (f"{i:08d}-0000-4000-8000-000000000000" for i in range(3))


def record(session, *kinds, **more):
    return json.dumps({"session": {"id": session, **more}, "events": [{"kind": k, "content": f"{k} of {session[:8]}", "tags": ["t"]} for k in kinds]})


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "one.jsonl").write_text(record(A, "issue", "pr", cwd="/x", git_branch="") + "\n\n" + record(B, "issue", agent_kind="bot", ended_at="2020") + "\n")
    (tmp_path / "deep/er/two.jsonl").write_text(record(C.upper(), "commit"))
    (tmp_path / "notes.txt").write_text("no record")
    return tmp_path


def test_every_record_of_every_file(spark, folder):
    rows = bundles.read(spark, str(folder)).orderBy("session_id", "position").collect()
    assert [(r.session_id, r.position, r.line, r.kind, r.type) for r in rows] == [(A, 0, 1, "issue", "user"), (A, 1, 1, "pr", "user"), (B, 0, 3, "issue", "user"), (C, 0, 1, "commit", "user")]
    assert (rows[0].cwd, rows[0].git_branch, rows[0].agent_kind, rows[2].agent_kind, rows[2].ended_at, rows[0].tags, rows[0].entities) == ("/x", None, "github", "bot", "2020", ["t"], [])
    assert bundles.read(spark, str(folder)).rdd.getNumPartitions() == 2
    assert bundles.read(spark, str(folder / "one.jsonl")).count() == 3


@pytest.mark.parametrize(
    "line,says",
    [(record(A, "issue")[:-20], "no JSON"), ("[]", "session.id is missing"), ('{"session": {}}', "session.id is missing"), (record("abc", "x"), "is no UUID"), (record(A), "no events"), (json.dumps({"session": {"id": A}, "events": [{"kind": "x"}, {"content": "y"}]}), r"events\[1\]: kind is missing"), ('{"session": {"id": 7}, "events": [1]}', "is no UUID")],
)
def test_bad_records_are_named(spark, tmp_path, line, says):
    (tmp_path / "a.jsonl").write_text(record(B, "issue") + "\n" + line + "\n")
    with pytest.raises(Exception, match=rf"a.jsonl line 2: .*{says}"):
        bundles.read(spark, str(tmp_path)).collect()
    rows = bundles.read(spark, str(tmp_path), "collect").collect()
    assert len(rows) == 2 and [r.line for r in rows if r.error] == [2]


def test_conditions_on_sessions_reach_the_source(spark, folder):
    rows = bundles.read(spark, str(folder))
    assert [r.session_id for r in rows.filter(~F.col("session_id").isin(A, B)).collect()] == [C]
    reader, other = bundles._Reader({"path": str(folder)}), EqualTo(("kind",), "pr")
    assert list(reader.pushFilters([Not(In(("session_id",), (A, B))), other, In(("session_id",), (B, C)), EqualTo(("session_id",), C)])) == [other]
    assert (reader.done, reader.only) == ({A, B}, {C})
    seen = [r[2] for p in reader.partitions() for r in reader.read(p)]
    assert seen == [C]
    assert {r.session_id for r in rows.filter(F.col("session_id") == B).collect()} == {B}
    assert rows.filter(F.col("session_id").isin(A, C)).filter(F.col("kind") == "pr").count() == 1


def test_odd_places(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert bundles.read(spark, str(tmp_path / "empty")).count() == 0
    for path, mode in [(str(tmp_path / "none"), "strict"), (str(tmp_path), "loose")]:
        with pytest.raises(Exception, match="none|loose"):
            bundles.read(spark, path, mode).collect()


def test_imports_resume(spark, folder, tmp_path):
    work = bundles.Import(spark, str(tmp_path / "store"), 4)
    assert work.run(str(folder), dry=True) == {"seen": 3, "imported": 3, "done": 0, "repeated": 0, "failed": 0, "events": 4} and work.events().count() == 0
    (folder / "bad.jsonl").write_text("{" + "\n" + record(A, "again"))
    assert work.run(str(folder)) == {"seen": 5, "imported": 3, "done": 0, "repeated": 1, "failed": 1, "events": 3}  # A's first record by file is the shorter
    assert work.run(str(folder)) == {"seen": 5, "imported": 0, "done": 4, "repeated": 0, "failed": 1, "events": 0}
    (folder / "bad.jsonl").write_text(record(A[:-1] + "9", "fixed"))
    assert bundles.Import(spark, str(tmp_path / "store"), 4).run(str(folder))["imported"] == 1
    assert sorted(r.kind for r in work.events().collect()) == ["again", "commit", "fixed", "issue"]
