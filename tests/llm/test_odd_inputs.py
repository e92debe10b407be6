"""Inputs that crashed once: labels without words, rows in no shard, page ids that aren't numbers, archives of nothing."""

import pytest
from pyspark.sql import functions as F

from strandline.llm import langid, reshard, warc

DOCS = "doc_id long, text string, lang string"


@pytest.mark.parametrize("rows", [[(1, "12", "en"), (2, "", "en")], [(1, None, "en")], [(1, "12", None)]])
def test_labels_without_words(spark, rows):
    docs = spark.createDataFrame(rows + [(9, "some words", None)], DOCS)
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs, F.lit(True))).collect()}
    assert set(got.values()) == {"und"} and len(got) == len(rows) + 1
    assert langid.keep_known(docs, langid.fit(docs, F.lit(True))).count() == 0


def test_rows_in_no_shard_are_placed(spark):
    rows = [(i, f"text {i}", [None, -1, 0, 1, 7][i % 5]) for i in range(50)]
    got = reshard.assign(spark.createDataFrame(rows, "doc_id long, text string, s int"), "s", shards=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(50))
    sizes = [sum(r["shard"] == k for r in got) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k])) for k in range(4))
    assert {r.old_shard for r in got} == {None, 0, 1, 7}
    assert all(r["shard"] == r.old_shard for r in got if r.old_shard in (0, 1))


@pytest.mark.parametrize("ids,rows", [("string", [("a-1", "u", "x" * 2000), ("b", "u", "x" * 2000), (None, "u", None)]), ("long", [(5, "u", "x"), (None, None, "")])])
def test_page_ids_of_either_kind(spark, tmp_path, ids, rows):
    warc.write(spark.createDataFrame(rows, f"page_id {ids}, url string, html string"), str(tmp_path / "w"))
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "w"), ids).collect()}
    assert got == ({("a-1", "revisit", "b"), ("b", "response", None), (None, "response", None)} if ids == "string" else {(5, "response", None), (None, "response", None)})


def test_archive_of_nothing(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).collect() == []
    with pytest.raises(ValueError):
        warc.read(spark, str(tmp_path / "w"), "double")
