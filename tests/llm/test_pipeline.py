"""The pipeline on a small table: each stage against what it must do to its own input."""

from strandline.llm.common import cut


def test_stages(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs
    sizes = []
    for name, stage in p.STAGES[:-1]:
        after = cut(stage(spark, before, sf), name.replace(" ", "-"))
        assert after.columns == columns
        sizes.append(after.count())
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > 0.95 * docs.count()
    assert before.groupBy("text").count().filter("count > 1").count() == 0
    packed = p.STAGES[-1][1](spark, before, sf)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    assert p.run(spark, sf).count() == packed.count()


def test_repeated_and_null_ids_take_no_clean_rows(spark, tmp_path):
    import random

    import corpus_pipeline as p

    rng = random.Random(1)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c, d, item = prose(100), prose(100), prose(100), prose(100), prose(30)
    near_a, near_c = a.rsplit(" ", 1)[0] + " end", c.rsplit(" ", 1)[0] + " end"
    rows = [(1, a, "x"), (1, a, "x"), (2, near_a, "x"), (3, b, "x"), (3, b, "x"), (4, c, "x"), (None, near_c, "x"), (None, d, "x"), (None, prose(80), "y"), (None, f"{prose(40)} {item}", "z"), (9, prose(90), "v"), (9, near_c, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    exact = cut(p.exact(spark, docs, str(tmp_path)), "exact")
    # near_c is there twice; the row with the larger id, 9, stays
    assert sorted(map(tuple, exact.collect()), key=str) == sorted({r for r in rows if r[:2] != (None, near_c)}, key=str)
    without = {r for r in rows if r[1] not in (near_a, near_c)}
    for before in (docs, exact):
        near = cut(p.near(spark, before, str(tmp_path)), "near")
        assert sorted(map(tuple, near.collect()), key=str) == sorted(without, key=str)
    clean = p.decontaminate(spark, near, str(tmp_path)).collect()
    assert sorted(map(tuple, clean), key=str) == sorted((r for r in without if item not in r[1]), key=str)
    twice = p.decontaminate(spark, docs, str(tmp_path))
    assert sorted(map(tuple, twice.collect()), key=str) == sorted((r for r in rows if item not in r[1]), key=str)
