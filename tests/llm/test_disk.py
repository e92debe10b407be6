"""What operators leave on disk."""

import os

from pyspark.sql import functions as F

from strandline.llm import near_dedup
from strandline.llm.common import FREED, cut, drop


def shuffled(spark):
    return len(list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("shuffle_"))) - 1


def test_cut_leaves_no_shuffle_files_and_drop_no_table(spark):
    before = shuffled(spark)
    table = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    assert shuffled(spark) <= before and spark.conf.get(FREED, "false") == "false"
    assert sorted(r["count"] for r in table.collect())[-1] == 143
    folder = table.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir("/" + folder.lstrip("/"))
    drop(table)
    assert not os.path.isdir("/" + folder.lstrip("/"))


def test_drop_leaves_what_it_did_not_make(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/mine")
    drop(spark.read.parquet(f"{tmp_path}/mine"))
    assert spark.read.parquet(f"{tmp_path}/mine").count() == 3


def test_near_duplicates_drop_their_prefixes(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 60]) for i in range(0, 300, 3)] + [" ".join(words[i : i + 58]) for i in range(0, 300, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    assert near_dedup.near_classes(docs).count() == len(texts)
    kept = {n.split("-")[0] for n in set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - made}
    assert not kept & {"prefixes", "bitmaps", "mixed", "words", "edges"}
