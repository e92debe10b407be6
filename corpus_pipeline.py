"""The corpus pipeline: documents go through language ID, exact dedup, near dedup, decontamination and packing.

Nulls: texts that are null, empty or without a letter have no language and go in the first stage. Null ids are ids like others, null sources conflict
with nothing, nulls in other columns stay as they are. Repeated rows (same id and text) are one row after exact dedup; different texts under
one id are documents of their own and never take each other along. Ties: of equal texts the largest id stays, of near duplicates
the least (then the least hash). Very long texts are read whole in every stage and packed in pieces. Empty tables go through as
empty tables, and an empty benchmark takes nothing. Extra columns are kept as they are up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import exact_dedup, langid, near_dedup, pack
from strandline.llm.common import cut, table
from strandline.llm.decontaminate import keep_clean

#: No SQL expresses the language model, the sketches or the packing.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; the model is fitted on a bounded sample of their labels (without labels no language is known, and all go)."""
    return langid.keep_known(docs, langid.fit(docs, langid.learnable()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id; of rows that share id and text, one."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the least id; texts without words stay, each a class of its own."""
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; each row is judged by its own text."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 8192 bytes, without two documents of a source or two copies in one; every row, null ids and texts too, is packed once."""
    return pack.pack_texts(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("benchmark decontamination", decontaminate), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
