"""Queries that cluster, without SQL: iterated joins are tested against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import density

from .registry import query, table


@query("ml09_density_clusters")
def density_clusters(spark, sf_dir):
    """The vectors of two workspaces, of five labels each, by density; noise has a null cluster."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("space", F.floor(F.col("label") / 5))
    return density.clusters(vectors, "space", "vec_id")


@query("ml10_blobs")
def blobs(spark, sf_dir):
    """Clusters and noise of each label, whose vectors are about one blob."""
    found = density.clusters(table(spark, sf_dir, "embeddings"), "label", "vec_id")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"), F.count_if(F.isnull("cluster")).alias("noise"))
