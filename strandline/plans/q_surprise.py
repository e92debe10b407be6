"""Queries of surprise: distance from a codebook, lift curves, rank sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import codebook, metrics

from .registry import query, table

_MEAN = "SELECT cell, list(x ORDER BY i) AS c FROM (SELECT cell, i, avg(x) AS x FROM {at} JOIN d USING (vec_id) GROUP BY cell, i) GROUP BY cell"
_AT = "SELECT vec_id, cell, s FROM (SELECT v.vec_id, cell, list_cosine_similarity(v.v, c) AS s, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v.v, c) DESC, cell) AS n FROM v, {book}) WHERE n = 1"
_RESIDUAL = f"""v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT vec_id, unnest(v) / sqrt(list_dot_product(v, v)) AS x, generate_subscripts(v, 1) AS i FROM v),
b0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, v AS c FROM v ORDER BY vec_id LIMIT 8),
a0 AS ({_AT.format(book="b0")}), b1 AS ({_MEAN.format(at="a0")}), a1 AS ({_AT.format(book="b1")}), b2 AS ({_MEAN.format(at="a1")}),
r AS (SELECT vec_id, cell, round(1 - s, 6) AS residual FROM ({_AT.format(book="b2")}))"""


def _residuals(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return codebook.residuals(vectors, codebook.fit(vectors, 8, 2)).withColumn("residual", F.round("residual", 6))


@query("ml26_centroid_residual", f"WITH {_RESIDUAL} SELECT vec_id, cell, residual FROM r")
def centroid_residual(spark, sf_dir):
    """How far each vector is from the nearest of eight entries fitted in two rounds."""
    return _residuals(spark, sf_dir)


_LIFT = "o AS (SELECT *, row_number() OVER (ORDER BY s DESC, k) AS place, count(*) OVER () AS n, sum(p) OVER () AS every FROM x WHERE s IS NOT NULL) SELECT budget, max(floor(n * budget))::BIGINT AS kept, count(*) FILTER (WHERE p = 1 AND place <= floor(n * budget)) AS hits, round(count(*) FILTER (WHERE p = 1 AND place <= floor(n * budget)) / max(every), 6) AS recall, round(count(*) FILTER (WHERE p = 1 AND place <= floor(n * budget)) / max(every) / budget, 6) AS lift FROM o, (SELECT unnest([0.1, 0.25, 0.5, 0.75]::DOUBLE[]) AS budget) GROUP BY budget"


def _rounded(curve):
    return curve.withColumn("recall", F.round("recall", 6)).withColumn("lift", F.round("lift", 6))


@query("ml26_lift_curve", f"WITH x AS (SELECT n_chars AS s, doc_id AS k, toxic AS p FROM documents JOIN labels USING (doc_id)), {_LIFT}")
def lift_curve(spark, sf_dir):
    """How many toxic documents are among the longest."""
    return _rounded(metrics.lift(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), "n_chars", "toxic", "doc_id"))


@query("ml26_residual_lift", f"WITH {_RESIDUAL}, x AS (SELECT residual AS s, vec_id AS k, (label < 2)::INT AS p FROM r JOIN embeddings USING (vec_id)), {_LIFT}")
def residual_lift(spark, sf_dir):
    """How many vectors of two labels are among those furthest from the codebook."""
    rows = _residuals(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 2).cast("int").alias("p")), "vec_id")
    return _rounded(metrics.lift(rows, "residual", "p", "vec_id"))


@query("ml26_rank_sums", "WITH x AS (SELECT n_chars AS s, toxic AS p FROM documents JOIN labels USING (doc_id) WHERE toxic IN (0, 1)), r AS (SELECT p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM x), u AS (SELECT count(*) FILTER (WHERE p = 1) AS n, count(*) FILTER (WHERE p = 0) AS m, sum(r) FILTER (WHERE p = 1) AS t FROM r), v AS (SELECT *, t - n * (n + 1) / 2 AS up FROM u) SELECT n AS n_pos, m AS n_neg, round(up, 3) AS u_pos, round(n * m - up, 3) AS u_neg, round((up - n * m / 2) / sqrt(n * m * (n + m + 1) / 12.0), 6) AS z, round((up - n * m / 2) / sqrt(n * m * (n + m + 1) / 12.0) / sqrt(n + m), 6) AS effect FROM v")
def rank_sums(spark, sf_dir):
    got = metrics.rank_sums(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"), "n_chars", "toxic")
    return got.select("n_pos", "n_neg", F.round("u_pos", 3).alias("u_pos"), F.round("u_neg", 3).alias("u_neg"), F.round("z", 6).alias("z"), F.round("effect", 6).alias("effect"))
