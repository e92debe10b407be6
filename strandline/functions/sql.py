"""The library's scores and look-ups as functions of a session's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCALARS = {
    "softplus": ("x DOUBLE", "CASE WHEN x > 20 THEN x ELSE ln(1 + exp(x)) END"),
    "actr_activation": ("uses DOUBLE, age_days DOUBLE", "ln(uses + 2) - 0.5 * ln(greatest(age_days, 1D / 1440) / (uses + 2))"),
    "ebbinghaus_decay": ("uses DOUBLE, spacing DOUBLE, days DOUBLE", "greatest(0.05D, exp(-days / least(greatest(20 * ln(uses) * (1 + 0.5 * tanh(spacing / 7)), 14D), 365D)))"),
    "bayesian_update": ("prior DOUBLE, evidence DOUBLE", "0.95 * prior * evidence / greatest(prior * evidence + (1 - prior) * (1 - evidence), 1e-9) + 0.025"),
}


def register(spark: SparkSession) -> None:
    """Scalar functions of the session; Spark expands them, so they cost what their expressions do."""
    for name, (args, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")


def register_edges(spark: SparkSession, edges: DataFrame, view: str = "strandline_edges") -> None:
    """``get_associations(node)`` over edges (``src, dst, weight``): both directions, as a table."""
    edges.createOrReplaceTempView(view)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION get_associations(node BIGINT) RETURNS TABLE(other BIGINT, weight DOUBLE, direction STRING) RETURN SELECT dst, weight, 'out' FROM {view} WHERE src = get_associations.node UNION ALL SELECT src, weight, 'in' FROM {view} WHERE dst = get_associations.node")
