"""Sessions stored with their turns: whether the turns are exactly the session's text, and what is wrong where they aren't."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Who can speak (fixed values).
ROLES = ["user", "assistant", "system", "tool"]


def turn_errors(sessions: DataFrame, turns: DataFrame, unit: str = "bytes") -> DataFrame:
    """``session, position, error``: everything that keeps a session from being its turns in a row; sessions without a row are whole.

    ``sessions`` has ``session, text`` (one row a session), ``turns`` has ``session, position, role, content, char_start, char_end``, offsets counting ``bytes`` of UTF-8 or ``chars``. A turn has one
    error, the first of: a negative start, an empty span, an end past the text, other content than the text there, a role nobody has, the position of another turn, an
    overlap with the turn before, a gap after it. A session (null position) can have no turns, or text after its last turn; turns of no known session are
    errors too. Each turn is held against its neighbours, so no session's turns are put together in one row.
    """
    if unit not in ("bytes", "chars"):
        raise ValueError("offsets count bytes or chars")
    value = lambda c: F.coalesce(F.col(c), F.lit("")) if unit == "chars" else F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8")
    known = sessions.select("session", value("text").alias("_text"), F.lit(True).alias("_known"))
    order = Window.partitionBy("session").orderBy("position", "char_start", "char_end")
    upto = F.coalesce(F.lag("char_end").over(order), F.lit(0))
    rows = turns.select("session", "position", "role", value("content").alias("_content"), "char_start", "char_end").withColumns({"_upto": upto, "_same": F.coalesce(F.lag("position").over(order).eqNullSafe(F.col("position")) & (F.row_number().over(order) > 1), F.lit(False))})
    rows = rows.join(known, "session", "left")
    size, a, b = F.length("_text"), F.col("char_start"), F.col("char_end")
    span = lambda text: F.concat(F.lit(text), a, F.lit(":"), b, F.lit("]"))
    error = (
        F.when(F.col("_known").isNull(), "no such session")
        .when(a.isNull() | b.isNull() | F.col("position").isNull(), "no position or span")
        .when(a < 0, F.concat(F.lit("negative start "), a))
        .when(b <= a, span("empty span ["))
        .when(b > size, F.concat(F.lit("end "), b, F.lit(" past the text's "), size))
        .when(F.substring("_text", a + 1, b - a) != F.col("_content"), span("content is not text["))
        .when(F.col("role").isNull() | ~F.col("role").isin(ROLES), F.concat(F.lit("role "), F.coalesce("role", F.lit("null"))))
        .when(F.col("_same"), "position of another turn")
        .when(a < F.col("_upto"), F.concat(F.lit("overlaps the turn before by "), F.col("_upto") - a))
        .when(a > F.col("_upto"), F.concat(F.lit("gap of "), a - F.col("_upto")))
    )
    of_turns = rows.select("session", F.col("position").cast("long").alias("position"), error.alias("error")).filter("error IS NOT NULL")
    last = turns.groupBy("session").agg(F.max("char_end").alias("_last"), F.lit(True).alias("_any"))
    rest = F.when(F.col("_any").isNull(), "no turns").when(F.col("_last") < size, F.concat(F.lit("text after the last turn: "), size - F.col("_last")))
    of_sessions = known.join(last, "session", "left").select("session", F.lit(None).cast("long").alias("position"), rest.alias("error")).filter("error IS NOT NULL")
    return of_turns.unionByName(of_sessions)


def whole(sessions: DataFrame, turns: DataFrame, unit: str = "bytes") -> tuple[DataFrame, DataFrame]:
    """The sessions that are their turns in a row, and those turns: what can be stored."""
    bad = turn_errors(sessions, turns, unit).select("session").distinct()
    good = sessions.join(bad, "session", "left_anti")
    return good, turns.join(good.select("session"), "session", "left_semi")


def offsets(turns: DataFrame, unit: str = "bytes") -> DataFrame:
    """``turns`` (``session, position, role, content``) with ``char_start, char_end``, as if they followed each other without anything between."""
    size = F.octet_length(F.coalesce("content", F.lit(""))) if unit == "bytes" else F.length(F.coalesce("content", F.lit("")))
    upto = F.sum(size).over(Window.partitionBy("session").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("char_end", upto.cast("long")).withColumn("char_start", (F.col("char_end") - size).cast("long"))
