"""Sessions: segmentation by gaps, roll-ups, and latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free(rows: DataFrame, name: str) -> str:
    """The name, or one made from it that the table doesn't have."""
    while name.lower() in {c.lower() for c in rows.columns}:
        name = f"_{name}"
    return name


def segments(events: DataFrame, by: str, ts: str, key: str, gap: str) -> DataFrame:
    """Adds ``segment`` (from 0 within ``by``; a column of that name is replaced): a new one begins where more than ``gap`` lies between events."""
    new, order = free(events, "_new"), Window.partitionBy(by).orderBy(ts, key)
    far = F.coalesce(F.col(ts) - F.lag(ts).over(order) > F.expr(f"INTERVAL {gap}"), F.lit(False))
    return events.withColumn(new, far.cast("int")).withColumn("segment", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop(new)


def latest(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    n = free(rows, "_n")
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(n) == 1).drop(n)


def merged(rows: DataFrame, by: str, order: list[str], newest: dict[str, str], oldest: dict[str, str]) -> DataFrame:
    """One row a key, with the newest value of some columns and the oldest of others (new name: column)."""
    when = F.struct(*order)
    return rows.groupBy(by).agg(*(F.max_by(c, when).alias(n) for n, c in newest.items()), *(F.min_by(c, when).alias(n) for n, c in oldest.items()))


def upsert(known: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows with ``inserted`` (key not known before), and known rows that they don't replace with null."""
    was = free(incoming, "_was")
    flagged = incoming.join(known.select(F.col(key), F.lit(True).alias(was)), key, "left").withColumn("inserted", F.col(was).isNull()).drop(was)
    return known.join(incoming.select(key), key, "left_anti").withColumn("inserted", F.lit(None).cast("boolean")).unionByName(flagged)


def clean_prefix(rows: DataFrame, by: str, order: str, broken: Column) -> DataFrame:
    """Rows of each key before the first for which ``broken`` holds."""
    b = free(rows, "_b")
    seen = F.max(broken.cast("int")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(b, seen).filter(F.col(b) == 0).drop(b)


def after_marks(rows: DataFrame, marks: DataFrame, by: str, key: str) -> DataFrame:
    """Rows past the ``mark`` of their key, and all rows of keys without one; adds ``mark``."""
    return rows.join(marks.select(by, "mark"), by, "left").filter(F.col("mark").isNull() | (F.col(key) > F.col("mark")))


def idle(events: DataFrame, by: str, ts: str, gap: str, strict: bool = False) -> DataFrame:
    """Keys whose last event lies at least ``gap`` (with ``strict``, more) before the last of all, as ``by, ended``."""
    now = events.agg(F.max(ts).alias("now"))  # one row
    last = events.groupBy(by).agg(F.max(ts).alias("ended")).crossJoin(F.broadcast(now))
    since, width = F.col("now") - F.col("ended"), F.expr(f"INTERVAL {gap}")
    return last.filter(since > width if strict else since >= width).select(by, "ended")


def given(**values: object) -> Column:
    """Equality with every value that is given; null and empty ones hold for every row."""
    out = F.lit(True)
    for name, value in values.items():
        if value is not None and value != "":
            out &= F.col(name) == value
    return out


def paged(rows: DataFrame, limit: int, offset: int, most: int = 500) -> DataFrame:
    """A page of ordered rows; limits are held between 1 and ``most``, offsets at 0 or more."""
    return rows.offset(max(0, offset)).limit(min(max(1, limit), most))
