"""Places in an order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.sources import files


def numbered(rows: DataFrame, by: list[str], order: list, name: str, parts: int | None = None) -> DataFrame:
    """rows with name: the place, from 1, of each in its group (the columns by) and the order given.

    Rows are dealt to ranges of group and order and sorted within each; a row's place is its place among the group's rows of
    its range and the number of those in the ranges before. Only these numbers, at most one a group and range, meet in a window,
    so one group may hold all rows. Rows that are equal in the whole order must be equal in all, or the order is not defined.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, part, first, before = _free(rows, "_at", "_part", "_first", "_before")
    held = files.kept(rows)  # read twice: to find the ranges, and to deal the rows
    sort = [*(F.col(f"`{c}`") for c in by), *(F.col(c) if isinstance(c, str) else c for c in order)]
    dealt = held.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn(at, F.monotonically_increasing_id())
    dealt = files.kept(dealt).withColumn(part, F.shiftright(at, 33))
    counts = dealt.groupBy(*by, part).agg(F.min(at).alias(first), F.count("*").alias(before))
    line = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(before).over(line), F.lit(0)))
    keys = [*by, part]
    same = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in keys]  # without by, all rows are one group
    joined = dealt.alias("l").join(counts.alias("r"), same)
    place = F.col(f"l.{at}") - F.col(f"r.{first}") + F.col(f"r.{before}") + 1
    return joined.select(*(F.col(f"l.`{c}`") for c in rows.columns), place.alias(name))


def _free(rows: DataFrame, *wanted: str) -> list[str]:
    taken, out = {c.lower() for c in rows.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
