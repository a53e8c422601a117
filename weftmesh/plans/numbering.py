"""Dense numbers and running sums over a whole table, without bringing it into one task.

Rows are dealt by ranges of their order, sorted within each range and written;
the ranges' totals (one row a partition) give each range its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

_PART, _PLACE = "_range_of_row", "_place_of_row"


def _ranged(df: DataFrame, by: list[str]) -> DataFrame:
    table = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_PLACE, F.monotonically_increasing_id())
    return materialize(table.withColumn(_PART, F.shiftright(_PLACE, 33)).withColumn(_PLACE, F.col(_PLACE) - F.shiftleft(_PART, 33)), "numbered")


def _offset(table: DataFrame, size, name: str, start: int) -> DataFrame:
    """The table with what all ranges before a row's range add up to, from ``start`` on."""
    totals, before = [], start
    for part, total in sorted(tuple(r) for r in table.groupBy(_PART).agg(size).collect()):  # one row a partition
        totals.append((part, before))
        before += total
    offsets = table.sparkSession.createDataFrame(totals, f"{_PART} bigint, {name} bigint")
    return table.join(F.broadcast(offsets), _PART)


def numbered(df: DataFrame, by: list[str], name: str, start: int = 0) -> DataFrame:
    """Add ``name``: ``start`` for the first row in the order of ``by``, one more for each next; an empty table stays empty."""
    ranged = _offset(_ranged(df, by), F.count("*"), name, start)
    return ranged.withColumn(name, F.col(name) + F.col(_PLACE)).drop(_PART, _PLACE)


def running_sum(df: DataFrame, by: list[str], size: str, name: str, start: int = 0) -> DataFrame:
    """Add ``name``: ``start`` and the sizes of all rows before in the order of ``by``."""
    ranged = _offset(_ranged(df, by), F.coalesce(F.sum(size), F.lit(0)).cast("bigint"), name, start)
    within = Window.partitionBy(_PART).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn(name, F.col(name) + F.coalesce(F.sum(size).over(within), F.lit(0))).drop(_PART, _PLACE)
