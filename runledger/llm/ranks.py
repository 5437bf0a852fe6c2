"""Places of rows in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from runledger.llm.common import sent_if_small, stored

_INDEX_BITS = 33  # monotonically_increasing_id holds the row's number in its partition in its lower 33 bits


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with ``place``, their number from 0 in ascending order of the columns (null first); a stored table.

    Rows are dealt to sorted ranges and written with their number inside the range; the ranges'
    sizes, one row each, are summed up before them. Give an order without large ties, for equal
    rows share a range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranged.withColumn("at", F.monotonically_increasing_id()), name)
    rows = rows.select(*df.columns, F.shiftright("at", _INDEX_BITS).alias("_range"), F.col("at").bitwiseAND((1 << _INDEX_BITS) - 1).alias("_index"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))
    begins = stored(sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin")), f"{name}-ranges")
    placed = rows.join(sent_if_small(begins), "_range")
    return placed.select(*df.columns, (F.col("_begin") + F.col("_index")).alias("place"))
