"""Joins of many rows per key with one row per key, where a key may hold much of the rows.

Spark splits a skewed join by itself where both sides come straight from a shuffle and
the big side is the preserved one. These are for the other places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PARTS = 1000


def hot_keys(counts: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """Keys with more than one part in ``parts`` of all rows, and the pieces to cut them in.

    ``counts`` has (key, rows). Fewer than ``parts`` keys can hold that much, and their
    pieces add up to less than twice ``parts``, whatever the data.
    """
    total = counts.agg(F.sum("rows")).scalar()
    pieces = F.ceil(F.col("rows") * parts / total).cast("int")
    return counts.where(F.col("rows") * parts > total).select(key, pieces.alias("pieces"))


def spread_join(
    rows: DataFrame,
    single: DataFrame,
    key: str,
    row_id: str,
    counts: DataFrame | None = None,
    how: str = "inner",
    parts: int = PARTS,
) -> DataFrame:
    """Join ``rows`` with a side that has one row per key; no key goes to one task whole.

    Rows of a hot key are spread over pieces by their id, and the other side's row is
    repeated once per piece. ``how`` is inner or left. Both sides are shuffled: Spark sizes
    them by compressed files before rows are exploded, and would take either for small
    enough to be collected by the driver and sent to every task.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("rows"))
    # Below ``parts`` rows by construction, so sending it to every task is safe.
    hot = F.broadcast(hot_keys(counts, key, parts))
    number = F.xxhash64(row_id)
    piece: Column = F.when(F.col(key).isNull(), F.pmod(number, F.lit(parts))).when(
        F.col("pieces").isNotNull(), F.pmod(number, F.col("pieces"))
    )
    left = rows.join(hot, key, "left").withColumn("piece", F.coalesce(piece, F.lit(0)).cast("int")).drop("pieces")
    last = F.coalesce("pieces", F.lit(1)) - 1
    right = single.join(hot, key, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), last))).drop("pieces")
    return left.join(right.hint("merge"), [key, "piece"], how).drop("piece")


def join_many(single: DataFrame, many: DataFrame, key: str, row_id: str) -> DataFrame:
    """A left join of one row per key with its many rows: those without any appear once."""
    matched = spread_join(many, single, key, row_id)
    alone = single.join(many.select(key).distinct().hint("merge"), key, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)
