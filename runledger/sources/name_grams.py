"""Postings of three-letter grams of a text column, for searches of a text anywhere inside it.

A search reads the postings of the rarest grams of its text, intersects them, and only rows
they have in common are looked at. Texts of under three letters have no gram and take the scan.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runledger.functions.predicates import contains_text

SIZE = 3
# Grams of a search whose postings are read, the rarest ones; more would seldom spare a row.
USED = 4


def grams_of(value: str) -> list[str]:
    """The grams that every text like ``%value%`` has; ``%`` and ``_`` in a value stand for any text, a backslash tells nothing."""
    pieces = [] if "\\" in value else re.split("[%_]", value)
    return sorted({piece[at : at + SIZE] for piece in pieces for at in range(len(piece) - SIZE + 1)})


class NameGrams:
    """The index of one text column of a table, at a folder of its own.

    With ``ignore_case`` the grams are those of the text in capitals, as the scan compares it.
    The index is written from the table as it is; after a change, write it anew at another folder.
    """

    def __init__(self, spark: SparkSession, location: str, key: str, column: str, ignore_case: bool = False):
        self.spark, self.key, self.column, self.ignore_case = spark, key, column, ignore_case
        self._postings, self._counts = os.path.join(location, "postings"), os.path.join(location, "counts")

    def _folded(self, text: Column) -> Column:
        return F.upper(text) if self.ignore_case else text

    def write(self, table: DataFrame) -> None:
        """Write the postings in the order of grams, each gram once per row, and how many each gram has.

        A gram that a third of the rows have is split over files by the key. Null and short
        texts, and rows without a key, have no postings.
        """
        text = self._folded(F.col(self.column).cast("string"))
        starts = F.sequence(F.lit(1), F.length("text") - (SIZE - 1))
        named = table.select(F.col(self.key).alias("key"), text.alias("text")).where((F.length("text") >= SIZE) & F.col("key").isNotNull())
        each = F.array_distinct(F.transform(starts, lambda at: F.substring("text", at, F.lit(SIZE))))
        postings = named.select(F.explode(each).alias("gram"), "key")
        postings.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.parquet(self._postings)
        counts = self._read_postings().groupBy("gram").agg(F.count("*").alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(self._counts)

    def _read_postings(self) -> DataFrame:
        return self.spark.read.parquet(self._postings)

    def candidates(self, value: str) -> DataFrame | None:
        """Keys (one row each) of all rows that may have the value, or nothing if it has no gram."""
        grams = grams_of(value.upper() if self.ignore_case else value)
        if not grams:
            return None
        # A row per gram of the value at most, of which the rarest come to the driver.
        known = self.spark.read.parquet(self._counts).where(F.col("gram").isin(grams))
        few = known.orderBy("n", "gram").limit(USED).collect()
        rarest = [row["gram"] for row in few]
        wanted = min(USED, len(grams))
        if len(rarest) < wanted:
            rarest = []  # some gram is in no row at all
        found = self._read_postings().where(F.col("gram").isin(rarest) if rarest else F.lit(False))
        shared = found.groupBy("key").agg(F.count("*").alias("n"))
        return shared.where(F.col("n") == wanted).select(F.col("key").alias(self.key))

    def search(self, table: DataFrame, value: str) -> DataFrame:
        """The rows whose text has the value, the same as by a scan with ``contains_text``."""
        found = self.candidates(value)
        rows = table if found is None else table.join(found, self.key, "left_semi")
        return rows.where(contains_text(F.col(self.column), value, self.ignore_case))
