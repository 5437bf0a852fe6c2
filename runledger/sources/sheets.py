"""Upload sheets as CSV: exact headings, text cells and row numbers from 2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from runledger.model import JOB_SHEET_COLUMNS, JOB_SHEET_HEADINGS, TASK_SHEET_HEADINGS


class HeadingError(ValueError):
    """A sheet's headings are not the expected ones."""


def check_headings(found: Sequence[str], headings: Sequence[str], exact: bool = False) -> None:
    """Headings have to agree by position; the first that does not is named.

    ``exact`` refuses further columns, as task sheets do.
    """
    if exact and len(found) > len(headings):
        raise HeadingError(f"File at row 1 has {len(found)} headings instead of {len(headings)}.")
    for place, heading in enumerate(headings):
        if place >= len(found) or found[place] != heading:
            raise HeadingError(f"File at row 1 {heading} heading missing.")


def _has_long_records(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell goes on in the next line: some line then has an odd number of quotes."""
    quotes = F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '[^"]', "")
    return not spark.read.text(path).where(F.length(quotes) % 2 == 1).isEmpty()


def read_sheet(
    spark: SparkSession,
    path: str,
    headings: Sequence[str] = JOB_SHEET_HEADINGS,
    columns: Sequence[str] = JOB_SHEET_COLUMNS,
) -> DataFrame:
    """The cells of a sheet, or of a folder of sheets, as text with their row numbers.

    The first file's headings are compared before anything is loaded and those of the
    others while they are read. A row's number is its place in its file: the rows of
    the file's earlier blocks plus its place in its own block, so large files are read
    and numbered by many tasks. ``load_no`` counts on over all sheets, in order of their
    paths, and is unique in the folder. A blank cell is an empty text. A cell may hold line
    breaks; only where one does, files are read whole, each by one task, and a row counts as one
    however many lines it has.
    """
    long_records = _has_long_records(spark, path)
    found = spark.read.csv(path, header=True, enforceSchema=False, multiLine=long_records).columns
    check_headings(found, headings, exact=tuple(headings) == tuple(TASK_SHEET_HEADINGS))
    schema = ", ".join(f"`{heading}` string" for heading in headings)
    lines = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("multiLine", long_records)
        .csv(path)
        .select(
            *(F.coalesce(F.col(f"`{heading}`"), F.lit("")).alias(column) for heading, column in zip(headings, columns)),
            F.col("_metadata.file_path").alias("sheet"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .withColumn("place", F.monotonically_increasing_id())
    )
    blocks = lines.groupBy("sheet", "block").agg(F.count("*").alias("rows"), F.min("place").alias("first_place"))
    # One row per file block, so this running sum stays small whatever the sheets hold.
    before = Window.partitionBy("sheet").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    all_before = Window.orderBy("sheet", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "sheet", "block", "first_place", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("rows").over(all_before), F.lit(0)).alias("all_before"),
    )
    inside = F.col("place") - F.col("first_place")
    return lines.join(blocks, ["sheet", "block"]).select(
        "sheet", (F.col("rows_before") + inside + 2).alias("row_no"), (F.col("all_before") + inside + 1).alias("load_no"), *columns
    )


def write_sheet(rows: DataFrame, path: str, headings: Sequence[str], columns: Sequence[str]) -> None:
    """Write rows as CSV sheets with the given headings."""
    named = rows.select(*(F.col(column).alias(heading) for heading, column in zip(headings, columns)))
    named.write.mode("overwrite").option("header", True).csv(path)
