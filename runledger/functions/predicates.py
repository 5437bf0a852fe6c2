"""Filters built from optional parameters."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from runledger.model import DAY_COLUMN


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions that are given; true when none is."""
    given = [condition for condition in conditions if condition is not None]
    return reduce(and_, given) if given else F.lit(True)


def moment(value: str | date | datetime) -> Column:
    """A constant timestamp without zone, independent of any machine's clock zone."""
    return F.lit(str(value)).cast("timestamp_ntz")


def _day(value: str | date) -> date:
    return date.fromisoformat(str(value))


def in_days(column: Column, start: str | date | None = None, end: str | date | None = None) -> Column | None:
    """Whole days ``start`` to ``end``, both included, either left out.

    Written as a half-open range on the bare column, so the scan can skip files and
    row groups by their minimum and maximum.
    """
    lower = column >= moment(_day(start)) if start else None
    upper = column < moment(_day(end) + timedelta(days=1)) if end else None
    return None if lower is None and upper is None else all_of(lower, upper)


def in_hour(column: Column, day: str | date | None, hour: int | None) -> Column | None:
    """An hour of the day, of one day or of any; a day alone keeps all its hours."""
    if day and hour is not None:
        start = datetime.combine(_day(day), datetime.min.time()) + timedelta(hours=hour)
        return (column >= moment(start)) & (column < moment(start + timedelta(hours=1)))
    if hour is not None:
        return F.hour(column) == hour
    return in_days(column, day, day)


def created_within(
    df: DataFrame, start: str | date | None = None, end: str | date | None = None, hour: int | None = None
) -> DataFrame:
    """Rows created on whole days, or in one hour of a day or of any day.

    Where the table is laid out by day, the days are given to its folders as well.
    """
    created = F.col("date_created")
    if hour is not None:
        if start != end:
            raise ValueError("an hour belongs to one day or to any")
        condition = in_hour(created, start, hour)
    else:
        condition = in_days(created, start, end)
    if DAY_COLUMN in df.columns:
        folder = F.col(DAY_COLUMN)
        first = folder >= F.lit(_day(start)) if start else None
        last = folder <= F.lit(_day(end)) if end else None
        condition = all_of(condition, first, last)
    return df.where(all_of(condition)).drop(DAY_COLUMN)


def contains_text(column: Column, value: str, ignore_case: bool = False) -> Column:
    """SQL ``like '%value%'`` on the column's text."""
    text = column.cast("string")
    if ignore_case:
        return F.upper(text).like(f"%{value.upper()}%")
    return text.like(f"%{value}%")


def is_blank(column: Column) -> Column:
    """Null or the empty text."""
    return F.coalesce(column, F.lit("")) == ""
