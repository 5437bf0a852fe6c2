"""Text forms of values: messages, exported cells and timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def job_message(job_id: Column, before: str, after: str) -> Column:
    return F.concat(F.lit(before), job_id.cast("string"), F.lit(after))


def iso_text(moment: Column) -> Column:
    """ISO text of a timestamp: seconds left out when zero, fractions of 3 or 6 digits."""
    text = F.translate(moment.cast("string"), " ", "T")
    whole = F.regexp_replace(text, ":00$", "")
    fraction = F.substring_index(text, ".", -1)
    padded = F.when(F.length(fraction) <= 3, F.rpad(fraction, 3, "0")).otherwise(F.rpad(fraction, 6, "0"))
    return F.when(F.instr(text, ".") > 0, F.concat(F.substring_index(text, ".", 1), F.lit("."), padded)).otherwise(whole)


def stamp_text(moment: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.f`` with at least one digit of fraction."""
    text = moment.cast("string")
    return F.when(F.instr(text, ".") > 0, text).otherwise(F.concat(text, F.lit(".0")))


def parsed_stamp(text: Column) -> Column:
    """The first 19 characters of a timestamp text; null when they do not parse."""
    return F.substring(text, 1, 19).try_cast("timestamp_ntz")


def flag_text(flag: Column) -> Column:
    return F.when(flag, "True").otherwise("False")
