"""Schedule arithmetic on timestamps without zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from runledger.functions.predicates import is_blank

# The unit one recurrence step of each frequency stands for.
STEP_UNITS = {"Mint": "MINUTE", "Hr": "HOUR", "Daily": "DAY", "Weekly": "WEEK", "Monthly": "MONTH"}
FIXED_STEP_SECONDS = {"Mint": 60, "Hr": 3_600, "Daily": 86_400, "Weekly": 604_800}


def clock_part(clock: Column, position: int) -> Column:
    return F.try_element_at(F.split(clock, ":"), F.lit(position)).try_cast("int")


def first_run(start_date: Column, clock: Column) -> Column:
    """Start of the day plus the hours and minutes of an ``HH:mm`` text."""
    minutes = clock_part(clock, 1) * 60 + clock_part(clock, 2)
    return F.timestamp_add("MINUTE", minutes, start_date.cast("timestamp_ntz"))


def last_allowed_run(end_date: Column, clock: Column) -> Column:
    """The end date at the schedule's start time; null when there is no end date."""
    seconds = clock_part(clock, 1) * 3600 + clock_part(clock, 2) * 60 + F.coalesce(clock_part(clock, 3), F.lit(0))
    return F.timestamp_add("SECOND", seconds, end_date.cast("timestamp_ntz"))


def step_count(recurrence: Column) -> Column:
    return F.when(~is_blank(recurrence), recurrence.try_cast("int"))


def next_run(run: Column, frequency: Column, recurrence: Column) -> Column:
    """One recurrence step later; null without a recurrence or a known frequency."""
    steps = step_count(recurrence)
    result = F.lit(None).cast("timestamp_ntz")
    for name, unit in STEP_UNITS.items():
        result = F.when(frequency == name, F.timestamp_add(unit, steps, run)).otherwise(result)
    return result


# Steps in which a monthly day has met every length of month that it will meet.
SETTLED_STEPS = 600


def later_run(run: Column, frequency: Column, steps: Column, times: Column) -> Column:
    """The run reached by ``times`` recurrences of ``steps``, as :func:`next_run` one after the other would; null as there.

    Steps of fixed length multiply. A chain of months never gets a lost day back, so its day is the
    least of the first day and the lengths of the months passed.
    """
    result = F.lit(None).cast("timestamp_ntz")
    far = steps.cast("bigint") * times
    for name, seconds in FIXED_STEP_SECONDS.items():
        result = F.when(frequency == name, F.timestamp_add("MICROSECOND", far * seconds * 1_000_000, run)).otherwise(result)
    month = F.timestamp_add("DAY", 1 - F.dayofmonth(run), run)
    passed = F.sequence(F.lit(0).cast("bigint"), F.least(times.cast("bigint"), F.lit(SETTLED_STEPS)))
    day = F.aggregate(
        passed, F.dayofmonth(run), lambda day, number: F.least(day, F.dayofmonth(F.last_day(F.add_months(F.to_date(month), (number * steps).cast("int")))))
    )
    monthly = F.timestamp_add("DAY", day - 1, F.timestamp_add("MONTH", far.cast("int"), month))
    return F.when(frequency == "Monthly", monthly).otherwise(result)


def at_day_of(moment: Column, day_of: Column) -> Column:
    """The time of day of ``moment`` on the date of ``day_of``."""
    return F.timestamp_add("DAY", F.datediff(F.to_date(day_of), F.to_date(moment)), moment)


def effective_time(status: Column, skip_time: Column, start_time: Column) -> Column:
    """When a queue row ran or was to run: skipped rows carry a skip time."""
    return F.when(status == "Skip", skip_time).otherwise(start_time)


def micros_since_1970(moment: Column) -> Column:
    """Microseconds from 1970 to a zone-free timestamp, by its own reading.

    Built from the date and the clock parts, because differences and truncations of
    timestamps go through the session's zone and would feel its summer time.
    """
    days = F.datediff(F.to_date(moment), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.hour(moment) * 3600 + F.minute(moment) * 60
    fraction = (F.extract(F.lit("SECOND"), moment) * 1_000_000).cast("bigint")
    return (days * 86_400 + seconds) * 1_000_000 + fraction


def months_between_starts(earlier: Column, later: Column) -> Column:
    """Months from the month of one timestamp to the month of another."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def as_instant(column: str) -> Column:
    """A zone-free timestamp as the instant with the same reading in UTC, as watermarks need."""
    return F.timestamp_micros(micros_since_1970(F.col(column)))


def as_local(column: str) -> Column:
    """The inverse of :func:`as_instant`."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.col(column)), start)
