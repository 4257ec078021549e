"""Named periods and dates before a date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name of a period, its first month, its months.
MONTHS = "January February March April May June July August September October November December".split()
PERIODS = {
    **{name: (i, 1) for i, name in enumerate(MONTHS, 1)},
    "Q1": (1, 3), "Q2": (4, 3), "Q3": (7, 3), "Q4": (10, 3),
    "Spring": (3, 3), "Summer": (6, 3), "Fall": (9, 3), "Winter": (12, 3),
}
UNITS = {"day": (1, 0), "week": (7, 0), "month": (0, 1), "quarter": (0, 3)}


def period(name: str, year: int) -> tuple[date, date]:
    """[start, end) of a month, quarter or season; Winter ends in the next year."""
    if name not in PERIODS or not 1 <= year <= 9999:
        raise ValueError(f"no such period: {name} {year}")
    first, months = PERIODS[name]
    over, last = divmod(first - 1 + months, 12)
    return date(year, first, 1), date(year + over, last + 1, 1)


def bounds(years: DataFrame, year: str = "year") -> DataFrame:
    """Every named period of every year with its start and end."""
    named = F.array(*[
        F.struct(F.lit(k).alias("period_name"), F.lit(first).alias("first_month"), F.lit(n).alias("months"))
        for k, (first, n) in PERIODS.items()
    ])
    start = F.make_date(F.col(year), F.col("first_month"), F.lit(1))
    return years.select(year, F.inline(named)).select(
        year, "period_name", start.alias("start_date"), F.add_months(start, F.col("months")).alias("end_date")
    )


def start_date(end: Column, unit: str, count: int) -> Column:
    """``end`` less ``count`` units; a month's end is clipped."""
    if unit not in UNITS or count < 0:
        raise ValueError(f"no such interval: {count} {unit}")
    days, months = (x * count for x in UNITS[unit])
    return end - F.make_dt_interval(F.lit(days)) if days or not months else end - F.make_ym_interval(F.lit(0), F.lit(months))


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from start to end, as a whole number (UTC session)."""
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


# The layouts of timestamps in parameters and in records, and the day from which sheets count.
PARAMETER = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z$"
RECORD = r"^(\d{4}-\d{1,2}-\d{1,2})T(\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6})(Z|[+-]\d{2}:?\d{2})$"
SERIAL_START = "1899-12-30"


def parameter_timestamp(text: Column) -> Column:
    """The timestamp of a parameter, ``YYYY-MM-DDTHH:MM:SSZ``; null for any other text."""
    plain = F.when(text.rlike(PARAMETER), F.translate(text, "TZ", " "))
    return F.try_to_timestamp(F.trim(plain), F.lit("yyyy-M-d H:m:s"))


def parameter_error(text: Column, name: str) -> Column:
    """Why a parameter is no timestamp, null where it is one."""
    message = f"Error: {name} must be in format 'YYYY-MM-DDTHH:MM:SSZ'"
    return F.when(parameter_timestamp(text).isNull(), F.lit(message))


def _record_local(text: Column) -> Column:
    """The wall-clock time that a record states, in its own offset."""
    digits = F.rpad(F.regexp_extract(text, r"\.(\d+)", 1), 6, "0")
    second = F.concat_ws(" ", F.regexp_extract(text, RECORD, 1), F.regexp_extract(text, r"T([\d:]+)\.", 1))
    return F.try_to_timestamp(F.when(text.rlike(RECORD), F.concat(second, F.lit("."), digits)), F.lit("yyyy-M-d H:m:s.SSSSSS"))


def record_timestamp(text: Column) -> Column:
    """The instant of a record, ``YYYY-MM-DDTHH:MM:SS.fff+HHMM``; null for any other text (UTC session)."""
    zone = F.translate(F.regexp_extract(text, RECORD, 3), ":", "")
    minutes = F.coalesce(F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"), F.lit(0))
    ahead = F.when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes)
    return _record_local(text) - F.make_dt_interval(mins=ahead)


def record_month(text: Column) -> Column:
    """The name of the month that a record states, in its own offset."""
    return F.date_format(_record_local(text), "MMMM")


def serial_days(moment: Column, noon_up: bool = False) -> Column:
    """A timestamp as whole spreadsheet days since the end of 1899; noon goes to the even day, or to the next one."""
    seconds = F.unix_micros(moment.cast("timestamp")) - F.unix_micros(F.lit(SERIAL_START).cast("timestamp"))
    whole = F.floor(seconds / 1_000_000)
    return F.floor((whole + 43200) / 86400).cast("double") if noon_up else F.rint(whole / F.lit(86400.0))


def clock_text(time: Column) -> Column:
    """A time's text without its last three characters: the seconds go."""
    return F.substring(time, F.lit(1), F.length(time) - 3)
