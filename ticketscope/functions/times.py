"""Timestamps and durations. The session time zone is expected to be UTC."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DATED = r"^\d{4}-\d{2}-\d{2}"
_SHORT_OFFSET = r"(:\d{2}(?:\.\d+)?) ?([+-]\d{2})(\d{2})$"
_HOUR_OFFSET = r"(:\d{2}(?:\.\d+)?) ?([+-]\d{2})$"
SECONDS_PER_DAY = 86400
SECONDS_PER_HOUR = 3600


def as_timestamp(df: DataFrame, name: str) -> Column:
    """The column as a zone-less timestamp in UTC; text that does not parse becomes null.

    Text is read whole: a date, with or without minutes, seconds and fractions, and with an offset as `Z`, `+05:00`,
    `+0500` or `+05`. A time with an offset is moved to UTC.
    """
    if isinstance(df.schema[name].dataType, StringType):
        text = F.trim(F.col(name))
        ahead = F.regexp_replace(F.regexp_replace(text, _SHORT_OFFSET, "$1$2:$3"), _HOUR_OFFSET, "$1$2:00")
        spelled = F.when(F.substring(text, -5, 5).rlike("[+-]") & F.contains(text, F.lit(":")), ahead).otherwise(text)
        return F.when(F.substring(text, 1, 10).rlike(_DATED), spelled.try_cast("timestamp")).cast("timestamp_ntz")
    return F.col(name).cast("timestamp_ntz")


def seconds_between(start: str, end: str) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def days_between(start: str, end: str) -> Column:
    """Elapsed days with two decimals."""
    return F.round(seconds_between(start, end) / SECONDS_PER_DAY, 2)


def whole_days_between(start: str, end: str) -> Column:
    """Calendar days; null when either end is missing."""
    return F.datediff(F.to_date(end), F.to_date(start))


def hours_between(start: str, end: str) -> Column:
    return seconds_between(start, end) / SECONDS_PER_HOUR
