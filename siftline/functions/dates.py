"""Date display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = (
    r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:[.,]\d{1,6})?)?"
    r"(?:Z|[+-]\d{2}:?\d{2})?$"
)


def format_datetime(col: Column, fmt: str = "yyyy-MM-dd HH:mm") -> Column:
    """ISO text shown as its own wall-clock time; other text is left unchanged."""
    day = F.regexp_extract(col, _ISO, 1)
    minute = F.regexp_extract(col, _ISO, 2)
    second = F.regexp_extract(col, _ISO, 3)
    wall = F.concat(
        day,
        F.lit(" "),
        F.when(minute == "", F.lit("00:00")).otherwise(minute),
        F.when(second == "", F.lit(":00")).otherwise(second),
    )
    stamp = F.try_to_timestamp(F.when(day != "", wall), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(F.date_format(stamp, fmt), col)
