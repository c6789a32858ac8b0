"""RFC 3339 text of a timestamp, always in UTC."""

from pyspark.sql import Column, functions as F


def rfc3339_utc(ts: Column) -> Column:
    """``2024-01-01T00:00:00.25Z``: trailing zeros of the fraction are dropped.

    Shifting to UTC first keeps the text right whatever zone the session displays in.
    """
    shown = F.to_utc_timestamp(ts, F.current_timezone()).cast("string")
    return F.concat(F.replace(shown, F.lit(" "), F.lit("T")), F.lit("Z"))
