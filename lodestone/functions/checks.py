"""Checks of arguments from outside, and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The most results and tokens that one call may ask for.
MAX_RESULTS, MAX_TOKENS = 100, 100_000


def bounded(name: str, value, most: int) -> int:
    """value, if it is a whole number from 1 to `most`; truth values and texts are none."""
    if type(value) is not int:
        raise ValueError(f"{name} must be an integer")
    if not 1 <= value <= most:
        raise ValueError(f"{name} must be between 1 and {most}")
    return value


def iso(seconds: Column) -> Column:
    """Seconds as 2024-01-31T12:00:00+00:00, with a fraction only if there is one; null for null."""
    micros = F.round(seconds.cast("double") * 1_000_000).cast("long")
    at = F.timestamp_micros(micros)
    whole = F.pmod(micros, F.lit(1_000_000)) == 0
    # The same moment whatever the session's time zone is.
    text = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(text, F.when(whole, "").otherwise(F.concat(F.lit("."), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"))), F.lit("+00:00"))


def epoch(text: Column) -> Column:
    """Seconds of an ISO time; without a zone it is UTC; null for what can't be read."""
    zoned = text.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$")
    at = F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("+00:00"))))
    return F.unix_micros(at) / 1_000_000
