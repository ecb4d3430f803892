"""Epoch arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def epoch_seconds(ts: Column) -> Column:
    """A number of seconds or millis (above 1e10) as seconds; null when not positive."""
    value = ts.try_cast("double")
    return F.when(value > 1e10, value / 1000.0).when(value > 0, value)


def normalise_epoch_ms(text: Column) -> Column:
    """Seconds, millis or ISO text (naive means UTC) as epoch millis; null when neither."""
    value = text.try_cast("double")
    date_only = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$")
    iso = F.when(date_only, F.concat(text, F.lit("T00:00:00Z"))).when(zoned, text).otherwise(F.concat(text, F.lit("Z")))
    return (
        F.when(value > 1e10, value.cast("long"))
        .when(value.isNotNull(), (value * 1000).cast("long"))
        .otherwise(F.unix_millis(iso.try_cast("timestamp")))
    )


def day_of(ts_ms: Column) -> Column:
    return F.date_from_unix_date(F.floor(ts_ms / DAY_MS).cast("int"))


def local_hour(ts_ms: Column, offset_ms: Column) -> Column:
    return F.pmod(F.floor((ts_ms + offset_ms) / HOUR_MS), F.lit(24)).cast("int")
