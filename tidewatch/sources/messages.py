"""Wire messages: one JSON array (or object) of events per row and device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.schema import WIRE_EVENT_DDL


def parse_messages(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Normalised events of (device_id, message_id, raw). Malformed messages give no rows."""
    text = F.trim(F.col(raw))
    array_text = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    parsed = F.from_json(array_text, f"array<struct<{WIRE_EVENT_DDL.replace(' STRING', ':string')}>>")
    return messages.select("device_id", "message_id", F.posexplode(parsed).alias("pos", "ev")).select(
        F.trim("device_id").alias("device_id"),
        "message_id",
        "pos",
        F.coalesce("ev.type", "ev.event_type", F.lit("UNKNOWN")).alias("event_type"),
        F.coalesce("ev.packageName", "ev.package_name").alias("package_name"),
        F.coalesce(F.col("ev.timestamp").try_cast("double").cast("long"), F.lit(0)).alias("ts_ms"),
        F.coalesce("ev.data", F.lit("{}")).alias("data"),
    )
