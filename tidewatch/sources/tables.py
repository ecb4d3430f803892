"""Stored tables: events, alerts, devices, exports and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.times import day_of
from tidewatch.settings import ENSEMBLE_DEFAULTS


def write_events(tel: DataFrame, path: str) -> None:
    """One folder per event date. A day is written in as many files as its size asks for."""
    (
        tel.withColumn("event_date", day_of(F.col("ts_ms")))
        .hint("rebalance", "event_date")
        .write.mode("overwrite").partitionBy("event_date").parquet(path)
    )


def alert_id(*parts: str):
    """Replaying the same window writes the same id."""
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256)


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Appends may repeat an id after a replay; each id is read once."""
    return spark.read.parquet(path).dropDuplicates(["anomaly_id"])


def refresh_devices(devices: DataFrame, contacts: DataFrame) -> DataFrame:
    """First and last contact per device merged into the stored dimension."""
    seen = contacts.groupBy("device_id").agg(F.min("ts_ms").alias("_first"), F.max("ts_ms").alias("_last"))
    return (
        devices.join(seen, "device_id", "full_outer")
        .select(
            "device_id",
            F.coalesce("name", F.concat(F.lit("Device-"), F.substring("device_id", 1, 8))).alias("name"),
            F.least("first_seen_ms", "_first").alias("first_seen_ms"),
            F.greatest("last_seen_ms", "_last").alias("last_seen_ms"),
            (F.col("_last").isNotNull() | F.coalesce("is_active", F.lit(False))).alias("is_active"),
        )
    )


def upgrade_schema(stored: DataFrame, required: T.StructType) -> DataFrame:
    """Adds missing columns as nulls; never drops or retypes a stored one."""
    empty = stored.sparkSession.createDataFrame([], required)
    missing = [f.name for f in required if f.name not in stored.columns]
    return stored.unionByName(empty.select(*missing), allowMissingColumns=True) if missing else stored


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def load(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def ensemble_config(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row of weights and thresholds: the file's values, defaults where it has none."""
    defaults = spark.range(1).select(*[F.lit(v).alias(k) for k, v in ENSEMBLE_DEFAULTS.items()])
    if not path:
        return defaults
    ddl = (
        "weights STRUCT<tabular:DOUBLE,text:DOUBLE>, thresholds STRUCT<tabular:DOUBLE,text:DOUBLE,ensemble:DOUBLE>"
    )
    stored = _only(spark.read.schema(ddl).option("multiLine", True).json(path), path).select(
        F.col("weights.tabular").alias("w_tabular"), F.col("weights.text").alias("w_text"),
        F.col("thresholds.tabular").alias("t_tabular"), F.col("thresholds.text").alias("t_text"),
        F.col("thresholds.ensemble").alias("t_ensemble"),
    )
    return _first_given(stored, defaults)


def _only(rows: DataFrame, path: str) -> DataFrame:
    """An artifact is one record; with two it would be unclear which one holds."""
    if len(rows.take(2)) > 1:
        raise ValueError(f"more than one record in {path}")
    return rows


def _first_given(stored: DataFrame, fallback: DataFrame) -> DataFrame:
    """One row: each column from ``stored`` where it has a value, else from ``fallback``."""
    both = stored.withColumn("_rank", F.lit(1)).unionByName(fallback.withColumn("_rank", F.lit(0)))
    return both.agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in fallback.columns])


def stored_baseline(spark: SparkSession, path: str | None, dim: int) -> DataFrame:
    """Fleet baseline from a JSON file, or zeros and identity where it is missing or misfits."""
    fallback = spark.range(1).select(
        F.array_repeat(F.lit(0.0), dim).alias("mean"),
        F.expr(f"transform(sequence(0, {dim * dim - 1}), i -> IF(i % {dim + 1} = 0, 1D, 0D))").alias("cov"),
    )
    if not path:
        return fallback
    read = spark.read.schema("baseline_mean ARRAY<DOUBLE>, baseline_covariance ARRAY<ARRAY<DOUBLE>>")
    stored = (
        _only(read.option("multiLine", True).json(path), path)
        .filter(F.size("baseline_mean") == dim)
        .select(F.col("baseline_mean").alias("mean"), F.flatten("baseline_covariance").alias("cov"))
    )
    return _first_given(stored, fallback)
