"""Runs a streaming frame over the files at hand and returns what it wrote as a table."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schema import RAW_EVENTS_DDL
from tidewatch.session import ROCKSDB, scratch_dir
from tidewatch.sources.managed import UpsertTable
from tidewatch.sources.telemetry import to_telemetry

#: Files of a micro-batch: bounds what a keyed state is handed at a time.
FILES_PER_BATCH = 16


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """What streams with ``transformWithState`` need of any session, set for as long as they are made and run.

    Spark's default store holds no state of several columns. The worker that Spark starts beside the driver to declare the state
    sees only the Python path, not the files that were added to the session.
    """
    provider, environment = "spark.sql.streaming.stateStore.providerClass", spark.sparkContext.environment
    store, path = spark.conf.get(provider, None), environment.get("PYTHONPATH")
    root = str(Path(__file__).resolve().parents[2])
    spark.conf.set(provider, ROCKSDB)
    environment["PYTHONPATH"] = os.pathsep.join([root, path] if path else [root])
    try:
        yield
    finally:
        spark.conf.set(provider, store) if store else spark.conf.unset(provider)
        environment.update(PYTHONPATH=path) if path else environment.pop("PYTHONPATH")


def telemetry_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = FILES_PER_BATCH) -> DataFrame:
    """Telemetry as a stream over the event files, with ``event_time`` for watermarks."""
    reader = spark.readStream.schema(RAW_EVENTS_DDL)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_event_time(to_telemetry(reader.parquet(f"{sf_dir}/events*.parquet")))


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis("ts_ms"))


def append_to_path(stream: DataFrame, name: str) -> str:
    """Append mode into a file sink (each row exactly once), until the input is used up; returns its folder."""
    spark = stream.sparkSession
    path, state = scratch_dir(spark, name), scratch_dir(spark, f"{name}-state")
    run = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
        .trigger(availableNow=True).start(path)
    )
    run.awaitTermination()
    return path


def append_to_table(stream: DataFrame, name: str) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(append_to_path(stream, name))


def publish(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Every micro-batch goes to a topic folder under its batch number.

    A repeated batch overwrites its own folder, so a retry leaves no duplicates.
    """
    spark = stream.sparkSession
    path, state = scratch_dir(spark, name), scratch_dir(spark, f"{name}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run = (
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    schema = stream.schema.add("batch_id", "long")
    return spark.read.schema(schema).parquet(path)


def each_batch(stream: DataFrame, make: Callable[[DataFrame], DataFrame], name: str) -> str:
    """Every micro-batch is made into rows by ``make``, a batch computation, and written under its number; returns the folder.

    A repeated batch overwrites its own folder, so a retry leaves no duplicates.
    """
    spark = stream.sparkSession
    path, state = scratch_dir(spark, name), scratch_dir(spark, f"{name}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return path


def merge_batches(stream: DataFrame, table: UpsertTable, name: str, state: str | None = None) -> str:
    """Every micro-batch is merged into ``table`` under its number. With the checkpoint folder of an earlier run, which is returned,
    only what has come since is read."""
    state = state or scratch_dir(stream.sparkSession, f"{name}-state")
    run = stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return state


def newest_version(topic: DataFrame, keys: list[str]) -> DataFrame:
    """Latest published row per key of a stream run in update mode."""
    values = [c for c in topic.columns if c not in (*keys, "batch_id")]
    return topic.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(*keys, "_v.*")
