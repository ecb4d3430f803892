"""Session settings and the scratch folder used for tables, streams and checkpoints."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for sessions whose workers cannot import it from a shared path."""
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="package-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))


def get_spark(app: str = "tidewatch", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster passes its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEWATCH_DRIVER_MEMORY", "8g"))
        # Above this size the JVM would interpret a generated method instead of compiling it.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can reach.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors are one process, may do without: it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Gives shuffle files back at the end of a query.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(FREE_SHUFFLES, before)


class Workspace:
    """Intermediate tables of one computation in a folder of the shared scratch space, removed as soon as they are of no use.

    ``write`` cuts the lineage like ``materialise``. Used as a context manager, it removes what is left of the folder at the end, also after a failure.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.count = spark, scratch_dir(spark, name), 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self._remove(self.base)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}-{name}"
        _write(df, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that ``write`` returned; frames made of them must not be used any more."""
        for t in tables:
            self._remove(t._workspace_path)

    def _remove(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write once to the shared folder and read back.

    Unlike a local checkpoint the files survive the loss of executors. Shuffle files are given back when the table is
    written, as nothing can ask for them later.
    """
    path = scratch_dir(df.sparkSession, name)
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
