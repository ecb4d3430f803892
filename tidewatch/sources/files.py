"""Text and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schema import CONNECTION_DDL


def read_log_lines(spark: SparkSession, folder: str, pattern: str = "*.log") -> DataFrame:
    """Lines of every log file below a folder with their file and offset-free text."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    )


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """Headerless connection records; the 43 column names and types are supplied."""
    return spark.read.schema(CONNECTION_DDL).option("header", False).csv(path)


def read_labelled(spark: SparkSession, path: str, label: str = "Label") -> DataFrame:
    """CSV with a header and a label column: benign is 0, everything else 1; features are doubles."""
    df = spark.read.option("header", True).csv(path)
    if label not in df.columns:
        raise ValueError(f"the file must contain a {label!r} column")
    features = [c for c in df.columns if c != label]
    return df.select(
        *[F.col(c).try_cast("double").alias(c) for c in features],
        F.when(F.lower(label) == "benign", 0).otherwise(1).alias("y"),
    )
