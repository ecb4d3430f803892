"""Tables of unchanging folders under numbered versions: retention that removes, and upserts that rewrite what they touch.

A version is one small JSON file that lists the folders that count, with their rows. It appears in one step, so a reader sees a whole
version or the one before; a failed write leaves folders that no version lists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.functions.times import DAY_MS

VERSIONS = "_versions"


class ManagedTable:
    """Folders of a table, each with a ``part`` value (a day, a bucket) and its number of rows."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.jvm = spark._jvm
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> tuple[int, dict]:
        """Number and content of the newest version; -1 and an empty table before the first."""
        root = self._at(f"{self.path}/{VERSIONS}")
        names = [str(x.getPath().getName()) for x in self.fs.listStatus(root)] if self.fs.exists(root) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return -1, {"parts": [], "applied": -1}
        newest = max(numbers)
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/{VERSIONS}/{newest:012d}").first()[0]
        return newest, json.loads(text)

    def _commit(self, number: int, content: dict) -> None:
        """The next version. Two writers that started from the same version cannot both succeed."""
        target = f"{self.path}/{VERSIONS}/{number:012d}"
        draft = f"{self.path}/{VERSIONS}/.{uuid.uuid4().hex}"
        out = self.fs.create(self._at(draft), False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        if self.fs.exists(self._at(target)) or not self.fs.rename(self._at(draft), self._at(target)):
            self.fs.delete(self._at(draft), False)
            raise RuntimeError(f"version {number} of {self.path} was written by another job")

    def _write(self, rows: DataFrame, part: str) -> list[dict]:
        """Rows written in one folder per value of ``part``, a column that is not stored; their numbers come with the write."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/data-{name}"
        seen = F.count(F.lit(1)).alias("rows")
        rows.select(*self.schema.names, part).hint("rebalance", part).write.partitionBy(part).parquet(folder)
        # Counting without a column reads the footers only.
        back = self.spark.read.schema(StructType([*self.schema.fields, StructField(part, LongType())])).parquet(folder)
        return [{"part": r[0], "folder": f"data-{name}/{part}={r[0]}", "rows": r[1]} for r in back.groupBy(part).agg(seen).collect()]

    def read(self, keep: Callable[[int], bool] = lambda part: True) -> DataFrame:
        """The rows of the newest version whose folder's part satisfies ``keep``."""
        folders = [f"{self.path}/{p['folder']}" for p in self.version()[1]["parts"] if keep(p["part"])]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def remove_unlisted(self, keep: int = 2) -> int:
        """Deletes the folders that none of the last ``keep`` versions lists; returns how many. Not while others write."""
        newest, _ = self.version()
        listed = set()
        for n in range(max(0, newest - keep + 1), newest + 1):
            text = self.spark.read.option("wholetext", True).text(f"{self.path}/{VERSIONS}/{n:012d}").first()[0]
            listed |= {p["folder"] for p in json.loads(text)["parts"]}
        gone = 0
        for top in self.fs.listStatus(self._at(self.path)):
            name = str(top.getPath().getName())
            if not name.startswith("data-"):
                continue
            for x in self.fs.listStatus(top.getPath()):
                if x.isDirectory() and f"{name}/{x.getPath().getName()}" not in listed:
                    self.fs.delete(x.getPath(), True)
                    gone += 1
        return gone


class DayTable(ManagedTable):
    """Rows in folders by the day of a time in milliseconds."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, time: str):
        super().__init__(spark, path, schema)
        self.time = time

    def append(self, rows: DataFrame) -> None:
        number, now = self.version()
        parts = self._write(rows.withColumn("_day", F.floor(F.coalesce(self.time, F.lit(0)) / DAY_MS)), "_day")
        self._commit(number + 1, now | {"parts": now["parts"] + parts})

    def retain(self, since_ms: int) -> dict[str, int]:
        """Removes all rows older than ``since_ms``; returns how many are kept and removed.

        Whole days go by leaving them out of the next version: their rows are known from it and nothing is read. Only
        the folders of the day that ``since_ms`` falls in are read and written again; younger ones stay untouched.
        """
        number, now = self.version()
        edge = since_ms // DAY_MS
        split = [p for p in now["parts"] if p["part"] == edge] if since_ms % DAY_MS else []
        kept = [p for p in now["parts"] if p["part"] > edge or (p["part"] == edge and not split)]
        if split:
            folders = [f"{self.path}/{p['folder']}" for p in split]
            rows = self.spark.read.schema(self.schema).parquet(*folders).filter(F.col(self.time) >= since_ms)
            kept += self._write(rows.withColumn("_day", F.lit(edge).cast("long")), "_day")
        before, after = (sum(p["rows"] for p in x) for x in (now["parts"], kept))
        if after != before:
            self._commit(number + 1, now | {"parts": kept})
        return {"kept": after, "removed": before - after}


class UpsertTable(ManagedTable):
    """The newest non-null value of each field of a key, in hash buckets. Stored beside each field is the version it is from."""

    def __init__(self, spark: SparkSession, path: str, rows: StructType, key: str, version: str, fields: Sequence[str], buckets: int = 64):
        self.key, self.order, self.fields, self.buckets = key, version, list(fields), buckets
        kinds = {f.name: f.dataType for f in rows}
        schema = StructType().add(key, kinds[key]).add(version, kinds[version])
        for f in self.fields:
            schema = schema.add(f, kinds[f]).add(f"_at_{f}", kinds[version])
        super().__init__(spark, path, schema)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Merges rows (key, version, fields; a null field changes nothing). A batch that was merged before is left out.

        Only the buckets that the batch touches are read and written again.
        """
        number, now = self.version()
        if batch_id <= now["applied"]:
            return
        new = batch.select(self.key, self.order, *[c for f in self.fields for c in (F.col(f), F.when(F.col(f).isNotNull(), F.col(self.order)).alias(f"_at_{f}"))])
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets))
        touched = {r[0] for r in new.select(bucket.alias("b")).distinct().collect()}
        both = new.unionByName(self.read(lambda part: part in touched))
        newest = [c for f in self.fields for c in (F.max_by(f, f"_at_{f}").alias(f), F.max(f"_at_{f}").alias(f"_at_{f}"))]
        merged = both.groupBy(self.key).agg(F.max(self.order).alias(self.order), *newest)
        parts = self._write(merged.withColumn("_bucket", bucket), "_bucket") if touched else []
        kept = [p for p in now["parts"] if p["part"] not in touched]
        self._commit(number + 1, {"parts": kept + parts, "applied": batch_id})

    def rows(self) -> DataFrame:
        return self.read().select(self.key, *self.fields, self.order)
