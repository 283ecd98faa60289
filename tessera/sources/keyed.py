"""Tables with one row for each key, bucketed by it, so that joins by key and upserts shuffle what is new and never what is stored.

Every upsert writes a new version: each bucket is read, met with the batch's rows of that bucket, and written by the same task. A version counts from the moment its entry is
there whole (schema, buckets, the stream's epoch), so a job that dies leaves the version before it; versions that no entry names, and older ones, go with ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import exists


class KeyedTable:
    """A table below ``path``. One writer at a time; readers keep the version that they found."""

    def __init__(self, spark: SparkSession, path: str, key: str = "point_id", buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.turn, self.epoch, self.version, self.schema = 0, -1, None, None
        for turn in sorted(self._entries(), reverse=True):
            self.turn = max(self.turn, turn)
            if exists(spark, f"{self.path}/entries/{turn}/_SUCCESS"):
                about = json.loads(spark.read.text(f"{self.path}/entries/{turn}").first()[0])
                self.epoch, self.version, self.key, self.buckets = about["epoch"], about["version"], about["key"], about["buckets"]
                self.schema = StructType.fromJson(about["schema"])
                break

    def _files(self, path: str) -> list:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return list(at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at)) if exists(self.spark, path) else []

    def _entries(self) -> list[int]:
        return [int(f.getPath().getName()) for f in self._files(f"{self.path}/entries")]

    def _name(self, version: str) -> str:
        return f"keyed_{version}"

    def read(self) -> DataFrame | None:
        """The rows, in buckets that Spark knows of; None before the first upsert."""
        if self.version is None:
            return None
        name = self._name(self.version)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data-{self.version}'")
        return self.spark.table(name)

    def upsert(self, batch: DataFrame, *, order: str | None = None, epoch: int | None = None) -> None:
        """Rows of the batch replace those of their keys or are new. Of rows with equal keys in a batch the one with the largest ``order`` counts, without it the largest row; rows
        without a key are left out. Columns that the batch lacks become null in its rows, new columns are added (null in what is stored). epoch: of a stream's batch; one that has been applied is left out.
        """
        if epoch is not None and epoch <= self.epoch:
            return
        stored = self.read()
        columns = list(self.schema.names) if self.schema is not None else []
        fresh = [c for c in batch.columns if c not in columns]
        kinds = {f.name: f.dataType for f in [*(self.schema.fields if self.schema is not None else []), *batch.schema.fields][::-1]}
        names = [*columns, *fresh]
        row = F.struct(*([F.col(f"`{order}`").alias("_order")] if order else []), *[(F.col(f"`{c}`") if c in batch.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names])
        best = batch.filter(F.col(f"`{self.key}`").isNotNull()).select(F.col(f"`{self.key}`").alias("_key"), row.alias("_new"))
        best = best.groupBy("_key").agg(F.max("_new").alias("_new"))
        if stored is None:
            out = best.repartition(self.buckets, "_key").select(*[F.col("_new")[c].alias(c) for c in names])
        else:
            new = best.repartition(self.buckets, "_key")
            both = stored.hint("merge").join(new, stored[self.key] == new["_key"], "full_outer")
            there = F.col("_key").isNotNull()
            own = lambda c: F.col(f"`{c}`") if c in columns else F.lit(None).cast(kinds[c])
            out = both.select(*[F.when(there, F.col("_new")[c]).otherwise(own(c)).alias(c) for c in names])
        version = uuid.uuid4().hex
        out.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.path}/data-{version}").saveAsTable(self._name(version))
        self.schema = StructType([f for f in self.spark.table(self._name(version)).schema.fields])
        self.turn, self.epoch, self.version = self.turn + 1, self.epoch if epoch is None else epoch, version
        about = {"epoch": self.epoch, "version": version, "key": self.key, "buckets": self.buckets, "schema": self.schema.jsonValue()}
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{self.path}/entries/{self.turn}")

    def missing(self, rows: DataFrame, *, same: str | None = None) -> DataFrame:
        """Rows whose key is not stored; same: nor stored with an equal value of that column (the content's hash). The stored side is not shuffled."""
        stored = self.read()
        if stored is None:
            return rows
        # one stored row for each key: a left join by the key alone keeps the buckets, where two keys would need others
        held = stored.select(F.col(f"`{self.key}`").alias("_stored"), *([F.col(f"`{same}`").alias("_same")] if same else []))
        met = rows.join(held.hint("merge"), rows[self.key] == F.col("_stored"), "left")
        gone = F.col("_stored").isNull()
        return met.filter(gone | ~rows[same].eqNullSafe(F.col("_same")) if same else gone).select(*[rows[c] for c in rows.columns])

    def vacuum(self) -> int:
        """Delete the data of all versions but the present one, their entries too; the number of versions that went."""
        gone = [f.getPath() for f in self._files(self.path) if f.getPath().getName().startswith("data-") and f.getPath().getName() != f"data-{self.version}"]
        for at in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(at.getName()[5:])}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        for f in self._files(f"{self.path}/entries"):
            if int(f.getPath().getName()) < self.turn:
                f.getPath().getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(f.getPath(), True)
        return len(gone)
