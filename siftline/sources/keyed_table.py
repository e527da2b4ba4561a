"""A stored table with one row per key, merged part by part (W1, W2, W9 at scale)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import cut_lineage


@dataclass(frozen=True)
class KeyedTable:
    """Parquet files in parts by hash of the key, and in buckets of the key within a part.

    A merge rewrites only the parts that hold an incoming key, each in one step when the
    job commits.  The stored rows are read in their buckets and never shuffled.
    """

    spark: SparkSession
    name: str
    key: str
    parts: int

    @staticmethod
    def create(spark: SparkSession, path: str, schema: str, key: str, parts: int = 64, buckets: int = 64) -> "KeyedTable":
        """A new table at a path."""
        name = f"siftline_keyed_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {name} ({schema}, part INT) USING parquet PARTITIONED BY (part) "
            f"CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return KeyedTable(spark, name, key, parts)

    @staticmethod
    def open(spark: SparkSession, path: str, schema: str, key: str, parts: int = 64, buckets: int = 64) -> "KeyedTable":
        """The table at a path, with the numbers of parts and buckets it was created with."""
        table = KeyedTable.create(spark, path, schema, key, parts, buckets)
        spark.sql(f"ALTER TABLE {table.name} RECOVER PARTITIONS")
        return table

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), self.parts).cast("int")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop("part")

    def kept(self, incoming: DataFrame, touched: list[int]) -> DataFrame:
        """Stored rows of the touched parts whose key does not come in."""
        stored = self.spark.table(self.name).filter(F.col("part").isin(touched))
        return stored.join(incoming.select(self.key), self.key, "left_anti")

    def merge(self, incoming: DataFrame) -> list[int]:
        """Insert or replace by key; ``incoming`` has one row per key.  Returns the parts rewritten."""
        columns = self.spark.table(self.name).columns
        # stored, as it is read for the parts, for the keys and for the rows
        held = cut_lineage(incoming.withColumn("part", self._part()).select(columns), "incoming")
        touched = sorted(r["part"] for r in held.select("part").distinct().collect())
        if touched:
            merged = self.kept(held, touched).select(columns).unionByName(held)
            conf, mode = self.spark.conf, "spark.sql.sources.partitionOverwriteMode"
            before = conf.get(mode)
            conf.set(mode, "dynamic")
            try:
                merged.write.insertInto(self.name, overwrite=True)
            finally:
                conf.set(mode, before)
        return touched
