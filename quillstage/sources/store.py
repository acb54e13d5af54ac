"""Key-value stores as tables that are bucketed by their keys, so that two of them are merged where they lie.

A store's rows are dealt to parts by a hash of the keys, each a folder, and within a part to buckets, sorted by key. Stores of equal keys
and buckets are joined bucket by bucket without a shuffle. A merge into a store reads and rewrites only the parts that have
one of the incoming keys: the incoming rows alone are shuffled, to the buckets of the store.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstage.sources.folder import shared_folder

PARTS, BUCKETS = 16, 8
_MODE = "spark.sql.sources.partitionOverwriteMode"


@dataclass
class Store:
    spark: SparkSession
    name: str
    keys: list[str]
    columns: list[str]
    parts: int

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.keys, *self.columns)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__part", F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def touched(self, incoming: DataFrame) -> list[int]:
        """The parts that have one of the incoming keys: at most as many numbers as there are parts."""
        return sorted(r[0] for r in self._dealt(incoming.select(*self.keys)).select("__part").distinct().collect())

    def merge(self, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> list[int]:
        """Puts ``combine`` of the stored rows and the incoming ones in the place of the touched parts, of which it returns the numbers."""
        parts = self.touched(incoming)
        if not parts:
            return parts
        stored = self.spark.table(self.name).filter(F.col("__part").isin(parts)).select(*self.keys, *self.columns)
        merged = self._dealt(combine(stored, incoming.select(*self.keys, *self.columns), self.keys).select(*self.keys, *self.columns))
        before = self.spark.conf.get(_MODE)
        self.spark.conf.set(_MODE, "dynamic")
        try:
            merged.write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(_MODE, before)
        return parts


def stored(rows: DataFrame, keys: list[str], parts: int = PARTS, buckets: int = BUCKETS, name: str | None = None) -> Store:
    """A new store of rows with one row for each of the keys, its files in the shared folder."""
    spark, name = rows.sparkSession, name or f"store_{uuid.uuid4().hex}"
    columns = [c for c in rows.columns if c not in keys]
    store = Store(spark, name, keys, columns, parts)
    dealt = store._dealt(rows.select(*keys, *columns)).repartition(*keys)
    dealt.write.partitionBy("__part").bucketBy(buckets, *keys).sortBy(*keys).option("path", shared_folder(spark, "store")).saveAsTable(name)
    return store


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of ``new``, and those of ``old`` that it lacks: incoming entries replace stored ones."""
    return kept(new, old, keys)


def kept(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of ``old``, and those of ``new`` that it lacks: stored entries stay."""
    columns = [c for c in old.columns if c not in keys]
    a, b = (side.select(*keys, F.struct(*columns).alias(name)) for side, name in ((old, "__a"), (new, "__b")))
    both: Column = F.coalesce("__a", "__b")
    return a.join(b, keys, "full_outer").select(*keys, *(both[c].alias(c) for c in columns))
