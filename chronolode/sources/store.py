"""Tables of the index as Parquet versions, and the changes that they know.

A change makes a new version beside the current one, so readers keep theirs and a failed change leaves the table as it was. Every
change is one plan: appends that skip known keys, appends, replacing and accumulating upserts, deletes, key updates.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolode.sources.files import VersionLog

MOST_PARTS = 50


def new_rows(stored: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """Those of ``rows`` whose key ``stored`` lacks; one row a key."""
    return rows.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def append_new(stored: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``stored`` and those of ``rows`` whose key is not there yet; one row a key of them."""
    return stored.unionByName(new_rows(stored, rows, *keys))


def upsert_replace(stored: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``stored`` with the rows of the same keys replaced; keys are unique in ``rows``."""
    return stored.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows)


def upsert_add(stored: DataFrame, rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """``stored`` with the ``sums`` of ``rows`` added by key; both sides combine before the exchange."""
    both = stored.select(*keys, *sums).unionByName(rows.select(*keys, *sums))
    types = {f.name: f.dataType for f in stored.schema}
    return both.groupBy(*keys).agg(*(F.sum(c).cast(types[c]).alias(c) for c in sums))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row that is last by ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def delete_keys(stored: DataFrame, keys: DataFrame) -> DataFrame:
    return stored.join(keys, keys.columns, "left_anti")


def update_key(stored: DataFrame, column: str, changes: DataFrame) -> DataFrame:
    """``stored`` with ``column`` renamed by ``changes`` (old, new)."""
    joined = stored.join(changes.select(F.col("old").alias(column), "new"), column, "left")
    return joined.withColumn(column, F.coalesce("new", column)).select(*stored.columns)


def lookup(table: DataFrame, column: str, values: Iterable[Any]) -> DataFrame:
    """The rows whose ``column`` is one of ``values``: a pushed-down filter for a few, a join for many."""
    values = list(dict.fromkeys(values))
    if len(values) <= 100:
        return table.where(F.col(column).isin(values))
    keys = table.sparkSession.createDataFrame([(v,) for v in values], table.select(column).schema)
    return table.join(keys, column, "left_semi")


class VersionedTable:
    """A Parquet table below ``path`` in numbered versions, kept over restarts; the newest complete one is current.

    A version is a list of folders. An append adds one, and other changes write one with all rows; after ``MOST_PARTS`` appends the
    folders are joined. The version before the current one stays readable, older ones go.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.schema, self.log = spark, schema, VersionLog(spark, path)

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*map(self.log.at, parts))

    def _write(self, rows: DataFrame) -> str:
        name = self.log.fresh("part")
        rows.write.parquet(self.log.at(name))
        return name

    def read(self) -> DataFrame:
        return self._read(self.log.content.get("parts", []))

    def replace(self, rows: DataFrame) -> DataFrame:
        self.log.commit({"parts": [self._write(rows)]})
        return self.read()

    def append(self, rows: DataFrame) -> DataFrame:
        parts = [*self.log.content.get("parts", []), self._write(rows.select(*self.read().columns))]
        if len(parts) > MOST_PARTS:
            parts = [self._write(self._read(parts))]
        self.log.commit({"parts": parts})
        return self.read()

    def append_new(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Appends those of ``rows`` whose key is not there yet, one row a key."""
        return self.append(new_rows(self.read(), rows, *keys))

    def upsert(self, rows: DataFrame, *keys: str) -> DataFrame:
        return self.replace(upsert_replace(self.read(), rows, *keys))

    def clear(self) -> DataFrame:
        self.log.commit({"parts": []})
        return self.read()
