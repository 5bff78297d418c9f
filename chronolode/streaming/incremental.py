"""Incremental maintenance of the change table and of coupling counts, as micro-batches over a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.plans.coupling import MAX_PATHS, pair_counts, with_totals
from chronolode.session import shared_path
from chronolode.sources.files import VersionLog

CHANGES = "commit_id long, is_merge boolean, file_id long, lines_added int, lines_deleted int"
PAIRS = "file_a_id long, file_b_id long, co_changes int"
MOST_PARTS = 50


class IncrementalIndex:
    """Change rows and pair counts of increments, kept over restarts; each commit is taken in once, however often it arrives.

    A batch writes its own changes and pair counts beside those of earlier ones and then makes them current, so its work grows with the batch,
    and a failed or repeated batch leaves the index as it was. ``coupling`` adds the counts up. After ``MOST_PARTS``
    batches the parts are joined. A commit must arrive within one batch.
    """

    def __init__(self, spark: SparkSession, path: str, max_paths: int = MAX_PATHS) -> None:
        self.spark, self.max_paths, self.log = spark, max_paths, VersionLog(spark, path)

    def _table(self, name: str, schema: str) -> DataFrame:
        parts = self.log.content.get(name, [])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*map(self.log.at, parts))

    def _write(self, name: str, rows: DataFrame) -> str:
        folder = self.log.fresh(name)
        rows.write.parquet(self.log.at(folder))
        return folder

    def absorb(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Takes in rows of commit_id, is_merge, file_id, lines_added, lines_deleted."""
        fresh = batch.join(self.changes().select("commit_id").distinct(), "commit_id", "left_anti").select(*self.changes().columns)
        changes = self._write("changes", fresh)
        written = self.spark.read.schema(CHANGES).parquet(self.log.at(changes))
        pairs = self._write("pairs", pair_counts(written, written.select("commit_id", "is_merge").distinct(), self.max_paths))
        now = {"changes": [*self.log.content.get("changes", []), changes], "pairs": [*self.log.content.get("pairs", []), pairs]}
        self.log.commit(now)
        if len(now["pairs"]) > MOST_PARTS:
            self.log.commit({"changes": [self._write("changes", self.changes())], "pairs": [self._write("pairs", self.pairs())]})

    def pairs(self) -> DataFrame:
        """file_a_id, file_b_id, co_changes over all increments."""
        return self._table("pairs", PAIRS).groupBy("file_a_id", "file_b_id").agg(F.sum("co_changes").cast("int").alias("co_changes"))

    def changes(self) -> DataFrame:
        return self._table("changes", CHANGES)

    def coupling(self) -> DataFrame:
        """Pair counts with the totals of all change rows, so these can't drift."""
        return with_totals(self.pairs(), self.changes())

    def run_available(self, landing: str, schema: str, checkpoint: str | None = None) -> None:
        """Streams what has landed in ``landing`` through ``absorb``, a file a micro-batch, and stops."""
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
        query = stream.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint or shared_path(self.spark, "stream")).trigger(availableNow=True).start()
        query.awaitTermination()
