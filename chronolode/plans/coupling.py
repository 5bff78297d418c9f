"""Co-change counts of file pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PATHS = 50


def build_coupling(file_changes: DataFrame, commits: DataFrame, max_paths: int = MAX_PATHS) -> DataFrame:
    """file_a_id < file_b_id, co_changes and both files' total changes."""
    return with_totals(pair_counts(file_changes, commits, max_paths), file_changes)


def pair_counts(file_changes: DataFrame, commits: DataFrame, max_paths: int = MAX_PATHS) -> DataFrame:
    """file_a_id < file_b_id, co_changes.

    Pairs come from commits that are no merges and touch at most ``max_paths`` files, which bounds each commit's
    pairs; totals count every change row. Pairs are made inside a commit's row, so they are combined before
    their only exchange.
    """
    touched = file_changes.select("commit_id", "file_id").distinct()
    sizes = touched.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, max_paths))
    plain = sizes.join(commits.where(~F.coalesce("is_merge", F.lit(False))).select("commit_id"), "commit_id", "left_semi").select("commit_id")
    sets = touched.join(plain, "commit_id").groupBy("commit_id").agg(F.sort_array(F.collect_list("file_id")).alias("f"))
    pairs = sets.select(F.posexplode("f").alias("i", "file_a_id"), "f").select("file_a_id", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("file_b_id"))
    return pairs.groupBy("file_a_id", "file_b_id").agg(F.count(F.lit(1)).cast("int").alias("co_changes"))


def with_totals(pairs: DataFrame, file_changes: DataFrame, *join_hint: str) -> DataFrame:
    totals = file_changes.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    a = totals.select(F.col("file_id").alias("file_a_id"), F.col("n").alias("ta"))
    b = totals.select(F.col("file_id").alias("file_b_id"), F.col("n").alias("tb"))
    for hint in join_hint:
        a, b = a.hint(hint), b.hint(hint)
    joined = pairs.join(a, "file_a_id", "left").join(b, "file_b_id", "left")
    return joined.select("file_a_id", "file_b_id", "co_changes", F.coalesce("ta", F.lit(0)).alias("total_changes_a"), F.coalesce("tb", F.lit(0)).alias("total_changes_b"))


def coupling_since(file_changes: DataFrame, commits: DataFrame, since_ms: int) -> DataFrame:
    """The same columns from all commits since ``since_ms``, merges and bulk commits too; totals are distinct commits.

    Totals have a row for every file, so the driver is not to collect them for a broadcast.
    """
    recent = file_changes.join(commits.where(F.col("author_date") >= since_ms).select("commit_id"), "commit_id", "left_semi").select("commit_id", "file_id").distinct()
    a, b = recent.withColumnRenamed("file_id", "file_a_id"), recent.withColumnRenamed("file_id", "file_b_id")
    pairs = a.join(b, "commit_id").where("file_a_id < file_b_id").groupBy("file_a_id", "file_b_id").agg(F.count(F.lit(1)).cast("int").alias("co_changes"))
    return with_totals(pairs, recent, "shuffle_hash")
