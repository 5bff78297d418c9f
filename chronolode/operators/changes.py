"""Requests on files by how they change: hotspots, churn, stale files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.functions.scalar import DAY_MS, like_any_case, whole_days
from chronolode.operators.scoring import scored
from chronolode.plans.model import RepoModel


def matching_files(model: RepoModel, extension: str = "", path_filter: str | None = "%") -> DataFrame:
    files = model.files
    if extension:
        files = files.where(like_any_case(F.col("path"), "%" + extension))
    if path_filter not in (None, "%"):
        files = files.where(like_any_case(F.col("path"), path_filter))
    return files


def touched(rows: DataFrame, files: DataFrame, model: RepoModel) -> DataFrame:
    """Of ``rows`` those on ``files``; where these are a part of all, the others go before anything is joined or summed."""
    return rows if files is model.files else rows.join(files.select("file_id"), "file_id", "left_semi")


def change_frequency(model: RepoModel, since_ms: int | None = None, extension: str = "", path_filter: str = "%", top_n: int = 20) -> DataFrame:
    """The most often changed files that have metrics: path, n, first and last commit of all time, metrics.

    One aggregation gives both the count in the window and the ages of all time; other dimensions join after it.
    """
    inside = F.lit(True) if since_ms is None else F.col("author_date") >= since_ms
    files = matching_files(model, extension, path_filter)
    touches = touched(model.file_changes, files, model).join(model.commits.select("commit_id", "author_date"), "commit_id")
    per_file = touches.groupBy("file_id").agg(F.count_if(inside).alias("n"), F.min("author_date").alias("first_ms"), F.max("author_date").alias("last_ms")).where("n > 0")
    rows = per_file.join(model.file_metrics, "file_id").join(files, "file_id")
    return rows.orderBy(F.desc("n"), "path").limit(top_n)


def hotspots(model: RepoModel, now_ms: int, top_n: int = 20, since_ms: int | None = None, extension: str = "", path_filter: str = "%") -> DataFrame:
    """Frequent and complex files; scores are relative to the ``top_n`` most frequent."""
    now = F.lit(now_ms).cast("long")
    rows = scored(change_frequency(model, since_ms, extension, path_filter, top_n), F.col("n"))
    return rows.select(
        "path", F.col("n").cast("int").alias("changeFrequency"), F.col("loc").alias("linesOfCode"), F.col("cyclomatic_complexity").alias("cyclomaticComplexity"),
        F.col("cognitive_complexity").alias("cognitiveComplexity"), F.col("score").alias("hotspotScore"),
        whole_days(now, F.col("first_ms")).alias("ageInDays"), whole_days(now, F.col("last_ms")).alias("daysSinceLastChange"),
    ).orderBy(F.desc("hotspotScore"), F.desc("changeFrequency"), "path")


def churn(model: RepoModel, top_n: int = 20, since_ms: int | None = None, extension: str = "", path_filter: str = "%") -> DataFrame:
    """Files with metrics by lines added and deleted."""
    added, deleted = F.col("lines_added").cast("long"), F.col("lines_deleted").cast("long")
    files = matching_files(model, extension, path_filter)
    per_file = touched(model.touches(since_ms), files, model).groupBy("file_id").agg(
        F.sum(added).alias("linesAdded"), F.sum(deleted).alias("linesDeleted"), F.sum(added + deleted).alias("churn"), F.count_distinct("commit_id").cast("int").alias("changeFrequency")
    )
    rows = per_file.where("churn > 0").join(model.file_metrics.select("file_id"), "file_id", "left_semi").join(files, "file_id")
    return rows.select(F.col("path").alias("filePath"), "linesAdded", "linesDeleted", "churn", "changeFrequency").orderBy(F.desc("churn"), "filePath").limit(top_n)


def stale_files(model: RepoModel, now_ms: int, top_n: int = 20, min_days_stale: int = 180, extension: str = "", path_filter: str = "%") -> DataFrame:
    """Files untouched for ``min_days_stale`` days, by age and complexity, scored over the 3 ``top_n`` oldest."""
    now = F.lit(now_ms).cast("long")
    files = matching_files(model, extension, path_filter)
    per_file = touched(model.touches(), files, model).groupBy("file_id").agg(F.max("author_date").alias("last_ms"), F.min("author_date").alias("first_ms")).where(F.col("last_ms") <= now_ms - min_days_stale * DAY_MS)
    oldest = per_file.join(files, "file_id").orderBy("last_ms", "path").limit(3 * top_n)
    rows = oldest.join(model.file_metrics.select("file_id", "loc", "cyclomatic_complexity"), "file_id", "left")
    rows = rows.withColumns({"loc": F.coalesce("loc", F.lit(0)), "cyclomatic_complexity": F.coalesce("cyclomatic_complexity", F.lit(-1)), "days": whole_days(now, F.col("last_ms"))})
    return scored(rows, F.col("days")).select(
        F.col("path").alias("filePath"), F.col("days").alias("daysSinceLastChange"), whole_days(now, F.col("first_ms")).alias("ageInDays"), "loc",
        F.col("cyclomatic_complexity").alias("cyclomaticComplexity"), F.col("score").alias("stalenessScore"),
    ).orderBy(F.desc("stalenessScore"), F.desc("daysSinceLastChange"), "filePath").limit(top_n)
