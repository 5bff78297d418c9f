"""Requests on commits and the whole repository: one file's history, the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolode.functions.scalar import extension, like_any_case
from chronolode.operators.changes import change_frequency
from chronolode.operators.people import require_path
from chronolode.plans.model import RepoModel


def file_history(model: RepoModel, file_path: str | None, limit: int = 50, since_ms: int | None = None, jira_slug: str | None = None) -> DataFrame:
    """Commits that touch a file, newest first, with all paths each touches."""
    target = model.files.where(F.col("path") == require_path(file_path)).select("file_id")
    commits = model.commits
    if since_ms is not None:
        commits = commits.where(F.col("author_date") >= since_ms)
    if jira_slug is not None:
        commits = commits.where(like_any_case(F.col("jira_slug"), jira_slug))
    touched = model.file_changes.join(target, "file_id", "left_semi").select("commit_id").distinct()
    newest = commits.join(touched, "commit_id", "left_semi").orderBy(F.desc("author_date"), "hash").limit(limit)
    paths = model.file_changes.join(newest.select("commit_id"), "commit_id", "left_semi").join(model.files, "file_id")
    listed = paths.groupBy("commit_id").agg(F.array_sort(F.collect_list("path")).alias("filesChanged"))
    rows = newest.join(listed, "commit_id")
    return rows.select("hash", F.col("author_date").alias("authorDate"), F.col("first_line").alias("firstLine"), F.col("jira_slug").alias("jiraSlug"), "filesChanged").orderBy(F.desc("authorDate"), "hash")


def summary_scalars(model: RepoModel) -> DataFrame:
    """One row: commits, files with metrics, paths touched, authors, first and last date."""
    c = model.commits.agg(
        F.count(F.lit(1)).cast("int").alias("totalCommits"), F.count_distinct("author_email").cast("int").alias("uniqueAuthors"),
        F.coalesce(F.min("author_date"), F.lit(0)).alias("earliestCommitMs"), F.coalesce(F.max("author_date"), F.lit(0)).alias("latestCommitMs"),
    )
    f = model.file_changes.agg(F.count_distinct("file_id").cast("int").alias("totalFilesTracked"))
    m = model.file_metrics.agg(F.count(F.lit(1)).cast("int").alias("filesWithMetrics"))
    # three rows of one
    return c.crossJoin(f).crossJoin(m).select("totalCommits", "uniqueAuthors", "totalFilesTracked", "filesWithMetrics", "earliestCommitMs", "latestCommitMs")


def summary_top_files(model: RepoModel, top_n: int = 5) -> DataFrame:
    return change_frequency(model, top_n=top_n).select(F.col("path").alias("filePath"), F.col("n").cast("int").alias("changeFrequency"))


def summary_top_authors(model: RepoModel, top_n: int = 5) -> DataFrame:
    rows = model.commits.groupBy(F.col("author_email").alias("email")).agg(F.max("author_name").alias("name"), F.count(F.lit(1)).cast("int").alias("commits"))
    return rows.select("name", "email", "commits").orderBy(F.desc("commits"), "email").limit(top_n)


def language_distribution(model: RepoModel) -> DataFrame:
    return model.files.groupBy(extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).cast("int").alias("fileCount")).orderBy(F.desc("fileCount"), "extension")


def summary(model: RepoModel) -> DataFrame:
    """The whole summary in one row: the scalars and the three lists."""

    def listed(rows: DataFrame, name: str, order: list) -> DataFrame:
        place = F.row_number().over(Window.orderBy(*order))  # a few rows: five, or one an extension
        one = rows.select(F.struct(place.alias("place"), F.struct(*rows.columns).alias("row")).alias("x"))
        return one.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["row"]).alias(name))

    files = listed(summary_top_files(model), "topChangedFiles", [F.desc("changeFrequency"), F.col("filePath")])
    authors = listed(summary_top_authors(model), "topAuthors", [F.desc("commits"), F.col("email")])
    languages = listed(language_distribution(model), "languageDistribution", [F.desc("fileCount"), F.col("extension")])
    return summary_scalars(model).crossJoin(files).crossJoin(authors).crossJoin(languages)
