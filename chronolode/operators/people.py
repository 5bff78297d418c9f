"""Requests on authors: one file's authors, bus factor, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolode.functions.scalar import like_any_case, ratio
from chronolode.operators.changes import touched
from chronolode.plans.model import RepoModel


class MissingPath(ValueError):
    pass


def require_path(path: str | None) -> str:
    if path is None or not path.strip():
        raise MissingPath("filePath is required")
    return path


def file_authors(model: RepoModel, file_path: str | None, top_n: int = 10, since_ms: int | None = None) -> DataFrame:
    """Authors of one file by number of changes."""
    target = model.files.where(F.col("path") == require_path(file_path)).select("file_id")
    rows = model.touches(since_ms).join(target, "file_id", "left_semi")
    counted = rows.groupBy(F.col("author_email").alias("authorEmail")).agg(F.max("author_name").alias("authorName"), F.count(F.lit(1)).cast("int").alias("commitCount"))
    return counted.orderBy(F.desc("commitCount"), "authorEmail").limit(top_n)


def top_owners(model: RepoModel, amount: Column, since_ms: int | None, files: DataFrame) -> DataFrame:
    """file_id, author_email, author_name, amount, total: each of ``files``' authors of the largest amount, ties too.

    An author's rows combine before the exchange; a file then has a row an author, however often it changed.
    """
    by_author = touched(model.touches(since_ms), files, model).groupBy("file_id", "author_email").agg(F.max("author_name").alias("author_name"), amount.cast("long").alias("amount"))
    file = Window.partitionBy("file_id")
    return by_author.withColumns({"total": F.sum("amount").over(file), "best": F.max("amount").over(file)}).where("amount = best").drop("best")


def _named(owners: DataFrame, model: RepoModel, files: DataFrame) -> DataFrame:
    return owners.join(model.file_metrics.select("file_id"), "file_id", "left_semi").join(files, "file_id")


def bus_factor(model: RepoModel, top_n: int = 20, threshold: float = 0.75, path_filter: str | None = None, since_ms: int | None = None) -> DataFrame:
    """Files with metrics of which one author made at least ``threshold`` of the changes; tied authors have a row each."""
    files = model.files if path_filter is None else model.files.where(like_any_case(F.col("path"), path_filter))
    owners = top_owners(model, F.count(F.lit(1)), since_ms, files).withColumn("r", ratio(F.col("amount"), F.col("total"))).where(F.col("r") >= threshold)
    rows = _named(owners, model, files).orderBy(F.desc("r"), F.desc("total"), "path", "author_email").limit(top_n)
    return rows.select(
        F.col("path").alias("filePath"), F.col("author_email").alias("topAuthorEmail"), F.col("author_name").alias("topAuthorName"),
        F.col("amount").cast("int").alias("topAuthorCommits"), F.col("total").cast("int").alias("totalCommits"), F.col("r").alias("dominanceRatio"),
    )


def ownership(model: RepoModel, top_n: int = 20, by: str = "commits", min_ownership: float = 0.0, extension: str = "", path_filter: str = "%", since_ms: int | None = None) -> DataFrame:
    """Each file's main author by commits or by lines added; files without added lines drop out of the latter."""
    if by not in ("commits", "lines"):
        raise ValueError(f"ownershipBy must be 'commits' or 'lines', not {by!r}")
    files = model.files
    if extension:
        files = files.where(like_any_case(F.col("path"), "%." + extension.removeprefix(".")))
    if path_filter != "%":
        files = files.where(like_any_case(F.col("path"), path_filter))
    owners = top_owners(model, F.count(F.lit(1)) if by == "commits" else F.sum("lines_added"), since_ms, files)
    owners = owners.where("total > 0").withColumn("r", ratio(F.col("amount"), F.col("total"))).where(F.col("r") >= min_ownership)
    rows = _named(owners, model, files).orderBy(F.desc("r"), F.desc("total"), "path", "author_email").limit(top_n)
    return rows.select(
        F.col("path").alias("filePath"), F.col("author_email").alias("topAuthorEmail"), F.col("author_name").alias("topAuthorName"),
        F.col("amount").alias("topAuthorAmount"), F.col("total").alias("totalAmount"), F.col("r").alias("ownershipRatio"),
    )
