"""From landing frames and a working tree to the model's tables."""

from __future__ import annotations

from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.functions.scalar import is_binary_path, ticket_slug
from chronolode.plans.complexity import file_metrics
from chronolode.plans.coupling import MAX_PATHS, build_coupling
from chronolode.plans.model import RepoModel
from chronolode.plans.renames import resolve_renames
from chronolode.sources.mailmap import resolve_identities


def build_commits(raw_commits: DataFrame, mailmap: DataFrame | None = None) -> DataFrame:
    people = raw_commits if mailmap is None else resolve_identities(raw_commits, mailmap)
    if mailmap is None:
        people = people.withColumns({"author_name": F.col("raw_name"), "author_email": F.col("raw_email")})
    return people.dropDuplicates(["hash"]).select(
        F.col("ord").alias("commit_id"), "hash", F.col("author_date_ms").alias("author_date"), F.coalesce("short_message", F.lit("")).alias("first_line"),
        ticket_slug(F.col("short_message")).alias("jira_slug"), "author_email", "author_name", (F.col("n_parents") > 1).alias("is_merge"),
    )


def file_id(path: F.Column) -> F.Column:
    """A file's id: a 64-bit hash of its path, the same in every build and increment."""
    return F.xxhash64(path)


def build_changes(raw_commits: DataFrame, raw_entries: DataFrame) -> DataFrame:
    """commit_id, path, lines_added, lines_deleted: paths after renames; no lines for merges and binary names."""
    order = raw_commits.dropDuplicates(["hash"]).select("hash", "ord", "n_parents")
    entries = raw_entries.dropDuplicates(["hash", "path", "status"]).join(order, "hash").select("ord", "path", "status", "lines_added", "lines_deleted", "n_parents")
    bare = (F.col("n_parents") > 1) | is_binary_path(F.col("path"))
    resolved = resolve_renames(entries)
    return resolved.select(
        F.col("ord").alias("commit_id"), F.col("final_path").alias("path"), F.when(bare, 0).otherwise(F.coalesce("lines_added", F.lit(0))).alias("lines_added"),
        F.when(bare, 0).otherwise(F.coalesce("lines_deleted", F.lit(0))).alias("lines_deleted"),
    )


def build_metrics(files: DataFrame, working_tree: DataFrame, analyzed_at_ms: int, failures: Accumulator | None = None) -> DataFrame:
    """Metrics of the tracked files that are in the working tree (path, content): line counts, complexity for Java."""
    tracked = working_tree.join(files.select("path"), "path", "left_semi")
    return file_metrics(tracked, failures).select(
        file_id(F.col("path")).alias("file_id"), "loc", "cyclomatic_complexity", "cognitive_complexity", F.lit(analyzed_at_ms).cast("long").alias("analyzed_at")
    )


def build_history(raw_commits: DataFrame, raw_entries: DataFrame, mailmap: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """commits, files and file_changes."""
    named = build_changes(raw_commits, raw_entries)
    files = named.select("path").distinct().select(file_id(F.col("path")).alias("file_id"), "path")
    return build_commits(raw_commits, mailmap), files, named.select("commit_id", file_id(F.col("path")).alias("file_id"), "lines_added", "lines_deleted")


def build_model(
    raw_commits: DataFrame, raw_entries: DataFrame, working_tree: DataFrame, now_ms: int, mailmap: DataFrame | None = None, max_paths: int = MAX_PATHS, failures: Accumulator | None = None
) -> RepoModel:
    """A full build; it replaces whatever was there, so a second build of the same input changes nothing."""
    commits, files, changes = build_history(raw_commits, raw_entries, mailmap)
    return RepoModel(commits, files, changes, build_metrics(files, working_tree, now_ms, failures), build_coupling(changes, commits, max_paths))
