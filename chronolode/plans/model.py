"""The repository model: five tables, lazily built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class RepoModel:
    """Columns as in ``chronolode.schema``; keys are commit_id, file_id and, for coupling, the ordered pair of file ids."""

    commits: DataFrame
    files: DataFrame
    file_changes: DataFrame
    file_metrics: DataFrame
    file_coupling: DataFrame | None = None

    def touches(self, since_ms: int | None = None) -> DataFrame:
        """file_changes with the commit's date and author, from ``since_ms`` on."""
        commits = self.commits if since_ms is None else self.commits.where(self.commits.author_date >= since_ms)
        return self.file_changes.join(commits.select("commit_id", "author_date", "author_email", "author_name"), "commit_id")
