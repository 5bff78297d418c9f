"""Schemas of the landing frames and of the model's five tables."""

from __future__ import annotations

RAW_COMMITS = "hash string, ord long, author_date_ms long, raw_name string, raw_email string, short_message string, n_parents int"
RAW_ENTRIES = "hash string, path string, status string, lines_added int, lines_deleted int"
MAILMAP = "entry_no int, canonical_name string, canonical_email string, commit_name string, commit_email string"
COMMITS = "commit_id long, hash string, author_date long, first_line string, jira_slug string, author_email string, author_name string, is_merge boolean"
FILES = "file_id long, path string"
FILE_CHANGES = "commit_id long, file_id long, lines_added int, lines_deleted int"
FILE_METRICS = "file_id long, loc int, cyclomatic_complexity int, cognitive_complexity int, analyzed_at long"
FILE_COUPLING = "file_a_id long, file_b_id long, co_changes int, total_changes_a int, total_changes_b int"
