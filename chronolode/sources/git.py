"""A git repository as landing frames: a Python data source around ``git log``, and the working tree as files."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronolode.schema import RAW_COMMITS, RAW_ENTRIES

SPLITS = 8
_HASH = re.compile(r"[0-9a-f]{40}(?:[0-9a-f]{24})?")
_COUNTS = re.compile(r"(\d+|-)\t(\d+|-)\t(.*)", re.DOTALL)


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def default_branch(repo: str) -> str | None:
    """The tip to walk: main, master, or else HEAD; None for a repository without commits. What is no repository is an error."""
    git(repo, "rev-parse", "--git-dir")
    for name in ("refs/heads/main", "refs/heads/master", "HEAD"):
        found = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, "rev-parse", "-q", "--verify", f"{name}^{{commit}}"], capture_output=True)
        if not found.returncode:
            return found.stdout.decode().strip()
    return None


def is_ancestor(repo: str, old: str, new: str) -> bool:
    """Whether all that ``old`` has is in ``new``; not so after a branch was written anew."""
    return not subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, "merge-base", "--is-ancestor", old, new], capture_output=True).returncode


def working_paths(repo: str) -> Iterator[str]:
    """Regular files below ``repo``, those of ``.git`` aside. Spark's own file listing leaves out names with a leading dot or dash below."""
    for folder, names, found in os.walk(repo):
        names[:] = [n for n in names if n != ".git"]
        for name in found:
            path = os.path.join(folder, name)
            if os.path.isfile(path) and not os.path.islink(path):
                yield os.path.relpath(path, repo)


def as_text(path: str) -> str:
    """A path of the file system as git's output gives it; bytes that are no UTF-8 are replaced."""
    return os.fsencode(path).decode("utf-8", "replace")


class _Range(InputPartition):
    def __init__(self, first: int, hashes: list[str]) -> None:
        self.first, self.hashes = first, hashes


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.repo, self.stop, self.table = options["path"], options.get("stop"), options.get("table", "commits")
        self.names = json.loads(options["names"]) if "names" in options else None

    def partitions(self) -> list[InputPartition]:
        """The commits, oldest first, in equal ranges, so that each task diffs its own."""
        if self.table == "tree":
            paths = sorted(working_paths(self.repo)) if self.names is None else [n for n in self.names if os.path.isfile(p := os.path.join(self.repo, n)) and not os.path.islink(p)]
            size = max(1, -(-len(paths) // SPLITS))
            return [_Range(i, paths[i : i + size]) for i in range(0, len(paths), size)] or [_Range(0, [])]
        tip = default_branch(self.repo)
        if tip is None:
            return [_Range(0, [])]
        past = len(git(self.repo, "rev-list", self.stop).split()) if self.stop else 0
        hashes = git(self.repo, "rev-list", "--reverse", tip, *([f"^{self.stop}"] if self.stop else [])).split()
        size = max(1, -(-len(hashes) // SPLITS))
        return [_Range(past + i, hashes[i : i + size]) for i in range(0, len(hashes), size)] or [_Range(0, [])]

    def read(self, partition: Any) -> Iterator[tuple]:
        if self.table == "tree":
            for path in partition.hashes:
                with open(os.path.join(self.repo, path), "rb") as f:
                    yield as_text(path), f.read()
            return
        for at in range(0, len(partition.hashes), 500):
            some = partition.hashes[at : at + 500]
            if self.table == "commits":
                # fields and records end with NUL, which none of them can hold
                fields = git(self.repo, "log", "--no-walk=unsorted", "-s", "-z", "--format=%H%x00%at%x00%an%x00%ae%x00%P%x00%s", *some).split("\0")
                for k in range(len(some)):
                    hash_, at_s, name, email, parents, subject = fields[6 * k : 6 * k + 6]
                    yield hash_, partition.first + at + k, int(at_s) * 1000, name, email, subject, len(parents.split())
            else:
                diff = ["--no-renames", "-w", "--diff-merges=first-parent", "--root", "--raw", "--numstat", "-z"]
                yield from entries(git(self.repo, "log", "--no-walk=unsorted", "--format=%H", *diff, *some))


def entries(text: str) -> Iterator[tuple]:
    """Changes from NUL-ended hashes, raw records with a path after each, and line counts with theirs.

    Raw records give every path; counts lack those of which only white space changed.
    """
    hash_, status, lines = "", {}, {}
    fields = iter(text.split("\0"))
    for f in fields:
        f = f.lstrip("\n")
        counts = _COUNTS.fullmatch(f)
        if f.startswith(":"):
            status[next(fields)] = {"A": "A", "D": "D"}.get(f.split(" ")[4][0], "M")
        elif counts:
            lines[counts[3]] = tuple(int(n) if n.isdigit() else 0 for n in counts.groups()[:2])
        elif _HASH.fullmatch(f.strip("\n")):
            for path, s in status.items():
                yield hash_, path, s, *lines.get(path, (0, 0))
            hash_, status, lines = f.strip("\n"), {}, {}
    for path, s in status.items():
        yield hash_, path, s, *lines.get(path, (0, 0))


class GitLog(DataSource):
    """``spark.read.format("gitlog").option("path", ...)``; option ``table``: commits, entries or tree; option ``stop``: a hash already read; option ``names``: of a tree, a JSON list of the files to read."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return {"entries": RAW_ENTRIES, "tree": "path string, content binary"}.get(self.options.get("table"), RAW_COMMITS)

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_git(spark: SparkSession, repo: str, stop: str | None = None) -> tuple[DataFrame, DataFrame]:
    """raw_commits and raw_entries; with ``stop`` only what is not reachable from it."""
    spark.dataSource.register(GitLog)
    reader = lambda t: spark.read.format("gitlog").options(path=repo, table=t, **({"stop": stop} if stop else {})).load()
    return reader("commits"), reader("entries")


def read_working_tree(spark: SparkSession, repo: str, names: list[str] | None = None) -> DataFrame:
    """path, content of the files below ``repo``, or of those among ``names`` that are there."""
    spark.dataSource.register(GitLog)
    only = {} if names is None else {"names": json.dumps(names)}
    return spark.read.format("gitlog").options(path=repo, table="tree", **only).load()
