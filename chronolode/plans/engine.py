"""The requests by name, with their parameters, defaults, errors and JSON results, and the index's life cycle."""

from __future__ import annotations

import inspect
import json
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.operators import changes, coupling, overview, people
from chronolode.operators.people import MissingPath
from chronolode.plans.coupling import build_coupling
from chronolode.plans.ingest import build_history, build_metrics
from chronolode.plans.model import RepoModel
from chronolode.schema import RAW_COMMITS, RAW_ENTRIES
from chronolode.session import shared_path
from chronolode.sources.files import VersionLog
from chronolode.sources.git import default_branch, is_ancestor, read_git, read_working_tree
from chronolode.sources.mailmap import read_mailmap
from chronolode.sources.store import VersionedTable

TABLES = ("commits", "files", "file_changes", "file_metrics", "file_coupling")
NAMED_FILES = 10_000  # changed files that are read by name; of more the whole working tree is read


@dataclass
class IndexStatus:
    """not_started, indexing, ready or error, with times."""

    state: str = "not_started"
    started_at_ms: int = 0
    elapsed_ms: int = 0
    error: str | None = None

    def begin(self, now_ms: int) -> None:
        self.started_at_ms, self.elapsed_ms, self.error, self.state = now_ms, 0, None, "indexing"

    def finish(self, now_ms: int) -> None:
        self.elapsed_ms, self.state = now_ms - self.started_at_ms, "ready"

    def fail(self, message: str) -> None:
        self.error, self.state = message, "error"

    def as_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"status": self.state}
        if self.started_at_ms:
            out["startedAtMs"] = self.started_at_ms
        if self.state == "ready":
            out["elapsedMs"] = self.elapsed_ms
        if self.state == "error" and self.error is not None:
            out["errorMessage"] = self.error
        return out


class NotReady(RuntimeError):
    pass


class Answer(NamedTuple):
    """What a request gives: JSON text, or the message of an error."""

    text: str
    is_error: bool = False


def store_model(model: RepoModel, path: str) -> RepoModel:
    """Writes the tables below ``path``, changes in ranges of files and commits and sorted so, and returns the model that reads them.

    A file of very many changes spreads over several ranges.
    """
    for name in TABLES:
        df = getattr(model, name)
        if name == "file_changes":
            df = df.repartitionByRange("file_id", "commit_id").sortWithinPartitions("file_id", "commit_id")
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return load_model(model.commits.sparkSession, path)


def load_model(spark: SparkSession, path: str) -> RepoModel:
    return RepoModel(**{n: spark.read.parquet(f"{path}/{n}") for n in TABLES})


class Engine:
    """A repository's index and the requests on it. ``call`` takes a request's name and arguments and gives an ``Answer``.

    The index lies below ``path`` and is there again when an engine is made with the same path; without one it lasts as long as the
    session. ``start`` brings it up to date in the background, as a service does when it begins.
    """

    def __init__(self, spark: SparkSession, model: RepoModel | None = None, repo: str | None = None, now_ms: int | None = None, path: str | None = None) -> None:
        self.spark, self.model, self.repo, self.fixed_now, self.path = spark, model, repo, now_ms, path
        self.log: VersionLog | None = None
        self.status = IndexStatus("ready" if model else "not_started")
        self.tip: str | None = None
        self.unparsed = 0  # Java files of the last build that could not be taken apart
        self.building = threading.Lock()
        if path is not None and model is None:
            self._open()
        self.requests: dict[str, Callable[..., Any]] = {
            "get_hotspots": self.get_hotspots, "get_temporal_coupling": self.get_temporal_coupling, "get_file_coupling": self.get_file_coupling,
            "get_coupling_clusters": self.get_coupling_clusters, "get_file_commit_history": self.get_file_commit_history, "get_file_authors": self.get_file_authors,
            "get_bus_factor": self.get_bus_factor, "get_ownership": self.get_ownership, "get_churn": self.get_churn, "get_stale_files": self.get_stale_files,
            "get_summary": self.get_summary, "get_index_status": self.get_index_status, "refresh_index": self.refresh_index,
        }

    def _open(self) -> VersionLog:
        """The log of the index; what it says is current becomes so here."""
        if self.log is None:
            self.log = VersionLog(self.spark, self.path or shared_path(self.spark, "index"))
            if "index" in self.log.content:
                self.model, self.tip = load_model(self.spark, self.log.at(self.log.content["index"])), self.log.content["_tip"] or None
                self.status = IndexStatus("ready")
        return self.log

    def now(self) -> int:
        return self.fixed_now if self.fixed_now is not None else int(time.time() * 1000)

    def call(self, name: str, **arguments: Any) -> Answer:
        """A request's answer: rows as a list of objects, with null fields; whatever fails is an error's message.

        Arguments that the request does not have are ignored; whole numbers may come as others.
        """
        if name not in self.requests:
            return Answer(f"Unknown request: {name}", True)
        handler = self.requests[name]
        known = inspect.signature(handler).parameters
        try:
            given = {k: v for k, v in arguments.items() if k in known and v is not None}
            for k, v in given.items():
                kind = str(known[k].annotation)
                given[k] = int(v) if kind.startswith("int") and not isinstance(v, str) else float(v) if kind.startswith("float") and not isinstance(v, str) else v
                if isinstance(v, str) != kind.startswith("str"):
                    raise TypeError(f"{k} must be a {'text' if kind.startswith('str') else 'number'}")
            out = handler(**given)
            if isinstance(out, DataFrame):
                rows = out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()
                return Answer("[" + ",".join(r[0] for r in rows) + "]")
            return Answer(json.dumps(out))
        except (NotReady, MissingPath) as e:
            return Answer(str(e), True)
        except Exception as e:
            return Answer(f"{name} failed: {e}", True)

    def guard(self) -> RepoModel:
        if self.status.state != "ready" or self.model is None:
            raise NotReady(f"Index not ready (status: {self.status.state}). Call get_index_status to check progress.")
        return self.model

    def get_hotspots(self, topN: int = 20, sinceEpochMs: int | None = None, extension: str = "", pathFilter: str = "%") -> DataFrame:
        return changes.hotspots(self.guard(), self.now(), topN, sinceEpochMs, extension, pathFilter)

    def get_temporal_coupling(self, topN: int = 20, minCoupling: float = 0.3, fileFilter: str | None = None, sinceEpochMs: int | None = None) -> DataFrame:
        return coupling.temporal_coupling(self.guard(), topN, minCoupling, fileFilter, sinceEpochMs)

    def get_file_coupling(self, filePath: str | None = None, topN: int = 10, minCoupling: float = 0.1, sinceEpochMs: int | None = None) -> DataFrame:
        return coupling.file_coupling(self.guard(), filePath, topN, minCoupling, sinceEpochMs)

    def get_coupling_clusters(
        self, filePath: str | None = None, minCoupling: float = 0.3, minClusterSize: int = 3, maxClusterSize: int | None = None,
        pathFilter: str | None = None, topN: int = 20, sinceEpochMs: int | None = None,
    ) -> DataFrame:
        model = self.guard()
        if filePath is not None and filePath.strip():
            return coupling.cluster_of_file(model, filePath, minCoupling, maxClusterSize, sinceEpochMs)
        return coupling.coupling_clusters(model, minCoupling, minClusterSize, maxClusterSize, pathFilter, topN, sinceEpochMs)

    def get_file_commit_history(self, filePath: str | None = None, limit: int = 50, sinceEpochMs: int | None = None, jiraSlug: str | None = None) -> DataFrame:
        return overview.file_history(self.guard(), filePath, limit, sinceEpochMs, jiraSlug)

    def get_file_authors(self, filePath: str | None = None, topN: int = 10, sinceEpochMs: int | None = None) -> DataFrame:
        return people.file_authors(self.guard(), filePath, topN, sinceEpochMs)

    def get_bus_factor(self, topN: int = 20, threshold: float = 0.75, pathFilter: str | None = None, sinceEpochMs: int | None = None) -> DataFrame:
        return people.bus_factor(self.guard(), topN, threshold, pathFilter, sinceEpochMs)

    def get_ownership(
        self, topN: int = 20, ownershipBy: str = "commits", minOwnership: float = 0.0, extension: str = "", pathFilter: str = "%", sinceEpochMs: int | None = None
    ) -> DataFrame:
        return people.ownership(self.guard(), topN, ownershipBy, minOwnership, extension, pathFilter, sinceEpochMs)

    def get_churn(self, topN: int = 20, sinceEpochMs: int | None = None, extension: str = "", pathFilter: str = "%") -> DataFrame:
        return changes.churn(self.guard(), topN, sinceEpochMs, extension, pathFilter)

    def get_stale_files(self, topN: int = 20, minDaysStale: int = 180, extension: str = "", pathFilter: str = "%") -> DataFrame:
        return changes.stale_files(self.guard(), self.now(), topN, minDaysStale, extension, pathFilter)

    def get_summary(self) -> dict[str, Any]:
        return json.loads(overview.summary(self.guard()).select(F.to_json(F.struct("*"))).first()[0])

    def get_index_status(self) -> dict[str, Any]:
        return self.status.as_dict()

    def refresh_index(self) -> dict[str, Any]:
        """Rebuilds the index from the repository and replaces the old one."""
        return self._build(anew=True)

    def update_index(self) -> dict[str, Any]:
        """Takes in the commits since the last build; the same index as a rebuild, and 0 commits where there are none.

        Only new commits are read from git, and only files that they touch from the working tree.
        """
        return self._build(anew=False)

    def start(self) -> threading.Thread:
        """``update_index`` in the background: requests are told that the index is not ready until it is."""
        self.status.begin(self.now())
        worker = threading.Thread(target=self.update_index, name="indexer", daemon=True)
        worker.start()
        return worker

    def _build(self, anew: bool) -> dict[str, Any]:
        with self.building:
            began, failures = time.time(), self.spark.sparkContext.accumulator(0)
            self.status.begin(self.now())
            try:
                log, tip = self._open(), default_branch(self.repo)
                if not anew and self.model is not None and tip == self.tip:
                    self.status.begin(self.now())
                    self.status.finish(self.now())
                    return self._result(began, "ok")
                anew = anew or self.model is None or self.tip is None or tip is None or not is_ancestor(self.repo, self.tip, tip)
                files, read = self._index(log, tip, anew, failures)
            except Exception as e:
                self.status.fail(str(e))
                return self._result(began, "error", message=str(e))
            self.unparsed = failures.value
            self.status.finish(self.now())
            return self._result(began, "ok", files, read)

    @staticmethod
    def _result(began: float, status: str, files: int = 0, commits: int = 0, message: str | None = None) -> dict[str, Any]:
        return {"status": status, "filesIndexed": files, "commitsProcessed": commits, "durationMs": int(1000 * (time.time() - began)), "errorMessage": message}

    def _index(self, log: VersionLog, tip: str | None, anew: bool, failures: Any) -> tuple[int, int]:
        """Reads what is new, writes landing tables and index, and makes them current; Java files measured and commits read.

        The index is current from the log's next version on. Landing rows of a build that stopped before that come
        again with the next one, and a commit that was read before changes nothing, however often it comes.
        """
        landing = log.fresh("landing") if anew else log.content["landing"]
        raw_commits, raw_entries = VersionedTable(self.spark, log.at(f"{landing}/commits"), RAW_COMMITS), VersionedTable(self.spark, log.at(f"{landing}/entries"), RAW_ENTRIES)
        before = 0 if anew else self.model.commits.count()
        commits, entries = read_git(self.spark, self.repo, None if anew else self.tip)
        commits = raw_commits.append_new(commits, "hash")
        entries = raw_entries.append_new(entries, "hash", "path", "status")
        mailmap = read_mailmap(self.spark, read_working_tree(self.spark, self.repo, [".mailmap"]))
        history = build_history(commits, entries, mailmap)
        if anew:
            metrics = java = build_metrics(history[1], read_working_tree(self.spark, self.repo), self.now(), failures)
        else:
            fresh = commits.join(self.model.commits.select("hash"), "hash", "left_anti").select("hash")
            metrics, java = self._metrics_since(history[1], entries.join(fresh, "hash", "left_semi").select("path").distinct(), failures)
        index = log.fresh("index")
        model = store_model(RepoModel(*history, metrics, build_coupling(history[2], history[0])), log.at(index))
        log.commit({"index": index, "landing": landing, "_tip": tip or ""})
        self.model, self.tip = model, tip
        files = model.files.where(F.col("path").endswith(".java")).join(model.file_metrics, "file_id", "left_semi")
        if not anew:
            files = files.join(java.select("path"), "path", "left_semi")
        return files.count(), model.commits.count() - before

    def _metrics_since(self, files: DataFrame, touched: DataFrame, failures: Any) -> tuple[DataFrame, DataFrame]:
        """Metrics with those of ``touched`` paths measured anew, those of files that are gone left out; and the paths measured."""
        names = [r[0] for r in touched.limit(NAMED_FILES + 1).collect()]
        tree = read_working_tree(self.spark, self.repo, names if len(names) <= NAMED_FILES else None).join(touched, "path", "left_semi")
        fresh = build_metrics(files, tree, self.now(), failures)
        kept = self.model.file_metrics.join(files.select("file_id"), "file_id", "left_semi")
        kept = kept.join(files.join(touched, "path", "left_semi").select("file_id"), "file_id", "left_anti")
        return kept.unionByName(fresh), touched
