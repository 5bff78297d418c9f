"""Small files and folders in any store that Spark reaches, and a log of versions kept there."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Folder:
    """A folder by Hadoop's file systems, so that it may be anywhere that the session can write."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.store = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        at = self._at("")
        return sorted(s.getPath().getName() for s in self.store.listStatus(at)) if self.store.exists(at) else []

    def read(self, name: str) -> str:
        with_ = self.store.open(self._at(name))
        try:
            return bytes(with_.readAllBytes()).decode()
        finally:
            with_.close()

    def write(self, name: str, text: str) -> None:
        """Makes the file whole or not at all; an existing one of that name is an error."""
        made = self._at(f"_{name}-{uuid.uuid4().hex}")
        out = self.store.create(made)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.store.exists(self._at(name)) or not self.store.rename(made, self._at(name)):
            self.store.delete(made, False)
            raise RuntimeError(f"{self.path}/{name} is there already: another writer was faster")

    def remove(self, name: str) -> None:
        self.store.delete(self._at(name), True)


class VersionLog:
    """Numbered descriptions of what is current below ``path``; the one with the largest number holds.

    A version is a JSON object whose values are names of folders beside the log, alone or in lists, or other texts under keys with a leading
    underscore. It counts from the moment its file is there, so a write that stops before leaves the last version as it was.
    Folders that none of the last ``keep`` versions names are removed.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.log, self.beside = Folder(spark, f"{self.path}/_versions"), Folder(spark, self.path)
        self.version, self.content = -1, {}
        known = self._numbers()
        if known:
            self.version = known[-1]
            self.content = json.loads(self.log.read(f"{self.version:012d}.json"))

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.log.names() if n.endswith(".json") and n[:-5].isdigit()]

    def fresh(self, name: str) -> str:
        """A new folder's name."""
        return f"{name}-{uuid.uuid4().hex}"

    def at(self, folder: str) -> str:
        return f"{self.path}/{folder}"

    def commit(self, content: dict[str, Any]) -> None:
        self.log.write(f"{self.version + 1:012d}.json", json.dumps(content))
        self.version, self.content = self.version + 1, content
        self._clean()

    def _clean(self) -> None:
        folders = lambda c: {f for k, v in c.items() if not k.startswith("_") for f in (v if isinstance(v, list) else [v])}
        numbers = self._numbers()
        kept: set[str] = set().union(*(folders(json.loads(self.log.read(f"{n:012d}.json"))) for n in numbers[-self.keep :]))
        for n in numbers[: -self.keep]:
            name = f"{n:012d}.json"
            for gone in folders(json.loads(self.log.read(name))) - kept:
                self.beside.remove(gone)
            self.log.remove(name)
