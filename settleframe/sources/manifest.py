"""Manifests: which folders make up a table, changed as one.

A version is a JSON file ``_manifest/<number>.json``, written under another name and renamed, so a reader meets the old
list or the new one. Folders are written before the version that names them, and are only deleted once neither the newest
version nor the one before it names them, so a reader that has just read the older list still finds its files.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Run:
    """A folder of the table: batches from first to last, their level and rows, and the bits of its bucket numbers."""

    name: str
    first: int = 0
    last: int = 0
    level: int = 0
    rows: int = 0
    bits: int = 0


class Manifest:
    """The versions of the table in ``folder``. One writer at a time; readers need no lock."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._files = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._files.Path(f"{self.folder}/{name}")

    def _system(self):
        return self._path("").getFileSystem(self._conf) if self.folder else None

    def _names(self, name: str) -> list[str]:
        path = self._files.Path(f"{self.folder}/{name}" if name else self.folder)
        system = path.getFileSystem(self._conf)
        return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._names("_manifest") if n[0] != "." and n.endswith(".json"))

    def runs(self, version: int | None = None) -> list[Run]:
        """The runs of a version, the newest if none is given; an empty list before the first one."""
        found = self.versions()
        if not found:
            return []
        path = self._path(f"_manifest/{found[-1] if version is None else version}.json")
        stream = path.getFileSystem(self._conf).open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Run(**r) for r in json.loads(text)]

    def paths(self, runs: list[Run]) -> list[str]:
        return [f"{self.folder}/{r.name}" for r in runs]

    def commit(self, runs: list[Run]) -> None:
        """Make ``runs`` the table, then delete folders that the last two versions don't name."""
        found = self.versions()
        number = found[-1] + 1 if found else 0
        hidden, path = self._path(f"_manifest/.{uuid.uuid4().hex}"), self._path(f"_manifest/{number}.json")
        system = path.getFileSystem(self._conf)
        stream = system.create(hidden, False)
        stream.write(bytearray(json.dumps([asdict(r) for r in runs]).encode()))
        stream.close()
        if not system.rename(hidden, path):
            raise OSError(f"{path} was written by someone else")
        self._clean(number)

    def _clean(self, number: int) -> None:
        named = {r.name for k in (number, number - 1) if k in self.versions() for r in self.runs(k)}
        for name in self._names(""):
            if name.startswith("run-") and name not in named:
                self._path(name).getFileSystem(self._conf).delete(self._path(name), True)
        for old in self.versions():
            if old < number - 1:
                self._path("").getFileSystem(self._conf).delete(self._path(f"_manifest/{old}.json"), False)
