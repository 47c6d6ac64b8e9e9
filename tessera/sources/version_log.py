"""Tables of files under a log of versions: each version is one small file that only one writer can make."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(ValueError):
    """Another writer made the next version first."""


class VersionLog:
    """What is at ``path`` is what the newest version lists; files that no version lists are left from writers that failed.

    A version file is written under another name and renamed to its own, which fails where that exists: exactly one
    writer wins on file systems whose renames do not replace, as HDFS's do not.
    """

    #: What a version has before there is one.
    EMPTY: dict = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The newest version, or -1."""
        folder = self._at("manifest")
        if not self._fs.exists(folder):
            return -1
        return max((int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json")), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            return {"version": -1, **self.EMPTY}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{version}.json", wholetext=True).first()[0])

    def commit(self, base: dict, **new) -> dict:
        """Make the version after ``base``, or raise Conflict if there is one already."""
        made = {**base, **new, "version": base["version"] + 1}
        hidden, place = self._at(f"manifest/.{uuid.uuid4().hex}"), self._at(f"manifest/{made['version']}.json")
        stream = self._fs.create(hidden, False)
        try:
            stream.write(json.dumps(made).encode())
        finally:
            stream.close()
        if self._fs.exists(place) or not self._fs.rename(hidden, place):
            self._fs.delete(hidden, False)
            raise Conflict(f"version {made['version']} exists")
        return made
