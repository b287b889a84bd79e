"""Manifests: what a table in a shared folder consists of, version by version.

A version is one small JSON file, written whole beside its place and then renamed to it; files that no manifest names are not there for readers. So a writer that dies leaves the version before as it
was, and a second writer of the same version fails at the rename.
"""

from __future__ import annotations

import json
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession


class Files:
    """The few file operations that a manifest needs, on whatever file system a path names."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def fs(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def names(self, pattern: str) -> list[str]:
        found = self.fs(pattern).globStatus(self.path(pattern))
        return sorted(str(f.getPath().toString()) for f in found) if found else []

    def read(self, name: str) -> str:
        stream = self.fs(name).open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """The file under its name, whole or not at all; an error if it is there already."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        out = self.fs(draft).create(self.path(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self.conf)
        context.rename(self.path(draft), self.path(name), SparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def delete(self, name: str) -> None:
        self.fs(name).delete(self.path(name), True)


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.files, self.path = Files(spark), f"{path.rstrip('/')}/_manifest"

    def versions(self) -> list[int]:
        return [int(n.rsplit("/", 1)[1][1:-5]) for n in self.files.names(f"{self.path}/v*.json")]

    def read(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/v{version:010d}.json"))

    def latest(self) -> tuple[int, dict]:
        """The newest version and what it says; version 0 says nothing."""
        found = self.versions()
        return (max(found), self.read(max(found))) if found else (0, {})

    def commit(self, said: dict, after: int) -> int:
        """The next version after the one that the change was made from; fails if another writer has made it by then."""
        self.files.write_new(f"{self.path}/v{after + 1:010d}.json", json.dumps(said))
        return after + 1

    def drop(self, version: int) -> None:
        self.files.delete(f"{self.path}/v{version:010d}.json")
