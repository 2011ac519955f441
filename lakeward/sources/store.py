"""Small-object access to a warehouse: listing, JSON, and exclusive creation."""

from __future__ import annotations

import json
import os
import tempfile
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import SparkSession

SCHEMES = ("", "file", "s3", "s3a", "hdfs", "viewfs")


class Conflict(Exception):
    """Another writer created the object first."""


class Store:
    """Objects under a root, through Hadoop's file systems; local creation is atomic by hard link."""

    def __init__(self, spark: SparkSession, root: str):
        scheme = urlparse(root).scheme
        if scheme not in SCHEMES:
            raise ValueError(f"no object store for scheme {scheme!r}")
        self.spark, self.local = spark, scheme in ("", "file")
        self.root = "file:" + os.path.abspath(urlparse(root).path) if self.local else root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, key: str) -> str:
        return f"{self.root}/{key}" if key else self.root

    def local_path(self, key: str) -> str:
        return self.at(key).removeprefix("file:")

    def exists(self, key: str) -> bool:
        return self.fs.exists(self._path(self.at(key)))

    def names(self, key: str) -> list[tuple[str, bool, int, int]]:
        """(name, is folder, bytes, modified ms) of a folder's children; none if it doesn't exist."""
        path = self._path(self.at(key))
        if not self.fs.exists(path):
            return []
        return sorted((s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in self.fs.listStatus(path))

    def walk(self, key: str) -> list[tuple[str, int, int]]:
        """(path as Spark reports it, bytes, modified ms) of all files below."""
        out: list[tuple[str, int, int]] = []
        for name, folder, size, modified in self.names(key):
            child = f"{key}/{name}" if key else name
            out += self.walk(child) if folder else [(spark_path(self.at(child)), size, modified)]
        return out

    def read(self, key: str) -> Any:
        stream = self.fs.open(self._path(self.at(key)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, key: str, value: Any) -> None:
        """Write a new object, or raise Conflict if there is one."""
        data = json.dumps(value).encode()
        if self.local:
            target = self.local_path(key)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            fd, temp = tempfile.mkstemp(dir=os.path.dirname(target), prefix=".")
            with os.fdopen(fd, "wb") as f:
                f.write(data)
            try:
                os.link(temp, target)
            except FileExistsError:
                raise Conflict(key) from None
            finally:
                os.unlink(temp)
            return
        try:
            stream = self.fs.create(self._path(self.at(key)), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(key) from None
            raise
        stream.write(bytearray(data))
        stream.close()

    def put(self, key: str, value: Any) -> None:
        """Write an object, whether or not there is one."""
        if self.local:
            target = self.local_path(key)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            fd, temp = tempfile.mkstemp(dir=os.path.dirname(target), prefix=".")
            with os.fdopen(fd, "wb") as f:
                f.write(json.dumps(value).encode())
            os.replace(temp, target)
            return
        stream = self.fs.create(self._path(self.at(key)), True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def delete(self, key: str) -> bool:
        return self.fs.delete(self._path(self.at(key)), True)

    def delete_path(self, path: str, whole: bool = False) -> bool:
        """Delete a file, or with `whole` a folder and all that is in it."""
        return self.fs.delete(self._path(path), whole)


def spark_path(path: str) -> str:
    """A path as the `_metadata.file_path` column spells it."""
    return path.replace("file:///", "file:/") if path.startswith("file:") else path
