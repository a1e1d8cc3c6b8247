"""Files under one folder of any of Spark's file systems: paths never leave it, files are not overwritten unless asked."""

from __future__ import annotations

import posixpath

from pyspark.sql import SparkSession

from . import writers


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        fs, p = writers._fs(spark, self.root)
        fs.mkdirs(p)
        self.base = fs.makeQualified(p).toString()

    def place(self, path: str) -> str:
        """The whole path of one under the folder; one that leads out of it raises."""
        inner = posixpath.normpath(path.lstrip("/"))
        if inner in ("", ".", "..") or inner.startswith("../") or "\0" in inner or ":" in inner.split("/")[0]:
            raise ValueError(f"path leads out of the storage: {path}")
        return f"{self.root}/{inner}"

    def write(self, path: str, text: str, overwrite: bool = False) -> str:
        at = self.place(path)
        if self.exists(path):
            if not overwrite:
                raise FileExistsError(at)
            writers.replace_text(self.spark, at, text)
        else:
            writers.write_text(self.spark, at, text)
        return at

    def read(self, path: str) -> bytes:
        """One small file's bytes."""
        if not self.exists(path):
            raise FileNotFoundError(self.place(path))
        return bytes(self.spark.read.format("binaryFile").load(self.place(path)).first()["content"])

    def exists(self, path: str) -> bool:
        fs, p = writers._fs(self.spark, self.place(path))
        return bool(fs.exists(p))

    def delete(self, path: str) -> bool:
        """Whether there was such a file, which is gone now."""
        fs, p = writers._fs(self.spark, self.place(path))
        return bool(fs.exists(p) and fs.delete(p, False))

    def files(self, prefix: str = "") -> list[str]:
        """Relative paths that begin with the prefix, in order."""
        fs, p = writers._fs(self.spark, self.root)
        found, listed = [], fs.listFiles(p, True)
        while listed.hasNext():
            inner = listed.next().getPath().toString().removeprefix(self.base).lstrip("/")
            if inner.startswith(prefix.lstrip("/")):
                found.append(inner)
        return sorted(found)
