"""The few file operations Spark's readers and writers do not offer, on any Hadoop path."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Listing, deleting and publishing below one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._gateway = spark.sparkContext._gateway
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._system = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._hadoop.Path(path)

    def names(self, folder: str) -> list[str]:
        """Names of what lies in a folder, sorted; none if it is not there."""
        if not self._system.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._system.listStatus(self._path(folder)))

    def exists(self, path: str) -> bool:
        return self._system.exists(self._path(path))

    def delete(self, path: str, root: str) -> None:
        """A file or a folder, and the folders above it, below ``root``, that are empty then."""
        found = self._system.makeQualified(self._path(path))
        top = self._system.makeQualified(self._path(root)).toString()
        self._system.delete(found, True)
        folder = found.getParent()
        while folder.toString().startswith(top + "/"):
            if self._system.exists(folder):
                if len(self._system.listStatus(folder)):
                    return
                self._system.delete(folder, False)
            folder = folder.getParent()

    def read(self, path: str) -> str:
        """A small text file."""
        stream = self._system.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Makes a small text file appear whole; False if another one is there already.

        The file is written under another name and renamed, which the file system must do
        in one step.
        """
        folder, _, name = path.rpartition("/")
        draft = self._path(f"{folder}/.{name}.{uuid.uuid4().hex}")
        stream = self._system.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        # without options an existing target is left alone
        context = self._hadoop.FileContext.getFileContext(self._system.getUri(), self._conf)
        kind = getattr(self._hadoop, "Options$Rename")
        try:
            context.rename(draft, self._path(path), self._gateway.new_array(kind, 0))
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            self._system.delete(draft, False)
            return False
