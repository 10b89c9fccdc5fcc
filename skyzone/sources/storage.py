"""Files and folders by URI, through the file systems that Spark itself reads."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..errors import InputError


@dataclass(frozen=True)
class Entry:
    path: str
    size: int
    folder: bool

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rpartition("/")[2]


def uri_of(path: str | os.PathLike) -> str:
    """A URI as it is; a local path as an absolute ``file:`` URI."""
    text = os.fspath(path)
    return text if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", text) else f"file://{os.path.abspath(text)}"


class Storage:
    """Driver-side operations on any Hadoop file system.  Bytes of data go through Spark, not through here."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.getActiveSession()
        if self.spark is None:
            raise InputError("no active session to reach storage with")

    def _at(self, path: str | os.PathLike):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(uri_of(path))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str | os.PathLike) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def is_folder(self, path: str | os.PathLike) -> bool:
        fs, where = self._at(path)
        return fs.exists(where) and fs.getFileStatus(where).isDirectory()

    def children(self, path: str | os.PathLike) -> list[Entry]:
        """What lies in a folder, by name; nothing where there is none."""
        fs, where = self._at(path)
        if not fs.exists(where):
            return []
        found = [Entry(s.getPath().toString(), s.getLen(), s.isDirectory()) for s in fs.listStatus(where)]
        return sorted(found, key=lambda e: e.name)

    def walk(self, path: str | os.PathLike) -> Iterator[Entry]:
        """All files below a folder."""
        for e in self.children(path):
            if e.folder:
                yield from self.walk(e.path)
            else:
                yield e

    def files(self, path: str | os.PathLike) -> list[tuple[str, int]]:
        """(path within the folder, size) of all files below it; listed in one go where Arrow knows the file system."""
        from pyarrow import ArrowException, fs

        try:
            store, base = fs.FileSystem.from_uri(uri_of(path))
            found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        except (ArrowException, OSError):
            base = self._at(path)[1].toUri().getPath().rstrip("/")
            return [(e.path.partition(base)[2].lstrip("/"), e.size) for e in self.walk(path)]
        return sorted((x.path[len(base.rstrip("/")) + 1 :], x.size) for x in found if x.type == fs.FileType.File)

    def read(self, path: str | os.PathLike) -> bytes:
        """A small file's bytes."""
        fs, where = self._at(path)
        if not fs.exists(where):
            raise InputError(f"there is no {path}", str(path))
        stream = fs.open(where)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str | os.PathLike, body: bytes) -> None:
        """A new small file; one that is there already is an error, whoever made it."""
        fs, where = self._at(path)
        try:
            stream = fs.create(where, False)
        except Exception as e:
            if fs.exists(where):
                raise FileExistsError(str(path)) from e
            raise
        try:
            stream.write(bytearray(body))
        finally:
            stream.close()

    def remove(self, path: str | os.PathLike) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def move(self, source: str | os.PathLike, target: str | os.PathLike) -> None:
        """Rename; what has the target's name already is an error."""
        fs, where = self._at(source)
        _, to = self._at(target)
        if fs.exists(to):
            raise FileExistsError(str(target))
        if not fs.rename(where, to):
            raise InputError(f"can't rename {source} to {target}", str(target))

    def copy(self, source: str | os.PathLike, target: str | os.PathLike) -> int:
        """Copy a tree file by file to any file system; how many files it has.  Existing files stay and are an error."""
        base, n = uri_of(source).rstrip("/"), 0
        files = list(self.walk(source)) if self.is_folder(source) else [Entry(base, 0, False)]
        conf = self.spark._jsc.hadoopConfiguration()
        for e in files:
            rest = e.path.partition(base.partition("://")[2].partition("/")[2].rstrip("/"))[2] if e.path != base else ""
            a, frm = self._at(e.path)
            b, to = self._at(uri_of(target).rstrip("/") + rest)
            if b.exists(to):
                raise FileExistsError(to.toString())
            self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, frm, b, to, False, False, conf)
            n += 1
        return n
