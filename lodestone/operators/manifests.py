"""Numbered manifests: the one place where a new version of a table becomes visible, or doesn't."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifests:
    """JSON documents 1, 2, 3 ... in a folder, of which the last is current.

    A document is written under another name and put into place only if its number is still free: on a local disk
    by a hard link, elsewhere by Hadoop's rename without overwriting, which HDFS does in one step. Of two writers of
    one number the second fails. An object store whose rename is a copy needs a single writer.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def last(self) -> dict | None:
        folder = self._path(self.folder)
        if not self._fs.exists(folder):
            return None
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if not names:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/{names[-1]}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, number: int, document: dict) -> None:
        temp, final = self._path(f"{self.folder}/.{uuid.uuid4().hex}.tmp"), self._path(f"{self.folder}/{number:012d}.json")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        try:
            self._place(temp, final)
        except Exception as e:
            raise RuntimeError(f"another run published version {number} first; repeat this one") from e
        finally:
            self._fs.delete(temp, False)

    def _place(self, temp, final) -> None:
        if self._fs.getUri().getScheme() == "file":
            file = self._jvm.java.io.File
            self._jvm.java.nio.file.Files.createLink(file(final.toUri().getPath()).toPath(), file(temp.toUri().getPath()).toPath())
            return
        options = self._jvm.org.apache.hadoop.fs.Options
        never = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()[0]  # NONE
        array = self.spark.sparkContext._gateway.new_array(options.Rename, 1)
        array[0] = never
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(temp, final, array)

    def remove(self, path: str) -> bool:
        there = self._fs.exists(self._path(path))
        return bool(there and self._fs.delete(self._path(path), True))

    def exists(self, path: str) -> bool:
        return bool(self._fs.exists(self._path(path)))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []
