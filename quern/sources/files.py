"""Driver-side files on any file system that Spark reads and that renames atomically (HDFS, viewfs, local disks).

Files are written under a name of their own and renamed into place, so that none is ever seen in part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        f = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode()
        finally:
            f.close()

    def _place(self, name: str, text: str, *, over: bool) -> None:
        temp = f"{name}.{uuid.uuid4().hex}.temp"
        f = self._fs.create(self._path(f"temp/{temp}"), True)
        f.write(bytearray(text.encode()))
        f.close()
        self._fs.mkdirs(self._path(name).getParent())
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if over else kind.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if "://" in self.root else self._fs.getUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(self._path(f"temp/{temp}")), self._fs.makeQualified(self._path(name)), how)
        except Exception:
            self._fs.delete(self._path(f"temp/{temp}"), False)
            raise

    def create(self, name: str, text: str) -> bool:
        """Write a new file, whole or not at all; False if it is there already."""
        if self.exists(name):
            return False
        try:
            self._place(name, text, over=False)
        except Exception:
            if self.exists(name):
                return False
            raise
        return True

    def replace(self, name: str, text: str) -> None:
        """Write a file in place of what is there; readers see the old one or the new one."""
        self._place(name, text, over=True)

    def move(self, old: str, new: str) -> None:
        self._fs.mkdirs(self._path(new.rpartition("/")[0]))
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot move {old} to {new}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
