"""Folder operations on whatever file system a path names, through Spark's own Hadoop client."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folders:
    """Metadata operations of the driver; table data never passes through here."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def make_parent(self, path: str) -> None:
        parent = self._path(path).getParent()
        if parent is not None:
            self._fs(path).mkdirs(parent)

    def qualified(self, path: str) -> str:
        """The path with its scheme, as Spark's file sources write it."""
        return self._fs(path).makeQualified(self._path(path)).toString()

    def unusual(self, path: str) -> list[tuple[str, int, bool]]:
        """(name, length, is a plain file) of what Spark's file sources pass over: hidden entries and folders.

        The listing is one call of the file system; only entries that an artifact should not have are
        looked at one by one.
        """
        found = self._fs(path).listStatus(self._path(path))
        return [
            (s.getPath().getName(), s.getLen(), s.isFile())
            for s in found
            if not s.isFile() or s.getPath().getName().startswith((".", "_"))
        ]

    def plain_files(self, path: str) -> list[str]:
        """Names of the files directly below a path, but for checksums of a local file system; none where it does not exist."""
        if not self.exists(path):
            return []
        names = [s.getPath().getName() for s in self._fs(path).listStatus(self._path(path)) if s.isFile()]
        return [n for n in names if not (n.startswith(".") and n.endswith(".crc"))]

    def folders(self, path: str) -> list[str]:
        """Names of the folders directly below a path; none where it does not exist."""
        if not self.exists(path):
            return []
        return [s.getPath().getName() for s in self._fs(path).listStatus(self._path(path)) if s.isDirectory()]

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def publish(self, staged: str, target: str) -> None:
        """Rename that refuses an existing target; a plain rename would move into it."""
        if self.exists(target):
            raise FileExistsError(target)
        source = self._fs(staged).makeQualified(self._path(staged))
        goal = self._fs(target).makeQualified(self._path(target))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            source.toUri(), self._conf
        )
        strict = self._gateway.new_array(
            getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0
        )
        context.rename(source, goal, strict)
