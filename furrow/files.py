"""Small files and folders of the store that Spark writes to, whatever its scheme."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """Folders below ``root`` through the file system that Spark itself uses for them."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        """Sorted names in a folder; none if it is not there."""
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def size(self, name: str = "") -> int:
        path = self._path(name)
        return int(self._fs.getContentSummary(path).getLength()) if self._fs.exists(path) else 0

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file as a whole: it appears under its name complete or not at all, and replaces none."""
        draft = self._path(f".{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        done = not self._fs.exists(self._path(name)) and self._fs.rename(draft, self._path(name))
        if not done:
            self._fs.delete(draft, False)
            raise FileExistsError(f"{self.root}/{name}")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def delete_on_exit(self) -> None:
        """Make the folder and remove it, with all in it, when the JVM ends."""
        self._fs.mkdirs(self._path())
        self._fs.deleteOnExit(self._path())

    def stamps(self, paths: list[str]) -> tuple[tuple[str, int, int], ...]:
        """Path, length and time of change of files of any store."""
        conf = self._conf
        found = []
        for path in paths:
            place = self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI(path))
            status = place.getFileSystem(conf).getFileStatus(place)
            found.append((path, int(status.getLen()), int(status.getModificationTime())))
        return tuple(found)
