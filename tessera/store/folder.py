"""Small files of a table in any store that Spark writes to: names, texts, and commits that happen once or not at all."""

import uuid

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has committed that version first."""


class Folder:
    """A folder by its path. What is read or written here is small: manifests and commit marks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, sub: str = "") -> list[str]:
        """Names in the folder, or in a folder below it; none if there is no such folder."""
        place = self._at(sub)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(place)) if self._fs.exists(place) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def size(self, *names: str) -> int:
        """Bytes of all files below the named folders."""
        return sum(self._fs.getContentSummary(self._at(n)).getLength() for n in names)

    def commit(self, name: str, text: str) -> None:
        """Writes a file that readers see whole or not at all; Conflict if there is one of that name."""
        draft = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._at(draft), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(draft), self._at(name)):
            self._fs.delete(self._at(draft), False)
            raise Conflict(f"{self.path}/{name} is there already")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)
