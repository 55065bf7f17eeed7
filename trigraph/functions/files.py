"""Small files and folders through Hadoop's file system, so that any shared storage works."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, path: str, folders: bool = True) -> list[str]:
        """Names of the folders, or of the files, in a folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() == folders) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def delete_at_end(self, path: str) -> None:
        """Deletes a folder when the application ends."""
        fs, p = self._at(path)
        fs.deleteOnExit(p)

    def write_text(self, path: str, text: str) -> None:
        """Written beside and renamed, so that readers see the old or the new text."""
        fs, p = self._at(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(path + ".new")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(beside, p)

    def read_text(self, path: str) -> str | None:
        fs, p = self._at(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(path + ".new")
        if not fs.exists(p):
            if not fs.exists(beside):
                return None
            fs.rename(beside, p)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
