"""Small files on any Hadoop file system, by URI or plain path; all work is the driver's."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import SparkSession


class Found(NamedTuple):
    """A file of a folder: its path, name, size and time of change (ms)."""

    path: str
    name: str
    size: int
    time: int


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(str(path))
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make(self, folder: str) -> None:
        fs, p = self._at(folder)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def ls(self, folder: str) -> list[Found]:
        """The folder's entries by name, none if it is missing."""
        fs, p = self._at(folder)
        if not fs.exists(p):
            return []
        out = [Found(f"{str(folder).rstrip('/')}/{s.getPath().getName()}", s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)]
        return sorted(out, key=lambda f: f.name)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a new file, which appears whole or not at all; False if there is one already."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        temp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{self.jvm.java.util.UUID.randomUUID().toString()}.tmp")
        stream = fs.create(temp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return self.rename(temp.toString(), path)

    def rename(self, source: str, target: str) -> bool:
        """Moves a file within a file system; False, and the source goes, if the target exists."""
        fs, p = self._at(source)
        fs_, to = self._at(target)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        try:
            context.rename(fs.makeQualified(p), fs_.makeQualified(to), how)
        except Exception:
            if not fs_.exists(to):
                raise
            fs.delete(p, False)
            return False
        return True

    def move(self, source: str, folder: str) -> None:
        """Moves a file into a folder, also of another file system, in place of one of its name."""
        fs, p = self._at(source)
        fs_, to = self._at(f"{str(folder).rstrip('/')}/{p.getName()}")
        fs_.mkdirs(to.getParent())
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, fs_, to, True, True, self.conf)
