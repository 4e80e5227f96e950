"""Files of any file system that Spark reads, through its own client."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """The file system of a path: local folders, a cluster's store and object stores alike."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *names: str):
        out = self.root
        for n in names:
            out = self.jvm.org.apache.hadoop.fs.Path(out, n)
        return out

    def exists(self, *names: str) -> bool:
        return self.system.globStatus(self.at(*names)) is not None and len(self.system.globStatus(self.at(*names))) > 0

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.system.listStatus(self.root)) if self.exists() else []

    def read(self, *names: str) -> str:
        stream = self.system.open(self.at(*names))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, text: str, name: str) -> None:
        """Writes a small file under another name and moves it into place, so that readers see the old or the new text."""
        new = self.at(f"{name}.new")
        stream = self.system.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        array = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        array[0] = options.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri() if self.root.toUri().getScheme() else self.system.getUri()).rename(self.system.makeQualified(new), self.system.makeQualified(self.at(name)), array)

    def delete(self, *names: str) -> None:
        self.system.delete(self.at(*names), True)
