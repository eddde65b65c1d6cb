"""Tables in generations: a new one is written beside the old and becomes current at once.

A store is a folder on any file system that Spark writes to. Each generation is a folder of
Parquet tables; the file CURRENT names the one in force and is replaced by a rename, so a
reader sees the old tables or the new ones, and a failed write leaves the old. One writer at
a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self._jvm = jvm

    def generation(self) -> int | None:
        """The one in force; None before the first."""
        if not self._fs.exists(self._path("CURRENT")):
            return None
        stream = self._fs.open(self._path("CURRENT"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if not text.strip().isdigit():
            raise ValueError(f"{self.path}/CURRENT is damaged")
        return int(text)

    def read(self, table: str) -> DataFrame | None:
        """A table of the generation in force; None if there is none. Damaged files are an error."""
        path = self.location(table)
        return self.spark.read.parquet(path) if path else None

    def location(self, table: str) -> str | None:
        """Where a table of the generation in force lies."""
        n = self.generation()
        return f"{self.path}/gen={n}/{table}" if n is not None and self._fs.exists(self._path(f"gen={n}", table)) else None

    def write(self, tables: dict[str, DataFrame], sort: dict[str, list[str]] | None = None, keep: int = 1, add: bool = False) -> int:
        """Write all tables of the next generation, then put it in force; ``keep`` older ones stay
        for readers. With ``add`` the tables join the generation in force, which has none of them."""
        n = (self.generation() or 0) + 1
        if add and n > 1:
            n -= 1
        else:
            self._fs.delete(self._path(f"gen={n}"), True)
        for name, df in tables.items():
            columns = (sort or {}).get(name, [])
            (df.sortWithinPartitions(*columns) if columns else df).write.parquet(f"{self.path}/gen={n}/{name}")
        out = self._fs.create(self._path("CURRENT.new"), True)
        try:
            out.write(bytearray(str(n).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path("CURRENT.new"), self._path("CURRENT"), options)
        for status in self._fs.listStatus(self._path()):
            name = status.getPath().getName()
            if name.startswith("gen=") and int(name[4:]) < n - keep:
                self._fs.delete(status.getPath(), True)
        return n

    def drop(self) -> None:
        self._fs.delete(self._path(), True)
