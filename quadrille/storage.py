"""Shared storage: checkpoints, and versions that are committed by a rename."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir, which driver and executors share. Where a session on one machine has none, as in
    tests, a temporary folder becomes it; on a cluster that is an error, since executors would not see the driver's folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quadrille-{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, label: str = "step") -> DataFrame:
    """df written to shared storage as Parquet and read again: its lineage ends there, and its size is known."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """df as a side of joins that go by shuffle. Spark would broadcast, through the driver, what is small as a compressed file,
    but millions of alike keys are that and take a hundred times the room as rows."""
    return df.hint("merge")


def whole_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc, scope, text): each file's name, the path that it was asked for by, and its whole text."""
    read = lambda path: spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.lit(path).alias("scope"), F.col("value").alias("text"))
    return reduce(DataFrame.union, map(read, paths))


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class Versions:
    """Numbered text files in a folder, each committed whole or not at all: a draft is renamed to its version, and the
    rename fails if that version exists, so of two writers one commits and the other starts again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop
        self.path = hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self.files = self.path(self.folder).getFileSystem(conf)
        self._context = hadoop.fs.FileContext.getFileContext(self.files.getUri(), conf)

    def name(self, version: int) -> str:
        return f"{self.folder}/{version:012d}.json"

    def all(self) -> list[int]:
        folder = self.path(self.folder)
        if not self.files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def latest(self) -> int:
        """The newest version, 0 if there is none."""
        return max(self.all(), default=0)

    def read(self, version: int) -> list[str]:
        stream = self.files.open(self.path(self.name(version)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()

    def first_line(self, version: int) -> str:
        """The first line alone, however long the file is."""
        stream = self.files.open(self.path(self.name(version)))
        try:
            java = self.spark._jvm.java.io
            return java.BufferedReader(java.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()

    def commit(self, version: int, lines: Iterable[str]) -> None:
        """Makes the lines the content of a version that is not there yet, or raises CommitConflict."""
        self.files.mkdirs(self.path(self.folder))
        draft, final = self.path(f"{self.folder}/_{uuid.uuid4().hex}"), self.path(self.name(version))
        stream = self.files.create(draft, False)
        stream.write(bytearray("".join(f"{line}\n" for line in lines).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(draft, final, options)  # without the option OVERWRITE: fails if it exists
        except Py4JJavaError as e:
            self.files.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise CommitConflict(f"version {version} exists") from e
            raise
