"""Folders that the driver and all executors share, reached through Spark's file systems."""

from __future__ import annotations

import atexit
import contextlib
import tempfile

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}
_OWN: dict[str, Files] = {}


class Files:
    """The file system of a path, whatever it is: local, HDFS, an object store."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)

    def names(self, path: str) -> list[str]:
        """What a folder holds; nothing if there is none."""
        at, fs = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def write(self, path: str, text: str) -> None:
        at, fs = self._at(path)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master, whose executors are the driver itself, may go without and gets a
    temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = f"file://{tempfile.mkdtemp(prefix='fernglass-')}"
        found = _LOCAL["dir"]
    return found


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/fernglass/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN[path] = Files(spark)
        if len(_OWN) == 1:
            atexit.register(_forget)
    return path


def _forget() -> None:
    for path, files in _OWN.items():
        with contextlib.suppress(Exception):  # the JVM may be gone before
            files.delete(path)
