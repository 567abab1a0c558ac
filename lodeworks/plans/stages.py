"""Written stages: intermediate tables in the folder that executors and driver share.

They are Parquet tables below ``spark.checkpoint.dir``. A stage cuts the lineage of
a plan, and a lost executor costs the tasks it ran, not what lies behind the table.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []
_WRITTEN: list[Scratch] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or that of ``SparkContext.setCheckpointDir``.

    Where neither is set, a temporary folder stands in under a local master, as in tests; on a cluster, where
    each executor would write to a disk of its own, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="lodeworks-"))
    return _FALLBACK[0]


def release() -> None:
    """Remove all tables that operators have written so far. Results that are still to be read need theirs: call it between jobs."""
    while _WRITTEN:
        _WRITTEN.pop().remove()


atexit.register(release)


class Scratch:
    """Written intermediate tables of one run of an operator.

    They are removed by :meth:`drop`, and whatever is left by :func:`release` or when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lodeworks/{label}-{uuid.uuid4().hex}"
        self._written: list[str] = []
        _WRITTEN.append(self)

    def _path(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def remove(self) -> None:
        """Remove all tables of the run."""
        if self.spark.sparkContext._jsc is None:  # the session has ended before
            return
        try:
            target, fs = self._path(self.root)
            fs.delete(target, True)
        except (Py4JError, ConnectionError) as e:
            print(f"left behind: {self.root} ({type(e).__name__})")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Run ``df`` once and return it as read back from its table."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self._written.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            target, fs = self._path(f"{self.root}/{name}")
            fs.delete(target, True)

    def keep(self, *names: str) -> None:
        """Remove all tables but those that the result still reads."""
        self.drop(*(n for n in self._written if n not in names))
        self._written = list(names)

    def bytes_of(self, name: str) -> int:
        """Bytes on disk of a written table."""
        target, fs = self._path(f"{self.root}/{name}")
        return fs.getContentSummary(target).getLength()


def broadcast_if_small(scratch: Scratch, df: DataFrame, name: str, limit: int) -> DataFrame:
    """Mark a written table for broadcast if its files are within ``limit`` bytes; else leave it to a shuffled join."""
    return F.broadcast(df) if scratch.bytes_of(name) <= limit else df
