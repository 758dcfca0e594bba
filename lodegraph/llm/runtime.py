"""What the corpus operators need from the cluster: shared scratch tables and shipped code."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.sources.tables import shared_dir

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors unless their module path has it already.

    Also bounds Arrow batches where the session has Spark's default of 10,000 rows: rows are whole texts here, and a worker
    holds a batch a few times over.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")
    places = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in places or getattr(sc, "_lodegraph_shipped", False):
        return
    folder = tempfile.mkdtemp()
    staged = Path(folder, "stage", "lodegraph")
    shutil.copytree(ROOT / "lodegraph", staged, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{folder}/lodegraph_code", "zip", staged.parent))
    sc._lodegraph_shipped = True


class Scratch:
    """Tables under the shared folder that cut lineage: written once as Parquet, read by every executor."""

    #: Open ones, where `closing` watches.
    opened: list[Scratch] | None = None

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.base = spark, f"{shared_dir(spark)}/lodegraph-{name}-{uuid.uuid4().hex}"
        self._n = 0
        if Scratch.opened is not None:
            Scratch.opened.append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lodegraph_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in tables:
            if path := getattr(df, "_lodegraph_path", None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def free(self) -> None:
        """Let Spark delete shuffle files of finished steps: its cleaner acts on what a collection finds unreachable."""
        gc.collect()
        self.spark._jvm.System.gc()

    def close(self) -> None:
        """Delete everything; what was returned from it must have been read by then."""
        self._delete(self.base)


@contextmanager
def closing(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written under it by operators of this session."""
    opened = Scratch.opened
    Scratch.opened = []
    try:
        yield
    finally:
        for s in Scratch.opened:
            if s.spark is spark:
                s.close()
        Scratch.opened = opened


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % modulus


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
