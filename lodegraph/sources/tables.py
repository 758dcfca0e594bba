"""Tables that cut a plan's lineage: Parquet in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only where it is unset, as on one machine, a temporary one."""
    conf = spark.sparkContext.getConf()
    place = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = f"file://{tempfile.gettempdir()}/checkpoints"
    return place.rstrip("/")


def dealt(df: DataFrame, *on: str) -> DataFrame:
    """Rows that meet others by ``on``, over all tasks: there are far more that meet than rows, so neither few tasks by the rows' bytes nor a broadcast do."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *on).hint("merge")


#: Bytes of input to a partition of `spread`: some 400,000 rows of a few small columns.
SPREAD = 4 << 20


def spread(df: DataFrame, *on: str, like: DataFrame | None = None) -> DataFrame:
    """Rows by ``on`` in partitions that grow in number, and not in rows, with the input (that of ``like``, for a join whose size the planner
    overrates). Adaptive execution goes by shuffled bytes, and such rows take many times these in a sort or a map of groups."""
    spark = df.sparkSession
    size = int(str((like or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = 2 * spark.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-size // SPREAD)) if size < 1 << 40 else max(least, int(spark.conf.get("spark.sql.shuffle.partitions"))), *on)


class Tables:
    """Intermediate tables of one call, written once and read by later steps; ``close`` deletes them, as does `closing`."""

    #: Open ones, where `closing` watches.
    opened: list[Tables] | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self._n = spark, f"{shared_dir(spark)}/lodegraph-{name}-{uuid.uuid4().hex}", 0
        if Tables.opened is not None:
            Tables.opened.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table. Joins with it are sort-merge joins unless a hint says else: by its compressed columns a table of millions of rows
        counts as small, and a step with many joins would then build many of them whole on the driver at once."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).hint("merge")

    def close(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def closing(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators of this session wrote under it; results that read from it must have been used by then."""
    before = Tables.opened
    Tables.opened = []
    try:
        yield
    finally:
        for t in Tables.opened:
            if t.spark is spark:
                t.close()
        Tables.opened = before
