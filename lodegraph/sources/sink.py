"""A transactional sink of graph rows: staged by tasks, visible when the job commits.

Every task writes its rows, in batches of JSON lines, to a file of its own attempt and reports it. On commit the driver writes one
small manifest that names the files of all successful attempts; until then, and for attempts it does not name, nothing is there
for a reader. An aborted job deletes its files; what a lost executor or a late attempt leaves is never read, and `vacuum` deletes it.
Folders are those of the cluster's shared storage.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.graph import loads

FORMAT = "graph_batches"


def _source():
    """The data source; made in a function so that tasks get its code with the job."""
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    @dataclass
    class Written(WriterCommitMessage):
        file: str
        rows: int
        batches: int

    class Writer(DataSourceWriter):
        def __init__(self, path: str, job: str, size: int, overwrite: bool):
            self.path, self.job, self.size, self.overwrite = path, job, size, overwrite

        def _store(self):
            from pyarrow import fs

            return fs.FileSystem.from_uri(self.path)

        def write(self, iterator):
            from pyspark import TaskContext

            store, root = self._store()
            task = TaskContext.get()
            name = f"{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}.json"
            store.create_dir(f"{root}/data", recursive=True)
            rows = batches = 0
            held = []
            try:
                with store.open_output_stream(f"{root}/data/{name}") as out:
                    for row in iterator:
                        held.append(json.dumps(row.asDict(recursive=True), default=str))
                        rows += 1
                        if len(held) == self.size:
                            out.write(("\n".join(held) + "\n").encode())
                            held, batches = [], batches + 1
                    if held:
                        out.write(("\n".join(held) + "\n").encode())
                        batches += 1
            except BaseException:
                store.delete_file(f"{root}/data/{name}")
                raise
            return Written(name, rows, batches)

        def commit(self, messages):
            store, root = self._store()
            done = [m for m in messages if m is not None]
            store.create_dir(f"{root}/commits", recursive=True)
            old = self._commits(store, root) if self.overwrite else []
            body = json.dumps({"files": [m.file for m in done if m.rows], "rows": sum(m.rows for m in done), "batches": sum(m.batches for m in done), "replaces": old})
            # Written beside and moved into place: a manifest is there as a whole or not at all.
            with store.open_output_stream(f"{root}/{self.job}.tmp") as out:
                out.write(body.encode())
            store.move(f"{root}/{self.job}.tmp", f"{root}/commits/{self.job}.json")

        @staticmethod
        def _commits(store, root):
            from pyarrow import fs

            return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True)) if f.base_name.endswith(".json"))

        def abort(self, messages):
            from pyarrow import fs

            store, root = self._store()
            for f in store.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)):
                if f.base_name.startswith(self.job):
                    store.delete_file(f.path)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return FORMAT

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], uuid.uuid4().hex, int(self.options.get("batchsize", "2000")), overwrite)

    return Source


def write(rows: DataFrame, path: str, batch_size: int = 2000, overwrite: bool = False) -> None:
    """Add ``rows`` to the table under ``path``, or replace it, all or nothing; ``path`` is a URI."""
    rows.sparkSession.dataSource.register(_source())
    rows.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("path", path).option("batchsize", str(batch_size)).save()


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, batch_size: int = 2000, overwrite: bool = False) -> None:
    """Nodes, then edges both of whose ends exist, as tables ``nodes`` and ``edges`` under ``path``."""
    kept, joined = loads(nodes, edges)
    write(kept, f"{path}/nodes", batch_size, overwrite)
    write(joined, f"{path}/edges", batch_size, overwrite)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """``files, rows, batches, replaces`` of each commit under ``path``, with its ``name``."""
    schema = "files array<string>, rows long, batches long, replaces array<string>"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"{schema}, name string")
    return spark.read.schema(schema).json(f"{path}/commits/*.json").withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that have been committed under ``path`` and not replaced since."""
    found = manifests(spark, path).collect()  # a row a job
    gone = {n for m in found for n in m["replaces"]}
    files = [f"{path}/data/{f}" for m in found if m["name"] not in gone for f in m["files"]]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete files that no valid commit names; returns how many. Not while a job writes there."""
    found = manifests(spark, path).collect()
    gone = {n for m in found for n in m["replaces"]}
    named = {f for m in found if m["name"] not in gone for f in m["files"]}
    place = spark._jvm.org.apache.hadoop.fs.Path
    p = place(f"{path}/data")
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    loose = [f.getPath() for f in (store.listStatus(p) if store.exists(p) else []) if f.getPath().getName() not in named]
    for f in loose:
        store.delete(f, False)
    return len(loose)
