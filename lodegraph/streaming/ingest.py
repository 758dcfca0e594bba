"""Resumable ingestion: exactly-once counts, upserts, windows and state over a stream of events.

Every stream ends by itself when all that has arrived is read, and goes on from its checkpoint the next time. Results go to
Parquet, not to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a file stream; the schema is that of the files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    # A stream watches folders: a single file is picked out of its own.
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def drain(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """All that has arrived, once; the result is ``path/out``, the checkpoint ``path/checkpoint``, and a later call goes on from there.

    ``complete`` replaces the table with each batch, ``append`` adds each batch's rows, ``update`` does so too: a key's last
    row by ``batch`` counts. A batch that is written again replaces what its first try left.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, epoch: int) -> None:
        place = f"{path}/out" if mode == "complete" else f"{path}/out/batch={epoch}"
        batch.write.mode("overwrite").parquet(place)

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/out")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{path}/out")


def counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("event_type").agg(F.count("*").alias("n"))


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of each user: rows closer than ``gap`` belong together; rows more than ``late`` behind the newest are dropped."""
    return _timed(stream, late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def windows(stream: DataFrame, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts by event type in windows of ``length``, a new one every ``slide`` (every ``length`` if that is not given)."""
    own = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _timed(stream, late).groupBy(own.alias("w"), "event_type").agg(F.count("*").alias("n"))


def upsert_batches(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, parts: int = 16) -> None:
    """Keep the latest row of each key under ``path``, in ``parts`` folders by the key's hash.

    A batch rewrites the folders its keys fall into and no others, in one write, as a new generation ``part=i/gen=n`` beside the last
    one, which goes with the next but one. A repeated batch leaves the same table. `latest` reads it.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        own = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        touched = [r["part"] for r in own.select("part").distinct().collect()]  # at most ``parts`` numbers
        known = {i: [g for g in v if g < epoch] for i, v in _generations(spark, path).items()}
        last = [f"{path}/part={i}/gen={max(known[i])}" for i in touched if known.get(i)]
        rows = own if not last else own.unionByName(spark.read.schema(batch.schema).parquet(*last).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")))
        kept = rows.groupBy("part", key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("part", "r.*")
        staged = f"{path}/_staged-{epoch}"
        kept.repartition(F.col("part")).write.mode("overwrite").partitionBy("part").parquet(staged)
        for i in touched:
            _replace(spark, f"{staged}/part={i}", f"{path}/part={i}/gen={epoch}")
            for g in known.get(i, [])[:-1]:
                _delete(spark, f"{path}/part={i}/gen={g}")
        _delete(spark, staged)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    p, store = _fs(spark, path)
    store.delete(p, True)


def _replace(spark: SparkSession, old: str, new: str) -> None:
    """Move a folder to where readers find it, marked as finished."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    p, store = _fs(spark, new)
    store.delete(p, True)
    store.mkdirs(p.getParent())
    store.rename(place(old), p)
    store.create(place(f"{new}/_SUCCESS")).close()


def _generations(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Finished generations of each part, oldest first."""
    p, store = _fs(spark, f"{path}/part=*/gen=*/_SUCCESS")
    out: dict[int, list[int]] = {}
    for f in store.globStatus(p) or []:
        gen, part = f.getPath().getParent(), f.getPath().getParent().getParent()
        out.setdefault(int(part.getName()[5:]), []).append(int(gen.getName()[4:]))
    return {k: sorted(v) for k, v in out.items()}


def latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that `upsert_batches` keeps."""
    places = [f"{path}/part={i}/gen={max(g)}" for i, g in sorted(_generations(spark, path).items())]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def tracked(stream: DataFrame) -> DataFrame:
    """Whether a node was changed in any row before, for rows ``base_id, seq, status``: the tracked set as state, a flag a node.

    Rows of one node are taken in order of ``seq`` within a batch; batches come in order of arrival.
    """
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else False
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        changed = (batch["status"] != "UNCHANGED").to_numpy()
        before = changed.cumsum() - changed > 0
        yield pd.DataFrame({"base_id": key[0], "seq": batch["seq"].to_numpy(), "tracked": before | known})
        state.update((bool(known or changed.any()),))

    return stream.groupBy("base_id").applyInPandasWithState(step, "base_id string, seq long, tracked boolean", "known boolean", "append", GroupStateTimeout.NoTimeout)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started under it keep their state in RocksDB, which state with several variables needs; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of `tracked_versions`, and of the state that it may begin with.
TRACKED = "base_id string, seq long, tracked boolean, versions int"
STATE = "base_id string, version string, status string"


def tracked_versions(stream: DataFrame, initial: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """For rows ``base_id, seq, version, status``: whether the node was changed before, and in how many versions it has been seen by then.

    The state of a node is a flag and a map of its versions to their last status. ``initial(base_id, version, status)``, such as the
    versions of a batch timeline, is what a new stream begins with; a stream that goes on from its checkpoint has its own. ``ttl_ms``:
    a node's state goes when it has not been written for so long (by the clock). Rows of one node are taken in order of ``seq`` within
    a batch; batches come in order of arrival. Start it under `rocksdb_state`.
    """

    class Tracker(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.changed = handle.getValueState("changed", "changed boolean", ttl_ms)
            self.versions = handle.getMapState("versions", "version string", "status string", ttl_ms)

        def handleInitialState(self, key, initialState, timerValues) -> None:
            for version, status in zip(initialState["version"], initialState["status"], strict=True):
                self.versions.updateValue((version,), (status,))
                if status != "UNCHANGED":
                    self.changed.update((True,))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
            changed, flags, seen = self.changed.exists(), [], []
            known = {v[0] for v in self.versions.keys()}
            for version, status in zip(batch["version"], batch["status"], strict=True):
                flags.append(changed)
                known.add(version)
                seen.append(len(known))
                self.versions.updateValue((version,), (status,))
                changed = changed or status != "UNCHANGED"
            if changed:
                self.changed.update((True,))
            yield pd.DataFrame({"base_id": key[0], "seq": batch["seq"].to_numpy(), "tracked": flags, "versions": pd.Series(seen, dtype="int32").to_numpy()})

        def close(self) -> None:
            pass

    begin = initial.select("base_id", "version", "status").groupBy("base_id") if initial is not None else None
    return stream.groupBy("base_id").transformWithStateInPandas(Tracker(), TRACKED, "Append", "ProcessingTime" if ttl_ms else "None", begin)
