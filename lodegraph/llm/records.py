"""Token sequences as length-delimited binary records with an offset index.

A shard ``NNNNN.rec`` holds records one after the other: length (u64), masked CRC-32C of
those eight bytes (u32), payload, masked CRC-32C of the payload (u32), all little-endian.
The payload is the document id (i64), a flag (u8: 0 if the id is null), the width of a token (u8: 2 or 4)
and the token ids. ``NNNNN.idx`` holds a row for each record: offset (u64) and payload
length (u64), so that records can be read in any order. Shards are ranges of the document
id, in order; within one, ids ascend.

Files go to and come from any place that ``pyarrow.fs`` can open by its address. A shard is
written under a name of its own and then renamed, so a task that is run again leaves the same file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.crc32c import crc32c, masked
from lodegraph.llm.runtime import Scratch, table, tasks
from lodegraph.llm.tokens import encoder, slices

HEAD, EXTRA = 10, 16  # payload bytes before the tokens; frame bytes around a payload
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8")])
READ_BYTES = 8 << 20


def frames(ids: list[int | None], tokens: np.ndarray, first: np.ndarray, width: int) -> tuple[bytes, np.ndarray]:
    """Records of some documents, and the payload length of each."""
    n = len(ids)
    count = np.diff(first)
    payload = HEAD + width * count
    at = np.concatenate([[0], np.cumsum(payload + EXTRA)])
    out = np.zeros(int(at[-1]), dtype=np.uint8)
    lengths = payload.astype("<u8").view(np.uint8).reshape(n, 8)
    put = lambda where, rows: out.__setitem__(where[:, None] + np.arange(rows.shape[1]), rows)
    put(at[:-1], lengths)
    put(at[:-1] + 8, masked(crc32c(lengths.reshape(-1), np.arange(n + 1) * 8)).astype("<u4").view(np.uint8).reshape(n, 4))
    head = np.zeros((n, HEAD), dtype=np.uint8)
    head[:, :8] = np.array([i or 0 for i in ids], dtype="<i8").view(np.uint8).reshape(n, 8)
    head[:, 8] = [i is not None for i in ids]
    head[:, 9] = width
    put(at[:-1] + 12, head)
    body = tokens[first[0] : first[-1]].astype(f"<u{width}").view(np.uint8)
    out[np.repeat(at[:-1] + 12 + HEAD - (first[:-1] - first[0]) * width, count * width) + np.arange(len(body))] = body
    edge = np.stack([at[:-1] + 12, at[1:] - 4], axis=1).reshape(-1)
    sums = crc32c(out, np.append(edge, len(out)))[::2] if n else np.zeros(0, np.uint32)
    put(at[1:] - 4, masked(sums).astype("<u4").view(np.uint8).reshape(n, 4))
    return out.tobytes(), payload


def _write(folder: str, path: str, drops_space: bool, end: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path, drops_space)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        own, done = f"{root}/{part:05d}-{uuid.uuid4().hex}", f"{root}/{part:05d}"
        docs = n_tokens = offset = 0
        with store.open_output_stream(f"{own}.rec") as rec, store.open_output_stream(f"{own}.idx") as idx:
            for b in batches:
                for lo, hi in slices(b["text"]):
                    tokens, first = enc.encode(b["text"].slice(lo, hi - lo))
                    tokens = np.insert(tokens, first[1:], np.uint32(end))
                    first = first + np.arange(hi - lo + 1)
                    raw, payload = frames(b["doc_id"].slice(lo, hi - lo).to_pylist(), tokens, first, width)
                    rows = np.empty(hi - lo, dtype=INDEX)
                    rows["offset"] = offset + np.concatenate([[0], np.cumsum(payload + EXTRA)[:-1]])
                    rows["length"] = payload
                    rec.write(raw)
                    idx.write(rows.tobytes())
                    offset, docs, n_tokens = offset + len(raw), docs + hi - lo, n_tokens + len(tokens)
        for kind in ("rec", "idx"):
            store.move(f"{own}.{kind}", f"{done}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs], "tokens": [n_tokens]})

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, drops_space: bool, end: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[tuple[int, int, int]]:
    """Write all documents in ascending id (nulls first, equal ids by text); returns (shard, documents, tokens) of each shard, in order.

    A null text is an empty one: its end id alone; texts of any length are one record each. A repeated row is written
    again. No documents give shards without records. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = ["doc_id", F.xxhash64("text")]
    dealt = docs.repartitionByRange(shards or tasks(docs.sparkSession), *keys).sortWithinPartitions(*keys, "text")
    width = 2 if vocabulary <= 1 << 16 else 4
    rows = dealt.mapInArrow(_write(folder, tokenizer, drops_space, end, width), "part long, docs long, tokens long").collect()
    return sorted((r["part"], r["docs"], r["tokens"]) for r in rows)


def read_shard(folder: str, part: int, order: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, token ids) of a shard's records, in file order or in that of ``order``; damaged records raise."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{part:05d}.idx") as f:
        index = np.frombuffer(f.read(), dtype=INDEX)
    with store.open_input_file(f"{root}/{part:05d}.rec") as f:
        if order is not None:
            for i in order:
                f.seek(int(index["offset"][i]))
                yield from unframe(f.read(int(index["length"][i]) + EXTRA), index[i : i + 1])
            return
        lo = 0
        ends = index["offset"] + index["length"] + np.uint64(EXTRA)
        while lo < len(index):
            hi = max(lo + 1, int(np.searchsorted(ends, index["offset"][lo] + np.uint64(READ_BYTES), "right")))
            f.seek(int(index["offset"][lo]))
            yield from unframe(f.read(int(ends[hi - 1] - index["offset"][lo])), index[lo:hi])
            lo = hi


def unframe(raw: bytes, index: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records that stand one after the other in ``raw``; every checksum is tested."""
    data, n = np.frombuffer(raw, dtype=np.uint8), len(index)
    at = np.concatenate([[0], np.cumsum(index["length"].astype(np.int64) + EXTRA)])
    take = lambda where, k: np.ascontiguousarray(data[where[:, None] + np.arange(k)])
    lengths = take(at[:-1], 8)
    sums = take(at[:-1] + 8, 4).view("<u4").reshape(-1)
    ok = (lengths.view("<u8").reshape(-1) == index["length"]) & (masked(crc32c(lengths.reshape(-1), np.arange(n + 1) * 8)) == sums)
    edge = np.stack([at[:-1] + 12, at[1:] - 4], axis=1).reshape(-1)
    ok &= masked(crc32c(data, np.append(edge, len(data)))[::2]) == take(at[1:] - 4, 4).view("<u4").reshape(-1)
    if not ok.all():
        raise ValueError(f"damaged record {int(np.flatnonzero(~ok)[0])} of a run of {n}")
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        body = raw[a + 12 : b - 4]
        yield (int.from_bytes(body[:8], "little", signed=True) if body[8] else None), np.frombuffer(body[HEAD:], dtype=f"<u{body[9]}")


def read_back(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record; ``start`` counts the ids of all records before it."""
    base, rows = 0, []
    for part, docs, n in shards:
        if docs:
            rows.append((part, base))
        base += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start in zip(b["part"].to_pylist(), b["base"].to_pylist(), strict=True):
                out: list[tuple] = []
                for doc, ids in read_shard(folder, part):
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row a shard, each in a task of its own.
    return spark.createDataFrame(rows, "part int, base long").repartitionById(len(rows), F.expr(f"pmod(part, {len(rows)})")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents through record files and back."""
    folder = Scratch(spark, "op5").path("records")
    shards = write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), drops_space=True, end=1, vocabulary=49_408)
    return read_back(spark, folder, shards)
