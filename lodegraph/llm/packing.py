"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

Documents become token ids with an end id. Each document is cut into pieces of ``width``
ids and one shorter rest. The rests are packed from their histogram alone (``width``
counts, whatever the corpus size), shortest pack first: lengths from long to short, each
into the open pack that holds least so far if it has room, as groups of equal lengths and
equal packs, updating pattern counts. Patterns are then joined back to documents by rank:
the r-th piece of a length takes the r-th slot of that length.

Ranks come from counts a (task file, length), so no length's pieces meet in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodegraph.llm.runtime import Scratch, table
from lodegraph.llm.tokens import encoder, slices

WIDTH, END = 1024, 0

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, rank long"


def _cut(path: str, drops_space: bool, end: int, width: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, enc = TaskContext.get().partitionId(), np.zeros(width + 1, dtype=np.int64), encoder(path, drops_space)
        for b in batches:
            for lo, hi in slices(b["text"]):
                ids, first = enc.encode(b["text"].slice(lo, hi - lo))
                n_docs = hi - lo
                ids = np.insert(ids, first[1:], np.uint32(end)).astype("<u4")
                first = first + np.arange(n_docs + 1)
                total = np.diff(first)
                n_piece = -(-total // width)
                row = np.repeat(np.arange(n_docs), n_piece)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n_piece) - n_piece, n_piece)
                start = nth * width
                length = np.minimum(total[row] - start, width)
                at = first[row] + start
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                runs = length[order]
                head = np.concatenate([[0], np.flatnonzero(np.diff(runs)) + 1]) if len(runs) else np.zeros(0, np.int64)
                within = np.arange(len(runs)) - np.repeat(head, np.diff(np.append(head, len(runs))))
                rank = np.empty(len(runs), dtype=np.int64)
                rank[order] = within + seen[runs]
                seen += np.bincount(length, minlength=width + 1)
                doc = b["doc_id"].slice(lo, n_docs).take(pa.array(row))
                cols = [doc, pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(total[row], pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank, pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
                if with_ids:
                    edge = np.append(at, len(ids)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(edge), pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pack_histogram(counts: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in place order) and how often each is used.

    Lengths are placed from long to short. A group of equal lengths goes to the shortest packs,
    those with the most room, as many as both allow; if not even those have room, what is left opens
    new packs, each filled before the next. The result is that of placing one piece at a time.
    Packs without room are closed.
    """
    open_: dict[int, list[list]] = {}  # room -> [pattern, count]
    closed: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room:
            open_.setdefault(room, []).append([pattern, n])
        else:
            closed.append((pattern, n))

    for length in sorted((k for k in counts if k > 0), reverse=True):
        left = counts[length]
        while left:
            room = max(open_, default=0)
            if room < length:
                each = width // length
                full, rest = divmod(left, each)
                if full:
                    put(width - each * length, (length,) * each, full)
                if rest:
                    put(width - rest * length, (length,) * rest, 1)
                break
            pattern, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
            used = min(left, n)
            if n > used:
                open_.setdefault(room, []).append([pattern, n - used])
            put(room - length, (*pattern, length), used)
            left -= used
    return closed + [(p, n) for group in open_.values() for p, n in group]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """For each place of each pattern: length, first and end rank of the pieces it takes, first sequence, offset."""
    out, taken, sequence = [], {}, 0
    for pattern, n in sorted(patterns, reverse=True):
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            out.append((length, rank, rank + n, sequence, offset))
            taken[length] = rank + n
            offset += length
        sequence += n
    return out


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, drops_space: bool, end: int = END, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces with their place: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids`` on request).

    A null or empty text is its end id alone; a text of any length is cut, never shortened. Rows are taken one by
    one: a repeated id is packed again, and a null id stays null. Equal lengths are placed in order of task and row. No
    documents give no pieces. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = scratch.write(docs.mapInArrow(_cut(tokenizer, drops_space, end, width, with_ids), schema), "pieces")
    per_part = scratch.write(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = per_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    # At most ``width`` rows: the histogram.
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table_ = pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*slots(pack_histogram(counts, width)), strict=True)] or [pa.array([], pa.int64())] * 5, names=["length", "lo", "hi", "first", "offset"])
    by_length: dict[int, tuple] = {}
    arr = {c: np.asarray(table_[c]) for c in table_.column_names}
    order = np.lexsort((arr["lo"], arr["length"]))
    arr = {c: v[order] for c, v in arr.items()}
    edge = np.searchsorted(arr["length"], np.arange(width + 2))
    for n in counts:
        s = slice(edge[n], edge[n + 1])
        by_length[n] = (arr["lo"][s], arr["first"][s], arr["offset"][s])

    # At most a few thousand places, whatever the corpus: as many as there are patterns of a histogram of ``width`` lengths.
    held = spark.sparkContext.broadcast(by_length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b["length"]), np.asarray(b["rank"])
            seq, off = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                lo, first, offset = held.value[int(n)]
                k = np.searchsorted(lo, rank[at], "right") - 1
                seq[at], off[at] = first[k] + rank[at] - lo[k], offset[k]
            cols = [c for c, name in zip(b.columns, b.schema.names, strict=True) if name != "rank"]
            names = [x for x in b.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if with_ids else [])
    out = T.StructType([*[pieces.schema[c] for c in keep], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*keep, "rank").mapInArrow(place, out).withColumn("length", F.col("length").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), Scratch(spark, "op6"), public_tokenizers.path("byte_bpe_50k.json"), drops_space=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every document that is left, as packed pieces.

    Null and empty texts are their end id alone, repeated rows and rows without an id are packed as they stand; an empty table gives
    no pieces. Other columns, whatever their names, are not read.
    """
    return pack(docs, Scratch(spark, "stage-pack"), public_tokenizers.path("byte_bpe_50k.json"), drops_space=False)
