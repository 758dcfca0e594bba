"""Fuzzy line deduplication: MinHash over character shingles, banding, exact check, union-find.

A line is compared after trimming white space and lower-casing A-Z. Its set holds the
distinct runs of ``shingle`` characters; a shorter line has none and equals exact copies only.
Equal lines are one node from the start (named by 96 bits of a hash of the trimmed line), lines of similarity at or above the threshold are linked, and of every class
only the first occurrence, by (doc_id, line number), stays in the corpus.

Three scans: the occurrences; the packed band entries of each task's distinct lines; the texts
of lines that share a bucket, thinned by a Bloom filter. All later steps work on those lines alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import buckets as B
from lodegraph.llm import textkernel as K
from lodegraph.llm.bloom import build
from lodegraph.llm.minhash import MinHasher
from lodegraph.llm.runtime import Scratch, table, tasks
from lodegraph.llm.setlinks import SetLinks, Sets

#: A pair at 0.8 shares no band with chance 6e-4, one at 0.9 with chance 1e-6.
BANDS, ROWS = 14, 4
SHINGLE = 8
_BLANK = b" \t\v\f\r"


class Lines:
    """Lines of some rows that hold anything but white space, split at line feeds.

    ``low``: the trimmed, lower-cased lines; ``row`` and ``number`` in the row; ``raw``: bytes before trimming.
    """

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        low, edge = buf.tobytes().lower(), offs.tolist()  # bytes.lower() changes A-Z alone
        self.low, row, number, raw = [], [], [], []
        for r in range(len(edge) - 1):
            for i, x in enumerate(low[edge[r] : edge[r + 1]].split(b"\n")):
                if t := x.strip(_BLANK):
                    self.low.append(t)
                    row.append(r)
                    number.append(i)
                    raw.append(len(x))
        self.row, self.number, self.raw = np.array(row, np.int64), np.array(number, np.int64), np.array(raw, np.int64)

    def nodes(self) -> np.ndarray:
        """The first twelve bytes of each line's 128-bit XXH3: its name."""
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.low)), np.uint8).reshape(-1, 16)[:, :12]


def names(nodes: np.ndarray) -> pa.Array:
    raw, edge = np.ascontiguousarray(nodes), np.arange(len(nodes) + 1, dtype=np.int32) * 12
    return pa.Array.from_buffers(pa.binary(), len(nodes), [None, pa.py_buffer(edge), pa.py_buffer(raw)])


def ids(nodes: np.ndarray) -> np.ndarray:
    """The first eight bytes of names, by which candidates are sought."""
    return np.ascontiguousarray(nodes[:, :8]).view(">i8").reshape(-1).astype(np.int64)


def characters(low: list[bytes]) -> np.ndarray:
    """How many characters each text has."""
    edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), dtype=np.int64, count=len(low)))])
    heads = (np.frombuffer(b"".join(low), dtype=np.uint8) & 0xC0) != 0x80
    return np.diff(np.concatenate([[0], np.cumsum(heads)])[edge])


def shingles(low: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` characters of each line, and each line's first one."""
    size = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
    flat = b"".join(low)
    raw = np.frombuffer(flat + bytes(8 + 4 * k), dtype=np.uint8)
    edge = np.concatenate([[0], np.cumsum(size)])
    char = np.flatnonzero((raw[: len(flat)] & 0xC0) != 0x80)
    c = np.searchsorted(char, edge)
    count = np.maximum(np.diff(c) - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    src = np.arange(first[-1]) + np.repeat(c[:-1] - first[:-1], count)
    char = np.append(char, len(flat))
    start, length = char[src], char[src + k]
    length -= start
    words = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    out = _word(words, start, length, 0)
    for at in range(8, 4 * k, 8):  # a character has up to four bytes
        more = np.flatnonzero(length > at)
        if not len(more):
            break
        out[more] = out[more] * K.U64(0xA0761D6478BD642F) + _word(words, start[more], length[more], at)
    return K.mix(out), first


def _word(words: np.ndarray, start: np.ndarray, length: np.ndarray, at: int) -> np.ndarray:
    """The eight bytes at ``at`` of each byte range, zero beyond its end."""
    out = words[start + at] if at else words[start]
    short = np.flatnonzero(length < at + 8)
    if len(short):
        out[short] &= (K.U64(1) << (8 * (length[short] - at)).astype(K.U64)) - K.U64(1)
    return out


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, buf, offs in K.chunks(*K.text_buffers(b["text"])):
            x = Lines(buf, offs)
            if x.low:
                trimmed = np.fromiter(map(len, x.low), dtype=np.int64, count=len(x.low))
                chars = characters(x.low) + x.raw - trimmed  # white space at the ends is ASCII
                doc = b["doc_id"].slice(lo, hi - lo).take(pa.array(x.row))
                yield pa.RecordBatch.from_arrays([doc, pa.array(x.number, pa.int32()), pa.array(chars, pa.int32()), names(x.nodes())], names=["doc_id", "line", "chars", "h"])


def _deal(hasher: MinHasher, shingle: int, slots: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        dealer = B.Dealer(hasher.bands, slots, num, den)
        for b in batches:
            for _, _, buf, offs in K.chunks(*K.text_buffers(b["text"])):
                x = Lines(buf, offs)
                x.low = list(set(x.low))
                if not x.low:
                    continue
                hashes, first = shingles(x.low, shingle)
                some = first[1:] > first[:-1]  # a line without shingles is linked by its hash alone
                keys = hasher.band_keys(hasher.signatures(hashes, np.append(first[:-1][some], first[-1])))
                dealer.add(keys, ids(x.nodes())[some], np.diff(first)[some])
                if dealer.full():
                    yield from map(pa.RecordBatch.from_pydict, dealer.flush())
        yield from map(pa.RecordBatch.from_pydict, dealer.flush())

    return run


def _expand(shingle: int):
    def run(items: pa.Array) -> Sets:
        """Shingles of trimmed, lower-cased lines, one line a row."""
        return shingles(items.to_pylist(), shingle)

    return run


def _texts(held):
    """Texts of wanted lines, each once a chunk of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offs in K.chunks(*K.text_buffers(b["text"])):
                x = Lines(buf, offs)
                if not x.low:
                    continue
                x.low = list(set(x.low))
                nodes = x.nodes()
                own = ids(nodes)
                at = np.flatnonzero(held.value.has(own))
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), names(nodes[at]), pa.array([x.low[i] for i in at], pa.binary())], names=["id", "node", "items"])

    return run


def repeated_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = 80, den: int = 100) -> DataFrame:
    """Occurrences to remove: ``doc_id, line (from 0), chars, class_id, keep_doc, keep_line``.

    Blank lines take no part. Lines shorter than a shingle are linked to exact copies. Others are linked if ``den * |A & B| >=
    num * |A | B|``; lines and texts of any length are compared whole. Ties do not arise: an
    occurrence is one (doc_id, line). A null or empty text, and an empty table, have no lines; a
    null id takes no part. Rows that share an id count as one document. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    hasher = MinHasher(BANDS, ROWS, seed=29)
    slots = B.n_slots(docs, BANDS, tasks(docs.sparkSession))
    lines = scratch.write(docs.mapInArrow(_occurrences, "doc_id long, line int, chars int, h binary"), "lines")
    multi = scratch.write(B.collisions(docs.select("text").mapInArrow(_deal(hasher, shingle, slots, num, den), B.SCHEMA), BANDS, slots, num, den), "multi")
    scratch.free()
    pairs, members = scratch.write(B.pairs(multi), "pairs"), scratch.write(B.members(multi), "members")
    wanted = scratch.write(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).union(members.select("id")).distinct(), "wanted")
    held = docs.sparkSession.sparkContext.broadcast(build(wanted, "id"))
    texts = scratch.write(docs.select("text").mapInArrow(_texts(held), "id long, node binary, items binary").dropDuplicates(["node"]), "texts")
    label = SetLinks(scratch, "binary", num, den, lambda by, keys: texts, expand=_expand(shingle), nodes=texts.select("id", "node")).classes(pairs, members)
    scratch.drop(multi, pairs, members, wanted, texts)
    scratch.free()

    once = lines.groupBy("h").agg(F.min(F.struct("doc_id", "line")).alias("k"), F.count("*").alias("m"))
    # The smallest line of a class has no row in ``label``. Lines that occur once and are like no other, most of them, end here.
    named = label.select("node", "component").union(label.select(F.col("component").alias("node"), "component").distinct())
    found = once.join(named, F.col("h") == F.col("node"), "left").where("m > 1 or component is not null")
    repeats = scratch.write(found.select("h", F.coalesce("component", "h").alias("c"), "k", "m"), "repeated-lines")
    keep = repeats.groupBy("c").agg(F.min("k").alias("k")).select("c", F.col("k.doc_id").alias("keep_doc"), F.col("k.line").alias("keep_line"))
    gone = repeats.join(keep, "c").where("m > 1 or k.doc_id <> keep_doc or k.line <> keep_line").select("h", F.col("c").alias("class_id"), "keep_doc", "keep_line")
    out = lines.join(gone, "h").where("doc_id <> keep_doc or line <> keep_line")
    return out.select("doc_id", "line", "chars", "class_id", "keep_doc", "keep_line")


def without_lines(text: str, gone: set[int]) -> str:
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def _strip(text_col: str, drop_emptied: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts, gone = b.column(at), b.column(b.num_columns - 1)
            hit = np.flatnonzero(np.asarray(gone.is_valid()))
            cols = b.columns[:-1]
            if len(hit):
                new = texts.to_pylist()
                for i in hit:
                    new[i] = without_lines(new[i], set(gone[i].as_py()))
                cols[at] = pa.array(new, texts.type)
                if drop_emptied:
                    keep = np.ones(b.num_rows, dtype=bool)
                    keep[[i for i in hit if not new[i].strip()]] = False
                    cols = [c.filter(pa.array(keep)) for c in cols]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return run


def remove_lines(docs: DataFrame, repeated: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True) -> DataFrame:
    """``docs`` with the given occurrences taken out of their texts, all columns kept.

    A document left with white space alone is dropped if ``drop_emptied``: all it held is elsewhere.
    """
    doc, lines = (f"_{c}_{uuid.uuid4().hex}" for c in ("doc", "lines"))  # no column of the user's has these names
    gone = repeated.groupBy("doc_id").agg(F.collect_set("line").alias(lines)).select(F.col("doc_id").alias(doc), lines)
    joined = docs.join(gone, docs[id_col] == gone[doc], "left").drop(doc)
    return joined.mapInArrow(_strip(text_col, drop_emptied), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: a row for each row of documents: its lines, those that go, and the length of what stays of it. Rows that share an id lose the same lines, as far as they have them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gone = repeated_lines(docs, Scratch(spark, "op4")).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    own = docs.select("doc_id", F.transform(F.split("text", "\n"), F.length).alias("chars"))
    none = F.array().cast("array<int>")
    removed = F.filter(F.coalesce("gone", none), lambda i: i < F.size("chars"))
    out = own.join(gone, "doc_id", "left").withColumn("removed_lines", removed)
    total = F.aggregate("chars", F.lit(-1).cast("long"), lambda n, c: n + c + 1)
    cut = F.aggregate("removed_lines", F.lit(0).cast("long"), lambda n, i: n + F.get("chars", i) + 1)
    return out.select("doc_id", F.size("chars").cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", F.greatest(F.lit(0), total - cut).alias("kept_chars"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first of each class of near-equal lines, by (doc_id, line number); all columns stay.

    A document that loses all its text goes. A null id or text, and an empty text, stay as they are. Rows that
    share an id lose the same lines; an empty table stays empty.
    """
    return remove_lines(docs, repeated_lines(docs, Scratch(spark, "stage-lines")))
