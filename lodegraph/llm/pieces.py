"""SentencePiece ids of whole texts for merge-type (BPE) vocabularies, and texts from ids.

A text is a row of symbols, one a code point, with a mark (U+2581) for every space and one before the
first. An agenda holds the adjacent pairs that make a piece; the pair of the best score, of equals the
leftmost, is merged, which brings up to two new pairs, until none is left. A symbol that is no piece
becomes the pieces of its UTF-8 bytes.

No piece of such a vocabulary holds a mark after another character (checked when it is read), so no merge
crosses the place before a run of marks; nor does one cross the end of letters where no piece does, or take in a
character that no longer piece holds. Texts are cut there, the agenda of each distinct stretch runs once a worker generation, and ids of a text are those of its
stretches. Every stretch that the agenda
has dealt with is compared with the sentencepiece library before its ids are used, all those of an Arrow batch at
once, and so are the decoded texts of every batch; a difference is an error.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice
from math import inf

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.runtime import ship, table
from lodegraph.llm.tokens import slices

MARK = "▁"
#: Kinds of pieces, and the fields of the model's messages that are read (fixed values of the public format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
MODEL_TYPE, BPE, SUFFIX_MARKS, BYTE_FALLBACK, UNKNOWN_TEXT = 3, 2, 24, 35, 44
CHARS_MAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
#: Stretches a cache generation, and stretches of one text held at a time.
CACHE, RUN = 250_000, 1 << 18
#: Symbols up to which a list serves as agenda, and bytes of text encoded together.
SHORT, TOGETHER = 24, 2 << 20
#: Latin, Greek and Cyrillic letters.
LETTER = "[A-Za-z\u00c0-\u024f\u0370-\u04ff]"
UNKNOWN_SURFACE = " ⁇ "

codecs.register_error("one_each", lambda e: ("�", e.start + 1))


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of an encoded message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[i : i + n]
            i += n


class Vocabulary:
    """Pieces, scores and settings of a model file. Other than merge-type models, and those with character maps or marks at word ends, are refused."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        trainer, normal = (dict(chain.from_iterable(_fields(v) for k, v in parts if k == part)) for part in (TRAINER, NORMALIZER))
        if trainer.get(MODEL_TYPE, 1) != BPE or trainer.get(SUFFIX_MARKS, 0) or normal.get(CHARS_MAP, b"") or not normal.get(ESCAPE_SPACES, 1) or normal.get(EXTRA_SPACES, 1) or not trainer.get(BYTE_FALLBACK, 0):
            raise ValueError(f"{path}: only merge-type vocabularies with all bytes, over texts as they are, with marks before words and all white space kept")
        self.prefix = bool(normal.get(DUMMY_PREFIX, 1))
        self.names, self.kinds, self.scores = [], [], []
        for _, v in (p for p in parts if p[0] == PIECES):
            piece = dict(_fields(v))
            self.names.append(piece[1].decode())
            self.scores.append(struct.unpack("<f", piece[2])[0])
            self.kinds.append(piece.get(3, NORMAL))
        if USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError(f"{path}: user-defined and unused pieces are not merged by score")
        self.merged = {s: i for i, (s, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == NORMAL}
        if any(MARK in s.lstrip(MARK) for s in self.merged):
            raise ValueError(f"{path}: a piece goes on over a mark")
        self.cost = {s: -self.scores[i] for s, i in self.merged.items()}
        inside = {c for s in self.merged if len(s) > 1 for c in s}
        #: ASCII characters that are merged with nothing; each is a stretch of its own.
        self.alone = "".join(c for c in map(chr, range(128)) if c not in inside and c != " ")
        lone = re.escape(self.alone)
        # Stretches with a text's spaces as they are: a run of spaces (or marks) and what follows it, up to the end of
        # letters where no piece goes on from a letter to anything else.
        rest = f"[^ {MARK}{lone}]"
        if not any(re.search(f"{LETTER}(?!{LETTER}).", s, re.DOTALL) for s in self.merged):
            rest = f"(?:{LETTER}+|(?:(?!{LETTER}){rest})+{LETTER}*)"
        else:
            rest += "+"
        self.stretch = re.compile(f"[ {MARK}]*{rest}|[ {MARK}]+" + (f"|[{lone}]" if lone else ""))
        controls = {s: i for i, (s, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == CONTROL}
        self.begin, self.end = controls["<s>"], controls["</s>"]
        self.bytes = {int(s[1:-1], 16): i for i, (s, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.is_byte = np.array([k == BYTE for k in self.kinds])
        surface = trainer.get(UNKNOWN_TEXT)
        unknown_text = surface.decode() if surface is not None else UNKNOWN_SURFACE
        self.texts = ["" if k == CONTROL else unknown_text if k == UNKNOWN else s.replace(MARK, " ") for s, k in zip(self.names, self.kinds, strict=True)]

    def agenda(self, part: str) -> list[int]:
        """Ids of symbols merged by score; ``part`` has its marks already. The agenda of a short part is a list, that of a long one a heap."""
        symbols = self._listed(part) if len(part) <= SHORT else self._heaped(part)
        out: list[int] = []
        for s in symbols:
            found = self.merged.get(s)
            if found is None:
                out += map(self.bytes.__getitem__, s.encode())
            else:
                out.append(found)
        return out

    def _listed(self, part: str) -> list[str]:
        symbol, cost = list(part), self.cost.get
        agenda = [cost(part[i : i + 2], inf) for i in range(len(part) - 1)]
        while agenda and (best := min(agenda)) < inf:
            i = agenda.index(best)
            symbol[i] += symbol.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(symbol[i] + symbol[i + 1], inf)
            if i:
                agenda[i - 1] = cost(symbol[i - 1] + symbol[i], inf)
        return symbol

    def _heaped(self, part: str) -> list[str]:
        symbol, n, cost = list(part), len(part), self.cost.get
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        agenda = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost(part[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            one, two = symbol[left], symbol[right]
            # A pair whose ends have been merged with others since is no longer there.
            if not one or not two or len(one) + len(two) != size:
                continue
            symbol[left] = one = one + two
            symbol[right] = ""
            after[left] = nxt = after[right]
            if nxt >= 0:
                before[nxt] = left
                if (c := cost(one + symbol[nxt])) is not None:
                    heapq.heappush(agenda, (c, left, nxt, size + len(symbol[nxt])))
            prev = before[left]
            if prev >= 0 and (c := cost(symbol[prev] + one)) is not None:
                heapq.heappush(agenda, (c, prev, left, size + len(symbol[prev])))
        return [s for s in symbol if s]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: marks are spaces (the first one of the text is left out if it was put there), bytes are read together, each wrong one U+FFFD."""
        texts = self.texts
        some = self.is_byte[ids]
        if not some.any():
            listed = ids.tolist()
            parts = [texts[i] for i in listed]
            return self._opened(listed, parts)
        out, listed = [], []
        edge = [0, *(np.flatnonzero(some[1:] != some[:-1]) + 1).tolist(), len(ids)]
        for lo, hi in zip(edge, edge[1:], strict=False):
            run = ids[lo:hi].tolist()
            if some[lo]:
                out.append(bytes(map(self.byte_of.__getitem__, run)).decode("utf-8", "one_each"))
                listed.append(-1)
            else:
                out += [texts[i] for i in run]
                listed += run
        return self._opened(listed, out)

    def _opened(self, ids: list[int], parts: list[str]) -> str:
        if self.prefix:
            for i, part in enumerate(parts):
                if part:
                    if ids[i] >= 0 and self.kinds[ids[i]] == NORMAL and part[0] == " ":
                        parts[i] = part[1:]
                    break
        return "".join(parts)


class Codec:
    """A vocabulary, the library that it is checked against, and the ids of stretches met lately."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.vocabulary = Vocabulary(path)
        self.library = SentencePieceProcessor(model_file=path)
        self.before = (self.vocabulary.alone + "\ue000")[0]
        self.before_ids = self.library.encode(self.before)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, stretches: set[str]) -> None:
        """Run the agenda over stretches that are not known, and hold it against the library."""
        fresh = []
        for s in stretches:
            if s in self.old:
                self.young[s] = self.old[s]
            else:
                fresh.append(s)
        if not fresh:
            return
        found = [self.vocabulary.agenda(s.replace(" ", MARK)) for s in fresh]
        # Read behind a character that merges with nothing, as the library puts a mark before what it is given.
        wanted = self.library.encode([self.before + s for s in fresh], num_threads=1)
        for s, ids, want in zip(fresh, found, wanted, strict=True):
            if self.before_ids + ids != want:
                raise ValueError(f"the agenda's ids of {s[:80]!r} are not the library's")
            self.young[s] = array("I", ids).tobytes()

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of each list of stretches."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        known = self.young
        if missing := {s for t in texts for s in t if s not in known}:
            self.learn(missing)
        return [b"".join(map(known.__getitem__, t)) for t in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, with begin and end, as little-endian unsigned 32-bit integers."""
        words = self.vocabulary
        begin, end = (array("I", [i]).tobytes() for i in (words.begin, words.end))
        opened = [" " + t if t and words.prefix else t for t in texts]
        found = iter(self.ids([words.stretch.findall(t) for t in opened if len(t) <= RUN]))
        out = []
        for t in opened:
            if len(t) <= RUN:
                out.append(begin + next(found) + end)
            else:
                stretches = (m.group() for m in words.stretch.finditer(t))
                out.append(b"".join([begin, *(self.ids([run])[0] for run in iter(lambda: list(islice(stretches, RUN)), [])), end]))  # noqa: B023
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids, held against the library's."""
        texts = [self.vocabulary.decode(i) for i in ids]
        wanted = self.library.decode([i.tolist() for i in ids], num_threads=1) if ids else []
        if texts != wanted:
            at = next(i for i, (a, b) in enumerate(zip(texts, wanted, strict=True)) if a != b)
            raise ValueError(f"the decoded text {texts[at][:80]!r} is not the library's {wanted[at][:80]!r}")
        return texts


@lru_cache(2)
def codec(path: str) -> Codec:
    """This process's codec; its cache lives as long as the Python worker."""
    return Codec(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for lo, hi in slices(b["text"], TOGETHER):
                ids = own.encode(["" if t is None else t for t in b["text"][lo:hi].to_pylist()])
                yield pa.RecordBatch.from_arrays([b["doc_id"][lo:hi], pa.array([len(i) >> 2 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _decode(path: str, ids_col: str, rest: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for lo, hi in slices(b[ids_col], 4 * TOGETHER):
                texts = own.decode([np.frombuffer(i or b"", dtype="<u4") for i in b[ids_col][lo:hi].to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b[c][lo:hi] for c in rest), pa.array(texts, pa.string())], names=[*rest, "decoded"])

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids``: every row's whole text between the begin and end ids.

    ``ids`` are little-endian unsigned 32-bit integers; `as_array` makes an array of them. A null text counts as
    empty and is its two ends; texts of any length are taken whole, spaces and all. Rows are taken one by one, so repeated rows
    and null ids come out as they went in; no rows give no rows. Other columns, whatever their names, are not read.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_encode(model), f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with the text of its ids as column ``decoded`` (a column of that name is replaced); null ids count as none."""
    ship(encoded.sparkSession)
    rest = [c for c in encoded.columns if c != "decoded"]
    encoded = encoded.select(*(F.col(f"`{c}`") for c in rest))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), "decoded string"])
    return encoded.mapInArrow(_decode(model, ids_col, rest), schema)


def as_array(ids: str) -> Column:
    """An array of the ids that a binary column holds."""
    n = (F.octet_length(ids) / 4).cast("int")
    byte = lambda at: F.conv(F.hex(F.substring(F.col(ids), at, F.lit(1))), 16, 10).cast("long")
    places = F.when(n > 0, F.sequence(F.lit(1), n * 4, F.lit(4))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda at: byte(at) + byte(at + 1) * 256 + byte(at + 2) * 65536 + byte(at + 3) * 16777216)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: digests of the ids and of the decoded text of every document."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(encode(table(spark, sf_dir, "documents"), model), model)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", "n_tokens", digest("ids").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))
