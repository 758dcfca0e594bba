"""Token ids of whole texts by the tokenizers library, each distinct stretch encoded once.

A text is split only where the tokenizer's own pre-tokenizer always splits, so the ids of
the stretches, put together, are the ids of the text:

* ``drops_space`` tokenizers (white space is a separator and is dropped): at ASCII white space;
* byte-level tokenizers (a word owns the one space before it): before a space that is
  followed by a character other than white space.

A text that holds one of the tokenizer's added tokens is encoded in one go, as the tokenizer
takes those out before it splits anything.

Stretches repeat heavily, so a two-generation cache of bounded size holds their ids.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_INNER = re.compile(r" (?=\S)")
#: White space at the front, by any rule: ASCII, the separators of ASCII, Unicode.
_ODD = r"^(?:[\x09-\x0d\x1c-\x20\x{85}]|\p{Z})"
#: Stretches a generation; about 220 bytes each, and workers keep two generations for later tasks.
CACHE = 200_000


class Encoder:
    def __init__(self, path: str, drops_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        #: An added token that is looked for in normalised text can hide anywhere.
        self.hidden = any(t.normalized for t in added)
        self.caches: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {"": ({}, {}), " ": ({}, {})}

    def _ids(self, names: list[str], before: str) -> list[bytes]:
        """Ids of ``before + name`` for each name."""
        young, old = self.caches[before]
        out = list(map(young.get, names))
        lacking = [i for i, x in enumerate(out) if x is None] if None in out else []
        missing = []
        for i in lacking:
            k = names[i]
            if (x := old.get(k)) is None:
                missing.append(i)
            else:
                out[i] = young[k] = x
        if missing:
            for i, e in zip(missing, self.tokenizer.encode_batch_fast([before + names[i] for i in missing], add_special_tokens=False), strict=True):
                out[i] = young[names[i]] = array("I", e.ids).tobytes()
        if len(young) > CACHE:
            self.caches[before] = ({}, young)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and each row's first one, with the total at the end. A null counts as empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        lists = pc.ascii_split_whitespace(texts) if self.drops_space else pc.split_pattern(texts, " ")
        bounds = np.asarray(lists.offsets).astype(np.int64)
        bounds = bounds - bounds[0]
        words = lists.flatten().dictionary_encode()
        code, names = np.asarray(words.indices).astype(np.int64), words.dictionary.to_pylist()
        whole = np.full(len(texts), self.hidden)
        for t in self.added:
            whole |= np.asarray(pc.match_substring(texts, t))
        if self.drops_space:
            parts = self._ids(names, "")
            return self._mixed(texts, code, parts, bounds, set(), whole) if whole.any() else self._join(code, parts, bounds)
        # A row's first stretch has no space before it.
        opens = bounds[:-1]
        heads, own = np.unique(code[opens], return_inverse=True)
        odd = np.asarray(pc.or_(pc.equal(pc.binary_length(words.dictionary), 0), pc.match_substring_regex(words.dictionary, _ODD)))
        late = odd[code]
        late[opens] = False
        rows = np.unique(np.searchsorted(bounds, np.flatnonzero(late), "right") - 1)
        code[opens] = len(names) + own
        parts = self._ids(names, " ") + self._ids([names[i] for i in heads], "")
        return self._mixed(texts, code, parts, bounds, set(rows.tolist()), whole) if len(rows) or whole.any() else self._join(code, parts, bounds)

    @staticmethod
    def _join(code: np.ndarray, parts: list[bytes], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) >> 2
        begin = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(b"".join(parts), dtype="<u4")
        n = size[code]
        total = np.concatenate([[0], np.cumsum(n)])
        src = np.arange(total[-1])
        src += np.repeat(begin[:-1][code] - total[:-1], n)
        return flat[src], total[bounds]

    def _mixed(self, texts: pa.Array, code: np.ndarray, parts: list[bytes], bounds: np.ndarray, odd: set[int], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_join``, but ``whole`` rows are encoded in one go, and ``odd`` ones (runs of spaces or other odd white space) split by the full rule."""
        more, codes, edge = list(parts), [], [0]
        for r in range(len(texts)):
            if whole[r]:
                codes.append(np.array([len(more)]))
                more.append(array("I", self.tokenizer.encode(texts[r].as_py(), add_special_tokens=False).ids).tobytes())
            elif r in odd:
                head, *tail = _INNER.split(texts[r].as_py())
                codes.append(np.arange(len(more), len(more) + 1 + len(tail)))
                more += self._ids([head], "") + self._ids(tail, " ")
            else:
                codes.append(code[bounds[r] : bounds[r + 1]])
            edge.append(edge[-1] + len(codes[-1]))
        return self._join(np.concatenate(codes), more, np.array(edge))


@lru_cache(4)
def encoder(path: str, drops_space: bool) -> Encoder:
    """This process's encoder; its cache lives as long as the Python worker."""
    return Encoder(path, drops_space)


def slices(texts: pa.Array, limit: int = 8 << 20):
    """Row ranges of at most ``limit`` bytes, or one longer row."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(texts):
        hi = min(max(int(np.searchsorted(edge, edge[lo] + limit, "right")) - 1, lo + 1), len(texts))
        yield lo, hi
        lo = hi
