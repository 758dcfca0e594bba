"""Spelling variants, SentencePiece and whitening against brute force and the library."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from lodegraph.llm import pieces, registry, spelling, whiten
from lodegraph.llm.runtime import Scratch
from tests.llm.test_llm import frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts(rng, n):
    words = ["hello", "hallo", "hell", "hellos", "world", "wörld", "worlds", "straße", "strasse", "ÀÉÎõ", "naïve", "naive", "naives", "aaaaa", "aaaaaa", "ab×cd÷"]
    words += ["naive"] * 16 + ["naives"] * 6 + ["naivesx"] * 2 + ["hello"] * 20 + ["hallo"] * 6 + ["hallos"] * 2
    return [" ".join(rng.choice(words).capitalize() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def variants(docs):
    """The contract read plainly, pair by pair."""
    count = {}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] = count.get(w, 0) + 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = [form[w], None, n[w], len(close), n[form[w]] if form[w] else None]
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out[w][1] = r
    return {w: tuple(v) for w, v in out.items()}


def test_spelling_variants(spark, tmp_path):
    rng = random.Random(2)
    docs = [(i if i else None, t) for i, t in enumerate(texts(rng, 300))] + [(900, None), (901, ""), (902, "x" * 70_000 + " hello " * 50_000), (5, "hello"), (5, "hello"), (903, "1 2 3 ??")]
    df = frame(spark, [t for _, t in docs], [i for i, _ in docs]).withColumns({c: F.lit(1) for c in ("word", "n", "key", "run", "h", "near", "root")})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in registry.QUERIES["op11_spelling_variants"](spark, str(tmp_path)).collect()}
    want = variants(docs)
    assert got == want and len(got) > 20
    assert any(r != w and f != r for w, (f, r, *_) in got.items())


def test_spelling_edges(spark):
    none = spelling.group_spellings(frame(spark, []), Scratch(spark, "t"))
    assert none.count() == 0 and none.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    words = spark.createDataFrame([("aaaa", 1), ("aaab", 2), ("aabb", 4), ("abbb", 8), ("bbbb", 16), ("bbbb", 16), (None, 5), ("zzzz", 3), ("zzzy", 3), ("zzyx", 3)], "word string, n long")
    got = {r["word"]: r for r in spelling.variants(words, Scratch(spark, "t")).collect()}
    assert got["aaaa"]["root"] == "bbbb" and got["abbb"]["form"] == "bbbb" and got["bbbb"]["n"] == 32
    assert got["zzzz"]["form"] is None and got["zzzz"]["n_near"] == 1 and got["zzyx"]["n_near"] == 0 and set(got) == {"aaaa", "aaab", "aabb", "abbb", "bbbb", "zzzz", "zzzy", "zzyx"}


def test_pieces_against_the_library(spark, tmp_path):
    rng = random.Random(4)
    alphabet = "ab  ▁▁étñ漢🙂\x00\n\t ﻿<s></s><0x41>inter1290.,()"
    own = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    own += [None, "", " ", "▁", "  x  ", "the same row", "the same row", "a" * 5000, "word and 123 more. " * 40_000, "漢字" * 400]
    ids = [*range(len(own) - 1), None]
    df = frame(spark, own, ids).withColumns({c: F.lit("x") for c in ("ids", "decoded", "n_tokens")})
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    library = SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t in zip(ids, own, strict=True):
        found = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((str(i), len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(found).encode()).hexdigest()))
    got = [(str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.QUERIES["op12_sentencepiece"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_pieces_decode_any_ids_and_agendas_agree():
    rng = random.Random(6)
    codec = pieces.codec(MODEL)
    codec.decode([np.array([rng.choice([rng.randrange(32000), rng.randrange(300)]) for _ in range(rng.randrange(30))], dtype="<u4") for _ in range(2000)])
    for _ in range(300):
        part = "▁" * rng.randrange(3) + "".join(rng.choice("inter nationalé'(=".replace(" ", "")) for _ in range(rng.randrange(1, 40)))
        assert codec.vocabulary._listed(part) == codec.vocabulary._heaped(part)


def test_pieces_refuse_what_they_do_not_do(tmp_path):
    with pytest.raises(ValueError, match="merge-type"):
        (tmp_path / "m").write_bytes(b"\x12\x02\x18\x01")  # a model of another type
        pieces.Vocabulary(str(tmp_path / "m"))


def test_pieces_on_no_rows_and_arrays(spark):
    assert pieces.decode(pieces.encode(frame(spark, []), MODEL), MODEL).count() == 0
    row = pieces.encode(frame(spark, ["hello 漢"], [1]), MODEL).select(pieces.as_array("ids").alias("a")).first()
    assert row["a"] == SentencePieceProcessor(model_file=MODEL).encode("hello 漢", add_bos=True, add_eos=True)


def brute(vectors):
    """Whitened components by LAPACK, from the contract."""
    x = np.floor(np.array(vectors, dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    e, q = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    return x, n, sums, e[::-1], q[:, ::-1]


def test_whitening(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((400, 24)) @ rng.standard_normal((24, 24))).astype(np.float32).astype(float).tolist()
    rows = [(i, r, 0) for i, r in enumerate(v)] + [(i, v[5], 0) for i in range(1000, 1300)]
    odd = [(None, v[3], 0), (2000, None, 0), (2001, [*v[0][:23], None], 0), (2002, [*v[0][:23], float("nan")], 0), (2003, [*v[0][:23], float("inf")], 0), (2004, v[0][:5], 0), (2005, [], 0), (2006, [1e300, *v[0][1:]], 0)]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["op13_whitening"](spark, str(tmp_path)).toPandas()
    x, n, sums, e, q = brute(v)
    assert len(got) == 16 * (len(rows) + 1) and set(got["n"]) == {400} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    by_id = {**{i: x[i] for i in range(400)}, **{i: x[5] for i in range(1000, 1300)}}
    for k in range(16):
        part = got[(got["component"] == k + 1) & got["vec_id"].notna()].sort_values("vec_id")
        z = np.array([(by_id[int(i)] - sums / n) @ q[:, k] / np.sqrt(e[k]) for i in part["vec_id"]])
        assert min(np.abs(part["whitened"] - z).max(), np.abs(part["whitened"] + z).max()) < 1e-7
        assert np.allclose(part["explained"], e[k] / e.sum(), rtol=1e-9)
        assert [int(d) for d in part["deviation"]] == [int(((n * by_id[int(i)] - sums) ** 2).sum()) for i in part["vec_id"]]


def test_whitening_edges(spark):
    make = lambda rows: whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), Scratch(spark, "t"))
    assert make([]).count() == 0 and make([(1, None)]).count() == 0 and make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0
    flat = make([(i, [float(i), 3.0, 2.0 * i]) for i in range(9)]).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 9 and abs(flat[0]["explained"] - 1) < 1e-12
    wide = make([(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 5.0])]).where("component = 1").collect()
    assert all(r["deviation"] is None or r["deviation"] > 0 for r in wide) and any(r["deviation"] is None for r in wide)


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_symmetric_eigen(d):
    rng = np.random.default_rng(d)
    for a in (rng.standard_normal((d, d)), np.diag(np.arange(d) % 3.0), np.zeros((d, d)), np.ones((d, d))):
        a = (a + a.T) / 2
        e, q = whiten.symmetric_eigen(a)
        scale = max(np.abs(a).max(), 1)
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * scale * d) and np.allclose(a @ q, q * e, atol=1e-12 * scale * d) and np.allclose(q.T @ q, np.eye(d), atol=1e-12)


def test_moments_merge_as_one():
    x = np.random.default_rng(5).integers(-500, 500, (1000, 7)) + whiten.SHIFT
    whole, parts = whiten.Moments.of(7), [whiten.Moments.of(7) for _ in range(4)]
    whole.take(x)
    for m, rows in zip(parts, np.array_split(x, [3, 400, 401]), strict=True):
        m.take(rows)
    for m in parts[1:]:
        parts[0].merge(m)
    assert parts[0].n == whole.n == 1000 and list(parts[0].sums) == list(whole.sums) == x.sum(axis=0).tolist()
    assert np.allclose(parts[0].covariance(), np.cov(x.T, bias=True), rtol=1e-11) and np.allclose(whole.covariance(), parts[0].covariance(), rtol=1e-12)
