"""Operators against brute force, and the edge cases every one of them defines."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodegraph.llm import ann, bloom, buckets, crc32c, decontaminate, langid, licenses, line_dedup, near_dup, packing, quality, records, toxicity
from lodegraph.llm import textkernel as K
from lodegraph.llm.components import components
from lodegraph.llm.minhash import MinHasher, posterior_floor
from lodegraph.llm.runtime import Scratch
from lodegraph.llm.tokens import Encoder, encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in zip(ids, texts, strict=True)], DOCS)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def odd_texts(rng):
    return [None, "", "  \n\t ", "one", "!!! ...", sentence(rng, 60) * 40, "x" * 5000, "日本語 テキスト", "\x00\x01 a", "a\nb\n\n"]


@pytest.fixture
def corpus(spark):
    """Exact copies, near copies at many distances, a shared passage, repeated and odd rows."""
    rng = random.Random(3)
    texts = [sentence(rng, rng.randrange(5, 80)) for _ in range(40)]
    base = sentence(rng, 50).split(" ")
    for k in range(25):
        own = list(base)
        for _ in range(k % 9):
            own[rng.randrange(50)] = f"edit{rng.randrange(1000)}"
        texts.append(" ".join(own))
    shared = sentence(rng, 30)
    texts += [shared + " " + sentence(rng, rng.randrange(3, 30)) for _ in range(20)]
    return texts + texts[:8] + odd_texts(rng)


def unions(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = sorted((top(a), top(b)))
        up[q] = p
    return [top(i) for i in range(n)]


def word_set(text, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def alike(a, b):
    n = len(a & b)
    return n and 100 * n >= 80 * (len(a) + len(b) - n)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, corpus, k):
    sets = [word_set(t, k) for t in corpus]
    want = unions(len(sets), [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if alike(sets[i], sets[j])])
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(frame(spark, corpus).repartition(3), Scratch(spark, "t"), shingle=k).collect()}
    assert [got[i]["component_id"] for i in range(len(corpus))] == want
    assert [got[i]["n_shingles"] for i in range(len(corpus))] == [len(s) for s in sets]
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got.values())


def test_near_duplicates_by_prefix_filter(spark):
    """Large buckets of texts that share much but not enough: the exact join must still find the few links."""
    rng = random.Random(9)
    common = sentence(rng, 60)
    texts = [f"{common} {sentence(rng, 22)}" for _ in range(60)]
    texts += [texts[50].rsplit(" ", 3)[0] + " p q r", texts[51].rsplit(" ", 2)[0] + " s t"]
    sets = [word_set(t, 2) for t in texts]
    want = unions(len(sets), [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if alike(sets[i], sets[j])])
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, texts), Scratch(spark, "t"), shingle=2).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_duplicates_edges(spark):
    df = frame(spark, ["a b c", "a b c", "a b c", None], [5, None, 3, 9]).withColumn("component_id", F.lit(1)).withColumn("kept", F.lit("x"))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df, Scratch(spark, "t")).collect()), key=str)
    assert got == [(3, 3, True), (5, 3, False), (9, 9, True), (None, None, True)]
    assert near_dup.near_duplicates(frame(spark, []), Scratch(spark, "t")).count() == 0
    twice = frame(spark, ["a b c d", "a b c d"], [1, 1])
    assert [r["component_id"] for r in near_dup.near_duplicates(twice, Scratch(spark, "t")).collect()] == [1, 1]


def test_posterior_floor_is_monotone():
    floors = posterior_floor(160, 32, 0.8, 1e-6)
    assert [n for n, _ in floors] == [32, 64, 96, 128, 160] and all(m < 0.8 * n for n, m in floors)
    assert [m / n for n, m in floors] == sorted(m / n for n, m in floors)
    assert MinHasher(32, 5).miss(0.8) < 1e-5


def line_sets(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [(i, s.strip(" \t\r\v\f").translate(low)) for i, s in enumerate((text or "").split("\n"))]


def test_lines(spark, corpus):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        picked = [rng.choice(corpus[:90]) or "" for _ in range(rng.randrange(1, 5))]
        texts.append(rng.choice(["\n", "\n \n", " \n"]).join(p if rng.random() < 0.6 else p.replace("1", "2") for p in picked) + rng.choice(["", "\n"]))
    texts += odd_texts(rng)
    occ = [(d, i, s) for d, t in enumerate(texts) for i, s in line_sets(t) if s]
    names = sorted({s for *_, s in occ})
    sets = [{s[i : i + 8] for i in range(len(s) - 7)} or {s} for s in names]
    classes = unions(len(names), [(i, j) for i, j in itertools.combinations(range(len(names)), 2) if alike(sets[i], sets[j])])
    of = dict(zip(names, classes, strict=True))
    first, want = {}, set()
    for d, i, s in sorted(occ):
        if of[s] in first:
            want.add((d, i))
        first.setdefault(of[s], (d, i))
    docs = frame(spark, texts)
    found = line_dedup.repeated_lines(docs.repartition(3), Scratch(spark, "t"))
    assert {(r["doc_id"], r["line"]) for r in found.collect()} == want
    kept = {r["doc_id"]: r for r in line_dedup.remove_lines(docs, found).collect()}
    for d, t in enumerate(texts):
        stay = "\n".join(x for i, x in enumerate((t or "").split("\n")) if (d, i) not in want)
        touched = any(x[0] == d for x in want)
        assert (d not in kept) if touched and not stay.strip() else kept[d]["text"] == (stay if touched else t)
    assert line_dedup.repeated_lines(frame(spark, []), Scratch(spark, "t")).count() == 0


def test_short_lines(spark):
    """Lines of any length take part: near copies from one shingle on, exact copies below."""
    rng = random.Random(5)
    pool = ["a", "}", "é", "1234567", "12345678", "In in oredble ea.", "in IN oredble ea.", "In in oredble ea!"]
    pool += ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 20))) for _ in range(40)]
    pool += [p + rng.choice("xyz") for p in pool[-20:]]
    texts = ["\n".join(rng.choice(["", " ", *pool]) for _ in range(rng.randrange(1, 6))) for _ in range(80)] + ["\n", "", None]
    occ = [(d, i, s) for d, t in enumerate(texts) for i, s in line_sets(t) if s]
    names = sorted({s for *_, s in occ})
    sets = [{s[i : i + 8] for i in range(len(s) - 7)} or {s} for s in names]
    classes = unions(len(names), [(i, j) for i, j in itertools.combinations(range(len(names)), 2) if alike(sets[i], sets[j])])
    of = dict(zip(names, classes, strict=True))
    first, want = {}, set()
    for d, i, s in sorted(occ):
        if of[s] in first:
            want.add((d, i))
        first.setdefault(of[s], (d, i))
    assert any(len(s) < 8 and (d, i) in want for d, i, s in occ) and any(8 <= len(s) < 20 and (d, i) in want for d, i, s in occ)
    found = line_dedup.repeated_lines(frame(spark, texts).repartition(3), Scratch(spark, "t"))
    assert {(r["doc_id"], r["line"]) for r in found.collect()} == want
    assert line_dedup.repeated_lines(frame(spark, ["a", "b", "a"]), Scratch(spark, "t")).count() == 1


def rows_of(batches):
    return [r for b in batches for r in pa.RecordBatch.from_pydict(b).to_pylist()]


def test_hot_buckets_in_one_task():
    """A bucket beyond the bound lists all its members, pairs its pivots with them, and sends on its first ids alone."""
    dealer = buckets.Dealer(1, 2, 80, 100)
    dealer.add(np.full((200, 1), 7, dtype=np.uint32), np.arange(200), np.full(200, 30))
    out = rows_of(dealer.flush())
    p = buckets.PIVOTS
    assert sorted(r["x"] for r in out if r["key"] is not None) == list(range(200))
    assert {(r["x"], r["y"]) for r in out if r["y"] is not None} == {(i, j) for i in range(p) for j in range(i + 1, 200)}
    sent = [np.frombuffer(r["entries"], dtype=buckets.ENTRY) for r in out if r["entries"] is not None]
    assert [e["id"].tolist() for e in sent] == [list(range(9))]


def test_buckets_pair_their_pivots():
    rng = np.random.default_rng(4)
    ids, sizes = rng.integers(-(1 << 40), 1 << 40, 300), rng.integers(1, 60, 300)
    keys = rng.integers(0, 40, (300, 2)).astype(np.uint32)
    dealer = buckets.Dealer(2, 3, 80, 100)
    for at in (slice(0, 200), slice(100, 300)):  # some ids come twice
        dealer.add(keys[at], ids[at], sizes[at])
    sent = pa.Table.from_batches([pa.RecordBatch.from_pydict(b) for b in dealer.flush()]).to_batches()
    out = [r for b in buckets._gather(3, buckets.size_reach(80, 100))(iter(sent)) for r in b.to_pylist()]
    size, want, large = dict(zip(ids.tolist(), sizes.tolist(), strict=True)), set(), set()
    for band in range(2):
        for key in range(40):
            own = sorted(n for n, k in zip(ids.tolist(), keys[:, band], strict=True) if k == key)
            want |= {(own[i], own[j]) for i in range(len(own) if len(own) <= 8 else buckets.PIVOTS) for j in range(i + 1, len(own))}
            large |= {((band << 32) | key, n) for n in own if len(own) > 8}
    got = {(r["x"], r["y"]) for r in out if r["y"] is not None}
    assert got <= want and {(r["key"], r["x"]) for r in out if r["y"] is None} == large and large
    near = lambda x, y, t: min(size[x], size[y]) >= t * max(size[x], size[y])
    assert {(x, y) for x, y in want if near(x, y, 0.8)} <= got and all(near(x, y, 0.7) for x, y in got)


def test_lines_with_one_id(spark, monkeypatch):
    """Lines whose 64-bit ids collide are still told apart by name."""
    import lodegraph.llm.line_dedup as own

    rng = random.Random(3)
    base = [sentence(rng, 12) for _ in range(6)]
    texts = base + [b + " x" for b in base[:3]] + base[:2]
    plain = {(r["doc_id"], r["line"]) for r in own.repeated_lines(frame(spark, texts), Scratch(spark, "t")).collect()}
    links = own.SetLinks(Scratch(spark, "t"), "binary", 80, 100, None)
    pairs = spark.createDataFrame([(1, 1)], "x long, y long")
    sets = spark.createDataFrame([(1, b"a", base[0].encode()), (1, b"b", (base[0] + " x").encode()), (1, b"c", base[1].encode())], "id long, node binary, items binary")
    links.sets_of, links.expand = lambda by, keys: sets, own._expand(8)
    got = {frozenset((bytes(r["x"]), bytes(r["y"]))) for r in links._verify(pairs, "id").collect()}
    assert got == {frozenset((b"a", b"b"))} and plain == {(i, 0) for i in range(6, 11)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    want = unions(141, edges)
    assert all(got.get(i, i) == want[i] for i in range(141))
    # With a few edges a task several rounds of unions and star steps are needed.
    few = spark.createDataFrame(edges, "u long, v long").repartition(5)
    assert {r["node"]: r["component"] for r in components(few, Scratch(spark, "t"), per_task=12).collect()} == got
    name = lambda c: F.unhex(F.format_string("%024x", c))
    named = components(few.select(name("u").alias("u"), name("v").alias("v")), Scratch(spark, "t")).collect()
    assert {int.from_bytes(r["node"]): int.from_bytes(r["component"]) for r in named} == got
    assert components(few.limit(0), Scratch(spark, "t")).count() == 0


def test_bloom_has_no_false_negatives(spark):
    rng = random.Random(2)
    ids = [rng.getrandbits(62) - (1 << 61) for _ in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    b = bloom.build(df, "id")
    assert b.has(np.array(ids)).all() and b.has(np.arange(10_000)).mean() < 0.05
    # More ids than the largest size is meant for: it lets nearly all through, and still misses none.
    full = bloom.build(df, "id", max_bits=8)
    assert full.has(np.array(ids)).all() and full.has(np.arange(10_000)).mean() > 0.5


def windows_of(text, item, weight):
    """Best share of the item's weight in any window of its size: every window, every position."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    k = min(5, len(item))
    sets = lambda x: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    own = sets(item)
    total = sum(weight[s] for s in own)
    return max((sum(weight[s] for s in own & sets(w[lo : lo + len(item)])) / total for lo in range(max(1, len(w) - len(item) + 1))), default=0.0)


def test_decontamination(spark, monkeypatch):
    rng = random.Random(6)
    items = [sentence(rng, n) for n in (5, 8, 20, 35, 60)] + [None, "too short ones", "...", "word"]
    items += [" ".join([*items[3].split(" ")[:30], *sentence(rng, 5).split(" ")])]  # shares most of another
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    texts = []
    for k in range(90):
        w = sentence(rng, 40).split(" ")
        if k % 3 == 0:
            own = (items[rng.choice((0, 1, 2, 3, 4, 6, 9))] or "").split(" ")
            for _ in range(rng.randrange(3)):
                if len(own) > 20:
                    own[rng.randrange(len(own))] = "changed"
            if rng.random() < 0.3 and len(own) > 20:
                own = own[: -rng.randrange(1, 8)]
            w[10:10] = [x.upper() + rng.choice(["", ",", "!"]) for x in own]
        texts.append(" ".join(w))
    texts += odd_texts(rng) + [items[2], "one word here", "too  Short, ones"]
    sets = {i: re.findall("[a-z0-9]+", t) for i, t in enumerate(items) if t and re.findall("[a-z0-9]+", t)}
    runs = {i: {tuple(w[j : j + min(5, len(w))]) for j in range(len(w) - min(5, len(w)) + 1)} for i, w in sets.items()}
    df = {}
    for r in runs.values():
        for x in r:
            df[x] = df.get(x, 0) + 1
    weight = {x: math.log1p(len(runs) / n) for x, n in df.items()}
    best = {(d, i): windows_of(t, w, weight) for d, t in enumerate(texts) for i, w in sets.items()}
    docs = frame(spark, texts).repartition(3)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {k for k, v in best.items() if v >= 0.8 - 1e-12} and len(got) > 25
    assert {i for _, i in got} >= {6, 8} and all(got[k] <= best[k] + 1e-9 for k in got)
    found = {d for d, _ in got}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - found
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0
    # Many passes give the same.
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 1)
    assert len(list(decontaminate.indexes(bench))) == 9 and {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - found
    odd = spark.createDataFrame([(None, items[2], 1), (7, items[2], 2), (7, items[2], 3)], "doc_id long, text string, item_id int")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd, bench.where("item_id = 2")).where("doc_id is not null").collect()) == [(7, 2), (7, 2)]
    assert decontaminate.clean(odd, bench).count() == 0


def test_block_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 12)) for _ in range(80)]
    x = decontaminate.ItemIndex(list(range(80)), texts)
    for _ in range(100):
        window = np.packbits(np.unpackbits(x.prints[rng.integers(80)]) ^ (rng.random(128) < rng.random() * 0.4))
        want = np.flatnonzero(np.bitwise_count(x.prints ^ window).sum(axis=1) <= x.radius)
        assert x.probe(window).tolist() == want.tolist()


def test_multi_index_is_exact_within_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 65536, (500, 8)).astype(np.uint16)
    index = ann.MultiIndex(codes)
    for r in (0, 30, 50, 64, 128):
        q = codes[3] ^ np.uint16(5)
        assert index.within(q, r).tolist() == np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= r).tolist()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24)) * rng.random((1500, 1))
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0]), (5004, []), (5005, [None] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0"), k=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 1500, 50):
        s = x @ x[q]
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-s[i], i))[:10]
        own = sorted(got[q])
        assert [o[0] for o in own] == list(range(1, 11)) and all(abs(o[2] - s[o[1]]) < 1e-12 for o in own)
        hit += len({o[1] for o in own} & set(want))
    assert hit / 300 >= 0.9
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.search(few, few.where("vec_id = 4"), k=20).orderBy("rank").collect()] == [3, 2, 1, 0]
    # A table of a few rows goes through codes and index as any other.
    small = df.where("vec_id < 300").withColumn("score", F.lit("x")).withColumn("rank", F.lit(0))
    found = {}
    for r in ann.search(small.union(small.where("vec_id = 7")), small.where("vec_id % 50 = 0"), k=10).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = sum(len(set(found[q]) & set(sorted((i for i in range(300) if i != q), key=lambda i: (-(x[i] @ x[q]), i))[:10])) for q in range(0, 300, 50))
    assert hits >= 54 and all(len(v) == 10 for v in found.values())
    huge = spark.createDataFrame([(i, [1e200 * (i + 1), 1.0]) for i in range(3)] + [(9, [1.0, 2.0]), (10, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r["vec_id"] for r in ann.search(huge, huge, k=5).collect()} == {9, 10}
    assert ann.search(few.limit(0), few.limit(0)).count() == 0


TRICKY = ["  two  spaces", "end ", "a\n b", "\n \n x", "", "tab\t x \t y  ", "don't I'll <|endoftext|> x", "a  <|endoftext|>b", "<|startoftext|><|endoftext|>", "x <|endoftext|>\n y <|endoftex", "x\x1cy \x1c z", "  ", "été Ã é", None, " x", "a \x01 b", "日本語 🎉🎉 x", " a\xa0  b", "a\r\n b"]


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_token_ids_are_the_tokenizers(name, drops):
    rng = random.Random(8)
    texts = TRICKY + ["".join(rng.choice(" \n\t.,'aébC1€") for _ in range(rng.randrange(40))) for _ in range(400)]
    e = Encoder(public_tokenizers.path(name), drops)
    ids, first = e.encode(pa.array(texts))
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    want = [x.ids for x in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want


def test_crc32c():
    raw = np.random.default_rng(0).integers(0, 256, 3000).astype(np.uint8)
    assert crc32c.crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0, 9])).tolist() == [0xE3069283]
    edges = np.array([0, 0, 1, 64, 65, 200, 2999])

    def plain(x):
        c = 0xFFFFFFFF
        for v in x.tolist():
            c ^= v
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert crc32c.crc32c(raw, edges).tolist() == [plain(raw[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def test_records_round_trip(spark, corpus, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    corpus = [*corpus, "a <|endoftext|> b"]
    ids = [3 * i - 50 for i in range(len(corpus))]
    random.Random(0).shuffle(ids)
    folder = f"file://{tmp_path}/rec"
    shards = records.write(frame(spark, corpus, ids), folder, public_tokenizers.path("word_bpe_49k.json"), True, 1, 49408)
    start, want = 0, []
    for i, t in sorted(zip(ids, corpus, strict=True)):
        own = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(tuple(r) for r in records.read_back(spark, folder, shards).collect()) == want
    part, n, _ = max(shards, key=lambda s: s[1])
    straight = list(records.read_shard(folder, part))
    shuffled = np.random.default_rng(1).permutation(n)
    again = list(records.read_shard(folder, part, shuffled))
    assert all(a[0] == straight[i][0] and (a[1] == straight[i][1]).all() for a, i in zip(again, shuffled, strict=True))
    path = tmp_path / "rec" / f"{part:05d}.rec"
    raw = bytearray(path.read_bytes())
    raw[40] ^= 1
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        list(records.read_shard(folder, part))
    none = records.write(frame(spark, []), f"file://{tmp_path}/none", public_tokenizers.path("word_bpe_49k.json"), True, 1, 49408)
    assert records.read_back(spark, f"file://{tmp_path}/none", none).count() == 0


def test_packing(spark, corpus):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    corpus = [*corpus, "a <|endoftext|> b"]
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(corpus)}
    got = packing.pack(frame(spark, corpus).repartition(4), Scratch(spark, "t"), public_tokenizers.path("byte_bpe_50k.json"), False).collect()
    seen, rows = {}, {}
    for r in got:
        assert zlib.crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, own in want.items():
        assert [s for s, _ in sorted(seen[i])] == list(itertools.accumulate((n for _, n in sorted(seen[i])), initial=0))[:-1]
        assert sum(n for _, n in seen[i]) == len(own)
    for own in rows.values():
        own.sort()
        assert [o for o, _ in own] == list(itertools.accumulate((n for _, n in own), initial=0))[:-1] and sum(n for _, n in own) <= 1024
    assert sorted(rows) == list(range(len(rows)))
    assert packing.pack(frame(spark, []), Scratch(spark, "t"), public_tokenizers.path("byte_bpe_50k.json"), False).count() == 0


def test_histogram_packing_is_tight():
    rng = random.Random(2)
    counts = {}
    for _ in range(20_000):
        n = rng.randrange(1, 1025)
        counts[n] = counts.get(n, 0) + 1
    patterns = packing.pack_histogram(counts)
    placed = {}
    for p, n in patterns:
        assert sum(p) <= 1024
        for x in p:
            placed[x] = placed.get(x, 0) + n
    assert placed == counts
    assert sum(n for _, n in patterns) <= 1.02 * math.ceil(sum(k * n for k, n in counts.items()) / 1024)
    spans = {}
    for length, lo, hi, _, _ in packing.slots(patterns):
        spans.setdefault(length, []).append((lo, hi))
    assert all(sorted(s)[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(sorted(s))) for s in spans.values())


@pytest.mark.parametrize("seed", range(6))
def test_packing_takes_the_shortest_pack(seed):
    """Against placing one piece at a time, longest first, each into the pack that holds least."""
    rng = random.Random(seed)
    lengths = sorted((rng.choice([rng.randrange(1, 101), rng.randrange(60, 101), rng.randrange(1, 12), 50]) for _ in range(rng.randrange(1, 400))), reverse=True)
    packs = []
    for n in lengths:
        held, at = min(((sum(p), i) for i, p in enumerate(packs)), default=(101, 0))
        if held + n <= 100:
            packs[at].append(n)
        else:
            packs.append([n])
    counts = {n: lengths.count(n) for n in set(lengths)}
    got = [sum(p) for p, k in packing.pack_histogram(counts, 100) for _ in range(k)]
    assert sorted(got) == sorted(map(sum, packs))


def labelled_corpus(spark, n=900):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(n):
        bad, junk = rng.random() < 0.2, rng.random() < 0.25
        w = sentence(rng, rng.randrange(20, 60)).split(" ")
        if bad:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vile", "grubby", "wretchedly"])
        t = " ".join(x + ("***" if junk else "") for x in w)
        texts.append(t)
        labels.append((i, int(not junk), int(bad)))
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity(spark):
    docs, labels, truth = labelled_corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    out = [(got[i]["predicted"], t) for i, _, t in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([a == b for a, b in out]) > 0.95
    odd = frame(spark, odd_texts(random.Random(0)))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in toxicity.score(odd, toxicity.fit(docs, labels)).collect())
    none = toxicity.fit(docs, labels.limit(0))
    assert none.bias is None and {(r["score"], r["predicted"]) for r in toxicity.score(docs.limit(3), none, threshold=0.5).collect()} == {(0.5, 1)}
    twice = docs.limit(1).union(docs.limit(1)).withColumn("score", F.lit("x"))
    assert toxicity.score(twice, none).count() == 2 and toxicity.score(docs.limit(0), none).count() == 0


def test_ftrl_against_a_plain_one():
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 300, rng.integers(1, 40))), int(rng.random() < 0.4)) for _ in range(200)]
    rows = [(np.unique(np.append(p, 5)) if y else p[p != 5], y) for p, y in rows]
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    z, n, bias = {}, {}, [0.0, 0.0]

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((b + math.sqrt(n.get(i, 0.0))) / a + l2)

    model = toxicity.Ftrl(300)
    for places, y in rows:
        own = places.tolist()
        w0 = -bias[0] / ((b + math.sqrt(bias[1])) / a)
        held = {i: weight(i) for i in own}
        g = 1 / (1 + math.exp(-max(-35, min(35, sum(held.values()) + w0)))) - y
        for i in own:
            step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / a
            z[i], n[i] = z.get(i, 0.0) + g - step * held[i], n.get(i, 0.0) + g * g
        step = (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / a
        bias = [bias[0] + g - step * w0, bias[1] + g * g]
        model.learn(places, y)
    at, w = model.sparse()
    want = {i: weight(i) for i in z if weight(i)}
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx(want) and 0 < len(want) < 300
    assert model.bias == pytest.approx(-bias[0] / ((b + math.sqrt(bias[1])) / a))


def rows_of_quality(spark, docs):
    return quality.vectors(docs, Scratch(spark, "t"))


def test_quality(spark):
    docs, labels, truth = labelled_corpus(spark)
    rows = rows_of_quality(spark, docs)
    model = quality.fit(rows, labels)
    good = np.mean([q for _, q, _ in truth])
    assert abs(model.prior - good) < 0.08
    got = {r["doc_id"]: r for r in quality.score(rows, model).collect()}
    out = [(got[i]["predicted"], q) for i, q, _ in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in out]) > 0.9
    # Labelled negatives are never looked at.
    again = quality.fit(rows, labels.where("quality = 1"))
    assert again.prior == model.prior and np.allclose(again.weights, model.weights)
    odd = rows_of_quality(spark, frame(spark, odd_texts(random.Random(0))))
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, model).collect()) and quality.score(odd, model).count() == 10
    assert quality.fit(rows, labels.limit(0)) is None and quality.fit(rows.limit(0), labels) is None
    assert {(r["score"], r["predicted"]) for r in quality.score(rows.limit(2), None, threshold=0.5).collect()} == {(0.5, 1)}
    assert quality.score(rows.limit(0), model).count() == 0


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(3)
    for prior in (0.2, 0.5, 0.8):
        good = rng.random(6000) < prior
        scores = np.where(good, rng.normal(1, 0.6, 6000), rng.normal(-1.5, 0.6, 6000))
        above = lambda x: np.cumsum(np.histogram(quality.sigmoid(x), np.linspace(0, 1, 1001))[0][::-1]).astype(float)
        assert abs(quality.best_bin(above(scores), above(rng.normal(1, 0.6, 3000))) - prior) < 0.06


def test_pu_risk_is_minimised(spark):
    """Against the plain non-negative risk, walked down by small steps over all rows at once."""
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.6
    x = rng.standard_normal((4000, quality.WIDTH)).astype(np.float32)
    x[:, 0] += np.where(good, 0.7, -0.7)
    positive = x[good][:1500].astype(np.float64)
    rows = spark.createDataFrame([(i, r.tobytes()) for i, r in enumerate(x)], "doc_id long, x binary")
    model = quality.fit_pu(positive, rows, x[:2000].astype(np.float64), prior=0.6)
    mean, scale = x.astype(np.float64).mean(axis=0), x.astype(np.float64).std(axis=0) + 1e-3
    p, u = (quality.standard(m, mean, scale) for m in (positive, x.astype(np.float64)))

    def risk(w):
        loss = lambda z: np.logaddexp(0, z)
        negative = loss(u @ w).mean() - 0.6 * loss(p @ w).mean()
        return 0.6 * loss(-(p @ w)).mean() + max(0.0, negative) + quality.DECAY / 2 * (w[:-1] @ w[:-1])

    w = np.zeros(quality.WIDTH + 1)
    w[-1] = np.log(0.6 / 0.4)
    for _ in range(1500):
        s, t = quality.sigmoid(p @ w), quality.sigmoid(u @ w)
        negative = np.logaddexp(0, u @ w).mean() - 0.6 * np.logaddexp(0, p @ w).mean()
        down = t @ u / len(u) - 0.6 * s @ p / len(p)
        w = w - 0.2 * (0.6 * (s - 1) @ p / len(p) + down + quality.DECAY * np.append(w[:-1], 0) if negative >= 0 else -down)
    assert np.allclose(model.mean, mean, atol=1e-5) and abs(risk(model.weights) - risk(w)) < 1e-3


def test_languages(spark):
    rng = random.Random(7)
    syllables = {"aa": ["ka", "ro", "mi", "tu", "sel"], "bb": ["sch", "eng", "wur", "olf", "ipf"], "cc": ["cion", "lla", "que", "osa", "ndo"]}
    word = lambda k: "".join(rng.choice(syllables[k]) for _ in range(rng.randrange(1, 4)))
    rows = [(i, " ".join(word(k) for _ in range(rng.randrange(10, 80))), k) for i, k in enumerate(rng.choice(["aa", "bb", "cc"]) for _ in range(300))]
    docs = spark.createDataFrame([*rows, (900, "ka ro", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in rows if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.97
    half = " ".join(word("aa") for _ in range(60)) + " " + " ".join(word("bb") for _ in range(40))
    mixed = {r["doc_id"]: r for r in langid.identify(frame(spark, [half, None, "", "123 !!", "ka ro mi"]), model).collect()}
    assert mixed[0]["langs"] == ["aa", "bb"] and abs(mixed[0]["score"] - 0.6) < 0.08
    assert [mixed[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and mixed[4]["langs"] == ["aa"]
    assert {r["lang_pred"] for r in langid.identify(docs.limit(3), langid.fit(docs.limit(0))).collect()} == {"und"}


def test_documents_of_many_languages(spark):
    rng = random.Random(8)
    syllables = {"aa": ["ka", "ro", "mi", "tu", "sel"], "bb": ["sch", "eng", "wur", "olf", "ipf"], "cc": ["cion", "lla", "que", "osa", "ndo"], "dd": ["yv", "zhe", "kry", "pta", "bly"], "ee": ["xo", "huh", "dja", "gwe", "fni"]}
    text = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(i, text(k, 60), k) for i, k in enumerate(sorted(syllables) * 60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    parts = [{"aa": 80, "bb": 60, "cc": 40, "dd": 20}, {"aa": 100, "bb": 80, "cc": 60, "dd": 40, "ee": 20}]
    got = {r["doc_id"]: r for r in langid.identify(frame(spark, [" ".join(text(k, n) for k, n in p.items()) for p in parts]), model).collect()}
    for i, p in enumerate(parts):
        assert got[i]["langs"] == list(p)
        assert got[i]["shares"] == pytest.approx([n / sum(p.values()) for n in p.values()], abs=0.04)


def test_mixtures_against_plain_em(spark):
    rng = random.Random(9)
    syllables = {"aa": ["ka", "ro", "mi"], "bb": ["sch", "eng", "wur"], "cc": ["cion", "lla", "que"]}
    text = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    model = langid.fit(spark.createDataFrame([(i, text(k, 40), k) for i, k in enumerate(sorted(syllables) * 30)], "doc_id long, text string, lang string"))
    texts = [text("aa", 30), text("aa", 12) + " " + text("bb", 20), text("cc", 3), "ka", " ".join(text(k, 15) for k in syllables)]
    got = {r["doc_id"]: r for r in langid.identify(frame(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        w = K.Words(*K.text_buffers(pa.array([t])), K.ALNUM_WORDS)
        like = model.words(w).T.astype(float).tolist()  # a row a word

        def em(share, rounds):
            for _ in range(rounds):
                new = [0.0] * len(share)
                for row in like:
                    parts = [x * p for x, p in zip(row, share, strict=True)]
                    new = [a + x / sum(parts) for a, x in zip(new, parts, strict=True)]
                share = [x / len(like) for x in new]
            return share, sum(math.log(sum(x * p for x, p in zip(row, share, strict=True)) + 1e-30) for row in like)

        full, _ = em([1 / 3] * 3, langid.FULL_ROUNDS)
        order = sorted(range(3), key=lambda k: (-full[k], k))
        best = None
        for m in range(1, 4):
            start = [full[k] + 1e-3 if k in order[:m] else 0.0 for k in range(3)]
            share, ll = em([x / sum(start) for x in start], langid.SET_ROUNDS if m > 1 else 0)
            cost = -2 * ll + (2 * m - 1) * math.log(len(like) + 1)
            if best is None or cost < best[0]:
                best = cost, share
        want = sorted(((x, model.langs[k]) for k, x in enumerate(best[1]) if x > 0), reverse=True)
        assert dict(zip(got[i]["langs"], got[i]["shares"], strict=True)) == pytest.approx({k: x for x, k in want}, abs=1e-3) and got[i]["shares"] == sorted(got[i]["shares"], reverse=True)


def test_licenses(spark):
    rng = random.Random(11)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = []
    for _ in range(80):
        w = sentence(rng, rng.randrange(1, 60)).split(" ")
        for _ in range(rng.randrange(3)):
            t = rng.choice([*licenses.TEMPLATES, ("Under the MIT License", ""), ("Apache License, Version 2", ""), ("CC-BY-NC", "")])[0].split(" ")
            own = [x for x in t if rng.random() > 0.12]
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        texts.append(rng.choice([" ", ", ", "\n"]).join(w))
    texts += odd_texts(rng)
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in licenses.scan(docs, licenses.document_spread(docs, licenses.TEMPLATES)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        base = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        found = {}
        for n, (template, _) in enumerate(licenses.TEMPLATES):
            s = set(template.split())
            for lo in range(max(1, len(w))):
                share = len(s & set(w[lo : lo + 2 * len(s)]))
                if 5 * share >= 4 * len(s):
                    found[n] = max(found.get(n, 0), share / len(s))
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(base))
        assert (r["first_word"], r["last_word"]) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert r["labels"] == ",".join(sorted({x for _, x in base} | {licenses.TEMPLATES[n][1] for n in found}))
        assert r["score"] == pytest.approx(max([float(bool(base)), *found.values()]))


def test_licenses_at_every_offset(spark):
    """Edited passages that lie across any fixed grid, against windows from every word."""
    rng = random.Random(12)
    texts = []
    for k in range(150):
        t = licenses.TEMPLATES[k % len(licenses.TEMPLATES)][0].split(" ")
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = f"other{rng.randrange(1000)}"
        for _ in range(rng.randrange(4)):
            t.insert(rng.randrange(len(t) + 1), f"more{rng.randrange(1000)}")
        texts.append(" ".join([sentence(rng, rng.randrange(1, 60)), *t, sentence(rng, rng.randrange(1, 30))]))
    docs = frame(spark, texts)
    got = {r["doc_id"]: {m["template"]: m["containment"] for m in r["matches"]} for r in licenses.scan(docs, licenses.document_spread(docs, licenses.TEMPLATES)).collect()}
    missed = 0
    for i, t in enumerate(texts):
        w, want = t.split(" "), {}
        for n, (template, _) in enumerate(licenses.TEMPLATES):
            s = set(template.split())
            share = {lo: len(s & set(w[lo : lo + 2 * len(s)])) for lo in range(len(w))}
            if 5 * max(share.values()) >= 4 * len(s):
                want[n] = max(share.values()) / len(s)
                missed += 5 * max(v for lo, v in share.items() if lo % len(s) == 0) < 4 * len(s)
        assert got[i] == pytest.approx(want)
    assert missed


def test_word_hashes_do_not_depend_on_chunks():
    rng = random.Random(0)
    col = pa.array([sentence(rng, 50), None, "", "é É x", "x"] * 20)
    buf, offs = K.text_buffers(col.slice(1, 90))
    whole = K.Words(buf, offs, K.SPACE_WORDS)
    parts = [K.Words(b, o, K.SPACE_WORDS).hash for _, _, b, o in K.chunks(buf, offs, 100)]
    assert (np.concatenate(parts) == whole.hash).all()
    assert whole.hash[-1] != whole.hash[-2] or len(whole) < 2
