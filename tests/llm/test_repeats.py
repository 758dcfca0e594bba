"""Repeated ids and rows: defined results, the same for any partitioning."""

import random

import numpy as np
import pytest

from lodegraph.llm import ann, line_dedup, near_dup, packing, records
from lodegraph.llm.runtime import Scratch
from lodegraph.llm.setlinks import SetLinks
from tests.llm.test_llm import frame, sentence


def test_a_repeated_query_row_is_one_query(spark):
    x = np.random.default_rng(1).standard_normal((80, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    base = spark.createDataFrame([*rows, rows[0], rows[7], (20, [9.0] * 8)], "vec_id long, embedding array<double>")
    got = ann.search(base, base.where("vec_id % 20 = 0"), k=10).collect()
    for q in (0, 20, 40, 60):
        v = min([x[q].tolist(), *([[9.0] * 8] if q == 20 else [])])
        all_ = [(i, np.array(r) @ np.array(v)) for i, r in [*rows, rows[0], rows[7], (20, [9.0] * 8)] if i != q]
        want = sorted(all_, key=lambda p: (-p[1], p[0]))[:10]
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [r for r, _ in own] == list(range(1, 11)) and sum(i in {w for w, _ in want} for _, i in own) >= 9


@pytest.mark.parametrize("parts", [1, 2, 3, 4])
def test_an_id_with_several_texts_holds_their_classes_together(spark, parts):
    rng = random.Random(3)
    a, b = sentence(rng, 60), sentence(rng, 60)
    near_a, near_b = a + " more", b + " more"
    docs = frame(spark, [a, b, near_a, near_b, sentence(rng, 60)], [1, 1, 2, 3, 4]).repartition(parts)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, Scratch(spark, "t")).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_lines_of_repeated_rows(spark, tmp_path):
    line = "this very line is in two documents"
    docs = frame(spark, [f"{line}\nalone here today", f"{line}\nother words to keep", f"{line}\nother words to keep", "short", None], [4, 5, 5, 5, 6])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_lines"], tuple(r["removed_lines"]), r["kept_chars"]) for r in line_dedup.query(spark, str(tmp_path)).collect())
    assert got[0] == (4, 2, (), len(f"{line}\nalone here today"))
    # All rows of document 5 lose its first line, and those of its second one but the first; so far as they have them.
    gone = {i for i in (0, 1)} if any(1 in g[2] for g in got if g[0] == 5) else {0}
    for d, n, removed, kept in got[1:4]:
        texts = ["other words to keep"] if n == 2 else [None]
        assert d == 5 and set(removed) == {i for i in gone if i < n}
        assert kept == (0 if n == 1 or len(removed) == 2 else len(texts[0]))
    assert got[4] == (6, 1, (), 0)
    left = line_dedup.remove_lines(docs, line_dedup.repeated_lines(docs, Scratch(spark, "t")), drop_emptied=False)
    assert sorted((r["doc_id"], len(r["text"] or "")) for r in left.collect()) == sorted((d, k) for d, _, _, k in got)


def test_repeated_rows_are_packed_and_recorded_one_by_one(spark, tmp_path):
    frame(spark, ["some words", "some words", "other"], [7, 7, 8]).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in packing.query(spark, str(tmp_path)).collect()) == [7, 7, 8]
    five = sorted((r["start"], r["doc_id"]) for r in records.query(spark, str(tmp_path)).collect())
    assert [d for _, d in five] == [7, 7, 8]


def test_near_duplicates_of_long_texts(spark):
    """Texts of several chunks (256 KB) each are compared whole."""
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(90_000))
    cut = long[: int(len(long) * 0.9)]
    docs = frame(spark, [long, cut, long[len(long) // 2 :]], [1, 2, 3])
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, Scratch(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and len(long) > 2 * (1 << 18)


def test_pairs_of_the_prefix_join_carry_masks(spark):
    """Sets whose rarest elements agree pass the prefix filter; those that differ in many others are no candidates, and no link is lost."""
    rng = random.Random(4)
    draw = lambda n: [rng.getrandbits(64) for _ in range(n)]
    often, rare = draw(300), draw(12)
    sets = [rare + rng.sample(often, 28) for _ in range(40)]
    sets += [[*s[:38], *draw(2)] for s in sets[:10]]
    rows = [(i, i % 7, np.array(s, dtype=np.uint64).tobytes()) for i, s in enumerate(sets)]
    held = spark.createDataFrame(rows, "id long, c long, items binary")
    got = {(r["a"], r["b"]) for r in SetLinks(Scratch(spark, "t"), "long", 80, 100, None)._prefix_pairs(held).collect()}
    apart = [(a, b) for b in range(len(sets)) for a in range(b) if a % 7 != b % 7]
    links = {(a, b) for a, b in apart if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))}
    assert links and links <= got and len(got) < len(apart) / 4
