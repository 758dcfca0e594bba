"""The one-pass timeline against merging pair by pair, and the binned interval join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import evolve, locate
from lodegraph.operators.graph import Graph
from lodegraph.sources import facts
from tests.test_operators import REFS, rows

NODE = "version string, node_id string, node_type string, name string, signature string, qualified_name string, source_code string, relative_path string, absolute_path string, line_start int, line_end int"


def history(rng, n_versions):
    """Nodes, edges, refactorings and hunks of versions c0, c1, ...; ids of some methods move from version to version, as their signature does not."""
    nodes, edges, refs, hunks = [], [], [], []
    for v in range(n_versions):
        alive = [m for m in range(12) if rng.random() < 0.85]
        for t in ("T0", "T1"):
            nodes.append((f"c{v}", t, "TYPE", t, t, t, "t", None, None, 0, 0))
        ids = {m: f"m{m}" if m % 4 else f"m{m}_{v}" for m in alive}
        for m in alive:
            nodes.append((f"c{v}", ids[m], "METHOD", f"m{m}", f"s{m}()", ids[m], rng.choice("aab"), f"F{m % 2}.java", f"/r/F{m % 2}.java", m * 20 + 1, m * 20 + 9))
            edges.append((f"c{v}", f"T{m % 2}", ids[m], "DECLARES"))
        edges += [(f"c{v}", ids[a], ids[b], "CALLS") for a, b in zip(alive, alive[1:], strict=False)]
        for k in range(4):
            place = lambda: [(f"F{m % 2}.java", f"m{m}()", m * 20 + 1, m * 20 + 9) for m in rng.sample(range(12), 2)]
            left = place()
            refs.append((f"c{v}", 10 * v + k, rng.choice(["RENAME_METHOD", "EXTRACT_METHOD", "INLINE_METHOD", "RENAME_VARIABLE"]), f"d{k}", 0.9, left, left if k == 0 else place()))
        for _ in range(2):
            m = rng.randrange(12)
            hunks.append((f"c{v}", "h", f"F{m % 2}.java", f"F{m % 2}.java", rng.choice(["INSERT", "DELETE", "REPLACE"]), m * 20 + 2, m * 20 + 4, m * 20 + 2, m * 20 + 4))
    return nodes, edges, refs, hunks


@pytest.mark.parametrize("seed", [1])
def test_one_pass_is_pair_by_pair(spark, seed):
    n = 4
    nodes, edges, refs, hunks = history(random.Random(seed), n)
    tables = [spark.createDataFrame(r, s) for r, s in ((nodes, NODE), (edges, "version string, src string, dst string, edge_type string"), (refs, f"version string, {REFS}"), (hunks, f"version string, {facts.HUNK}"))]
    label = lambda v: "V0" if v == n - 1 else f"V{v - n + 1}"
    versions = spark.createDataFrame([(label(v), v, f"c{v}") for v in range(n)], "label string, ord int, commit_id string")
    whole = evolve.timeline(tables[0], tables[1], versions, tables[2], tables[3])
    of = lambda df, v: df.where(F.col("version") == f"c{v}").drop("version")
    tracked, got, states = set(), set(), {}
    for v in range(n - 1, 0, -1):
        g1, g2 = (Graph(of(tables[0], x), of(tables[1], x)) for x in (v - 1, v))
        m = evolve.analyse(g1, g2, of(tables[2], v), of(tables[3], v), (label(v - 1), label(v)), spark.createDataFrame([(t,) for t in sorted(tracked)], "base_id string"))
        for r in m.nodes.collect():
            states.setdefault(r["node_id"], []).append((r["version_status"], tuple(r["versions"])))
            if r["version_status"] != "UNCHANGED" or len(r["versions"]) == 1:
                tracked.add(r["original_id"].split("@")[0])
        got |= {(r["src"], r["edge_type"], r["dst"]) for r in m.evolution.collect()}
    rank = {"ADDED": 3, "DELETED": 3, "MODIFIED": 2, "UNCHANGED": 1}
    out = {r["node_id"]: r for r in whole.nodes.collect()}
    assert set(out) == set(states)
    for i, seen in states.items():
        assert set(out[i]["versions"]) == {x for _, vs in seen for x in vs}
        best = max(rank[s] for s, _ in seen)
        assert out[i]["version_status"] == next(s for s, _ in seen if rank[s] == best)
    assert set(rows(whole.evolution, "src", "edge_type", "dst")) == got
    assert {r["edge_type"] for r in whole.evolution.collect()} >= {"UNCHANGED", "REFACTORED", "RENAMED"}


def test_plan_does_not_grow_with_versions(spark):
    def size(n):
        nodes, edges, refs, hunks = history(random.Random(3), n)
        tables = [spark.createDataFrame(r, s) for r, s in ((nodes, NODE), (edges, "version string, src string, dst string, edge_type string"), (refs, f"version string, {REFS}"), (hunks, f"version string, {facts.HUNK}"))]
        versions = spark.createDataFrame([(f"c{v}", v) for v in range(n)], "label string, ord int")
        out = evolve.timeline(tables[0], tables[1], versions, tables[2], tables[3])
        return [len(t._jdf.queryExecution().optimizedPlan().toString().split("\n")) for t in (out.nodes, out.edges, out.evolution)]

    assert size(2) == size(4)


def test_commit_ids_become_labels(spark):
    versions = spark.createDataFrame([("V-1", 0, "aa"), ("V0", 1, "bb")], "label string, ord int, commit_id string")
    df = spark.createDataFrame([(1, "aa", "zz"), (2, None, "bb"), (3, "V0", "aa")], "k int, a string, b string")
    assert rows(evolve.labelled(df, ["a", "b"], versions), "k", "a", "b") == [(1, "V-1", "zz"), (2, None, "V0"), (3, "V0", "V-1")]
    assert rows(evolve.neighbours(versions), "pair", "first", "second") == [(0, "V-1", "V0")]


def test_bins_find_every_overlap_once(spark):
    rng = random.Random(5)
    length = lambda: rng.choice([0, 3, 63, 64, 700, 66000, 300000])
    one = lambda n, p: [(f"{p}{i}", rng.choice("fg"), lo, lo + length()) for i in range(n) for lo in [rng.choice([rng.randrange(400), rng.randrange(200000), -rng.randrange(100)])]]
    a, b = one(150, "a"), one(150, "b")
    a += [("null", "f", None, 5), ("back", "f", 9, 5)]
    left = spark.createDataFrame(a, "x string, path string, s int, e int")
    right = spark.createDataFrame(b, "y string, path string, lo int, hi int")
    got = rows(locate.range_join(left, right, ["path"], (F.col("s"), F.col("e")), (F.col("lo"), F.col("hi"))), "x", "y")
    assert got == sorted((p[0], q[0]) for p in a[:150] for q in b if p[1] == q[1] and max(p[2], q[2]) <= min(p[3], q[3])) and len(got) > 500


def test_a_hot_file_compares_what_is_near(spark):
    """One file of 20,000 lines: pairs compared stay within a few times the pairs found."""
    n = 2000
    e = spark.range(n).select(F.lit("f").alias("path"), F.concat(F.lit("e"), "id").alias("node_id"), (F.col("id") * 10 + 1).cast("int").alias("start_line"), (F.col("id") * 10 + 8).cast("int").alias("end_line"))
    h = spark.range(n).select(F.lit("f").alias("path"), (F.col("id") * 10 + 4).cast("int").alias("lo"), (F.col("id") * 10 + 5).cast("int").alias("hi"))
    assert locate.overlapping(e, h, ["path"]).count() == n
    a = locate._dealt(e, F.col("start_line"), F.col("end_line"), "a")
    b = locate._dealt(h, F.col("lo"), F.col("hi"), "b")
    met = a.where("_level = 0").join(b.where("_level = 0"), ["path", "_level", "_bin"]).count()
    assert met < 16 * n


def test_short_ranges_meet_in_fine_bins_alone(spark):
    """All rows of a file once met in its coarse bin, and every row was dealt to one."""
    n = 2000
    e = spark.range(n).select(F.lit("f").alias("path"), (F.col("id") * 10 + 1).alias("s"), (F.col("id") * 10 + 8).alias("e"))
    h = spark.range(n).select(F.lit("f").alias("path"), (F.col("id") * 10 + 4).alias("lo"), (F.col("id") * 10 + 5).alias("hi"))
    at = (F.col("s"), F.col("e")), (F.col("lo"), F.col("hi"))
    a, b = locate._dealt(e, *at[0], "a"), locate._dealt(h, *at[1], "b")
    assert a.join(b, ["path", "_level", "_bin"]).count() < 16 * n
    a = locate._dealt(e, *at[0], "a", locate._some_long(h, *at[1]))
    assert a.where("_level > 0").count() == 0 and a.count() < 2 * n
    # One long range on the other side meets all of them, one on each side meet once.
    long = spark.createDataFrame([("f", 1, 300_000)], "path string, lo long, hi long")
    assert locate.range_join(e, h.union(long), ["path"], *at).count() == 2 * n
    assert locate.range_join(e.union(long), h.union(long), ["path"], *at).count() == 3 * n + 1
