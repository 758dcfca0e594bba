"""Fixtures for the quirks of the model, and round trips."""

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import exprs as X
from lodegraph.operators import build, collapse, commits, evolve, export, graph, locate, mining, versions
from lodegraph.sources import facts
from lodegraph.streaming import ingest


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_collapse_counts_and_hotspots(spark):
    occ = spark.createDataFrame([("a", f"b{n}", i % 4, "INVOCATION") for n in (1, 3, 10, 11, 21) for i in range(n)], "src string, dst string, line int, occ_kind string")
    got = {r["dst"]: r for r in collapse.collapse(occ).collect()}
    assert [got[f"b{n}"]["is_hotspot"] for n in (1, 3, 10, 11, 21)] == [False, False, True, True, True]
    assert [got[f"b{n}"]["frequency"] for n in (1, 3, 10, 11, 21)] == ["single", "few", "several", "many", "heavy"]
    assert got["b21"]["lines"] == [0, 1, 2, 3] and got["b21"]["call_count"] == 21


def test_tests_go_to_other_kinds_only(spark):
    nodes = spark.createDataFrame([("t1", "TEST_METHOD"), ("t2", "TEST_METHOD"), ("s", "SOURCE_METHOD")], "node_id string, kind string")
    occ = spark.createDataFrame([("t1", "t2"), ("t1", "s"), ("s", "s"), ("s", "gone")], "src string, dst string")
    assert rows(collapse.route(occ, nodes), "src", "dst", "edge_type") == [("s", "s", "CALLS"), ("t1", "s", "TESTS"), ("t1", "t2", "CALLS")]


def test_constructors_are_routed_by_their_place(spark):
    nodes = spark.createDataFrame([("t", "TEST_METHOD", "/p/src/test/T.java"), ("in", "CONSTRUCTOR", "/p/src/test/A.java"), ("back", "CONSTRUCTOR", "C:\\src\\test\\A.java"), ("out", "CONSTRUCTOR", "/p/src/main/B.java"), ("none", "CONSTRUCTOR", None), ("s", "SOURCE_METHOD", "/p/src/main/S.java")], "node_id string, kind string, absolute_path string")
    occ = spark.createDataFrame([("t", d, "CONSTRUCTOR") for d in ("in", "back", "out", "none")] + [("s", "out", "CONSTRUCTOR"), ("t", "in", "INVOCATION")], "src string, dst string, occ_kind string")
    got = rows(collapse.route(occ, nodes), "src", "dst", "occ_kind", "edge_type")
    assert got == [("s", "out", "CONSTRUCTOR", "CALLS"), ("t", "back", "CONSTRUCTOR", "CALLS"), ("t", "in", "CONSTRUCTOR", "CALLS"), ("t", "in", "INVOCATION", "TESTS"), ("t", "none", "CONSTRUCTOR", "CALLS"), ("t", "out", "CONSTRUCTOR", "TESTS")]


def test_call_and_access_texts(spark):
    occ = spark.createDataFrame([("a", f"b{n}", i + 1, "virtual") for n in (1, 3, 6, 25) for i in range(n)], "src string, dst string, line int, occ_kind string")
    got = {r["dst"]: r for r in collapse.calls(occ).collect()}
    assert [got[f"b{n}"]["description"] for n in (1, 3, 6)] == [None, "Called 3 times at lines 1, 2, 3", "Called 6 times at lines 1, 2, 3, ..."]
    assert got["b1"]["semantic_summary"] is None and got["b25"]["semantic_summary"].startswith("Very high") and got["b6"]["call_types"] == ["virtual"]
    reads = {r["dst"]: r for r in collapse.accesses(occ, "read").collect()}
    assert reads["b6"]["description"] == "Field read 6 times at lines 1, 2, 3, ..., 5, 6" and reads["b6"]["semantic_summary"] == "High frequency field access"
    assert reads["b3"]["semantic_summary"] == "Normal field access" and (reads["b1"]["first_line"], reads["b1"]["lines"]) == (None, [1])


def test_evolution_lists_unite_in_order(spark):
    e = spark.createDataFrame([(2, "a", "MOVED", "b", 0.5, "T2", "d1", ["x", " y "]), (1, "a", "MOVED", "b", 0.9, "T1", "d1", ["y"]), (3, "a", "MOVED", "b", 0.1, "T1", " ", None)], "seq int, src string, edge_type string, dst string, confidence double, type string, description string, left_locations array<string>")
    r = collapse.merge_evolution(e).first()
    assert (r["occurrences"], r["confidence"], r["refactoring_types"], r["descriptions"], r["left_locations"]) == (3, 0.9, ["T1", "T2"], ["d1"], ["y", "x"])


def test_match_confidence_and_nulls(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1), ("n", None), ("m", None)], "node_id string, source int")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("n", None), ("m", 3)], "node_id string, source int")
    assert rows(versions.match(a, b), "node_id", "confidence") == [("m", 0.8), ("n", 1.0), ("x", 1.0), ("y", 0.8)]


def test_diff_accounts_for_every_node(spark):
    a = spark.createDataFrame([(str(i), i) for i in range(10)], "node_id string, source int")
    b = spark.createDataFrame([(str(i), i + i % 2) for i in range(4, 15)], "node_id string, source int")
    got = {r["version_status"]: r["count"] for r in versions.diff(a, b).groupBy("version_status").count().collect()}
    assert got == {"DELETED": 4, "ADDED": 5, "UNCHANGED": 3, "MODIFIED": 3}
    assert versions.materialise(versions.diff(a, b)).count() == 4 + 5 + 3 + 2 * 3


@pytest.mark.parametrize(("gap", "hit"), [(3, True), (4, True), (5, False)])
def test_interval_tolerance(spark, gap, hit):
    e = spark.createDataFrame([("f", "e", 10, 20)], "path string, node_id string, start_line int, end_line int")
    h = spark.createDataFrame([("f", 20 + gap, 30)], "path string, lo int, hi int")
    assert (locate.overlapping(e, h, ["path"], slack=2).count() == 1) is hit


def test_hunk_sides(spark):
    h = spark.createDataFrame([("INSERT", 5, 5, 7, 9), ("DELETE", 1, 3, 1, 1), ("REPLACE", 0, 1, 0, 2)], "type string, begin_a int, end_a int, begin_b int, end_b int")
    assert rows(locate.hunk_sides(h), "type", "side", "lo", "hi") == [("DELETE", "V1", 2, 4), ("INSERT", "V2", 8, 10), ("REPLACE", "V1", 1, 2), ("REPLACE", "V2", 1, 3)]


def test_refactoring_fan_out(spark):
    r = spark.createDataFrame([(1, 0, "EXTRACT_METHOD", "a", "b", 1.0), (1, 1, "EXTRACT_METHOD", "c", "d", 1.0), (2, 0, "INLINE_METHOD", "a", "b", 1.0), (2, 1, "INLINE_METHOD", "c", "d", 1.0), (3, 0, "MOVE_METHOD", "a", "b", 1.0), (3, 1, "MOVE_METHOD", "c", "d", 1.0)], "ref_id long, pos int, type string, left_id string, right_id string, confidence double")
    assert rows(versions.refactoring_edges(r), "ref_id", "src", "dst") == [(1, "a", "b"), (1, "a", "d"), (2, "a", "b"), (2, "c", "b"), (3, "a", "b")]
    assert rows(versions.with_edge_type(spark.createDataFrame([("RENAME_CLASS",), ("NEW_ONE",)], "type string")), "edge_type", "sub_type") == [("REFACTORED", None), ("RENAMED", "class")]


def test_roll_up_priority(spark):
    r = spark.createDataFrame([("a", "V0", 0, "UNCHANGED", 0), ("a", "V-1", -1, "MODIFIED", 1), ("b", "V0", 0, "DELETED", 0), ("b", "V-1", -1, "ADDED", 1)], "node_id string, label string, ord int, status string, seq int")
    assert rows(versions.roll_up(r), "node_id", "status", "first_version", "last_version") == [("a", "MODIFIED", "V-1", "V0"), ("b", "DELETED", "V-1", "V0")]


def one_at_a_time(spark, scores, threshold):
    """The best pair left, by score, hash of the pair and ids, until none is left."""
    df = spark.createDataFrame(scores, "v1_id long, v2_id long, score double").withColumn("tie", F.xxhash64("v1_id", "v2_id"))
    left, out = [tuple(r) for r in df.collect() if r["score"] >= threshold], []
    while left:
        a, b, _, _ = min(left, key=lambda x: (-x[2], x[3], x[0], x[1]))
        out.append((a, b))
        left = [y for y in left if y[0] != a and y[1] != b]
    return sorted(out)


def test_mutual_best_is_one_to_one(spark):
    import itertools

    s = [(a, b, ((a * 7 + b * 3) % 10) / 10) for a, b in itertools.product(range(6), range(10, 16))]
    got = rows(versions.best_mutual(spark.createDataFrame(s, "v1_id long, v2_id long, score double"), 0.5), "v1_id", "v2_id")
    assert got == one_at_a_time(spark, s, 0.5)


def test_mutual_best_settles_chains_and_ties(spark):
    chain = [(i, 100 + i, 1 - i / 100) for i in range(25)] + [(i, 101 + i, 0.995 - i / 100) for i in range(24)]
    ties = [(a, b, 0.9) for a in range(200, 223) for b in range(300, 323)] + [(50, 150, 0.4)]
    for s in (chain, ties):
        got = rows(versions.best_mutual(spark.createDataFrame(s, "v1_id long, v2_id long, score double").coalesce(1), 0.5), "v1_id", "v2_id")
        assert got == one_at_a_time(spark, s, 0.5) and len(got) in (23, 25)
    assert versions.best_mutual(spark.createDataFrame([], "v1_id long, v2_id long, score double"), 0.5).count() == 0


def test_matching_by_node_type(spark):
    cols = "node_id string, node_type string, qualified_name string, signature string, field_type string, relative_path string, label string, source_code string"
    a = spark.createDataFrame([("T", "TYPE", "q.T", None, None, None, "l", "s"), ("m", "METHOD", None, "m()", None, None, "l", "x"), ("f", "FIELD", "q.T#f", None, "int", None, "l", None), ("F", "FILE", None, None, None, None, "l", None), ("P", "PROJECT", None, None, None, None, "Project:p", None)], cols)
    b = spark.createDataFrame([("T2", "TYPE", "q.T", None, None, None, "z", "s"), ("m2", "METHOD", None, "m()", None, None, "z", "y"), ("f2", "FIELD", "q.T#f", None, "long", None, "z", None), ("F2", "FILE", None, None, None, None, "l", None), ("P2", "PROJECT", None, None, None, None, "Project:p", None)], cols)
    assert rows(versions.match_nodes(a, b), "v1_id", "v2_id", "confidence") == [("P", "P2", 1.0), ("T", "T2", 1.0), ("m", "m2", 0.8)]


def test_matchers_take_what_is_free(spark):
    cols = "node_id string, node_type string, name string, signature string, source_code string, lines_of_code int, complexity int, called_methods array<string>, accessed_fields array<string>, local_variables array<string>"
    row = lambda i, sig, calls: (i, "METHOD", "m", sig, "s", 10, 2, calls, ["f"], ["v"])
    a = spark.createDataFrame([row("a1", "same()", ["x"]), row("a2", "old()", ["x", "y"])], cols)
    b = spark.createDataFrame([row("b1", "same()", ["x"]), row("b2", "new()", ["x", "y"]), row("b3", "other()", ["z"])], cols)
    got = rows(versions.match_all(a, b, [versions.StructuralMatcher()]), "v1_id", "v2_id", "matcher")
    assert got == [("a1", "b1", "ExactMatcher"), ("a2", "b2", "StructuralMatcher")]
    assert rows(versions.match_all(a, b), "v1_id") == [("a1",)]  # by default nothing but exact matches


def history(spark, steps, days=None):
    """``steps`` from the target back: (type, new, old) of each commit."""
    n = len(steps)
    c = spark.createDataFrame([("t", i, f"c{n - 1 - i}", -86400 * (days or [0] * n)[i], i == n - 1) for i in range(n)], "k string, depth int, commit_id string, commit_time long, is_root boolean")
    r = spark.createDataFrame([("t", f"c{n - 1 - i}", j, kind, [old], [new]) for i, s in enumerate(steps) for j, (kind, new, old) in enumerate(s)], "k string, commit_id string, pos int, type string, left array<string>, right array<string>")
    return c, r


@pytest.mark.parametrize(("kind", "after"), [("RENAME_METHOD", ["src()"]), ("MOVE_METHOD", ["src()"]), ("REMOVE_PARAMETER", ["src()"]), ("CHANGE_RETURN_TYPE", ["src()"]), ("EXTRACT_METHOD", ["m()", "src()"]), ("INLINE_METHOD", ["m()", "src()"]), ("EXTRACT_AND_MOVE_METHOD", ["src()"]), ("MOVE_AND_INLINE_METHOD", ["src()"]), ("ADD_PARAMETER", ["m()"]), ("PULL_UP_METHOD", ["m()"])])
def test_walk_rules(spark, kind, after):
    w = versions.tracked_walk(*history(spark, [[("RENAME_METHOD", "m()", "before()")], [(kind, " m()", "src() ")], []]), ["k"]).first()
    assert sorted(w["tracked"]) == after and w["commits"] == ["c1", "c2"] and (w["analysed"], w["relevant"]) == (1, 1)


def test_walk_of_a_rename_and_an_extract(spark):
    """Six versions of which four touch what is followed; the oldest is a root and is never analysed."""
    steps = [[("EXTRACT_METHOD", "S.check(U)", "S.update(U)")], [("EXTRACT_METHOD", "S.check(U)", "S.update(U)")], [("RENAME_METHOD", "S.update(U)", "S.modify(U)")], [("RENAME_METHOD", "X.a()", "X.b()")], [("ADD_PARAMETER", "X.a()", "X.b()")], [("RENAME_METHOD", "S.modify(U)", "S.edit(U)")], [("RENAME_METHOD", "S.edit(U)", "S.z(U)")]]
    w = versions.tracked_walk(*history(spark, steps), ["k"]).first()
    assert w["commits"] == ["c1", "c4", "c5", "c6"] and sorted(w["tracked"]) == ["S.check(U)", "S.edit(U)"] and w["analysed"] == 5
    short = versions.tracked_walk(*history(spark, steps), ["k"], max_depth=2).first()
    assert short["commits"] == ["c4", "c5", "c6"] and short["analysed"] == 2
    late = versions.tracked_walk(*history(spark, steps, [0, 10, 20, 181, 5, 5, 5]), ["k"], max_days=180).first()
    assert late["analysed"] == 2 and versions.tracked_walk(*history(spark, steps, [0, 10, 20, 181, 5, 5, 5]), ["k"], max_days=0).first()["analysed"] == 5
    none = versions.tracked_walk(*history(spark, [[("RENAME_CLASS", "A", "B")], [("RENAME_METHOD", "m()", "n()")], []]), ["k"]).first()
    assert none["commits"] == ["c2"] and none["analysed"] == 0


def test_linear_history(spark):
    c = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None, "m", "a", i) for i in range(20)], "commit_id string, parent_id string, message string, author string, commit_time long")
    heads = spark.createDataFrame([("x", "c19"), ("y", "c2")], "timeline string, commit_id string")
    for depth in (0, 1, 5, 7, 8, 30):
        got = rows(commits.linear_history(c, heads, depth), "timeline", "depth", "commit_id")
        assert got == sorted([("x", d, f"c{19 - d}") for d in range(min(depth, 19) + 1)] + [("y", d, f"c{2 - d}") for d in range(min(depth, 2) + 1)])
    t = commits.timeline(commits.linear_history(c, heads, 2), c)
    assert rows(t.where("timeline = 'y'"), "ord", "label", "commit_id") == [(0, "V-2", "c0"), (1, "V-1", "c1"), (2, "V0", "c2")]
    assert rows(commits.version_pairs(t).where("timeline = 'y'"), "older", "newer", "pair_ord") == [("c0", "c1", 1), ("c1", "c2", 0)]


def code(spark, nodes, edges):
    cols = "node_id string, node_type string, name string, signature string, qualified_name string, source_code string, relative_path string, absolute_path string, line_start int, line_end int"
    full = [(i, t, i, i, i, src, "A.java" if t == "METHOD" else None, "/r/A.java" if t == "METHOD" else None, at, at + 5) for i, t, src, at in nodes]
    return graph.Graph(spark.createDataFrame(full, cols), spark.createDataFrame(edges, "src string, dst string, edge_type string"))


REFS = f"ref_id long, type string, description string, confidence double, left {facts.LOCATIONS}, right {facts.LOCATIONS}"


def test_self_loop_is_split(spark):
    """A refactoring inside a method that matches exactly: one unchanged row becomes two modified ones, and so does its type."""
    own = [("T", "TYPE", "t", 0), ("m", "METHOD", "s", 10), ("n", "METHOD", "s", 30)]
    edges = [("T", "m", "DECLARES"), ("T", "n", "DECLARES"), ("n", "m", "CALLS")]
    place = [("A.java", "m()", 10, 15)]
    refs = spark.createDataFrame([(1, "RENAME_VARIABLE", "d", 1.0, place, place)], REFS)
    none = spark.createDataFrame([], facts.HUNK)
    m = evolve.analyse(code(spark, own, edges), code(spark, own, edges), refs, none)
    assert rows(m.nodes, "node_id", "version_status", "first_version", "last_version") == [("T", "MODIFIED", "V1", "V1"), ("T@V2", "MODIFIED", "V2", "V2"), ("m", "MODIFIED", "V1", "V1"), ("m@V2", "MODIFIED", "V2", "V2"), ("n", "UNCHANGED", "V1", "V2")]
    assert rows(m.evolution, "src", "edge_type", "dst") == [("T", "REFACTORED", "T@V2"), ("m", "RENAMED", "m@V2")]
    assert rows(m.edges, "src", "edge_type", "dst", "side") == [("T", "DECLARES", "m", 1), ("T", "DECLARES", "n", 1), ("T@V2", "DECLARES", "m@V2", 2), ("T@V2", "DECLARES", "n", 2), ("n", "CALLS", "m", 1), ("n", "CALLS", "m@V2", 2)]
    assert evolve.statistics(m).where("kind in ('MODIFIED', 'ADDED', 'RENAMED', 'MOVED')").count() == 4


def test_diff_marks_and_tracks(spark):
    a = code(spark, [("m", "METHOD", "s", 10), ("n", "METHOD", "s", 30), ("gone", "METHOD", "s", 60)], [("n", "gone", "CALLS")])
    b = code(spark, [("m", "METHOD", "s", 10), ("n", "METHOD", "s", 30), ("new", "METHOD", "s", 90)], [("new", "m", "CALLS")])
    hunks = spark.createDataFrame([("c", "A.java", "A.java", "REPLACE", 10, 12, 10, 12)], facts.HUNK)
    tracked = spark.createDataFrame([("n",)], "base_id string")
    m = evolve.analyse(a, b, spark.createDataFrame([], REFS), hunks, ("V-1", "V0"), tracked)
    assert rows(m.nodes, "node_id", "version_status") == [("gone@V-1", "DELETED"), ("m@V-1", "MODIFIED"), ("m@V0", "MODIFIED"), ("n@V-1", "UNCHANGED"), ("n@V0", "UNCHANGED"), ("new@V0", "ADDED")]
    assert rows(m.evolution, "src", "edge_type", "dst", "confidence", "version_flow") == [("m@V-1", "REFACTORED", "m@V0", 0.7, "V-1->V0"), ("n@V-1", "UNCHANGED", "n@V0", 1.0, "V-1->V0")]
    stamp = spark.createDataFrame([("V0", "abcdefgh", "abcdefg", "msg", "me", 7)], "label string, commit_id string, short_id string, message string, author string, commit_time long")
    got = {r["node_id"]: r["commit_short_id"] for r in evolve.stamped(m.nodes, stamp).collect()}
    assert got["new@V0"] == "abcdefg" and got["gone@V-1"] is None


def test_tagged_merge(spark):
    a = code(spark, [("m", "METHOD", "s", 10), ("x", "METHOD", "s", 30), ("y", "METHOD", "s", 50), ("z", "METHOD", "s", 70)], [("m", "x", "CALLS")])
    b = code(spark, [("m", "METHOD", "s", 10), ("x2", "METHOD", "s", 30), ("y2", "METHOD", "s", 50), ("w", "METHOD", "s", 70)], [("m", "x", "CALLS"), ("m", "y2", "CALLS")])
    refs = spark.createDataFrame([("x", "x2", "RENAME_METHOD")], "left_id string, right_id string, type string")
    scores = spark.createDataFrame([("y", "y2", 0.9), ("x", "y2", 0.99), ("z", "w", 0.8)], "v1_id string, v2_id string, score double")
    mapping, edges = evolve.tagged(a, b, refs, scores)
    got = {(r["v1_id"], r["v2_id"], r["mapping"]) for r in mapping.collect()}
    assert got == {("x", "x2", "RENAMED"), ("y", "y2", "MODIFIED"), ("m", "m", "IDENTICAL"), ("z", None, "DELETED"), (None, "w", "ADDED")}
    assert rows(edges, "src", "dst", "version") == [("m", "x", "both"), ("m", "y2", "v2")]


def test_sides_of_unequal_length(spark):
    r = spark.createDataFrame([(1, "EXTRACT_METHOD", ["a", "b"], ["x", "y", "z"]), (2, "INLINE_METHOD", ["a", "b"], ["x"]), (3, "MOVE_METHOD", ["a", "b"], ["x", "y"]), (4, "MOVE_METHOD", [], ["x"])], "ref_id long, type string, left_ids array<string>, right_ids array<string>")
    assert rows(versions.sided_edges(r), "ref_id", "src", "dst") == [(1, "a", "x"), (1, "a", "y"), (1, "a", "z"), (2, "a", "x"), (2, "b", "x"), (3, "a", "x")]


def test_places_of_nodes(spark):
    nodes = spark.createDataFrame([("rel", "METHOD", "a/F.java", None, 10, 20), ("abs", "METHOD", None, "/r/a/F.java", 12, 20), ("field", "FIELD", "a/F.java", None, 14, 14), ("half", "METHOD", None, "/r/xa/F.java", 10, 20), ("zero", "METHOD", "a/F.java", None, 0, 0)], "node_id string, node_type string, relative_path string, absolute_path string, line_start int, line_end int")
    at = lambda lo, hi: rows(locate.located(nodes, spark.createDataFrame([("a/F.java", lo, hi)], "path string, lo int, hi int")), "node_id")
    assert at(24, 30) == [("abs",), ("rel",)] and at(25, 30) == [] and at(16, 16) == [("abs",), ("field",), ("rel",)] and at(17, 17) == [("abs",), ("rel",)]


def test_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("a", "c")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node_id string")
    assert sorted(r["path"] for r in graph.simple_paths(e, start, "c", 3).collect()) == [["a", "b", "c"], ["a", "c"], ["a", "c"]]
    assert [r["path"] for r in graph.simple_paths(e, start, "a", 3).collect()] == [["a"]]
    assert rows(graph.reach(e, spark.createDataFrame([("c",)], "node_id string"), 3), "node_id", "depth") == [("a", 1), ("b", 1), ("c", 0)]
    chains = rows(graph.callers(e, spark.createDataFrame([("c",)], "node_id string"), 3), "node_id", "depth")
    # Two edges lead from a to c: each chain may use one and then the other, but neither twice.
    assert chains == sorted([("a", 1), ("a", 1), ("b", 1), ("c", 2), ("c", 2), ("a", 2), ("b", 3), ("b", 3), ("a", 3), ("a", 3), ("c", 3)])


def test_impact_and_tests(spark):
    calls = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("a", "e")], "src string, dst string")
    tests = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t4", "d"), ("t5", "e")], "src string, dst string")
    changed = spark.createDataFrame([("a", "RENAMED"), ("a", "REFACTORED"), ("c", "REFACTORED"), ("e", None)], "node_id string, edge_type string")
    got = {r["node_id"]: r for r in graph.impact(calls, tests, changed).collect()}
    assert [(got[i]["level"], got[i]["direct"], got[i]["callers"], got[i]["by_depth"], got[i]["tests"]) for i in "ace"] == [("HIGH", 1, 3, "1,1,1", 3), ("MEDIUM", 1, 3, "1,1,1", 3), ("NONE", 1, 3, "1,1,1", 3)]
    assert "a: HIGH" in graph.impact_report(graph.impact(calls, tests, changed)).where("node_id = 'a'").first()["report"]
    one = spark.createDataFrame([("a",)], "node_id string")
    assert rows(graph.tests_to_rerun(calls, tests, one), "test_id") == [("t2",), ("t4",)]


def test_contexts(spark):
    cols = "node_id string, node_type string, name string, label string, relative_path string, semantic_summary string, documentation string, comments string, source_code string"
    nodes = spark.createDataFrame([("a", "TYPE", "A", "A (CLASS)", "A.java", "sum a", None, "note", None), ("m", "METHOD", "m", "m(K)", None, None, "doc", None, "code"), ("b", "TYPE", "B", "B (CLASS)", None, None, None, None, None)], cols)
    edges = spark.createDataFrame([("a", "m", "DECLARES", "method", "has"), ("a", "b", "EXTENDS", None, None), ("m", "m", "CALLS", None, None)], "src string, dst string, edge_type string, detail string, description string")
    text = graph.context(nodes, edges, "a", 1).first()["context"]
    assert text == "========== MAIN NODE ==========\n=== TYPE: A (CLASS) ===\nLocation: A.java\nSummary: sum a\nComments:\nnote\n\n========== NEIGHBORS ==========\n\n--- EXTENDS --> B (CLASS) ---\n\n--- DECLARES --> m(K) ---\nRelationship: has\n"
    assert graph.context(nodes, edges, "zz", 1).first()["context"] == "Node not found: zz"
    one = graph.test_contexts(nodes, edges).where("type_id = 'a'").first()["context"]
    assert "=== METHODS ===\n\n--- Method: m ---\n=== METHOD: m(K) ===\nDocumentation:\ndoc\nSource Code:\ncode\n  Calls: m(K)\n" in one and "EXTENDS: B (CLASS)\n" in one


def test_build_leaves_out_what_is_no_node(spark):
    f = {
        "project": spark.createDataFrame([("p",)], "name string"), "files": spark.createDataFrame([("/r/A.java",)], "path string"),
        "packages": spark.createDataFrame([("q", False), ("", True)], "qualified_name string, is_unnamed boolean"),
        "types": spark.createDataFrame([("q.A", "CLASS", "q", "/r/A.java", None, [], False, 1, 9), ("q.A$1", "CLASS", "q", "/r/A.java", "q.A", ["q.A"], True, 2, 3), ("q.B", "CLASS", "", "/r/B.java", "q.A", None, False, 1, 9)], "qualified_name string, kind string, package string, path string, super_class string, interfaces array<string>, is_anonymous boolean, line_start int, line_end int"),
        "methods": spark.createDataFrame([(t, "m()", "m", "SOURCE_METHOD", "q.A", [], [], [], t == "q.B", "/r/A.java", 2, 3) for t in ("q.A", "q.B", "q.A$1")], "declaring_type string, signature string, name string, kind string, return_type string, parameter_types array<string>, parameter_names array<string>, exceptions array<string>, has_override boolean, path string, line_start int, line_end int"),
        "fields": spark.createDataFrame([("q.A", "f", "int", False, 1, "/r/A.java"), ("q.A", "E", "q.A", True, 1, "/r/A.java")], "declaring_type string, name string, type string, is_enum_constant boolean, line_number int, path string"),
        "occurrences": spark.createDataFrame([("q.A#m()", "q.B#m()", "INVOCATION", 5), ("q.A#m()", "java.X#y()", "INVOCATION", 6), ("q.A#m()", "q.A#f", "READ", 7)], "src string, dst string, occ_kind string, line int"),
    }
    g = build.build(f)
    assert rows(g.nodes, "node_id") == [("/r/A.java",), ("p",), ("q",), ("q.A",), ("q.A#f",), ("q.A#m()",), ("q.B",), ("q.B#m()",)]
    got = rows(g.edges.select("edge_type", "src", "dst"), "edge_type", "src", "dst")
    assert got == [("CALLS", "q.A#m()", "q.B#m()"), ("CONTAINS_FILE", "p", "/r/A.java"), ("DECLARES", "q.A", "q.A#f"), ("DECLARES", "q.A", "q.A#m()"), ("DECLARES", "q.B", "q.B#m()"), ("DECLARES_TYPE", "/r/A.java", "q.A"), ("EXTENDS", "q.B", "q.A"), ("HAS_PACKAGE", "p", "q"), ("IN_PACKAGE", "q.A", "q"), ("OVERRIDES", "q.B#m()", "q.A#m()"), ("READS", "q.A#m()", "q.A#f"), ("RETURN_TYPE", "q.A#m()", "q.A"), ("RETURN_TYPE", "q.B#m()", "q.A")]


@pytest.mark.parametrize(("f", "t", "ok"), [(1, 1, False), (2, 1, True), (1, 2, True), (0, 5, False), (5, 0, False)])
def test_valid_commit(spark, f, t, ok):
    e = [("c", f"m{i}", f"f{i}", "NEW") for i in range(f)] + [("c", f"src/test/{i}", f"t{i}", "OLD") for i in range(t)]
    df = mining.commit_sets(mining.classify(spark.createDataFrame(e, "commit_id string, path string, element_name string, version string")))
    assert (df.where(mining.is_valid()).count() == 1) is ok


def test_coverage_prefix_and_overloads(spark):
    report = spark.createDataFrame([("p/C", "m", "(ILp/T;)V", 3), ("p/C", "m", "(J)V", 0), ("p/C", "<init>", "()V", 1)], "class string, method string, descriptor string, covered int")
    ids = spark.createDataFrame([("p.C.m(int,p.T)",), ("p.C.m(long)",), ("p.C.m()",), ("p.C()",), ("nodot",)], "method_id string")
    assert rows(mining.covered(report, ids), "method_id") == [("p.C.m()",), ("p.C.m(int,p.T)",)]


def test_coverage_xml(spark):
    x = '<class name="p/C"><method name="m" desc="()V"><counter type="INSTRUCTION" covered="4"/></method><method name="n" desc="()V"><counter type="LINE" covered="4"/></method></class>'
    got = facts.report_methods(spark.createDataFrame([(x,)], "xml string"))
    assert rows(got.select("class", "method", "covered"), "class", "method") == [("p/C", "m"), ("p/C", "n")]


@pytest.mark.parametrize("s", ["a\\b", 'q"q', "x\r\ny\tz", "\x01\x1f\x00", "é;日", "", "\\n", "tail\\"])
def test_codec_round_trip(spark, s):
    assert value(spark, X.csv_decode(X.csv_encode(F.lit(s)))) == s.replace("\r\n", "\n")


def test_names_and_paths(spark):
    assert value(spark, X.simple_name(F.lit("a.b.C"))) == "C" and value(spark, X.simple_name(F.lit(".C"))) == ".C"
    names = [(" package: a.b", "a.b"), ("FILE:x(y)", "x"), ("count: int", "count"), ("m(int)", "m"), ("(x) y", "(x) y"), (": int", ": int"), (None, "")]
    assert [value(spark, X.clean_name(F.lit(a))) for a, _ in names] == [b for _, b in names]
    short = [("a.b.C.m(int)", "m(...)"), ("m(x)", "m(...)"), ("plain", "plain"), ("a.m(java.lang.X)", "a.m(...)"), (None, "")]
    assert [value(spark, X.short_signature(F.lit(a))) for a, _ in short] == [b for _, b in short]
    assert value(spark, X.relative_path(F.lit("/r/p/a/B.java"), "/r/p")) == "a/B.java" and value(spark, X.relative_path(F.lit("/x"), "/r")) == "/x"
    loc = [("f", 3, 5, "m", "f:3-5::m"), ("f", 0, 0, "", "f"), ("f", 3, 3, None, "f:3"), ("f", 0, 7, " m ", "f:-7::m"), (None, 0, 0, "m", "m")]
    assert [value(spark, X.location(F.lit(p), F.lit(a), F.lit(b), F.lit(e))) for p, a, b, e, _ in loc] == [x[-1] for x in loc]
    assert value(spark, X.version_flow(F.lit("a"), F.lit(" "))) is None
    assert value(spark, X.versioned_id(F.lit(None).cast("string"), F.lit("V1"))).endswith("@V1") and value(spark, X.versioned_id(F.lit("a@V1"), F.lit("V1"))) == "a@V1"
    assert value(spark, X.doc_summary(F.lit("/** One two. Three\n * @param x */"))) == "One two."


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/gen/*.java", "/r/a/gen/X.java", True), ("gen/*.java", "/r/mygen/X.java", True), ("gen/*.java", "/r/a/gen/b/X.java", False), ("gen\\\\?.java", "/r/gen/X.java", True), ("gen/?.java", "/r/gen/XY.java", False), ("a{b}(c).java", "/a{b}(c).java", True), ("A.java", "/r/Axjava", False), ("**", "/anything", True)])
def test_globs(spark, glob, path, hit):
    glob = glob.replace("\\\\", "\\")
    assert value(spark, X.excluded(F.lit(path), "/r", [glob, ""])) is hit


def test_list_and_text_fields(spark):
    one = lambda *xs: value(spark, X.list_format(F.array(*map(F.lit, xs))))
    assert one("a;b", "c\\d", "x\n") == "a\\;b;c\\\\d;x\\n" and one("a,b") == '"a,b"' and value(spark, X.list_format(F.array().cast("array<string>"))) == ""
    assert [value(spark, X.property_text(F.lit(x))) for x in (None, "", "a", 'q"')] == ['""', '""', "a", '"q"""']
    kinds = {"callLocations": "string[]", "lineNumber": "int", "firstCallLine": "int", "occurrences": "int", "isFinal": "boolean", "hasX": "boolean", "confidence": "float", "name2": "string"}
    assert {k: X.header_type(k) for k in kinds} == kinds


def test_node_and_edge_lines(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "METHOD", "K", None, 'say "hi", x: int', {"size": "1", "gone": " "}, {"annotations": ["x", "y"]}, ["V1"], None, "V1", None), ("b", "FILE", None, "f", "File:f", {}, {}, None, None, None, None)], "node_id string, node_type string, kind string, name string, label string, props map<string,string>, lists map<string,array<string>>, versions array<string>, version_status string, first_version string, last_version string")
    header, lines = export.node_lines(nodes)
    assert header == ":ID,:LABEL,name,versionStatus:string,versions:string[],firstVersion:string,lastVersion:string,annotations:string[],size:string"
    assert rows(lines, "value") == [('a,METHOD;K,"say ""hi"", x",,V1,V1,,x;y,1',), ('b,FILE,f,,,,,"",""',)]
    plain, _ = export.node_lines(nodes.drop("versions"))
    assert plain == ":ID,:LABEL,name,annotations:string[],size:string"
    edges = spark.createDataFrame([("a", "b", "CALLS", {"callCount": "2"})], "src string, dst string, edge_type string, props map<string,string>")
    assert export.edge_lines(edges)[0] == ":START_ID,:END_ID,:TYPE,callCount:int" and export.edge_lines(edges)[1].first()["value"] == "a,b,CALLS,2"
    export.write_package(nodes, edges, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out/nodes/rows").count() == 2 and "Nodes: 2" in spark.read.text(f"{tmp_path}/out/readme").first()["value"]
    assert spark.read.text(f"{tmp_path}/out/script", wholetext=True).count() == 1 and "--skip-bad-relationships=true" in export.import_script("x")


def test_loads_and_tables(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "T"), ("a", "T"), ("b", "M")], "node_id string, node_type string")
    edges = spark.createDataFrame([("a", "b", "E"), ("a", "zz", "E")], "src string, dst string, edge_type string")
    n, e = graph.loads(nodes, edges)
    assert n.count() == 2 and rows(e, "dst") == [("b",)]
    for _ in range(2):
        export.write_tables(n, e, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t/nodes").count() == 2 and rows(spark.read.parquet(f"{tmp_path}/t/edges"), "src", "edge_type") == [("a", "E")]
    up = graph.Graph(nodes.withColumn("seq", F.lit(1)), edges).upsert(spark.createDataFrame([("a", "X", 2)], "node_id string, node_type string, seq int"), "seq")
    assert rows(up.node("a"), "node_type") == [("X",)] and rows(up.of_type("M"), "node_id") == [("b",)] and up.edges_of_type("E").count() == 2


def test_versions_of_nodes(spark):
    g = graph.Graph(spark.createDataFrame([("a", "ADDED", ["V1"]), ("b", None, ["V1", "V2"]), ("c", None, None)], "node_id string, version_status string, versions array<string>"), None)
    assert rows(g.with_status("ADDED"), "node_id") == [("a",)] and rows(g.in_version("V1"), "node_id") == [("a",), ("b",)] and g.is_evolution().first()[0]
    more = spark.createDataFrame([("a", ["V2"]), ("c", ["V0"])], "node_id string, versions array<string>")
    assert rows(graph.with_versions(g.nodes, more), "node_id", "versions") == [("a", ["V1", "V2"]), ("b", ["V1", "V2"]), ("c", ["V0"])]
    assert rows(graph.with_versions(g.nodes, more, replace=True), "node_id", "versions")[0] == ("a", ["V2"])


def test_batches_go_out_whole(spark, tmp_path):
    def send(batch):
        import json
        import uuid

        with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as f:
            json.dump(batch, f)

    import json

    assert export.write_batches(spark.range(25).repartition(2), send, size=10) == 25
    sent = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert sorted(r["id"] for b in sent for r in b) == list(range(25)) and max(map(len, sent)) == 10


def test_record_files(spark, tmp_path):
    e = '[{"commit_id": "c1", "changed_methods": {"A.java": [{"element_name": "m", "element_type": "METHOD", "start_line": 1, "end_line": 2, "version": "NEW"}]}, "changed_classes": {}, "changed_constructors": null}]'
    (tmp_path / "proj.json").write_text(e)
    r = facts.read_json_records(spark, f"{tmp_path}/*.json", facts.CHANGE_RECORD)
    assert rows(r, "project", "commit_id") == [("proj", "c1")] and rows(facts.changed_elements(r), "path", "element_name", "version") == [("A.java", "m", "NEW")]
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "p2.json").write_text('[{"commit": {"sha1": "c9"}, "focal_methods": {"new": ["a"], "old": []}, "test_methods": {"new": [], "old": ["t"]}}]')
    assert [tuple(x) for x in facts.read_json_records(spark, f"{tmp_path}/v/*.json", facts.VALID_COMMIT).select("commit.sha1", "test_methods.old", "project").collect()] == [("c9", ["t"], "p2")]
    (tmp_path / "list.txt").write_text("repo1\n\n  repo2  \n")
    assert rows(facts.read_lines(spark, f"{tmp_path}/list.txt"), "value") == [("repo1",), ("repo2",)]
    (tmp_path / "ns.txt").write_text("A\ta.java\nM\tb.java\nbroken\n")
    assert rows(facts.name_status(facts.read_lines(spark, f"{tmp_path}/ns.txt")), "status", "path") == [("A", "a.java"), ("M", "b.java")]
    (tmp_path / "r.jsonl").write_text('{"ref_id": 1, "type": "MOVE_METHOD", "left": [{"file_path": "A.java", "start_line": 1, "end_line": 2}]}\n')
    got = facts.read_refactorings(spark, f"{tmp_path}/r.jsonl").first()
    assert got["confidence"] == 1.0 and got["right"] == [] and got["left"][0]["file_path"] == "A.java"
    sets = spark.createDataFrame([("p", "c", ["a"], [], [], ["t"])], "project string, commit_id string, focal_new array<string>, focal_old array<string>, test_new array<string>, test_old array<string>")
    export.write_json(export.valid_commit_records(sets), f"{tmp_path}/valid", "project")
    assert spark.read.json(f"{tmp_path}/valid/project=p").first()["commit"]["sha1"] == "c"


def test_progress_is_kept(spark, tmp_path):
    assert export.load_progress(spark, f"{tmp_path}/none").count() == 0
    p = spark.createDataFrame([("p", "running", ["c1"], 1, 1.0, 2.0, 9, 1, None, None, 11.1)], facts.PROGRESS)
    export.save_progress(p, f"{tmp_path}/progress")
    back = export.load_progress(spark, f"{tmp_path}/progress")
    assert rows(back, "project_name", "current_index", "successful_commits") == [("p", 1, 1)]
    c = spark.createDataFrame([("p", i, f"c{i}") for i in range(4)], "project string, idx int, commit_id string")
    assert rows(mining.remaining(c, back), "commit_id", "recount") == [("c1", True), ("c2", False), ("c3", False)]
    assert rows(mining.remaining(c, back, parity=False), "commit_id") == [("c2",), ("c3",)]


def test_config():
    c = facts.Config.read("# note\nanalysis.mode = multi_evolution\nproject.path=/r/proj/\nevolution.historyWindow=0\nevolution.timeline.strategy=file_based\nother=1\n", commit="abc")
    assert (c.mode, c.project_name, c.history_window, c.commit, c.max_depth, c.effective_strategy) == ("MULTI_EVOLUTION", "proj", 0, "abc", 50, "LINEAR")
    assert c.problems() == ["the history window must be 1 or more"] and facts.Config.read().problems() == ["no project path"]
    assert facts.Config.read(project_path="/x", mode="EVOLUTION").problems() == ["no commit to analyse"]


def test_test_classes_and_docs(spark):
    assert [value(spark, X.is_test_class(F.lit(n))) for n in ("FooTest", "Tests", "TestFoo", "MyTestCaseX", "Foo")] == [True, True, True, True, False]
    assert value(spark, X.is_test_method(F.array(F.lit("org.junit.Test")), F.lit("x"))) and value(spark, X.is_test_method(F.array().cast("array<string>"), F.lit("a/src/test/b"))) and not value(spark, X.is_test_method(F.array(F.lit("Override")), F.lit("x")))
    assert value(spark, X.strip_doc(F.lit("/** doc */\n  class A"))) == "class A" and value(spark, X.strip_doc(F.lit("class A"))) == "class A"


def test_constructors_are_not_covered_by_default(spark):
    report = spark.createDataFrame([("p/C", "<init>", "(I)V", 1)], "class string, method string, descriptor string, covered int")
    ids = spark.createDataFrame([("p.C(int)",), ("p.C(long)",)], "method_id string")
    assert mining.covered(report, ids).count() == 0 and rows(mining.covered(report, ids, constructors=True), "method_id") == [("p.C(int)",)]


def test_stream_upsert_matches_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, seq int, v string")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest.upsert_batches(stream(), f"{tmp_path}/out", "k", "seq", f"{tmp_path}/cp")
    assert rows(ingest.latest(spark, f"{tmp_path}/out", df.schema), "k", "v") == [(1, "b"), (2, "c")]
    spark.createDataFrame([(2, 5, "z"), (3, 1, "n")], df.schema).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.upsert_batches(stream(), f"{tmp_path}/out", "k", "seq", f"{tmp_path}/cp")
    assert rows(ingest.latest(spark, f"{tmp_path}/out", df.schema), "k", "v") == [(1, "b"), (2, "z"), (3, "n")]


def test_streams_resume(spark, tmp_path):
    import datetime as dt

    at = lambda h, d=1: dt.datetime(2024, 1, d, h)
    schema = "user_id long, ts timestamp_ntz, event_type string"
    put = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put((1, at(1), "a"), (1, at(2), "b"), (2, at(1), "a"))
    read = lambda: ingest.event_stream(spark, f"{tmp_path}/in")
    assert rows(ingest.drain(ingest.counts(read()), f"{tmp_path}/c"), "event_type", "n") == [("a", 2), ("b", 1)]
    put((3, at(1, 9), "a"))
    assert rows(ingest.drain(ingest.counts(read()), f"{tmp_path}/c"), "event_type", "n") == [("a", 3), ("b", 1)]
    win = lambda: ingest.windows(read(), "1 hour", late="1 hour")
    first = ingest.drain(win(), f"{tmp_path}/w", "append")
    assert first.where("event_type = 'a'").agg(F.sum("n")).first()[0] == 2  # the newest window is still open
    put((4, at(3), "a"), (5, at(5, 20), "a"))  # one far behind the newest event, one ahead
    late = ingest.drain(win(), f"{tmp_path}/w", "append")
    assert late.where("event_type = 'a'").agg(F.sum("n")).first()[0] == 3


def test_tracked_state_goes_on(spark, tmp_path):
    schema = "base_id string, seq long, status string"
    put = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = lambda: ingest.tracked(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    put(("a", 1, "UNCHANGED"), ("a", 2, "MODIFIED"), ("a", 3, "UNCHANGED"), ("b", 1, "UNCHANGED"))
    assert rows(ingest.drain(read(), f"{tmp_path}/s", "append"), "base_id", "seq", "tracked") == [("a", 1, False), ("a", 2, False), ("a", 3, True), ("b", 1, False)]
    put(("a", 4, "UNCHANGED"), ("b", 2, "UNCHANGED"))
    assert rows(ingest.drain(read(), f"{tmp_path}/s", "append"), "base_id", "seq", "tracked")[-3:] == [("a", 4, True), ("b", 1, False), ("b", 2, False)]
