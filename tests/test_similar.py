"""Similarity joins and traversals against all pairs and plain searches."""

import random
from itertools import product

import pytest

from lodegraph.operators import graph, similar, versions
from tests.test_operators import rows

METHOD = "node_id string, node_type string, signature string, source_code string, lines_of_code int, complexity int, called_methods array<string>, accessed_fields array<string>, local_variables array<string>"


def methods(rng, n, p):
    some = lambda k, c, top: [f"{c}{min(rng.randrange(top), rng.randrange(top))}" for _ in range(rng.randrange(k))]
    return [(f"{p}{i}", "METHOD", f"{p}s{i}", "x", rng.choice([None, 0, 3, 3, 4, 5, 10, 11, 40]), rng.choice([0, 1, 1, 2, 3]), some(6, "m", 12), some(4, "f", 6), some(4, "v", 9)) for i in range(n)]


def score(a, b):
    ratio = lambda x, y: 1 - abs(x - y) / max(x, y) if (x or 0) > 0 and (y or 0) > 0 else 0
    alike = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else 0
    return round(0.2 * ratio(a[4], b[4]) + 0.2 * ratio(a[5], b[5]) + 0.3 * alike(a[6], b[6]) + 0.2 * alike(a[7], b[7]) + 0.1 * ratio(len(a[8]), len(b[8])), 6)


@pytest.mark.parametrize("threshold", [0.5, 0.62])
def test_structural_candidates_are_all_pairs(spark, threshold):
    rng = random.Random(3)
    a, b = methods(rng, 120, "a"), methods(rng, 120, "b")
    got = {(r["v1_id"], r["v2_id"]): r["score"] for r in similar.structural_candidates(spark.createDataFrame(a, METHOD), spark.createDataFrame(b, METHOD), threshold).collect()}
    share = lambda x, y: set(x[6]) & set(y[6]) or set(x[7]) & set(y[7])
    want = {(x[0], y[0]): score(x, y) for x, y in product(a, b) if share(x, y) and score(x, y) >= threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and len(want) > 50


def test_renamed_methods_match_themselves(spark):
    rng = random.Random(4)
    a, b = methods(rng, 60, "a"), methods(rng, 60, "b")
    got = {r["v1_id"]: (r["v2_id"], r["confidence"]) for r in versions.match_all(spark.createDataFrame(a, METHOD), spark.createDataFrame(b, METHOD), [similar.StructuralJoin()]).collect()}
    left, right = {x[0]: x for x in a}, {y[0]: y for y in b}
    assert len({v for v, _ in got.values()}) == len(got)
    assert all(abs(score(left[k], right[v]) - c) < 2e-6 and c >= 0.5 for k, (v, c) in got.items())
    # Nothing is left that could still be matched.
    free = [(x, y) for x, y in product(a, b) if x[0] not in got and y[0] not in {v for v, _ in got.values()} and score(x, y) >= 0.5]
    assert not free and len(got) > 20


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.8, 0.75])
def test_similar_methods_are_all_pairs(spark, threshold):
    rng = random.Random(5)
    make = lambda p: [(f"{p}{i}", rng.choice(["getName", "getNames", "setName", "name", "x", "", "toStringValue"]), rng.choice(["()", "(int)"]), rng.sample("abcde", rng.randrange(5)), rng.sample("uvw", rng.randrange(3))) for i in range(70)]
    a, b = make("a"), make("b")
    schema = "node_id string, name string, signature string, code array<string>, calls array<string>"
    alike = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0

    def plain(x, y):
        return round(0.3 * (1 - levenshtein(x[1], y[1]) / max(len(x[1]), len(y[1]), 1)) + 0.2 * (x[2] == y[2]) + 0.3 * alike(x[3], y[3]) + 0.2 * alike(x[4], y[4]), 6)

    got = {(r["v1_id"], r["v2_id"]): r["score"] for r in similar.similar_methods(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), threshold).collect()}
    want = {(x[0], y[0]): plain(x, y) for x, y in product(a, b) if plain(x, y) > threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and len(want) > 20


def walk(edges, source, target, depth):
    out = []

    def go(path):
        if path[-1] == target:
            out.append(path)
        elif len(path) <= depth:
            for s, d in edges:
                if s == path[-1] and d not in path:
                    go([*path, d])

    go([source])
    return sorted(out)


@pytest.mark.parametrize("depth", [1, 2, 5, 6])
def test_paths_from_both_ends(spark, depth):
    rng = random.Random(depth)
    edges = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(28)]
    df, start = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("n0",), ("n1",), ("n8",)], "node_id string")
    want = sorted(p for s in ("n0", "n1", "n8") for p in walk(edges, s, "n8", depth))
    assert sorted(r["path"] for r in graph.simple_paths(df, start, "n8", depth).collect()) == want
    assert sorted(r["path"] for r in graph.simple_paths_recursive(df, start, "n8", depth).collect()) == want


def test_reach_by_bits(spark):
    """More starts than a mask has bits; rows a step stay within nodes times blocks."""
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(330)]
    df, start = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(f"n{i}",) for i in range(140)], "node_id string")
    want = []
    for s in range(140):
        seen, front = {f"n{s}": 0}, {f"n{s}"}
        for d in (1, 2, 3):
            front = {a for a, b in edges if b in front} - seen.keys()
            seen |= dict.fromkeys(front, d)
        want += [(f"n{s}", n, d) for n, d in seen.items()]
    assert rows(graph.reach(df, start, 3), "start", "node_id", "depth") == sorted(want)
    from lodegraph.sources.tables import Tables

    starts = graph.start_bits(start)
    assert starts.select("block").distinct().count() == 3 and graph.reach_bits(df, starts, 3, Tables(spark, "t")).where("depth = 3").count() <= 150 * 3


def test_contexts_of_many(spark):
    cols = "node_id string, node_type string, name string, label string, relative_path string, semantic_summary string, documentation string, comments string, source_code string"
    nodes = spark.createDataFrame([(n, "TYPE", n, n, None, f"sum {n}", None, None, None) for n in "abcd"], cols)
    edges = spark.createDataFrame([("a", "b", "CALLS", "first"), ("b", "c", "CALLS", None), ("c", "a", "CALLS", "back"), ("b", "d", "READS", "reads d"), ("a", "gone", "CALLS", None)], "src string, dst string, edge_type string, description string")
    starts = spark.createDataFrame([("a",), ("c",), ("d",), ("zz",), (None,)], "node_id string")
    got = {r["node_id"]: r["context"] for r in graph.contexts(nodes, edges, starts, 2).collect()}
    assert set(got) == {"a", "c", "d", "zz"} and got["zz"] == "Node not found: zz"
    assert got["a"].split("========== NEIGHBORS ==========\n")[1] == "\n--- CALLS --> b ---\nRelationship: first\nsum b\n\n--- CALLS --> c ---\nsum c\n\n--- READS --> d ---\nRelationship: reads d\nsum d\n"
    assert got["d"].endswith("========== NEIGHBORS ==========\n") and "Relationship: back" in got["c"]
    assert graph.contexts(nodes, edges, starts, 0).where("node_id = 'a'").first()["context"].startswith("========== MAIN NODE")
    assert graph.context(nodes, edges, "a", 2).first()["context"] == got["a"]
