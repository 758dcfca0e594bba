"""Similarity joins shuffle rows, not pairs, and meet by tokens that pairs must share."""

from lodegraph.operators import similar
from tests.test_similar import METHOD


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_structural_pairs_are_never_shuffled(spark):
    both = [("x", "METHOD", "s", "c", 4, 1, ["m"], ["f", None], ["v"])]
    got = similar.structural_candidates(spark.createDataFrame(both, METHOD), spark.createDataFrame(both, METHOD))
    assert [tuple(r) for r in got.collect()] == [("x", "x", 1.0)]
    text = plan(got)
    assert text.count("Exchange hashpartitioning") == 2 and "Aggregate" not in text and "Broadcast" not in text


def test_pairs_above_0_8_meet_by_calls(spark):
    schema = "node_id string, name string, signature string, code array<string>, calls array<string>"
    # All share their code and signature; those without a common call could reach 0.8, but not exceed it.
    a = spark.createDataFrame([(f"a{i}", "n", "()", ["c"], [f"x{i}"]) for i in range(40)] + [("ae", "n", "()", [], [])], schema)
    b = spark.createDataFrame([(f"b{i}", "n", "()", ["c"], [f"x{i}"]) for i in range(40)] + [("be", "n", "()", [], [])], schema)
    got = similar.similar_methods(a, b)
    assert {tuple(r) for r in got.collect()} == {(f"a{i}", f"b{i}", 1.0) for i in [*range(40), "e"]}
    text = plan(got)
    assert "calls" in text[text.index("SortMergeJoin") :] and text[: text.index("SortMergeJoin")].count("Exchange") == 0
