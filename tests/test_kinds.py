"""Pairs of kinds give what pairs of methods give, without a table of pairs."""

import random

from pyspark.sql import functions as F

from lodegraph.operators import versions
from tests.test_operators import rows
from tests.test_similar import METHOD, methods


def test_kinds_give_the_pairs_and_matches_of_all_methods(spark, monkeypatch):
    rng = random.Random(8)
    # Few kinds and many copies of each.
    a, b = ([(f"{p}{i}", *rng.choice(some)[1:]) for i in range(60)] for p, some in (("a", methods(rng, 7, "k")), ("b", methods(rng, 7, "k"))))
    one, two = (spark.createDataFrame(x, METHOD).fillna({"lines_of_code": 3}) for x in (a, b))
    met = one.alias("a").join(two.alias("b"), F.col("a.node_type") == F.col("b.node_type"))
    want = met.select(F.col("a.node_id").alias("v1_id"), F.col("b.node_id").alias("v2_id"), F.round(versions.structural_score(), 6).alias("score"))
    kinds = versions.structural_kinds(one, two, ["node_type"])
    got = kinds.pairs()
    assert rows(got, "v1_id", "v2_id", "score") == rows(want, "v1_id", "v2_id", "score") and kinds.scores.count() <= 49
    written = []
    write = versions.Tables.write
    monkeypatch.setattr(versions.Tables, "write", lambda self, df, name: written.append(out := write(self, df, name)) or out)
    for threshold in (0.3, 0.5, 2.0):
        found = rows(versions.best_mutual_kinds(kinds, threshold), "v1_id", "v2_id", "score")
        assert max(x.count() for x in written) <= 60
        assert found == rows(versions.best_mutual(want, threshold), "v1_id", "v2_id", "score")
        written.clear()
