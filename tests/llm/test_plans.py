"""Plans that only matter on larger tables."""

from lodegraph.llm import spelling
from lodegraph.llm.runtime import Scratch


def test_spelling_tables_are_not_broadcast(spark):
    scratch = Scratch(spark, "test")
    words = spark.createDataFrame([("hello", 9), ("hallo", 3), ("hullo", 1)], "word string, n long")
    plans, write = [], scratch.write

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    scratch.write = watched
    found = spelling.variants(words, scratch)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
    assert {(r["word"], r["form"], r["root"]) for r in found.collect()} == {("hello", None, "hello"), ("hallo", "hello", "hello"), ("hullo", "hello", "hello")}
