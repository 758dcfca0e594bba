"""State taken over from a batch, a transactional sink, bucketed tables, statements."""

import os

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import export
from lodegraph.sources import sink
from lodegraph.streaming import ingest
from tests.test_operators import rows


def test_state_of_a_batch_goes_on_in_a_stream(spark, tmp_path):
    schema = "base_id string, seq long, version string, status string"
    every = [("a", 1, "V-3", "UNCHANGED"), ("b", 1, "V-3", "MODIFIED"), ("a", 2, "V-2", "MODIFIED"), ("c", 2, "V-2", "ADDED"), ("a", 3, "V-1", "UNCHANGED"), ("b", 3, "V-1", "UNCHANGED"), ("d", 3, "V-1", "UNCHANGED"), ("a", 4, "V0", "UNCHANGED"), ("d", 4, "V0", "UNCHANGED")]
    want = {}
    for i, s, v, _ in every:
        before = [e for e in every if e[0] == i and e[1] < s]
        want[(i, s)] = (any(e[3] != "UNCHANGED" for e in before), len({e[2] for e in before} | {v}))
    first = spark.createDataFrame([e for e in every if e[1] <= 2], schema)
    put = lambda r: spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: ingest.drain(ingest.tracked_versions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), first), f"{tmp_path}/s", "append")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with ingest.rocksdb_state(spark):
        put([e for e in every if e[1] == 3])
        run()
        put([e for e in every if e[1] == 4])
        got = {(r["base_id"], r["seq"]): (r["tracked"], r["versions"]) for r in run().collect()}
    assert got == {k: v for k, v in want.items() if k[1] > 2} and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


SCHEMA = "node_id string, n int"


def test_sink_shows_what_is_committed(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    nodes = spark.range(50).select(F.concat(F.lit("n"), "id").alias("node_id"), F.col("id").cast("int").alias("n")).repartition(4)
    assert sink.read(spark, path, SCHEMA).count() == 0
    sink.write(nodes, path, batch_size=7)
    assert rows(sink.read(spark, path, SCHEMA), "n") == [(i,) for i in range(50)]
    m = sink.manifests(spark, path).first()
    assert m["rows"] == 50 and m["batches"] >= 8
    # A job that fails in one task leaves nothing behind that a reader sees.
    bad = nodes.repartitionByRange(4, "n").select("node_id", F.when(F.col("n") == 30, F.raise_error(F.lit("no"))).otherwise(F.col("n")).cast("int").alias("n"))
    with pytest.raises(Exception, match="no"):
        sink.write(bad, path)
    assert sink.read(spark, path, SCHEMA).count() == 50
    # Files that no commit names, such as those of an attempt that came too late, are not read.
    (tmp_path / "t" / "data" / "late.json").write_text('{"node_id": "x", "n": 999}\n')
    sink.write(nodes.limit(3), path)
    assert sink.read(spark, path, SCHEMA).count() == 53
    sink.write(nodes.limit(2), path, overwrite=True)
    assert sink.read(spark, path, SCHEMA).count() == 2
    assert sink.vacuum(spark, path) >= 6 and sink.read(spark, path, SCHEMA).count() == 2 and sink.vacuum(spark, path) == 0
    assert all("late" not in f for f in os.listdir(f"{tmp_path}/t/data"))


def test_graph_goes_out_nodes_first_without_loose_edges(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], SCHEMA)
    edges = spark.createDataFrame([("a", "b"), ("a", "gone")], "src string, dst string")
    sink.write_graph(nodes, edges, f"file://{tmp_path}/g")
    assert rows(sink.read(spark, f"file://{tmp_path}/g/nodes", SCHEMA), "node_id", "n") == [("a", 1), ("b", 3)]
    assert rows(sink.read(spark, f"file://{tmp_path}/g/edges", "src string, dst string"), "src", "dst") == [("a", "b")]


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    nodes = spark.range(200).select(F.concat(F.lit("n"), "id").alias("node_id"), F.lit("METHOD").alias("node_type"))
    edges = spark.range(400).select(F.concat(F.lit("n"), F.col("id") % 200).alias("src"), F.concat(F.lit("n"), F.col("id") * 7 % 230).alias("dst"))
    export.save_bucketed(nodes, edges, "graph_of_test", buckets=8, path=str(tmp_path))
    try:
        for incoming, n in ((False, 400), (True, sum(i * 7 % 230 < 200 for i in range(400)))):
            out = export.bucketed_neighbors(spark, "graph_of_test", incoming)
            assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == n
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells of its buckets
        one = spark.table("graph_of_test_out").where("src = 'n17'")
        assert "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 2
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        for t in ("nodes", "out", "in"):
            spark.sql(f"drop table if exists graph_of_test_{t}")


def test_statements_with_properties(spark):
    nodes = spark.createDataFrame([("m", "METHOD", "it's()", 3, True, 0.5, ["a", None, "b"], None), ("t", "TYPE", None, None, None, None, [], "x")], "node_id string, node_type string, signature string, lines int, is_static boolean, weight double, annotations array<string>, note string")
    got = dict(rows(export.node_statements(nodes, ["lines", "is_static", "weight", "annotations", "note"]), "node_id", "statement"))
    assert got["m"] == "CREATE (n:METHOD {key: 'it\\'s()', lines: 3, is_static: true, weight: 0.5, annotations: ['a', 'b']})"
    assert got["t"] == "CREATE (n:TYPE {key: 't', annotations: [], note: 'x'})"
    edges = spark.createDataFrame([("m", "t", "CALLS", 4)], "src string, dst string, edge_type string, line int")
    assert export.statements(export.resolve_endpoints(edges, nodes), ["line"]).first()["statement"].endswith(" CREATE (src)-[:CALLS {line: 4}]->(dst)")


def test_tables_go_when_their_block_ends(spark):
    from lodegraph.sources.tables import Tables, closing

    kept = Tables(spark, "kept")
    kept.write(spark.range(3), "t")
    with closing(spark):
        gone = Tables(spark, "gone")
        assert gone.write(spark.range(3), "t").count() == 3
    assert not os.path.exists(gone.base.removeprefix("file://")) and os.path.exists(kept.base.removeprefix("file://"))
    kept.close()


def test_test_classes(spark):
    from lodegraph.operators import mining

    types = spark.createDataFrame([("a", "ATest", None, None), ("b", "B", ["org.x.RunWith"], None), ("c", "C", [], "/r/src/test/C.java"), ("d", "D", [], "/r/src/main/D.java"), ("e", "E", None, "/r/src/test/E.java"), ("f", None, None, None)], "node_id string, name string, annotations array<string>, path string")
    methods = spark.createDataFrame([("c", ["org.junit.Test"]), ("d", ["org.junit.Test"]), ("e", ["Override"]), ("base", ["x.Test"])], "declaring_type string, annotations array<string>")
    assert rows(mining.test_classes(types, methods), "node_id", "reason") == [("a", "name"), ("b", "annotation"), ("c", "path")]
    above = spark.createDataFrame([("e", "base")], "node_id string, ancestor string")
    assert rows(mining.test_classes(types, methods, above), "node_id", "reason")[-1] == ("e", "path")
