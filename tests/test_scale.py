"""Cases that only larger tables meet."""

from pyspark.sql import functions as F

from lodegraph.functions import exprs as X
from lodegraph.operators import graph
from lodegraph.sources.tables import Tables


def test_sizes_stop_at_the_largest_unit(spark):
    n = spark.createDataFrame([(1023,), (1024,), (1 << 20,), (5590068,), (3 << 30,)], "n long")
    got = [tuple(r) for r in n.select(X.byte_size(F.col("n"), "KB"), X.byte_size(F.col("n")), X.byte_size(F.col("n"), "B")).collect()]
    assert got == [("1023B", "1023B", "1023B"), ("1.0KB", "1.0KB", "1024B"), ("1024.0KB", "1.0MB", "1048576B"), ("5459.1KB", "5.3MB", "5590068B"), ("3145728.0KB", "3.00GB", "3221225472B")]


def test_report_sizes_of_large_ids(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(1023,), (1 << 20,), (5590068,)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["size"] for r in entry.queries()["report_formats"](spark, str(tmp_path)).collect()}
    assert got == {1023: "1023B", 1 << 20: "1024.0KB", 5590068: "5459.1KB"}


def test_written_tables_are_not_broadcast(spark):
    """A step of a timeline joins some twenty written tables; none of them may be built whole on the driver."""
    tables = Tables(spark, "test")
    a, b = (tables.write(spark.range(10).withColumn("x", F.lit(1)), n) for n in ("a", "b"))
    both = a.where("x = 1").select("id").join(b.groupBy("id").agg(F.max("x").alias("x")), "id").join(b.select("id", F.col("x").alias("y")), "id", "left_anti")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
    assert "BroadcastHashJoin" in a.join(F.broadcast(b), "id")._jdf.queryExecution().executedPlan().toString()


def test_starts_of_one_part_of_a_graph_share_blocks(spark):
    """Masks grow with the reach of starts, not with the product of starts and nodes."""
    parts, size, d = 8, 64, 3
    ring = [(f"{p}_{i}", f"{p}_{(i + 1) % size}") for p in range(parts) for i in range(size)]
    chord = [(f"{p}_{i}", f"{p}_{(i * 7 + 3) % size}") for p in range(parts) for i in range(size)]
    edges, starts = spark.createDataFrame(ring + chord, "src string, dst string"), spark.createDataFrame([(a,) for a, _ in ring] + [("alone",)], "node_id string")
    tables = Tables(spark, "test")
    dealt = tables.write(graph.start_bits(starts, graph.reach_labels(edges, size, tables)), "starts")
    assert dealt.count() == dealt.select("block", "bit").distinct().count() == parts * size + 1
    near = graph.reach_bits(edges, dealt, d, tables).count()
    far = graph.reach_bits(edges, tables.write(graph.start_bits(starts), "starts"), d, tables).count()
    assert 2 * near < far
    rows = graph.reach(edges, starts, d).collect()
    up = {}
    for a, b in ring + chord:
        up.setdefault(b, set()).add(a)
    want = set()
    for s in [a for a, _ in ring] + ["alone"]:
        met, front = {s: 0}, {s}
        for i in range(1, d + 1):
            front = {u for x in front for u in up.get(x, ())} - met.keys()
            met |= dict.fromkeys(front, i)
        want |= {(s, x, i) for x, i in met.items()}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    counts = {r["depth"]: (r["n"], r["nodes"], r["starts"]) for r in graph.reach_counts(edges, starts, d).collect()}
    assert counts == {i: (len(x := [r for r in want if r[2] == i]), len({r[1] for r in x}), len({r[0] for r in x})) for i in range(d + 1)}


def test_spread_grows_in_partitions_and_not_in_rows(spark):
    """Calls of few small columns are dealt by the size of their input, also where a join's size is overrated."""
    from lodegraph.sources.tables import SPREAD, spread

    least = 2 * spark.sparkContext.defaultParallelism
    few, many = spark.range(1000), spark.range(4 * least * (SPREAD // 8))
    assert spread(few, "id").rdd.getNumPartitions() == least
    assert spread(many, "id").rdd.getNumPartitions() == spread(few, "id", like=many).rdd.getNumPartitions() == 4 * least


def test_facts_of_two_versions_are_read_once(spark):
    """The merge reads nodes, edges and refactorings in many steps; it once made them anew from their sources in each."""
    from lodegraph.operators import evolve
    from lodegraph.sources import facts
    from tests.test_operators import REFS, code

    def from_range(g):
        both = lambda df: df.join(spark.range(1).withColumnRenamed("id", "made"), F.lit(True), "cross").drop("made")
        return graph.Graph(both(g.nodes), both(g.edges))

    g1, g2 = (from_range(code(spark, [("T", "TYPE", "t", 0), ("m", "METHOD", s, 10)], [("T", "m", "DECLARES"), ("m", "m", "CALLS")])) for s in ("a", "b"))
    assert "Range (" in g1.nodes._jdf.queryExecution().optimizedPlan().toString()
    m = evolve.analyse(g1, g2, spark.createDataFrame([], REFS), spark.createDataFrame([], facts.HUNK))
    for t in (m.nodes, m.edges, m.evolution, evolve.counters(m)):
        assert "Range (" not in t._jdf.queryExecution().optimizedPlan().toString()
    counts = {(r["what"], r["kind"]): r["n"] for r in evolve.counters(m).collect()}
    assert counts["edge", "CALLS"] == counts["call", "V1"] + counts["call", "V2"] and counts["node", "MODIFIED"] == 2


def test_dealt_sides_are_not_broadcast(spark):
    """A small table of nodes becomes many rows, one for each path end and bin; the planner counts those of the table and would build them all on the driver."""
    from lodegraph.operators import locate

    at = spark.range(100).select(F.concat(F.lit("F"), F.col("id") % 9, F.lit(".java")).alias("path"), F.col("id").alias("lo"), (F.col("id") + 5).alias("hi"))
    nodes = spark.range(50).select(F.concat(F.lit("n"), "id").alias("node_id"), F.lit("METHOD").alias("node_type"), F.lit(None).cast("string").alias("relative_path"), F.concat(F.lit("/r/s/F"), F.col("id") % 9, F.lit(".java")).alias("absolute_path"), (F.col("id") * 2 + 1).alias("line_start"), (F.col("id") * 2 + 2).alias("line_end"))
    found = locate.located(nodes, at)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    want = {(f"n{n}", lo) for lo in range(100) for n in range(50) if n % 9 == lo % 9 and lo - 2 <= 2 * n + 4 and lo + 7 >= 2 * n - 1}
    got = [(r["node_id"], r["lo"]) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_masks_are_dealt_before_edges_open(spark):
    """A step's exchanges hold masks and lists of ends: an edge with a mask is not shuffled, whatever the length of a list."""
    ends = graph.LIST + 44
    edges = spark.createDataFrame([(f"u{i}", "hub") for i in range(ends)] + [(f"v{i}", f"u{i}") for i in range(50)] + [("hub", "v7")], "src string, dst string")
    starts = spark.createDataFrame([("hub",)] + [(f"u{i}",) for i in range(50)], "node_id string")
    tables = Tables(spark, "test")
    dealt = tables.write(graph.start_bits(starts), "starts")
    lists = graph._lists(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("up")), tables)
    assert sorted(len(r["ups"]) for r in lists.where("node_id = 'hub'").collect()) == [44, graph.LIST]
    steps = graph.reach_wide(edges, dealt, 3, tables)
    sent = graph._either(graph._sent(steps[0], lists), ["wide", "node_id"])
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(ups") < plan.index("Exchange hashpartitioning(wide")
    assert plan.count("Exchange hashpartitioning(wide") == 1 and sent.count() == ends + 50
    assert [x.count() for x in steps[:2]] == [51, ends + 50]
    bits = {(r["block"], r["bit"]): r["start"] for r in dealt.collect()}
    got = {(bits[r["wide"] * graph.WORDS + i, j], r["node_id"], d) for d, x in enumerate(steps) for r in x.collect() for i, m in enumerate(r["m"]) for j in range(64) if m >> j & 1}
    want = {("hub", "hub", 0)} | {("hub", f"u{i}", 1) for i in range(ends)} | {("hub", f"v{i}", 2) for i in range(50)}  # v7 calls u7, and hub calls v7
    assert {x for x in got if x[0] == "hub"} == want
    assert {x for x in got if x[0] == "u7"} == {("u7", "u7", 0), ("u7", "v7", 1), ("u7", "hub", 2)} | {("u7", f"u{i}", 3) for i in range(ends) if i != 7}
