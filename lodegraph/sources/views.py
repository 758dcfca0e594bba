"""The driver tables seen as facts about code: ids carry a one-letter prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.operators.graph import Graph
from lodegraph.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pid(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are methods (urgent ones tests); parts are methods too (small ones constructors, large ones tests), every second size in a test folder."""
    test = F.startswith("o_orderpriority", F.lit("1-"))
    o = table(spark, sf_dir, "orders").select(pid("O", "o_orderkey").alias("node_id"), F.when(test, "TEST_METHOD").otherwise("SOURCE_METHOD").alias("kind"), F.col("o_orderpriority").alias("name"), F.lit("/r/src/main/O.java").alias("absolute_path"))
    kind = F.when(F.col("p_size") <= 5, "CONSTRUCTOR").when(F.col("p_size") > 45, "TEST_METHOD").otherwise("SOURCE_METHOD")
    path = F.when(F.col("p_size") % 2 == 0, "/r/src/test/P.java").otherwise("/r/src/main/P.java")
    p = table(spark, sf_dir, "part").select(pid("P", "p_partkey").alias("node_id"), kind.alias("kind"), F.col("p_name").alias("name"), path.alias("absolute_path"))
    return o.unionByName(p)


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in code: order to part at a line."""
    return table(spark, sf_dir, "lineitem").select(pid("O", "l_orderkey").alias("src"), pid("P", "l_partkey").alias("dst"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", "CONSTRUCTOR").otherwise("INVOCATION").alias("occ_kind"), F.col("l_linestatus").alias("access"))


def dense_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(pid("U", "user_id").alias("src"), F.col("event_type").alias("dst"), F.hour("ts").alias("line"), F.col("event_type").alias("occ_kind"))


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges from each part to the next in its order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem")
    prev = spread(lines, "l_orderkey").select("l_partkey", F.lag("l_partkey").over(w).alias("prev"))
    edges = prev.where("prev is not null and prev <> l_partkey").select(pid("P", "prev").alias("src"), pid("P", "l_partkey").alias("dst"))
    return spread(edges, "src", "dst", like=lines).distinct()


def version(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """Parts sold in a year; their "source" is how many lines they have."""
    lines = table(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == year)
    return lines.groupBy("l_partkey").agg(F.count("*").alias("source")).select(pid("P", "l_partkey").alias("node_id"), F.col("source"))


def versions(spark: SparkSession, sf_dir: str, first: int = 1995, last: int = 1998) -> DataFrame:
    """One row a (year, part): the whole timeline in one pass."""
    lines = table(spark, sf_dir, "lineitem").withColumn("yr", F.year("l_shipdate")).where(F.col("yr").between(first, last))
    return lines.groupBy("yr", "l_partkey").agg(F.count("*").alias("source")).select("yr", pid("P", "l_partkey").alias("node_id"), "source")


def version_edges(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.year("l_shipdate") == year).select(pid("S", "l_suppkey").alias("src"), pid("P", "l_partkey").alias("dst"), F.lit("CALLS").alias("edge_type"), F.col("l_linenumber").alias("line"))


def _steps(spark: SparkSession, sf_dir: str, first: int = 1997, last: int = 1997) -> DataFrame:
    """From each part to the next of those in its order that were shipped in the same year."""
    w = Window.partitionBy("yr", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").withColumn("yr", F.year("l_shipdate")).where(F.col("yr").between(first, last))
    x = lines.select("yr", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lag("l_partkey").over(w).alias("prev"), F.row_number().over(w).alias("pos"))
    return x.where("prev is not null").withColumn("pos", (F.col("pos") - 2).cast("int"))


def refactorings(spark: SparkSession, sf_dir: str, types: list[str]) -> DataFrame:
    """A refactoring from each part to the next in its order, its type told by the order's key."""
    x = _steps(spark, sf_dir)
    names = F.array(*[F.lit(t) for t in types])
    kind = F.element_at(names, (F.col("l_orderkey") % len(types) + 1).cast("int"))
    return x.select(F.col("l_orderkey").alias("ref_id"), "pos", kind.alias("type"), pid("P", "prev").alias("left_id"), pid("P", "l_partkey").alias("right_id"), (F.lit(0.5) + (F.col("l_linenumber") % 6) / 10).alias("confidence"))


def place(key: str):
    """Where a part stands: its file, first and last line."""
    start = (F.col(key) % 40 * 10 + 1).cast("int")
    return F.concat(F.lit("F"), F.floor(F.col(key) / 40).cast("string"), F.lit(".java")), start, start + 8


def sided_refactorings(spark: SparkSession, sf_dir: str, types: list[str], first: int = 1997, last: int = 1997) -> DataFrame:
    """One refactoring an order and year (``version``), with the places of its parts as both sides, in the layout of the record files."""
    def at(key: str):
        path, start, end = place(key)
        return F.struct(path.alias("file_path"), F.concat(F.lit("P"), F.col(key).cast("string"), F.lit("()")).alias("code_element"), start.alias("start_line"), end.alias("end_line"))

    listed = lambda key: F.transform(F.sort_array(F.collect_list(F.struct("pos", "l_partkey", at(key).alias("v")))), lambda r: r["v"])
    x = _steps(spark, sf_dir, first, last).groupBy("yr", F.col("l_orderkey").alias("ref_id")).agg(listed("prev").alias("left"), listed("l_partkey").alias("right"))
    kind = F.element_at(F.array(*[F.lit(t) for t in types]), (F.col("ref_id") % len(types) + 1).cast("int"))
    return x.select(F.col("yr").cast("string").alias("version"), "ref_id", kind.alias("type"), F.concat(F.lit("order "), (F.col("ref_id") % 5).cast("string")).alias("description"), (F.lit(0.5) + (F.col("ref_id") % 6) / 10).alias("confidence"), "left", "right")


def version_tables(spark: SparkSession, sf_dir: str, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a code base's versions, one a year (``version``): parts sold in it are methods (source: how many lines), their brands types that declare them, the next part of an order is called."""
    lines = table(spark, sf_dir, "lineitem").withColumn("yr", F.year("l_shipdate")).where(F.col("yr").between(first, last)).withColumn("version", F.col("yr").cast("string"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    path, start, end = place("l_partkey")
    own = lines.groupBy("version", "l_partkey").agg(F.count("*").cast("string").alias("source_code")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    null = F.lit(None).cast("string")
    cols = lambda node_id, t, name, source, rel, lo, hi: ["version", node_id.alias("node_id"), F.lit(t).alias("node_type"), name.alias("name"), node_id.alias("signature"), node_id.alias("qualified_name"), source.alias("source_code"), rel.alias("relative_path"), F.concat(F.lit("/r/"), rel).alias("absolute_path"), lo.cast("int").alias("line_start"), hi.cast("int").alias("line_end")]
    methods = own.select(*cols(pid("P", "l_partkey"), "METHOD", pid("P", "l_partkey"), F.col("source_code"), path, start, end))
    types = own.select("version", "p_brand").distinct().select(*cols(F.col("p_brand"), "TYPE", F.col("p_brand"), F.lit("type"), null, F.lit(0), F.lit(0)))
    w = Window.partitionBy("version", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    prev = lines.select("version", "l_partkey", "l_linenumber", F.lag("l_partkey").over(w).alias("prev")).where("prev is not null")
    calls = prev.select("version", pid("P", "prev").alias("src"), pid("P", "l_partkey").alias("dst"), F.lit("CALLS").alias("edge_type"), F.col("l_linenumber").alias("line"))
    return methods.union(types), own.select("version", F.col("p_brand").alias("src"), pid("P", "l_partkey").alias("dst"), F.lit("DECLARES").alias("edge_type"), F.lit(0).alias("line")).union(calls)


def version_graph(spark: SparkSession, sf_dir: str, year: int) -> Graph:
    """One version of `version_tables`."""
    nodes, edges = version_tables(spark, sf_dir, year, year)
    return Graph(nodes.drop("version"), edges.drop("version"))


def version_hunks(spark: SparkSession, sf_dir: str, first: int = 1997, last: int = 1997) -> DataFrame:
    """A hunk for each line of a year (``version``): in its part's file, at a line told by its keys, one in ten of them where nodes are."""
    path, _, _ = place("l_partkey")
    lines = table(spark, sf_dir, "lineitem").withColumn("yr", F.year("l_shipdate")).where(F.col("yr").between(first, last))
    at = ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 131 + F.col("l_suppkey") * 17) % 4000 + 1).cast("int")
    x = lines.select(F.col("yr").cast("string").alias("version"), path.alias("old_path"), F.when(F.col("l_returnflag") == "A", "/dev/null").otherwise(path).alias("new_path"), kind_of_hunk().alias("type"), at.alias("lo")).distinct()
    return x.select("version", "old_path", "new_path", "type", *[(F.col("lo") - 1 + n).alias(c) for c, n in (("begin_a", 0), ("end_a", 2), ("begin_b", 0), ("end_b", 2))])


def kind_of_hunk():
    return F.when(F.col("l_returnflag") == "R", "INSERT").when(F.col("l_returnflag") == "A", "DELETE").otherwise("REPLACE")


def code_facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A code base: nations are packages, customers and suppliers types, orders and parts methods, large parts fields, lines occurrences."""
    t = lambda n: table(spark, sf_dir, n)
    c, text = F.col, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    arr = lambda *xs: F.array(*xs) if xs else F.array().cast("array<string>")
    building = c("c_mktsegment") == "BUILDING"
    half = F.floor(c("c_custkey") / 2)
    c_path = F.concat(F.lit("/root/p/src/"), F.when(building, "test").otherwise("main"), F.lit("/java/C"), half.cast("string"), F.lit(".java"))
    c_start = (c("c_custkey") % 2 * 50 + 1).cast("int")
    customers = t("customer").select(
        text("store.C", c("c_custkey")).alias("qualified_name"), F.when(building, "TEST_CLASS").otherwise("CLASS").alias("kind"), text("pkg.N", c("c_nationkey")).alias("package"), c_path.alias("path"),
        F.when(c("c_custkey") % 4 == 0, "java.lang.Object").otherwise(text("store.S", c("c_custkey") % 37)).alias("super_class"),
        arr(text("store.S", c("c_custkey") % 7), F.lit("java.io.Serializable")).alias("interfaces"), (c("c_custkey") % 11 == 0).alias("is_anonymous"), c_start.alias("line_start"), (c_start + 49).alias("line_end"),
    )
    suppliers = t("supplier").select(
        text("store.S", c("s_suppkey")).alias("qualified_name"), F.when(c("s_suppkey") % 3 == 0, "INTERFACE").otherwise("CLASS").alias("kind"), text("pkg.N", c("s_nationkey")).alias("package"),
        text("/root/p/src/main/java/S", c("s_suppkey"), ".java").alias("path"), F.lit(None).cast("string").alias("super_class"), arr().alias("interfaces"), F.lit(False).alias("is_anonymous"),
        F.lit(1).alias("line_start"), F.lit(100).alias("line_end"),
    )
    nine = (c("o_orderkey") % 9).cast("string")
    o_start = (c("o_orderkey") % 100).cast("int")
    orders = t("orders").select(
        text("store.C", c("o_custkey")).alias("declaring_type"), F.concat(F.lit("m"), nine, F.lit("(int)")).alias("signature"), F.concat(F.lit("m"), nine).alias("name"),
        F.when(F.startswith("o_orderpriority", F.lit("1-")), "TEST_METHOD").otherwise("SOURCE_METHOD").alias("kind"), text("store.S", c("o_orderkey") % 50).alias("return_type"),
        arr(F.lit("int"), text("store.C", c("o_custkey"))).alias("parameter_types"), arr(F.lit("n"), F.lit("c")).alias("parameter_names"), arr(text("store.S", c("o_orderkey") % 13)).alias("exceptions"),
        (c("o_orderkey") % 2 == 0).alias("has_override"), text("/root/p/src/main/java/C", c("o_custkey"), ".java").alias("path"), o_start.alias("line_start"), (o_start + 5).alias("line_end"),
    )
    k, made = c("p_partkey") % 60, c("p_size") <= 5
    p_name = F.when(made, text("S", k)).otherwise(text("m", c("p_size") % 9))
    p_start = (c("p_partkey") % 100).cast("int")
    p_path = F.concat(F.lit("/root/p/src/"), F.when(c("p_size") % 2 == 0, "test").otherwise("main"), F.lit("/java/S.java"))
    parts = t("part").select(
        text("store.S", k).alias("declaring_type"), F.concat(p_name, F.when(made, "()").otherwise("(int)")).alias("signature"), p_name.alias("name"), F.when(made, "CONSTRUCTOR").otherwise("SOURCE_METHOD").alias("kind"),
        F.lit("void").alias("return_type"), F.when(made, arr()).otherwise(arr(F.lit("int"))).alias("parameter_types"), F.when(made, arr()).otherwise(arr(F.lit("n"))).alias("parameter_names"),
        arr().alias("exceptions"), F.lit(False).alias("has_override"), p_path.alias("path"), p_start.alias("line_start"), (p_start + 3).alias("line_end"),
    )
    fields = t("part").where("p_size > 40").select(text("store.S", k).alias("declaring_type"), text("f", c("p_size")).alias("name"), F.lit("int").alias("type"), (c("p_size") == 50).alias("is_enum_constant"), (c("p_partkey") % 90).cast("int").alias("line_number"), p_path.alias("path"))
    kind = F.when(c("l_returnflag") == "R", "READ").when(c("l_returnflag") == "A", "WRITE").when(c("l_quantity") > 40, "CONSTRUCTOR").otherwise("INVOCATION")
    own = (c("l_partkey") % 60).cast("string")
    member = F.when(c("occ_kind").isin("READ", "WRITE"), text("f", c("l_linenumber") + 41)).when(c("occ_kind") == "CONSTRUCTOR", F.concat(F.lit("S"), own, F.lit("()"))).otherwise(text("m", c("l_linenumber") % 9, "(int)"))
    lines = t("lineitem").withColumn("occ_kind", kind).join(t("orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    occ = lines.select(F.concat(text("store.C", c("o_custkey")), F.lit("#m"), nine, F.lit("(int)")).alias("src"), F.concat(F.lit("store.S"), own, F.lit("#"), member).alias("dst"), "occ_kind", c("l_linenumber").alias("line"))
    files = customers.where("not (line_end < 0)").select("path").union(suppliers.select("path")).distinct().where(~c("path").rlike("C[0-9]*5[.]java$"))
    packages = t("nation").select(text("pkg.N", c("n_nationkey")).alias("qualified_name"), (c("n_nationkey") % 12 == 0).alias("is_unnamed"))
    return {"project": spark.createDataFrame([("store",)], "name string"), "packages": packages, "files": files, "types": customers.unionByName(suppliers), "methods": orders.unionByName(parts), "fields": fields, "occurrences": occ}


def histories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Commits and refactorings of a history for each user: events in order, two to a commit; what was an event type becomes the next one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kinds = F.array(*[F.lit(x) for x in WALK_TYPES])
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.lag("event_type").over(w).alias("was"), F.row_number().over(w).alias("r"))
    e = e.withColumn("no", F.floor((F.col("r") - 1) / 2)).withColumn("commit_id", F.concat(F.lit("c"), F.col("no").cast("string")))
    last = F.max("no").over(Window.partitionBy("user_id"))
    e = e.withColumn("depth", (last - F.col("no")).cast("int"))
    commits = e.groupBy("user_id", "commit_id", "depth", "no").agg(F.unix_timestamp(F.max("ts").cast("timestamp")).alias("commit_time")).withColumn("is_root", F.col("no") == 0).drop("no")
    side = lambda c: F.array(F.lit("Field"), F.concat(F.lit(" "), c, F.lit("() ")))
    refs = e.where("was is not null").select("user_id", "commit_id", F.col("r").alias("pos"), F.element_at(kinds, (F.col("event_id") % len(WALK_TYPES) + 1).cast("int")).alias("type"), side(F.col("was")).alias("left"), side(F.col("event_type")).alias("right"))
    return commits, refs


#: Types that reach each rule of a walk.
WALK_TYPES = ("RENAME_METHOD", "EXTRACT_METHOD", "INLINE_METHOD", "ADD_PARAMETER", "REMOVE_PARAMETER", "MOVE_AND_INLINE_METHOD", "CHANGE_RETURN_TYPE", "PULL_UP_METHOD")
