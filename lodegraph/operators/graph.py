"""Lookups, neighbours, paths, impact and text contexts over ``nodes`` and ``edges`` tables.

Traversals are loops over a bounded depth, a join a step. Edges and each frontier are written once, so a step's plan never
holds those of the steps before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.functions import texts as T
from lodegraph.sources.tables import Tables


class Graph:
    """``nodes(node_id, ...)`` and ``edges(src, dst, edge_type, ...)``."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("node_id") == node_id)

    def of_type(self, node_type: str) -> DataFrame:
        return self.nodes.where(F.col("node_type") == node_type)

    def with_status(self, *status: str) -> DataFrame:
        return self.nodes.where(F.col("version_status").isin(*status))

    def in_version(self, label: str) -> DataFrame:
        return self.nodes.where(F.array_contains("versions", label))

    def outgoing(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("src") == node_id)

    def incoming(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("dst") == node_id)

    def neighbors(self, node_id: str, edge_type: str | None = None) -> DataFrame:
        """End nodes of outgoing edges; parallel edges repeat them."""
        out = self.outgoing(node_id)
        out = out.where(F.col("edge_type") == edge_type) if edge_type else out
        return out.select(F.col("dst").alias("node_id")).join(self.nodes, "node_id")

    def edge(self, edge_id: str) -> DataFrame:
        return self.edges.where(F.col("edge_id") == edge_id)

    def edges_of_type(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("edge_type").isin(*types))

    def is_evolution(self) -> DataFrame:
        """One row: whether any node carries a version status or a version."""
        some = F.col("version_status").isNotNull() | (F.coalesce(F.size("versions"), F.lit(0)) > 0)
        return self.nodes.agg(F.coalesce(F.bool_or(some), F.lit(False)).alias("is_evolution"))

    def upsert(self, rows: DataFrame, order: str) -> Graph:
        """Nodes with ``rows`` added; of one id the row with the largest ``order`` stays."""
        both = self.nodes.unionByName(rows, allowMissingColumns=True)
        keep = both.groupBy("node_id").agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")
        return Graph(keep, self.edges)


def union_graph(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_versions(nodes: DataFrame, more: DataFrame, replace: bool = False) -> DataFrame:
    """``nodes`` with the versions of ``more(node_id, versions)`` added to their own, or in place of them."""
    extra = more.groupBy("node_id").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("extra"))
    joined = nodes.join(extra, "node_id", "left")
    own = F.col("extra") if replace else F.array_union(F.coalesce("versions", F.array().cast("array<string>")), F.col("extra"))
    return joined.withColumn("versions", F.array_sort(F.coalesce(own, F.col("versions")))).drop("extra")


def simple_paths(edges: DataFrame, sources: DataFrame, target: str | None, max_depth: int) -> DataFrame:
    """``path array, depth``: simple paths of at most ``max_depth`` edges from each ``node_id`` of ``sources``.

    With a target only paths that end there are returned, and none goes on from it; a source that is
    the target is a path of one node. Parallel edges give a path each. Paths to a target are grown from both ends, half
    the depth each, and joined where they meet: a longer path is one that goes on from exactly the first half.
    """
    tables = Tables(edges.sparkSession, "paths")
    step = tables.write(edges.select("src", "dst"), "edges")
    half = -(-max_depth // 2) if target else max_depth
    last = F.element_at("path", -1)
    frontier = tables.write(sources.select(F.array("node_id").alias("path"), F.lit(0).alias("depth")), "frontier")
    found = frontier.where(last == target) if target else frontier.limit(0)
    for d in range(1, half + 1):
        grow = frontier.where(last != target) if target else frontier
        longer = grow.join(step, last == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        frontier = tables.write(longer.select(F.array_append("path", F.col("dst")).alias("path"), F.lit(d).alias("depth")), "frontier")
        found = found.union(frontier.where(last == target) if target else frontier)
    if not target or half == max_depth:
        return found
    open_ = frontier.where(last != target).withColumn("meet", last)
    first = F.element_at("tail", 1)
    back = edges.sparkSession.createDataFrame([([target],)], "tail array<string>")
    for d in range(1, max_depth - half + 1):
        longer = back.join(step, first == F.col("dst")).where(~F.array_contains("tail", F.col("src")))
        back = tables.write(longer.select(F.concat(F.array("src"), "tail").alias("tail")), "back")
        rest = back.select(first.alias("meet"), F.slice("tail", 2, d).alias("rest"))
        both = open_.join(rest, "meet").where(~F.arrays_overlap("path", "rest"))
        found = found.union(both.select(F.concat("path", "rest").alias("path"), F.lit(half + d).alias("depth")))
    return found


def simple_paths_recursive(edges: DataFrame, sources: DataFrame, target: str, max_depth: int) -> DataFrame:
    """`simple_paths` to a target as one recursive query, for short paths: one plan, grown from the sources alone."""
    return edges.sparkSession.sql(
        """with recursive p(path, depth) as (
             select array(node_id), 0 from {sources}
             union all
             select array_append(path, dst), depth + 1 from p join {edges} on src = element_at(path, -1)
             where depth < :most and element_at(path, -1) <> :target and not array_contains(path, dst))
           select path, depth from p where element_at(path, -1) = :target""",
        args={"target": target, "most": max_depth}, sources=sources.select("node_id"), edges=edges.select("src", "dst"),
    )


def callers(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """``start, node_id, depth``: one row for every chain of 1 to ``max_depth`` edges that ends at a start; no chain uses an edge twice.

    ``edges(src, dst)``; parallel edges are different ones.
    """
    tables = Tables(edges.sparkSession, "callers")
    own = tables.write(edges.select("src", "dst", F.monotonically_increasing_id().alias("e")), "edges")
    chain = tables.write(start.select(F.col("node_id").alias("start"), "node_id", F.array().cast("array<bigint>").alias("used")), "chains")
    out = []
    for d in range(1, max_depth + 1):
        grown = chain.join(own, F.col("node_id") == F.col("dst")).where(~F.array_contains("used", F.col("e")))
        chain = tables.write(grown.select("start", F.col("src").alias("node_id"), F.array_append("used", F.col("e")).alias("used")), "chains")
        out.append(chain.select("start", "node_id", F.lit(d).alias("depth")))
    return union_graph(*out)


#: Starts that one mask holds.
BITS = 64


#: Starts that are numbered together.
GROUP = 4096


def reach_labels(edges: DataFrame, max_depth: int, tables: Tables) -> DataFrame:
    """``node_id, label``: the least hash among the nodes that lead to each end of an edge within ``max_depth`` edges, its own included.

    Two nodes share a label as often as the sets they are reached from overlap.
    """
    back = tables.write(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("up")).distinct(), "label-edges")
    own = tables.write(back.select("node_id").union(back.select("up")).distinct().select("node_id", F.xxhash64("node_id").alias("label")), "labels")
    for _ in range(max_depth):
        via = back.join(own.select(F.col("node_id").alias("up"), F.col("label").alias("via")), "up").groupBy("node_id").agg(F.min("via").alias("via"))
        own = tables.write(own.join(via, "node_id", "left").select("node_id", F.least("label", "via").alias("label")), "labels")
    return own


def start_bits(start: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``start, block, bit``: distinct starts (``node_id``) dealt to blocks of up to 64, numbered within hashed groups (no global order).

    With ``labels`` (`reach_labels`) starts that are reached from much the same nodes share blocks: else every block meets every node, and masks
    grow with the product of starts and nodes though each start reaches few.
    """
    own = start.select(F.col("node_id").alias("start")).distinct()
    groups = max(1, -(-own.count() // GROUP))
    own = own.withColumn("label", F.xxhash64("start"))
    g = F.pmod("label", F.lit(groups))
    if labels is not None:
        own = own.join(labels.select(F.col("node_id").alias("start"), F.col("label").alias("known")), "start", "left").select("start", F.coalesce("known", "label").alias("label"))
        # A label of many starts has groups of its own, numbered after those that others share; there are at most as many such labels as groups.
        many = own.groupBy("label").agg(F.ceil(F.count("*") / GROUP).alias("own_groups")).where("own_groups > 1")
        many = many.withColumn("from", F.sum("own_groups").over(Window.orderBy("label")) - F.col("own_groups") + groups)
        own = own.join(many, "label", "left")
        g = F.coalesce(F.col("from") + F.pmod(F.xxhash64("start"), F.col("own_groups")), g)
    k = F.row_number().over(Window.partitionBy("g").orderBy("label", "start")) - 1
    return own.withColumn("g", g).withColumn("k", k).select("start", (F.col("g") * (1 << 20) + F.floor(F.col("k") / BITS)).cast("long").alias("block"), (F.col("k") % BITS).cast("int").alias("bit"))


#: Words of 64 starts to a wide mask, and ends to a list of those that a mask goes to next.
WORDS, LIST = 32, 256


def _word(i: int, m: str = "m") -> Column:
    return F.get(m, F.lit(i))


def _either(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, m``: the wide masks of each key, united."""
    return rows.groupBy(*keys).agg(F.array(*[F.bit_or(_word(i)) for i in range(WORDS)]).alias("m"))


def _lists(links: DataFrame, tables: Tables) -> DataFrame:
    """``node_id, ups``: the distinct ends ``up`` that masks of a node go to, in lists of bounded length."""
    at = F.floor((F.row_number().over(Window.partitionBy("node_id").orderBy("up")) - 1) / LIST)
    return tables.write(links.distinct().withColumn("at", at).groupBy("node_id", "at").agg(F.collect_list("up").alias("ups")).select("node_id", "ups"), "lists")


def _sent(masks: DataFrame, lists: DataFrame, *more: DataFrame) -> DataFrame:
    """``wide, m, old, node_id``: each of ``masks(node_id, wide, m)`` at every end of its node's ``lists``, and the masks of ``more`` as ``old`` ones.

    Masks meet lists and are dealt by ``wide`` before the lists are opened, so what goes over the network is masks and not edges with masks, and
    whatever is grouped by ``wide`` and a node needs no other exchange.
    """
    rows = masks.join(lists, "node_id").select("wide", "m", "ups", F.lit(False).alias("old"))
    rows = union_graph(rows, *[x.select("wide", "m", F.array("node_id").alias("ups"), F.lit(True).alias("old")) for x in more])
    spark = masks.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, "wide").select("wide", "m", "old", F.explode("ups").alias("node_id"))


def reach_wide(edges: DataFrame, starts: DataFrame, max_depth: int, tables: Tables) -> list[DataFrame]:
    """``node_id, wide, m`` for each depth from 0: for each node and ``WORDS`` blocks of ``starts`` (`start_bits`) those that it first leads to, as bits.

    A step is one grouped OR within partitions of starts, with at most a row for each node and ``wide``, however many starts lead there.
    """
    lists = _lists(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("up")), tables)
    bit = F.expr("shiftleft(1L, bit)")
    own = F.array(*[F.when(F.col("block") % WORDS == i, bit).otherwise(F.lit(0).cast("long")) for i in range(WORDS)])
    out = [tables.write(starts.select(F.col("start").alias("node_id"), F.floor(F.col("block") / WORDS).alias("wide"), own.alias("m")), "masks")]
    for _ in range(max_depth):
        of = lambda i, old: F.coalesce(F.bit_or(F.when(F.col("old") == old, _word(i))), F.lit(0).cast("long"))
        both = _sent(out[-1], lists, *out).groupBy("wide", "node_id").agg(F.array(*[of(i, False) for i in range(WORDS)]).alias("grown"), F.array(*[of(i, True) for i in range(WORDS)]).alias("had"))
        fresh = F.array(*[_word(i, "grown").bitwiseAND(F.bitwise_not(_word(i, "had"))) for i in range(WORDS)])
        out.append(tables.write(both.select("node_id", "wide", fresh.alias("m")).where(F.exists("m", lambda x: x != 0)), "masks"))
    return out


def _narrow(masks: DataFrame, *keys: str) -> DataFrame:
    """``keys, block, mask``: the words of wide masks that hold any start, one a row."""
    return masks.select(*keys, "wide", F.posexplode("m").alias("word", "mask")).where("mask <> 0").select(*keys, (F.col("wide") * WORDS + F.col("word")).alias("block"), "mask")


def reach_bits(edges: DataFrame, starts: DataFrame, max_depth: int, tables: Tables) -> DataFrame:
    """``node_id, block, mask, depth``: the words of `reach_wide`, at most a row for each node, block of starts and depth."""
    return union_graph(*[_narrow(x, "node_id").withColumn("depth", F.lit(d)) for d, x in enumerate(reach_wide(edges, starts, max_depth, tables))])


def bit_counts(masks: DataFrame, keys: list[str], starts: DataFrame) -> DataFrame:
    """``start, *keys, n``: how many rows of ``masks(block, mask, *keys)`` hold each start, none left out that one holds."""
    ones = [F.sum(F.expr(f"shiftrightunsigned(mask, {i}) & 1L")).alias(f"b{i}") for i in range(BITS)]
    sums = masks.groupBy("block", *keys).agg(*ones).select("block", *keys, F.posexplode(F.array(*[f"b{i}" for i in range(BITS)])).alias("bit", "n"))
    return sums.where("n > 0").join(starts, ["block", "bit"]).select("start", *keys, "n")


def reach(edges: DataFrame, start: DataFrame, max_depth: int, tables: Tables | None = None) -> DataFrame:
    """``start, node_id, depth``: every node reached against the edges' direction within ``max_depth``, at its least depth; a start reaches itself at 0.

    The rows of `reach_bits`, one a start; counts need no such rows.
    """
    tables = tables or Tables(edges.sparkSession, "reach")
    starts = tables.write(start_bits(start, reach_labels(edges, max_depth, tables)), "starts")
    masks = reach_bits(edges, starts, max_depth, tables)
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("bit_get", F.col("mask"), i) == 1)
    return masks.select("node_id", "block", "depth", F.explode(bits).alias("bit")).join(starts, ["block", "bit"]).select("start", "node_id", "depth")


def reach_counts(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """``depth, n, nodes, starts``: how many rows `reach` has at each depth, and how many distinct nodes and starts, from its bits alone."""
    tables = Tables(edges.sparkSession, "reach")
    edges = tables.write(edges.select("src", "dst").distinct(), "edges")
    starts = tables.write(start_bits(start, reach_labels(edges, max_depth, tables)), "starts")
    masks = union_graph(*[x.withColumn("depth", F.lit(d)) for d, x in enumerate(reach_wide(edges, starts, max_depth, tables))])
    ones = sum((F.bit_count(_word(i)) for i in range(WORDS)), F.lit(0).cast("long"))
    nodes = masks.groupBy("depth", "node_id").agg(F.sum(ones).alias("n")).groupBy("depth").agg(F.sum("n").alias("n"), F.count("*").alias("nodes"))
    met = _either(masks, ["depth", "wide"]).groupBy("depth").agg(F.sum(ones).alias("starts"))
    return nodes.join(met, "depth").select("depth", "n", "nodes", "starts")


def tests_to_rerun(calls: DataFrame, tests: DataFrame, changed: DataFrame, max_depth: int = 3) -> DataFrame:
    """``test_id`` of the tests (``tests(src, dst)``) of any method that calls a changed one (``node_id``) over 1 to ``max_depth`` edges.

    A changed method itself counts only if it calls a changed one. All changed methods set out together, so a step is one join of
    edges with distinct nodes, whatever their number.
    """
    tables = Tables(calls.sparkSession, "tests")
    back = tables.write(calls.select(F.col("dst").alias("node_id"), F.col("src").alias("up")).distinct(), "edges")
    frontier, met = changed.select("node_id").distinct(), None
    for _ in range(max_depth):
        grown = frontier.join(back, "node_id").select(F.col("up").alias("node_id")).distinct()
        if met is not None:
            grown = grown.join(met, "node_id", "left_anti")
        frontier = tables.write(grown, "frontier")
        met = frontier if met is None else met.union(frontier)
    return tests.join(met, F.col("dst") == F.col("node_id"), "left_semi").select(F.col("src").alias("test_id")).distinct()


#: How far a change of each evolution edge type reaches; any other is MEDIUM.
IMPACT = {"CHANGED_SIGNATURE": "HIGH", "RENAMED": "HIGH"}


def impact(calls: DataFrame, tests: DataFrame, changed: DataFrame, max_depth: int = 3) -> DataFrame:
    """Impact of each changed method: ``node_id, level, direct, callers, by_depth, tests``.

    ``changed(node_id, edge_type)`` (null: no evolution edge, level NONE; of several the strongest). ``callers``: distinct methods that reach
    it over 1 to ``max_depth`` calls, ``by_depth`` how many at each least depth, ``tests``: tests of it or of any of them.
    """
    tables = Tables(calls.sparkSession, "impact")
    kind = F.coalesce(*[F.when(F.col("edge_type") == k, F.lit(v)) for k, v in IMPACT.items()], F.when(F.col("edge_type").isNotNull(), "MEDIUM"), F.lit("NONE"))
    # NONE sorts after MEDIUM and HIGH before both.
    level = changed.groupBy("node_id").agg(F.min(kind).alias("level"))
    calls = tables.write(calls.select("src", "dst").distinct(), "edges")
    starts = tables.write(start_bits(level, reach_labels(calls, max_depth, tables)), "starts")
    steps = reach_wide(calls, starts, max_depth, tables)
    # A test counts once for a start, over whichever nodes it is reached.
    of = _lists(tests.select(F.col("dst").alias("node_id"), F.col("src").alias("up")), tables)
    met = _narrow(_either(_sent(union_graph(*steps), of), ["wide", "node_id"]))
    found = union_graph(*[_narrow(x).withColumn("depth", F.lit(d)) for d, x in enumerate(steps) if d])
    tested = bit_counts(met, [], starts).select(F.col("start").alias("node_id"), F.col("n").alias("tests"))
    own = bit_counts(found, ["depth"], starts).groupBy(F.col("start").alias("node_id"))
    depths = own.agg(F.sum("n").alias("callers"), *[F.coalesce(F.sum(F.when(F.col("depth") == d, F.col("n"))), F.lit(0)).alias(f"d{d}") for d in range(1, max_depth + 1)])
    text = F.concat_ws(",", *[F.coalesce(F.col(f"d{d}"), F.lit(0)).cast("string") for d in range(1, max_depth + 1)])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = level.join(depths, "node_id", "left").join(tested, "node_id", "left")
    return out.select("node_id", "level", F.coalesce("d1", F.lit(0)).alias("direct"), zero("callers"), text.alias("by_depth"), zero("tests"))


def impact_report(impacts: DataFrame) -> DataFrame:
    """One text a changed method."""
    n = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("Impact of "), F.col("node_id"), F.lit(": "), F.col("level"), F.lit("\nDirect callers: "), n("direct"), F.lit("\nCallers by depth: "), F.col("by_depth"), F.lit("\nTests to run: "), n("tests"))
    return impacts.select("node_id", text.alias("report"))


def caller_counts(edges: DataFrame, max_depth: int) -> DataFrame:
    """``node_id, depth, n``: for every node the number of walks of each length that end at it.

    Walks are counted step by step, one row a node, so a step costs one join of edges with nodes.
    """
    tables = Tables(edges.sparkSession, "counts")
    edges = tables.write(edges.select("src", "dst"), "edges")
    step = tables.write(edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n")), "step")
    out = step.select("node_id", F.lit(1).alias("depth"), "n")
    for d in range(2, max_depth + 1):
        grown = edges.join(step, F.col("src") == F.col("node_id")).groupBy("dst").agg(F.sum("n").alias("n")).withColumnRenamed("dst", "node_id")
        step = tables.write(grown, "step")
        out = out.union(step.select("node_id", F.lit(d).alias("depth"), "n"))
    return out


def contexts(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``node_id, context`` for each of ``starts(node_id)``: its text, then each node within ``depth`` edges, once, nearest first, then by id.

    A neighbour is told by the edge that first leads to it (the smallest kind and source of that step), with its description and the
    neighbour's summary. ``nodes(node_id, node_type, label, relative_path, semantic_summary, documentation, comments, source_code)``,
    ``edges(src, dst, edge_type, description)``. A start that is no node gives a line that says so. All starts set out together; a
    step is one join, and its finds are written, so that no step plans those before it.
    """
    c, tables = F.col, Tables(nodes.sparkSession, "contexts")
    asked = tables.write(starts.select(c("node_id").alias("start")).where("start is not null").distinct(), "starts")
    own = T.node_text(c("node_type"), c("label"), c("relative_path"), c("semantic_summary"), c("documentation"), c("comments"), c("source_code"))
    head = F.concat(F.lit("========== MAIN NODE ==========\n"), own, F.lit("\n"))
    main = nodes.join(asked, c("node_id") == c("start"), "left_semi").groupBy(c("node_id").alias("start")).agg(F.max(head).alias("h"))
    missing = F.concat(F.lit("Node not found: "), c("start"))
    if depth < 1:
        return asked.join(main, "start", "left").select(c("start").alias("node_id"), F.coalesce("h", missing).alias("context"))
    step = tables.write(edges.select("src", "dst", "edge_type", "description"), "edges")
    frontier = nodes.join(asked, c("node_id") == c("start"), "left_semi").select(c("node_id").alias("start"), "node_id").distinct()
    found = None
    for d in range(1, depth + 1):
        # The first node may be met again through a cycle; others only once.
        new = step.join(frontier.withColumnRenamed("node_id", "src"), "src").groupBy("start", c("dst").alias("node_id")).agg(F.min(F.struct("edge_type", "src", "description")).alias("e"))
        new = new if found is None else new.join(found.select("start", "node_id"), ["start", "node_id"], "left_anti")
        rows = tables.write(new.select("start", "node_id", "e.edge_type", "e.description", F.lit(d).alias("depth")), "met")
        frontier = rows.select("start", "node_id")
        found = rows if found is None else found.union(rows)
    line = lambda x, before: F.when(x.isNotNull(), F.concat(F.lit(before), x, F.lit("\n"))).otherwise("")
    told = F.concat(F.lit("\n--- "), c("edge_type"), F.lit(" --> "), c("label"), F.lit(" ---\n"), line(c("description"), "Relationship: "), line(c("semantic_summary"), ""))
    rest = found.join(nodes.select("node_id", "label", "semantic_summary"), "node_id").select("start", "depth", "node_id", told.alias("x"))
    text = rest.groupBy("start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node_id", "x"))), lambda r: r["x"]), "").alias("x"))
    whole = F.concat(c("h"), F.lit("========== NEIGHBORS ==========\n"), F.coalesce("x", F.lit("")))
    return asked.join(main, "start", "left").join(text, "start", "left").select(c("start").alias("node_id"), F.coalesce(whole, missing).alias("context"))


def context(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int) -> DataFrame:
    """One row ``context``: `contexts` of one node."""
    return contexts(nodes, edges, nodes.sparkSession.createDataFrame([(node_id,)], "node_id string"), depth).select("context")


def _joined(df: DataFrame, keys: list[str], text: Column, name: str) -> DataFrame:
    """The texts of each key, by node id, one after the other."""
    listed = F.sort_array(F.collect_list(F.struct("node_id", text.alias("x"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda r: r["x"]), "").alias(name))


def test_contexts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``type_id, context`` for every type: its text, supertypes, fields, and methods with what they call; members in order of id.

    ``edges(src, dst, edge_type, detail)``, where DECLARES has the kind of member as detail.
    """
    c = F.col
    text = T.node_text(c("node_type"), c("label"), c("relative_path"), c("semantic_summary"), c("documentation"), c("comments"), c("source_code"))
    own = nodes.withColumn("text", text)
    to = lambda kinds: edges.where(c("edge_type").isin(*kinds)).join(own.withColumnRenamed("node_id", "dst"), "dst").withColumnRenamed("dst", "node_id")
    summary = F.coalesce(F.concat(F.lit("  "), c("semantic_summary"), F.lit("\n")), F.lit(""))
    supers = _joined(to(["EXTENDS", "IMPLEMENTS"]), ["src"], F.concat("edge_type", F.lit(": "), "label", F.lit("\n"), summary), "supers")
    members = to(["DECLARES"])
    fields = _joined(members.where("detail = 'field'"), ["src"], F.concat(F.coalesce("semantic_summary", F.lit("null")), F.lit("\n")), "fields")
    called = to(["CALLS"]).groupBy(c("src").alias("caller")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "label"))), lambda r: r["label"]), ", ").alias("called"))
    methods = members.where("detail in ('method', 'constructor')").join(called, c("node_id") == c("caller"), "left")
    told = F.concat(F.lit("\n--- Method: "), "name", F.lit(" ---\n"), "text", F.lit("  Calls: "), F.coalesce("called", F.lit("none")), F.lit("\n"))
    listed = _joined(methods, ["src"], told, "methods")
    types = own.where("node_type = 'TYPE'").select(c("node_id").alias("type_id"), "label", "text")
    for part in (supers, fields, listed):
        types = types.join(part.withColumnRenamed("src", "type_id"), "type_id", "left")
    head = F.concat(F.lit("========== TEST CONTEXT FOR: "), "label", F.lit(" ==========\n\n=== CLASS DEFINITION ===\n"), "text", F.lit("\n"))
    part = lambda name, title, end="\n": F.concat(F.lit(f"=== {title} ===\n"), F.coalesce(name, F.lit("")), F.lit(end))
    return types.select("type_id", F.concat(head, part("supers", "INHERITANCE"), part("fields", "FIELDS"), part("methods", "METHODS", "")).alias("context"))


#: What a project summary counts, in its order.
SUMMARY = (("Packages", "PACKAGE"), ("Files", "FILE"), ("Types", "TYPE"), ("Methods", "METHOD"), ("Fields", "FIELD"))


def project_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``summary``: the project, counts of five kinds of nodes, and each package with the number of its types."""
    n = nodes.agg(F.min(F.when(F.col("node_type") == "PROJECT", F.col("name"))).alias("project"), *[F.count_if(F.col("node_type") == k).alias(k) for _, k in SUMMARY])
    inside = edges.where("edge_type = 'IN_PACKAGE'").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("types"))
    packages = nodes.where("node_type = 'PACKAGE'").join(inside, "node_id", "left")
    line = F.concat("node_id", F.lit(" ("), F.coalesce("types", F.lit(0)).cast("string"), F.lit(" types)\n"))
    listed = packages.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", line.alias("x")))), lambda r: r["x"]), "").alias("listed"))
    counts = F.concat(*[F.concat(F.lit(f"Total {t}: "), F.col(k).cast("string"), F.lit("\n")) for t, k in SUMMARY])
    head = F.coalesce(F.concat(F.lit("========== PROJECT: "), "project", F.lit(" ==========\n")), F.lit(""))
    return n.crossJoin(listed).select(F.concat(head, F.lit("=== STATISTICS ===\n"), counts, F.lit("\n=== PACKAGE STRUCTURE ===\n"), "listed").alias("summary"))


def loads(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an offline import takes in: one node an id (of unequal ones the first in order of their text), and edges both of whose ends exist."""
    ids = nodes.select("node_id").distinct()
    first = nodes.groupBy("node_id").agg(F.min_by(F.struct(*nodes.columns), F.to_json(F.struct(*nodes.columns))).alias("r")).select("r.*")
    return first, edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
