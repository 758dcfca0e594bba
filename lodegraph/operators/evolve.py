"""Two versions of a graph merged into one, and many rolled up into a timeline.

The steps that decide on each other in a sequential merge (splitting a node, propagating a change to its type, tracking what newer pairs
changed) are set up as sets first: which pairs must be split is known before any row is written, so no row is written twice. All
neighbouring versions are merged in one pass, told apart by the column ``pair``; a merge of two versions is a pass over one pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import exprs as X
from lodegraph.operators import collapse as C
from lodegraph.operators import locate as L
from lodegraph.operators import versions as R
from lodegraph.operators.graph import Graph
from lodegraph.sources.tables import Tables

STATES = ("ADDED", "DELETED", "MODIFIED", "UNCHANGED")


@dataclass
class Evolution:
    """A merged graph: ``nodes`` with versions and status, structural ``edges``, and evolution edges ``evolution``."""

    nodes: DataFrame
    edges: DataFrame
    evolution: DataFrame


def clone(nodes: DataFrame, merged_id, label: str, status: str) -> DataFrame:
    """Copies of ``nodes`` under ``merged_id``, as they are in version ``label``; ``original_id`` names what they were copied from."""
    one = F.lit(label)
    own = nodes.withColumn("original_id", F.col("node_id")).withColumn("node_id", merged_id)
    return own.withColumns({"versions": F.array(one), "version_status": F.lit(status), "first_version": one, "last_version": one})


def stamped(nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """Commit id, short id, message, author and time of the version each snapshot is from; null for other nodes."""
    meta = versions.select(F.col("label").alias("_label"), *[F.col(c).alias(n) for c, n in (("commit_id", "commit_id"), ("short_id", "commit_short_id"), ("message", "commit_message"), ("author", "commit_author"), ("commit_time", "commit_time"))])
    snapshot = F.when(F.size("versions") == 1, F.col("first_version"))
    return nodes.join(meta, snapshot == F.col("_label"), "left").drop("_label")


def resolve(refactorings: DataFrame, nodes: DataFrame, side: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``ref_id, ids`` (after ``by``): for each location of array ``side`` (path, start and end line) the nearest node there, in order.

    Locations without a node drop out. Nodes need ``absolute_path, relative_path, line_start, line_end``.
    """
    at = refactorings.select(*by, "ref_id", F.posexplode(side).alias("pos", "loc")).select(*by, "ref_id", "pos", F.col("loc.file_path").alias("path"), F.col("loc.start_line").alias("lo"), F.col("loc.end_line").alias("hi"))
    found = L.nearest(L.located(nodes, at, by=by), [*by, "ref_id", "pos"], ["node_id"])
    return found.groupBy(*by, "ref_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda r: r["node_id"]).alias("ids"))


def with_sides(refactorings: DataFrame, n1: DataFrame, n2: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Refactorings with arrays ``left`` and ``right`` of locations, resolved to nodes of both versions: ``left_ids, right_ids`` and the lists an edge carries."""
    text = lambda side: X.trimmed_distinct(F.transform(side, lambda p: X.location(p["file_path"], p["start_line"], p["end_line"], p["code_element"])))
    parts = lambda side: X.trimmed_distinct(F.transform(F.filter(side, lambda p: p["code_element"].isNotNull()), lambda p: p["code_element"]))
    own = refactorings.withColumns({"left_locations": text("left"), "right_locations": text("right"), "left_elements": parts("left"), "right_elements": parts("right")})
    key = [*by, "ref_id"]
    out = own.join(resolve(refactorings, n1, "left", by).withColumnRenamed("ids", "left_ids"), key).join(resolve(refactorings, n2, "right", by).withColumnRenamed("ids", "right_ids"), key)
    return out.drop("left", "right")


#: What tells pairs of versions apart: 0 is the newest.
PAIR = ("pair",)


def _member_edges(edges: DataFrame, n1: DataFrame, o1: DataFrame, o2: DataFrame) -> DataFrame:
    """Edges of members (methods, fields) as edges of the types that declare them."""
    members = edges.join(n1.where("node_type in ('METHOD', 'FIELD')").select("pair", F.col("node_id").alias("src")), ["pair", "src"], "left_semi")
    text = F.concat(F.lit("Type changed due to member refactoring: "), F.coalesce("description", F.lit("")))
    return R.remap_sides(members, o1, o2, PAIR).withColumns({"edge_type": F.lit("REFACTORED"), "type": F.lit("MEMBER_CHANGED"), "description": text, "step": F.lit(1), "detected_by": F.lit(None).cast("string"), "sub_type": F.lit(None).cast("string")})


def tracked_since(rows: DataFrame, tables: Tables, tracked: DataFrame | None = None) -> DataFrame:
    """``base_id, since``: the newest pair whose merge leaves a node tracked, from rows ``pair, b1, b2, hot`` (-1 for those of ``tracked``).

    A row that is hot (changed, added or deleted) tracks both its ends for older pairs; a row that leads to a node tracked by a
    newer pair tracks its other end. Where both ends share an id this is a grouped minimum; only rows that lead from one id to another
    need steps, as many as such rows follow each other.
    """
    ends = rows.where("hot").select("pair", F.explode(F.array("b1", "b2")).alias("base_id")).where("base_id is not null")
    if tracked is not None:
        ends = ends.union(tracked.select(F.lit(-1), "base_id"))
    since = tables.write(ends.groupBy("base_id").agg(F.min("pair").alias("since")), "since")
    apart = rows.where("b1 <> b2").select("pair", "b1", "b2")
    links = tables.write(apart.union(apart.select("pair", "b2", "b1")).toDF("pair", "base_id", "other").distinct(), "links")
    if links.isEmpty():
        return since
    while True:
        reached = links.join(since, "base_id").where("since < pair").groupBy(F.col("other").alias("base_id")).agg(F.min("pair").alias("new"))
        both = tables.write(since.join(reached, "base_id", "full_outer").select("base_id", F.least("since", "new").alias("since"), (F.col("since").isNull() | (F.col("new") < F.col("since"))).alias("moved")), "since")
        since = both.select("base_id", "since")
        if both.where("moved").isEmpty():
            return since


def merge_pairs(n1: DataFrame, n2: DataFrame, e1: DataFrame, e2: DataFrame, pairs: DataFrame, mapping: DataFrame, refactorings: DataFrame, changed: DataFrame, tracked: DataFrame | None = None, tables: Tables | None = None) -> Evolution:
    """Merge the two versions of every pair, all pairs at once: nodes, edges and evolution edges with a column ``pair``.

    ``n1, e1`` are nodes and edges of each pair's older version, ``n2, e2`` of its newer one; ``pairs(pair, first, second)`` names both
    versions, 0 being the newest pair (one row a pair: it is broadcast). ``mapping(pair, v1_id, v2_id, confidence)``;
    ``refactorings(pair, ref_id, type, description, confidence, left_ids, right_ids, lists...)`` from `with_sides`; ``changed(pair, side, node_id)``
    from diffs; ``tracked(base_id)``: nodes that a still newer pair changed.

    A mapped pair of nodes is MODIFIED (a row a version) if its sources differ, the diff touches it, or an edge would otherwise lead from the
    merged node to itself; in that last case the first row keeps its id without a version. Else it is UNCHANGED: one row with both
    versions, or, if a newer pair left it tracked, a row a version and an UNCHANGED edge between them. The rest is DELETED or ADDED.

    Evolution edges come from refactorings, from diffs (CODE_DIFF, where a touched pair has no other edge) and from members to their
    types (MEMBER_CHANGED), merged by their ends and kind. A diff's edges of a pair count after those of all refactorings.
    Structural edges of the first version come first, and one stays for each pair of ends and kind.
    """
    tables = tables or Tables(n1.sparkSession, "evolution")
    named = F.broadcast(pairs.select("pair", "first", "second"))
    ids = ["pair", "v1_id", "v2_id"]
    mapped = tables.write(R.changed_pairs(mapping, changed, PAIR), "mapped")

    o1, o2 = R.owners(e1, PAIR), R.owners(e2, PAIR)
    found = R.with_edge_type(R.sided_edges(refactorings)).withColumns({"step": F.lit(0), "phase": F.lit(0), "detected_by": F.lit("RefactoringMiner")})
    found = tables.write(found, "found")
    from_refs = tables.write(found.unionByName(_member_edges(found, n1, o1, o2)), "from-refactorings")
    taken = from_refs.select("pair", F.col("src").alias("v1_id"), F.col("dst").alias("v2_id")).distinct()
    none = F.array().cast("array<string>")
    by_diff = mapped.where("forced").join(taken, ids, "left_anti").select("pair", F.col("v1_id").alias("src"), F.col("v2_id").alias("dst"))
    diffs = by_diff.withColumns({
        "ref_id": F.lit(0).cast("long"), "type": F.lit("CODE_DIFF"), "description": F.lit("code changed in diff"), "confidence": F.lit(0.7), "edge_type": F.lit("REFACTORED"),
        "sub_type": F.lit(None).cast("string"), "left_pos": F.lit(0), "right_pos": F.lit(0), "step": F.lit(0), "phase": F.lit(1), "detected_by": F.lit("GitDiff"),
        **{c: none for c in ("left_locations", "right_locations", "left_elements", "right_elements")},
    })
    raw = tables.write(from_refs.unionByName(diffs).unionByName(_member_edges(diffs, n1, o1, o2)), "raw-edges")

    # An edge between the ends of an unchanged pair would be a loop on its merged node.
    loops = raw.select("pair", F.col("src").alias("v1_id"), F.col("dst").alias("v2_id"), F.lit(True).alias("loop")).distinct()
    base = lambda c: X.base_id(F.col(c))
    same = (F.col("confidence") >= 1.0) & ~F.col("forced")
    looped = mapped.join(loops, ids, "left").withColumn("loop", F.coalesce("loop", F.lit(False)))
    looped = tables.write(looped.select(*ids, same.alias("same"), "loop", base("v1_id").alias("b1"), base("v2_id").alias("b2")), "looped")
    gone = tables.write(n1.select("pair", "node_id").join(mapped.select("pair", F.col("v1_id").alias("node_id")), ["pair", "node_id"], "left_anti"), "gone")
    come = tables.write(n2.select("pair", "node_id").join(mapped.select("pair", F.col("v2_id").alias("node_id")), ["pair", "node_id"], "left_anti"), "come")
    lone = lambda df: df.select("pair", base("node_id").alias("b1"), base("node_id").alias("b2"), F.lit(True).alias("hot"))
    since = tracked_since(looped.select("pair", "b1", "b2", (~F.col("same") | F.col("loop")).alias("hot")).union(lone(gone)).union(lone(come)), tables, tracked)
    watched = looped
    for i in ("1", "2"):
        watched = watched.join(since.select(F.col("base_id").alias(f"b{i}"), F.col("since").alias(f"s{i}")), f"b{i}", "left")
    watched = watched.withColumn("is_tracked", F.coalesce(F.least("s1", "s2") < F.col("pair"), F.lit(False))).join(named, "pair")

    split = F.col("same") & ~F.col("is_tracked") & F.col("loop")
    apart = ~F.col("same") | F.col("is_tracked")
    v1, v2 = X.versioned_id(F.col("v1_id"), F.col("first")), X.versioned_id(F.col("v2_id"), F.col("second"))
    merged = {"status": F.when(~F.col("same") | split, "MODIFIED").otherwise("UNCHANGED"), "m1": F.when(apart, v1).otherwise(F.col("v1_id")), "m2": F.when(apart | split, v2).otherwise(F.col("v1_id")), "apart": apart | split}
    state = tables.write(watched.withColumns(merged).select(*ids, "is_tracked", "first", "second", *merged), "state")
    left, right = gone.join(named, "pair"), come.join(named, "pair")

    def rows(side: DataFrame, ends: DataFrame) -> DataFrame:
        """Nodes of a side at ``ends``, copied to their merged id with versions and status: each side is joined once."""
        own = side.join(ends, ["pair", "node_id"]).withColumn("original_id", F.col("node_id")).withColumn("node_id", F.col("_id")).drop("_id")
        return own.withColumns({"first_version": F.element_at("versions", 1), "last_version": F.element_at("versions", -1)})

    old, new = X.versioned_id(F.col("node_id"), F.col("first")), X.versioned_id(F.col("node_id"), F.col("second"))
    one, two, status = F.array("first"), F.array("second"), F.col("status")
    at = lambda ends, key, merged_id, versions, status: ends.select("pair", F.col(key).alias("node_id"), merged_id.alias("_id"), versions.alias("versions"), status.alias("version_status"))
    ends1 = at(state, "v1_id", F.col("m1"), F.when(F.col("apart"), one).otherwise(F.array("first", "second")), status).union(at(left, "node_id", old, one, F.lit("DELETED")))
    ends2 = at(state.where("apart"), "v2_id", F.col("m2"), two, status).union(at(right, "node_id", new, two, F.lit("ADDED")))
    nodes = rows(n1, ends1).unionByName(rows(n2, ends2))

    ids1 = state.select("pair", "v1_id", "m1").union(left.select("pair", "node_id", old))
    ids2 = state.select("pair", "v2_id", "m2").union(right.select("pair", "node_id", new))
    line = lambda e: e.select("pair", "src", "dst", "edge_type", (F.col("line") if "line" in e.columns else F.lit(0)).alias("line"))
    edges = R.merge_edges(R.remap(line(e1), ids1, PAIR), R.remap(line(e2), ids2, PAIR), PAIR)

    seq = F.struct("phase", "ref_id", "left_pos", "right_pos", "step")
    placed = R.remap_sides(raw, ids1, ids2, PAIR).withColumn("seq", seq).drop("phase", "ref_id", "left_pos", "right_pos", "step")
    evolution = C.merge_evolution(placed, PAIR).drop("seq")
    quiet = state.where("is_tracked and status = 'UNCHANGED'").select("pair", F.col("m1").alias("src"), F.lit("UNCHANGED").alias("edge_type"), F.col("m2").alias("dst"), F.lit(1).cast("long").alias("occurrences"), F.lit(1.0).alias("confidence"))
    evolution = evolution.unionByName(quiet, allowMissingColumns=True).join(named, "pair").withColumnsRenamed({"first": "from_version", "second": "to_version"})
    return Evolution(nodes, edges, evolution.withColumn("version_flow", X.version_flow(F.col("from_version"), F.col("to_version"))))


def merge(g1: Graph, g2: Graph, mapping: DataFrame, refactorings: DataFrame, changed: DataFrame, labels: tuple[str, str] = ("V1", "V2"), tracked: DataFrame | None = None, tables: Tables | None = None) -> Evolution:
    """Merge two versions: `merge_pairs` over one pair, whose tables are given without ``pair``."""
    at = lambda df: df.withColumn("pair", F.lit(0))
    pairs = g1.nodes.sparkSession.createDataFrame([(0, *labels)], "pair int, first string, second string")
    m = merge_pairs(at(g1.nodes), at(g2.nodes), at(g1.edges), at(g2.edges), pairs, at(mapping), at(refactorings), at(changed), tracked, tables)
    return Evolution(m.nodes.drop("pair"), m.edges.drop("pair"), m.evolution.drop("pair"))


def analyse(g1: Graph, g2: Graph, refactorings: DataFrame, hunks: DataFrame, labels: tuple[str, str] = ("V1", "V2"), tracked: DataFrame | None = None, matchers=None) -> Evolution:
    """The two-version analysis from facts: match, resolve refactorings, mark changed nodes from ``hunks``, merge. The facts are written once, as many steps read them."""
    tables = Tables(g1.nodes.sparkSession, "evolution")
    g1, g2 = (Graph(tables.write(g.nodes, "nodes"), tables.write(g.edges, "edges")) for g in (g1, g2))
    refactorings, hunks = tables.write(refactorings, "refactorings"), tables.write(hunks, "hunks")
    mapping = R.match_all(g1.nodes, g2.nodes, matchers)
    return merge(g1, g2, mapping, with_sides(refactorings, g1.nodes, g2.nodes), L.changed_nodes(g1.nodes, g2.nodes, hunks), labels, tracked, tables)


def statistics(merged: Evolution) -> DataFrame:
    """``what, kind, n``: nodes by status and evolution edges by type, each known kind even if there is none of it."""
    spark = merged.nodes.sparkSession
    known = spark.createDataFrame([("node", s) for s in STATES], "what string, kind string")
    kinds = sorted({k for _, k, _ in R.KINDS} | {"UNCHANGED", "SIMILAR_TO"})
    known = known.union(spark.createDataFrame([("evolution", k) for k in kinds], "what string, kind string"))
    n = merged.nodes.groupBy(F.lit("node").alias("what"), F.col("version_status").alias("kind")).agg(F.count("*").alias("n"))
    e = merged.evolution.groupBy(F.lit("evolution").alias("what"), F.col("edge_type").alias("kind")).agg(F.count("*").alias("n"))
    return known.join(n.union(e), ["what", "kind"], "left").select("what", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def counters(merged: Evolution) -> DataFrame:
    """``what, kind, n`` of a merge: nodes by status, structural edges by type, those of calls also by the version they came from, evolution edges by type."""
    c = F.col
    nodes = merged.nodes.groupBy(F.lit("node").alias("what"), c("version_status").alias("kind")).agg(F.count("*").alias("n"))
    # Edges are counted once by type and version; these few rows give both kinds of counts.
    own = F.struct(F.lit("edge").alias("what"), c("edge_type").alias("kind"))
    call = F.struct(F.lit("call").alias("what"), F.concat(F.lit("V"), c("side").cast("string")).alias("kind"))
    sided = merged.edges.groupBy("edge_type", "side").agg(F.count("*").alias("n"))
    edges = sided.select(F.explode(F.when(c("edge_type") == "CALLS", F.array(own, call)).otherwise(F.array(own))).alias("k"), "n").groupBy("k.what", "k.kind").agg(F.sum("n").alias("n"))
    evolution = merged.evolution.groupBy(F.lit("evolution").alias("what"), c("edge_type").alias("kind")).agg(F.count("*").alias("n"))
    return nodes.union(edges).union(evolution)


def labelled(rows: DataFrame, columns: list[str], versions: DataFrame) -> DataFrame:
    """``rows`` with commit ids in ``columns`` replaced by the labels of ``versions(label, commit_id)``; what is no known commit id stays."""
    names = versions.where("commit_id is not null").groupBy("commit_id").agg(F.min("label").alias("_label"))
    for c in columns:
        own = names.withColumnRenamed("commit_id", "_commit")
        rows = rows.join(own, F.col(c) == F.col("_commit"), "left").withColumn(c, F.coalesce("_label", c)).drop("_label", "_commit")
    return rows


def neighbours(versions: DataFrame) -> DataFrame:
    """``pair, first, second``: labels of neighbouring versions, the newest pair 0; ``versions(label, ord)`` counts from 0, oldest first, without gaps."""
    newest = versions.agg(F.max("ord").alias("top"))
    older = versions.select(F.col("label").alias("first"), (F.col("ord") + 1).alias("ord"))
    both = older.join(versions.select(F.col("label").alias("second"), "ord"), "ord").crossJoin(F.broadcast(newest))
    return both.select((F.col("top") - F.col("ord")).cast("int").alias("pair"), "first", "second")


def aggregate(merged: Evolution, versions: DataFrame) -> Evolution:
    """Merged pairs (``pair`` 0 the newest) rolled up into one graph.

    Versions of nodes and ends of evolution edges may be named by commit id; they become labels of ``versions(label, ord, commit_id)``, and a name
    that is none of these stays. Nodes of one id unite their versions and keep the strongest status, the newest pair's of equals, and
    the other columns of the newest pair; of structural edges with the same ends and kind the newest pair's stays. An evolution
    edge enters with one occurrence and one description, and one that is already there is merged into.
    """
    order = F.broadcast(versions.select("label", "ord"))
    names = versions if "commit_id" in versions.columns else versions.withColumn("commit_id", F.lit(None).cast("string"))
    rows = labelled(merged.nodes.select("node_id", F.explode("versions").alias("label"), F.col("version_status").alias("status"), F.col("pair").alias("seq")), ["label"], names)
    rolled = R.roll_up(rows.join(order, "label", "left")).withColumnsRenamed({"status": "version_status"})
    rest = [c for c in merged.nodes.columns if c not in ("node_id", "versions", "version_status", "first_version", "last_version", "pair")]
    latest = merged.nodes.groupBy("node_id").agg(F.min(F.struct("pair", "original_id", *[c for c in rest if c != "original_id"])).alias("r")).select("node_id", *[F.col(f"r.{c}") for c in rest])
    kept = [c for c in merged.edges.columns if c not in ("src", "edge_type", "dst", "pair")]
    structural = merged.edges.groupBy("src", "edge_type", "dst").agg(F.min(F.struct("pair", *kept)).alias("r")).select("src", "edge_type", "dst", *[F.col(f"r.{c}") for c in kept])
    fresh = merged.evolution.withColumn("descriptions", F.slice("descriptions", 1, 1)) if "descriptions" in merged.evolution.columns else merged.evolution
    fresh = labelled(fresh, ["from_version", "to_version"], names).withColumn("version_flow", X.version_flow(F.col("from_version"), F.col("to_version")))
    evolution = C.merge_evolution(fresh.withColumnRenamed("pair", "seq").drop("occurrences")).drop("seq")
    return Evolution(rolled.join(latest, "node_id"), structural, evolution)


def timeline(nodes: DataFrame, edges: DataFrame, versions: DataFrame, refactorings: DataFrame, hunks: DataFrame, matchers=None) -> Evolution:
    """All versions of a code base as one graph, in one pass over all pairs of neighbours.

    ``nodes`` and ``edges`` hold every version, told apart by ``version``, and ``refactorings`` and ``hunks`` those of a pair under the
    ``version`` that is its newer one: a label or a commit id of ``versions(label, ord[, commit_id])``. A pair's steps are those of
    `merge_pairs`, in which a node that a newer pair changed is tracked; pairs are then put together by `aggregate`. The plan is the same
    for two versions and for fifty.
    """
    names = versions if "commit_id" in versions.columns else versions.withColumn("commit_id", F.lit(None).cast("string"))
    tables, pairs = Tables(nodes.sparkSession, "timeline"), neighbours(versions)
    at = lambda df, end: labelled(df, ["version"], names).join(F.broadcast(pairs.select("pair", F.col(end).alias("version"))), "version").drop("version")
    n1, n2, e1, e2 = (tables.write(at(df, end), "side") for df in (nodes, edges) for end in ("first", "second"))
    refs, diffs = at(refactorings, "second"), at(hunks, "second")
    mapping = R.match_all(n1, n2, matchers, by=PAIR)
    merged = merge_pairs(n1, n2, e1, e2, pairs, mapping, with_sides(refs, n1, n2, PAIR), L.changed_nodes(n1, n2, diffs, PAIR), tables=tables)
    return aggregate(Evolution(*(tables.write(t, "merged") for t in (merged.nodes, merged.edges, merged.evolution))), versions)


def tagged(g1: Graph, g2: Graph, refactorings: DataFrame, scores: DataFrame | None = None, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The variant that only the design describes: mapping and structural edges that name their version.

    Mapping tiers, each among what is still free: refactorings (``left_id, right_id, type``: RENAMED, MOVED, else MODIFIED), ``scores(v1_id,
    v2_id, score)`` above ``threshold`` (MODIFIED), then nodes of one id, type, source and signature (IDENTICAL); the rest is ADDED or
    DELETED. Returns ``v1_id, v2_id, mapping`` and ``src, dst, edge_type, version`` (v1, v2 or both).
    """
    kind = F.when(F.col("type").contains("RENAME"), "RENAMED").when(F.col("type").contains("MOVE"), "MOVED").otherwise("MODIFIED")
    out = R.best_mutual(refactorings.select(F.col("left_id").alias("v1_id"), F.col("right_id").alias("v2_id"), F.lit(1.0).alias("score")).distinct(), 0.0)
    names = refactorings.select(F.col("left_id").alias("v1_id"), F.col("right_id").alias("v2_id"), kind.alias("mapping")).groupBy("v1_id", "v2_id").agg(F.max("mapping").alias("mapping"))
    out = out.join(names, ["v1_id", "v2_id"]).select("v1_id", "v2_id", "mapping")
    free = lambda df, c: df.join(out.select(c), c, "left_anti")
    if scores is not None:
        won = R.best_mutual(free(free(scores.where(F.col("score") > threshold), "v1_id"), "v2_id"), threshold)
        out = out.union(won.select("v1_id", "v2_id", F.lit("MODIFIED")))
    own = ["node_id", "node_type", "source_code", "signature"]
    a, b = free(g1.nodes.select(*own).withColumnRenamed("node_id", "v1_id"), "v1_id"), free(g2.nodes.select(*own).withColumnRenamed("node_id", "v2_id"), "v2_id")
    same = (F.col("v1_id") == F.col("v2_id")) & (a["node_type"] == b["node_type"]) & a["source_code"].eqNullSafe(b["source_code"]) & a["signature"].eqNullSafe(b["signature"])
    out = out.union(a.join(b, same).select("v1_id", "v2_id", F.lit("IDENTICAL")))
    gone = free(g1.nodes.select(F.col("node_id").alias("v1_id")), "v1_id").select("v1_id", F.lit(None).cast("string"), F.lit("DELETED"))
    come = free(g2.nodes.select(F.col("node_id").alias("v2_id")), "v2_id").select(F.lit(None).cast("string"), "v2_id", F.lit("ADDED"))
    sides = g1.edges.select("src", "dst", "edge_type", F.lit("v1").alias("v")).union(g2.edges.select("src", "dst", "edge_type", F.lit("v2")))
    version = F.when(F.min("v") != F.max("v"), "both").otherwise(F.min("v"))
    return out.union(gone).union(come), sides.groupBy("src", "dst", "edge_type").agg(version.alias("version"))
