"""From facts about code to the nodes and edges of a property graph.

``facts`` is a mapping of names to tables, as outside tools leave them: ``project, packages, files, types, methods,
fields, occurrences``. Ids are natural keys: a package's and type's qualified name, a file's path, and
``Type#signature`` or ``Type#name`` of a member. Whatever refers to a node that is not there gives no edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import exprs as X
from lodegraph.functions import texts as T
from lodegraph.operators import collapse as C
from lodegraph.operators.graph import Graph
from lodegraph.sources.tables import Tables

NODE = "node_id string, node_type string, kind string, name string, label string, absolute_path string, line_start int, line_end int"
EDGE = ("src", "dst", "edge_type", "detail", "position")


def member_id(owner: str = "declaring_type", own: str = "signature") -> Column:
    return F.concat(F.col(owner), F.lit("#"), F.col(own))


def _known(facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Facts that become nodes: no unnamed packages, anonymous types or enum constants, and no members of types that are left out."""
    types = facts["types"].where("not is_anonymous")
    owner = types.select(F.col("qualified_name").alias("declaring_type")).distinct()
    return facts | {
        "packages": facts["packages"].where("not is_unnamed"),
        "types": types,
        "methods": facts["methods"].join(owner, "declaring_type", "left_semi"),
        "fields": facts["fields"].where("not is_enum_constant").join(owner, "declaring_type", "left_semi"),
    }


def nodes(facts: dict[str, DataFrame]) -> DataFrame:
    """One row a node; of facts with one id the one that begins first (then the smallest) counts."""
    f = _known(facts)

    def rows(name: str, node_type: str, node_id: Column, title: Column, kind=None, detail=None, path=None, start=None, end=None) -> DataFrame:
        text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
        pick = lambda c, none: none if c is None else c
        t, d = F.lit(node_type), pick(detail, pick(kind, text))
        cols = [node_id, t, pick(kind, text), title, T.node_label(t, title, d), pick(path, text), pick(start, number), pick(end, number)]
        return f[name].select(*[c.alias(n.split(" ")[0]) for c, n in zip(cols, NODE.split(", "), strict=True)])

    c = F.col
    parts = [
        rows("project", "PROJECT", c("name"), c("name")),
        rows("packages", "PACKAGE", c("qualified_name"), c("qualified_name")),
        rows("files", "FILE", c("path"), F.element_at(F.split("path", "/"), -1), path=c("path")),
        rows("types", "TYPE", c("qualified_name"), X.simple_name(c("qualified_name")), c("kind"), None, c("path"), c("line_start"), c("line_end")),
        rows("methods", "METHOD", member_id(), c("name"), c("kind"), None, c("path"), c("line_start"), c("line_end")),
        rows("fields", "FIELD", member_id(own="name"), c("name"), None, c("type"), c("path"), c("line_number"), c("line_number")),
    ]
    every = reduce(DataFrame.unionByName, parts)
    own = [x.split(" ")[0] for x in NODE.split(", ")]
    first = F.min(F.struct("line_start", *[x for x in own if x not in ("node_id", "node_type", "line_start")]))
    return every.groupBy("node_id", "node_type").agg(first.alias("r")).select("node_id", "node_type", "r.*").select(*own)


def _ids(all_nodes: DataFrame, node_type: str, name: str) -> DataFrame:
    return all_nodes.where(F.col("node_type") == node_type).select(F.col("node_id").alias(name))


def _edges(df: DataFrame, edge_type, detail=None, position=None) -> DataFrame:
    kind = F.lit(edge_type) if isinstance(edge_type, str) else edge_type
    none = F.lit(None)
    return df.select("src", "dst", kind.alias("edge_type"), (none if detail is None else detail).cast("string").alias("detail"), (none if position is None else position).cast("int").alias("position"))


def project_edges(facts: dict[str, DataFrame], all_nodes: DataFrame) -> DataFrame:
    """The project (one row, so a cross join) to its packages and files."""
    one = F.broadcast(facts["project"].agg(F.min("name").alias("src")).where("src is not null"))
    own = all_nodes.where("node_type in ('PACKAGE', 'FILE')").select(F.col("node_id").alias("dst"), "node_type").crossJoin(one)
    return _edges(own, F.when(F.col("node_type") == "PACKAGE", "HAS_PACKAGE").otherwise("CONTAINS_FILE"))


def type_edges(facts: dict[str, DataFrame], all_nodes: DataFrame) -> DataFrame:
    """Types to their package, and files to their types."""
    types = _known(facts)["types"]
    inside = types.select(F.col("qualified_name").alias("src"), F.col("package").alias("dst")).distinct().join(_ids(all_nodes, "PACKAGE", "dst"), "dst", "left_semi")
    declared = types.select(F.col("path").alias("src"), F.col("qualified_name").alias("dst")).distinct().join(_ids(all_nodes, "FILE", "src"), "src", "left_semi")
    return _edges(inside, "IN_PACKAGE").union(_edges(declared, "DECLARES_TYPE"))


def member_edges(facts: dict[str, DataFrame]) -> DataFrame:
    """Types to their methods, constructors and fields; the kind of member is the detail."""
    f = _known(facts)
    kind = F.when(F.col("kind") == "CONSTRUCTOR", "constructor").otherwise("method")
    methods = f["methods"].groupBy(F.col("declaring_type").alias("src"), member_id().alias("dst")).agg(F.min(kind).alias("m"))
    fields = f["fields"].select(F.col("declaring_type").alias("src"), member_id(own="name").alias("dst"), F.lit("field").alias("m")).distinct()
    return _edges(methods.unionByName(fields), "DECLARES", F.col("m"))


def inheritance_edges(facts: dict[str, DataFrame], all_nodes: DataFrame) -> DataFrame:
    """Types to a superclass and interfaces that are nodes themselves."""
    types = _known(facts)["types"]
    up = types.select(F.col("qualified_name").alias("src"), F.col("super_class").alias("dst"), F.lit("EXTENDS").alias("k")).where("dst <> 'java.lang.Object'")
    wide = types.select(F.col("qualified_name").alias("src"), F.explode("interfaces").alias("dst"), F.lit("IMPLEMENTS").alias("k"))
    return _edges(up.union(wide).distinct().join(_ids(all_nodes, "TYPE", "dst"), "dst", "left_semi"), F.col("k"))


def override_edges(facts: dict[str, DataFrame], all_nodes: DataFrame) -> DataFrame:
    """A method to the method of the same signature in each direct supertype; ``annotated`` or not is the detail."""
    f = _known(facts)
    types, methods = f["types"], f["methods"]
    supers = types.select(F.col("qualified_name").alias("declaring_type"), F.explode(F.array_compact(F.concat(F.array("super_class"), F.coalesce("interfaces", F.array().cast("array<string>"))))).alias("up")).distinct()
    known = supers.join(_ids(all_nodes, "TYPE", "up"), "up", "left_semi")
    own = methods.where("kind <> 'CONSTRUCTOR'").groupBy("declaring_type", "signature").agg(F.max("has_override").alias("o"))
    pairs = own.join(known, "declaring_type").select(member_id().alias("src"), member_id("up").alias("dst"), "o")
    found = pairs.join(_ids(all_nodes, "METHOD", "dst"), "dst", "left_semi")
    return _edges(found, "OVERRIDES", F.when(F.col("o"), "annotated").otherwise("plain"))


def signature_edges(facts: dict[str, DataFrame], all_nodes: DataFrame) -> DataFrame:
    """Methods to the types of their parameters (an edge each, with its position), results and exceptions."""
    m = _known(facts)["methods"]
    first = m.groupBy("declaring_type", "signature").agg(F.min(F.struct("line_start", "parameter_types", "parameter_names", "return_type", "exceptions", "kind")).alias("r"))
    own = first.select(member_id().alias("src"), "r.*")
    used = own.select("src", F.posexplode(F.arrays_zip("parameter_types", "parameter_names")).alias("position", "p"))
    used = _edges(used.withColumn("dst", F.col("p.parameter_types")), "USES_PARAMETER", F.col("p.parameter_names"), F.col("position"))
    result = _edges(own.where("kind <> 'CONSTRUCTOR'").withColumn("dst", F.col("return_type")), "RETURN_TYPE")
    thrown = _edges(own.select("src", F.explode("exceptions").alias("dst")).distinct(), "THROWS")
    return used.union(result).union(thrown).join(_ids(all_nodes, "TYPE", "dst"), "dst", "left_semi").select(*EDGE)


def use_edges(facts: dict[str, DataFrame], all_nodes: DataFrame) -> dict[str, DataFrame]:
    """Calls, tests, reads and writes, collapsed to an edge a pair; occurrences count only with both ends known."""
    methods = all_nodes.where("node_type = 'METHOD'")
    occ = facts["occurrences"]
    routed = C.route(occ.where("occ_kind in ('INVOCATION', 'CONSTRUCTOR')"), methods)
    access = occ.where("occ_kind in ('READ', 'WRITE')").join(_ids(all_nodes, "METHOD", "src"), "src", "left_semi").join(_ids(all_nodes, "FIELD", "dst"), "dst", "left_semi")
    return {
        "CALLS": C.calls(routed.where("edge_type = 'CALLS'")),
        "TESTS": C.first_only(routed.where("edge_type = 'TESTS'"), ("src", "dst"), ("line", "occ_kind"), ("line", "occ_kind")),
        "READS": C.accesses(access.where("occ_kind = 'READ'"), "read"),
        "WRITES": C.accesses(access.where("occ_kind = 'WRITE'"), "written"),
    }


def build(facts: dict[str, DataFrame]) -> Graph:
    """All nodes and all edges. Edge columns: ``src, dst, edge_type, detail, position, n, lines, description``."""
    # Every kind of edge looks its ends up here, so nodes are written once.
    all_nodes = Tables(facts["types"].sparkSession, "build").write(nodes(facts), "nodes")
    plain = [project_edges(facts, all_nodes), type_edges(facts, all_nodes), member_edges(facts), inheritance_edges(facts, all_nodes), override_edges(facts, all_nodes), signature_edges(facts, all_nodes)]
    out = reduce(DataFrame.unionByName, [p.select(*EDGE) for p in plain])
    used = use_edges(facts, all_nodes)
    for kind, count in (("CALLS", "call_count"), ("READS", "access_count"), ("WRITES", "access_count")):
        rows = used[kind].select("src", "dst", F.lit(kind).alias("edge_type"), F.col(count).cast("long").alias("n"), F.col("lines"), "description")
        out = out.unionByName(rows, allowMissingColumns=True)
    tests = used["TESTS"].select("src", "dst", F.lit("TESTS").alias("edge_type"), F.lit(1).cast("long").alias("n"), F.array("line").alias("lines"))
    return Graph(all_nodes, out.unionByName(tests, allowMissingColumns=True))
