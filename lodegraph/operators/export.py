"""Sinks: bulk CSV and its import, JSON records, batches for a database, partitioned tables, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import exprs as X
from lodegraph.sources import facts

#: Columns of a bulk file that are no properties.
NODE_HEADER, EDGE_HEADER = (":ID", ":LABEL", "name"), (":START_ID", ":END_ID", ":TYPE")
VERSION_HEADER = ("versionStatus:string", "versions:string[]", "firstVersion:string", "lastVersion:string")
FIXED_KEYS = ("id", "label", "name")


def property_profile(rows: DataFrame, props: str = "props", kind: str = "node_type") -> DataFrame:
    """Property keys with a meaningful value somewhere, by kind, with how many rows carry one."""
    x = rows.select(kind, F.explode(props).alias("key", "value"))
    return x.where(X.meaningful(F.col("value"))).groupBy(kind, "key").agg(F.count("*").alias("n"))


def property_keys(rows: DataFrame) -> list[str]:
    """Keys of ``props`` (texts) and ``lists`` (arrays), where there are such columns, with a meaningful value in any row; sorted."""
    found = []
    if "props" in rows.columns:
        found.append(rows.select(F.explode("props").alias("key", "v")).where(X.meaningful(F.col("v"))).select("key"))
    if "lists" in rows.columns:
        found.append(rows.select(F.explode("lists").alias("key", "v")).where(F.size("v") > 0).select("key"))
    names = {r["key"] for part in found for r in part.distinct().collect()}  # as many as there are names of properties
    return sorted(names - set(FIXED_KEYS))


def _cells(rows: DataFrame, keys: list[str]) -> list[Column]:
    """A field for each property: a list if the row has one under that name, else the text."""
    null = F.lit(None).cast("string")
    text = lambda k: F.try_element_at("props", F.lit(k)) if "props" in rows.columns else null
    if "lists" not in rows.columns:
        return [X.property_text(text(k)) for k in keys]
    listed = lambda k: F.try_element_at("lists", F.lit(k))
    return [F.when(listed(k).isNotNull(), X.list_format(listed(k))).otherwise(X.property_text(text(k))) for k in keys]


def _lines(rows: DataFrame, fixed: list[Column], keys: list[str]) -> DataFrame:
    return rows.select(F.array_join(F.array(*fixed, *_cells(rows, keys)), ",", "").alias("value"))


def labels(nodes: DataFrame) -> Column:
    """``TYPE;kind`` and ``METHOD;kind`` where a kind is known, else the node's type."""
    kind = F.trim(F.coalesce("kind", F.lit("")))
    return F.when(F.col("node_type").isin("TYPE", "METHOD") & (kind != ""), F.concat_ws(";", "node_type", kind)).otherwise(F.col("node_type"))


def ready_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("label", labels(nodes))


def node_lines(nodes: DataFrame, keys: list[str] | None = None) -> tuple[str, DataFrame]:
    """Header and one line a node: id, label, cleaned name, version columns if any node has a version, then the properties by name.

    ``nodes(node_id, node_type, kind, name, label)`` with, where there are any, ``props``, ``lists``, ``version_status, versions,
    first_version, last_version``. A blank name gives way to the label. ``keys`` are found in the data unless given.
    """
    keys = property_keys(nodes) if keys is None else sorted(keys)
    named = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.col("label")).otherwise(F.col("name"))
    fixed, header = [X.csv_quote(F.col("node_id")), labels(nodes), X.csv_quote(X.clean_name(named))], [*NODE_HEADER]
    if "versions" in nodes.columns and not nodes.where("version_status is not null or size(versions) > 0").isEmpty():
        header += VERSION_HEADER
        listed = F.array_join(F.coalesce("versions", F.array().cast("array<string>")), ";")
        fixed += [X.csv_quote(F.coalesce(c, F.lit(""))) for c in (F.col("version_status"), listed, F.col("first_version"), F.col("last_version"))]
    header += [f"{k}:{X.header_type(k)}" for k in keys]
    return ",".join(header), _lines(nodes, fixed, keys)


def edge_lines(edges: DataFrame, keys: list[str] | None = None) -> tuple[str, DataFrame]:
    """Header and one line an edge: both ends, type, then the properties by name; snippets and descriptions are no properties."""
    keys = property_keys(edges) if keys is None else sorted(keys)
    fixed = [X.csv_quote(F.col("src")), X.csv_quote(F.col("dst")), F.col("edge_type")]
    return ",".join([*EDGE_HEADER, *(f"{k}:{X.header_type(k)}" for k in keys)]), _lines(edges, fixed, keys)


def write_lines(header: str, lines: DataFrame, path: str) -> None:
    """Part files under ``path/rows`` and the header in ``path/header``, as bulk importers read them: no task gathers all rows."""
    lines.write.mode("overwrite").text(f"{path}/rows")
    lines.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def import_script(path: str, database: str = "graph", command: str = "bulk-import") -> str:
    """A shell script that feeds both bulk files to an importer; repeated nodes and edges without ends are skipped, as in `loads`."""
    parts = [f"{command} --database={database}", f"--nodes={path}/nodes/header,{path}/nodes/rows/part-.*", f"--relationships={path}/edges/header,{path}/edges/rows/part-.*"]
    return "#!/bin/sh\nset -e\n" + " \\\n  ".join([*parts, "--skip-duplicate-nodes=true", "--skip-bad-relationships=true"]) + "\n"


def readme(n_nodes: int, n_edges: int) -> str:
    """What stands beside the bulk files: how many rows there are, and queries that check an import."""
    return f"Nodes: {n_nodes}\nEdges: {n_edges}\n\nCheck after the import: count the nodes, count the edges, count nodes by label.\n"


def write_package(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Bulk files, script and readme under ``path``."""
    spark = nodes.sparkSession
    write_lines(*node_lines(nodes), f"{path}/nodes")
    write_lines(*edge_lines(edges), f"{path}/edges")
    for name, text in (("script", import_script(path)), ("readme", readme(nodes.count(), edges.count()))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def write_json(rows: DataFrame, path: str, by: str) -> None:
    """JSON lines, a folder for each value of ``by`` (a repository or project)."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def valid_commit_records(sets: DataFrame) -> DataFrame:
    """Records of valid commits, as `facts.VALID_COMMIT` describes them, from `mining.commit_sets`; other columns stay."""
    side = lambda g: F.struct(F.col(f"{g}_new").alias("new"), F.col(f"{g}_old").alias("old")).alias(f"{g}_methods")
    rest = [c for c in sets.columns if c not in ("commit_id", "focal_new", "focal_old", "test_new", "test_old")]
    return sets.select(*rest, F.struct(F.col("commit_id").alias("sha1")).alias("commit"), side("focal"), side("test"))


def write_batches(rows: DataFrame, send: Callable[[list[dict]], None], size: int = 2000, retries: int = 3) -> int:
    """Hand rows to ``send`` in batches of ``size`` from every partition; a batch that fails is tried again. Returns how many rows went out.

    ``send`` must allow a batch to come twice (a retried task sends its rows again). Write all nodes before any edges.
    """
    def flush(batch: list[dict]) -> int:
        for left in range(retries, -1, -1):
            try:
                send(batch)
                return len(batch)
            except Exception:
                if not left:
                    raise
        return 0

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sent, held = 0, []
        for b in batches:
            for row in b.to_pylist():
                held.append(row)
                if len(held) == size:
                    sent, held = sent + flush(held), []
        if held:
            sent += flush(held)
        yield pa.RecordBatch.from_pydict({"n": [sent]})

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def endpoint_key(columns: list[str]) -> Column:
    """The natural key that a statement names a node of each type by: signature, qualified name, a file's path, a project's name."""
    c = lambda name: F.col(name) if name in columns else F.lit(None).cast("string")
    by = F.when(F.col("node_type") == "METHOD", F.coalesce(c("signature"), c("node_id"))).when(F.col("node_type") == "FILE", F.coalesce(c("absolute_path"), c("node_id")))
    return by.when(F.col("node_type") == "PROJECT", c("name")).otherwise(F.coalesce(c("qualified_name"), c("node_id")))


def resolve_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edge_type, src_type, src_key, dst_type, dst_key`` (and the edge's own columns): what a statement that creates the edge has to name.

    An edge with an unknown end gives none; evolution edges are rejected, as no statement knows them.
    """
    key = nodes.select("node_id", "node_type", endpoint_key(nodes.columns).alias("key"))
    end = lambda e: key.select(F.col("node_id").alias(e), F.col("node_type").alias(f"{e}_type"), F.col("key").alias(f"{e}_key"))
    own = edges.where(~F.col("edge_type").isin(*EVOLUTION_TYPES))
    return own.join(end("src"), "src").join(end("dst"), "dst")


#: Evolution edge types.
EVOLUTION_TYPES = ("RENAMED", "MOVED", "EXTRACTED", "INLINED", "CHANGED_SIGNATURE", "REFACTORED", "UNCHANGED", "SIMILAR_TO")


def property_text(value: Column, kind: str) -> Column:
    """A value of a property as statements write it: numbers and booleans bare, lists in brackets, texts quoted; null for null."""
    if kind.startswith("array<"):
        inner = kind[6:-1]
        return F.concat(F.lit("["), F.array_join(F.transform(F.filter(value, lambda x: x.isNotNull()), lambda x: property_text(x, inner)), ", "), F.lit("]"))
    if kind in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return value.cast("string")
    return F.when(value.isNotNull(), F.concat(F.lit("'"), X.query_text(value.cast("string")), F.lit("'")))


def properties(df: DataFrame, columns: list[str]) -> Column:
    """``{a: 1, b: 'x'}`` of the columns that have a value in a row, in the order given."""
    kinds = dict(df.dtypes)
    each = [F.concat(F.lit(f"{c}: "), property_text(F.col(c), kinds[c])) for c in columns]
    return F.concat(F.lit("{"), F.concat_ws(", ", *each), F.lit("}"))


def node_statements(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``node_id, statement`` that creates each node with its key and the properties ``columns`` that it has."""
    own = nodes.withColumn("key", endpoint_key(nodes.columns))
    return own.select("node_id", F.concat(F.lit("CREATE (n:"), F.col("node_type"), F.lit(" "), properties(own, ["key", *columns]), F.lit(")")).alias("statement"))


def statements(resolved: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One text a resolved edge that creates it between the nodes of its keys, with the properties ``columns`` that it has."""
    node = lambda e: F.concat(F.lit(f"({e}:"), f"{e}_type", F.lit(" {key: '"), X.query_text(F.col(f"{e}_key")), F.lit("'})"))
    own = F.concat(F.lit(" "), properties(resolved, columns)) if columns else F.lit("")
    return resolved.select(F.concat(F.lit("MATCH "), node("src"), F.lit(", "), node("dst"), F.lit(" CREATE (src)-[:"), F.col("edge_type"), own, F.lit("]->(dst)")).alias("statement"))


def write_tables(nodes: DataFrame, edges: DataFrame, path: str, reset: bool = True) -> None:
    """Nodes by type and edges by type as partitioned Parquet, each partition sorted by what lookups ask for; ``reset`` replaces what is there."""
    mode = "overwrite" if reset else "append"
    nodes.repartition("node_type", "node_id").sortWithinPartitions("node_type", "node_id").write.mode(mode).partitionBy("node_type").parquet(f"{path}/nodes")
    edges.repartition("edge_type", "src").sortWithinPartitions("edge_type", "src").write.mode(mode).partitionBy("edge_type").parquet(f"{path}/edges")


def save_bucketed(nodes: DataFrame, edges: DataFrame, name: str, buckets: int = 64, path: str | None = None) -> None:
    """Tables ``<name>_nodes`` bucketed by node id, and ``<name>_out``, ``<name>_in``: edges bucketed by their source and by their target.

    Joins of edges with the nodes at either end need no exchange, and the rows of one id are read from one bucket. ``path``: where the
    files go, if not to the warehouse.
    """
    for df, part, key in ((nodes, "nodes", "node_id"), (edges, "out", "src"), (edges, "in", "dst")):
        # Dealt like the buckets, so that a bucket is one file.
        w = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
        (w.option("path", f"{path}/{part}") if path else w).saveAsTable(f"{name}_{part}")


def bucketed_neighbors(spark: SparkSession, name: str, incoming: bool = False) -> DataFrame:
    """Every edge with the node at its source (at its target for ``incoming``), from `save_bucketed` tables, each bucket joined where it lies."""
    end, part = ("dst", "in") if incoming else ("src", "out")
    nodes = spark.table(f"{name}_nodes").hint("merge")
    return spark.table(f"{name}_{part}").join(nodes, F.col(end) == F.col("node_id"))


def save_progress(progress: DataFrame, path: str) -> None:
    """Progress records as JSON, a folder a project."""
    progress.write.mode("overwrite").partitionBy("project_name").json(path)


def load_progress(spark: SparkSession, path: str) -> DataFrame:
    """Saved progress; an empty table where none was saved."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], facts.PROGRESS)
    return spark.read.schema(facts.PROGRESS).json(path)
