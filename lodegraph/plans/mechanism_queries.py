"""Sinks, bucketed tables, state that goes on, and what is left of tests and statements."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodegraph.functions import exprs as X
from lodegraph.operators import build as B
from lodegraph.operators import evolve as V2
from lodegraph.operators import export as E
from lodegraph.operators import graph as G
from lodegraph.operators import mining as M
from lodegraph.operators import versions as R
from lodegraph.plans import oracle as O
from lodegraph.plans.adding import adder
from lodegraph.sources import sink
from lodegraph.sources import views as V
from lodegraph.sources.tables import Tables, shared_dir
from lodegraph.streaming import ingest as I

QUERIES, ORACLES, add = adder()


def _place(s):
    return f"{shared_dir(s)}/query-{uuid.uuid4().hex}"


@add("graph_sink", f"select 'node' kind, 'P'||p_partkey a, p_name b from part union all select 'edge', src, dst from ({O.GRAPH}) where src in (select 'P'||p_partkey from part) and dst in (select 'P'||p_partkey from part)")
def _(s, d):
    """A graph written through the transactional sink, some nodes twice and an edge that leads nowhere, and read back."""
    place = _place(s)
    nodes = V.table(s, d, "part").select(V.pid("P", "p_partkey").alias("node_id"), F.col("p_name").alias("name"))
    edges = V.part_graph(s, d)
    sink.write_graph(nodes.union(nodes.where("name like '%a%'")), edges.union(nodes.select("node_id", F.lit("gone"))), place)
    read = sink.read(s, f"{place}/nodes", "node_id string, name string").select(F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("name").alias("b"))
    return read.union(sink.read(s, f"{place}/edges", "src string, dst string").select(F.lit("edge"), "src", "dst"))


@add("bucketed_neighbors", f"select g.src, g.dst, p_name \"name\" from ({O.GRAPH}) g join part on 'P'||p_partkey=g.src")
def _(s, d):
    """Every edge with its source, from bucketed tables: no exchange in the join."""
    name = f"graph_{uuid.uuid4().hex}"
    nodes = V.table(s, d, "part").select(V.pid("P", "p_partkey").alias("node_id"), F.col("p_name").alias("name"))
    E.save_bucketed(nodes, V.part_graph(s, d), name, buckets=16, path=_place(s))
    return E.bucketed_neighbors(s, name).select("src", "dst", "name")


_W = "over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)"


@add("stream_tracked_versions", f"select * from (select 'U'||user_id base_id, event_id seq, coalesce(max((event_type<>'view')::int) {_W},0)=1 tracked, len(list_distinct(list_append(coalesce(list(event_type) {_W}, []), event_type)))::int versions from events) where seq*2>=(select max(event_id) from events)")
def _(s, d):
    """The older half of the events as a batch whose state a stream of the newer half begins with."""
    status = F.when(F.col("event_type") == "view", "UNCHANGED").otherwise("MODIFIED")
    cols = [V.pid("U", "user_id").alias("base_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("version"), status.alias("status")]
    events = V.table(s, d, "events")
    cut = events.agg(F.max("event_id")).first()[0] or 0
    before = events.where(F.col("event_id") * 2 < cut).select(*cols).select("base_id", "version", "status").distinct()
    stream = I.event_stream(s, f"{d}/events.parquet").where(F.col("event_id") * 2 >= cut).select(*cols)
    with I.rocksdb_state(s):
        return I.drain(I.tracked_versions(stream, before), _place(s), "append").select("base_id", "seq", "tracked", "versions")


@add("tracked_running_flag", f"select 'U'||user_id node_id, event_id seq, coalesce(max((event_type<>'view')::int) {_W},0)=1 tracked from events")
def _(s, d):
    """The tracked set of a timeline: since which pair a node is followed."""
    rows = V.table(s, d, "events").select(F.col("event_id").alias("pair"), V.pid("U", "user_id").alias("b1"), V.pid("U", "user_id").alias("b2"), (F.col("event_type") != "view").alias("hot"))
    since = V2.tracked_since(rows, Tables(s, "tracked"))
    return rows.join(since, F.col("b1") == F.col("base_id"), "left").select(F.col("b1").alias("node_id"), F.col("pair").alias("seq"), F.coalesce(F.col("since") < F.col("pair"), F.lit(False)).alias("tracked"))


@add("node_statements", f"with {O.CODE} select node_id, 'CREATE (n:'||node_type||' {{key: '''||replace(node_id,'''',chr(92)||'''')||''', name: '''||\"name\"||''''||case when ls is null then '' else ', line_start: '||ls end||', is_test: '||(coalesce(kind,'')='TEST_METHOD')||'}})' \"statement\" from n where node_type in ('TYPE','METHOD')")
def _(s, d):
    own = B.nodes(V.code_facts(s, d)).where("node_type in ('TYPE', 'METHOD')")
    return E.node_statements(own.withColumn("is_test", F.coalesce(F.col("kind") == "TEST_METHOD", F.lit(False))), ["name", "line_start", "is_test"])


_MARKS = "case p_size%5 when 0 then ['org.junit.Test'] when 1 then ['RunWith','x'] else [] end"


@add("test_classes", f"""with t as (select 'T'||p_partkey id, case p_size%4 when 0 then p_name||'Test' when 1 then 'Contest'||p_name else p_name end nm, {_MARKS} an, case when p_partkey%2=0 then '/r/src/test/x' else '/r/src/main/x' end path from part),
 m as (select distinct 'T'||l_partkey own from lineitem where l_returnflag='R')
 select id node_id, case when nm like '%Test' then 'name' when len(an)>0 then 'annotation' else 'path' end reason from t where nm like '%Test' or len(an)>0 or (path like '%src/test/%' and id in (select own from m))""")
def _(s, d):
    """By name, by annotation, and in a test folder by a test method."""
    size, name = F.col("p_size"), F.col("p_name")
    marks = F.when(size % 5 == 0, F.array(F.lit("org.junit.Test"))).when(size % 5 == 1, F.array(F.lit("RunWith"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    path = F.when(F.col("p_partkey") % 2 == 0, "/r/src/test/x").otherwise("/r/src/main/x")
    types = V.table(s, d, "part").select(V.pid("T", "p_partkey").alias("node_id"), F.when(size % 4 == 0, F.concat(name, F.lit("Test"))).when(size % 4 == 1, F.concat(F.lit("Contest"), name)).otherwise(name).alias("name"), marks.alias("annotations"), path.alias("path"))
    own = V.table(s, d, "lineitem").select(V.pid("T", "l_partkey").alias("declaring_type"), F.when(F.col("l_returnflag") == "R", F.array(F.lit("org.junit.Test"))).alias("annotations"))
    return M.test_classes(types, own)


@add("test_methods", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag='R' or l_linestatus='O' v from lineitem")
def _(s, d):
    marks = F.when(F.col("l_returnflag") == "R", F.array(F.lit("x.TestFactory"))).otherwise(F.array(F.lit("Override")))
    path = F.when(F.col("l_linestatus") == "O", "a/src/test/b").otherwise("a/src/main/b")
    return V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.is_test_method(marks, path).alias("v"))


@add("remove_by_signature", "with p as (select *, 'pkg.'||p_brand||'.'||p_name||'('||p_size||',int)' g from part) select 'P'||p_partkey node_id, g signature from p where g not in (select g from p where p_size%3=0)")
def _(s, d):
    """Methods that no line of a removal list names."""
    signature = X.signature(F.lit("pkg"), F.col("p_brand"), F.col("p_name"), F.array(F.col("p_size").cast("string"), F.lit("int")))
    methods = V.table(s, d, "part").select(V.pid("P", "p_partkey").alias("node_id"), signature.alias("signature"), "p_size")
    return M.without_methods(methods, methods.where("p_size % 3 = 0")).select("node_id", "signature")


@add("matcher_counts", f"with e as ({O.version(1996)}), f as ({O.version(1997)}) select 'ExactMatcher' matcher, count(*) matched, round(100.0*count(*)/(select count(*) from e),2)::double pct from e join f on e.node_id=f.node_id")
def _(s, d):
    null = F.lit(None).cast("string")
    side = lambda y: V.version(s, d, y).select("node_id", F.lit("METHOD").alias("node_type"), F.col("node_id").alias("signature"), null.alias("qualified_name"), F.col("source").cast("string").alias("source_code"))
    return R.match_counts(R.match_all(side(1996), side(1997)), side(1996))


@add("stamped_nodes", f"select 'P'||p_partkey node_id, c.commit_id, left(c.commit_id,7) commit_short_id, c.message commit_message, c.author commit_author, c.commit_time from part left join ({O.COMMITS}) c on c.commit_id='O'||(p_partkey*4)")
def _(s, d):
    """Snapshots with the metadata of the version that they are from, all five fields."""
    w = V.table(s, d, "orders").select(V.pid("O", "o_orderkey").alias("commit_id"), F.col("o_orderpriority").alias("message"), F.col("o_orderstatus").alias("author"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("commit_time"))
    versions = w.select(F.col("commit_id").alias("label"), "commit_id", F.substring("commit_id", 1, 7).alias("short_id"), "message", "author", "commit_time")
    label = F.concat(F.lit("O"), (F.col("p_partkey") * 4).cast("string"))
    nodes = V.table(s, d, "part").select(V.pid("P", "p_partkey").alias("node_id"), F.array(label).alias("versions"), label.alias("first_version"))
    return V2.stamped(nodes, versions).select("node_id", "commit_id", "commit_short_id", "commit_message", "commit_author", "commit_time")


@add("graph_upsert", "select 'P'||p_partkey node_id, case when n is null then p_name else 'sold '||n end \"name\" from part left join (select l_partkey, count(*) n from lineitem group by 1) on l_partkey=p_partkey union all select 'S'||s_suppkey, s_name from supplier")
def _(s, d):
    """The last row of each id stays; new ids are added."""
    part = V.table(s, d, "part").select(V.pid("P", "p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.lit(0).alias("at"))
    sold = V.table(s, d, "lineitem").groupBy(V.pid("P", "l_partkey").alias("node_id")).agg(F.concat(F.lit("sold "), F.count("*").cast("string")).alias("name")).withColumn("at", F.lit(1))
    new = V.table(s, d, "supplier").select(V.pid("S", "s_suppkey").alias("node_id"), F.col("s_name").alias("name"), F.lit(1).alias("at"))
    return G.Graph(part, None).upsert(sold.join(part.select("node_id"), "node_id", "left_semi").union(new), "at").nodes.select("node_id", "name")
