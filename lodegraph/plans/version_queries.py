"""Matching, merging, locating, refactoring edges and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.functions import exprs as X
from lodegraph.operators import collapse as C
from lodegraph.operators import commits as K
from lodegraph.operators import locate as L
from lodegraph.operators import similar as M2
from lodegraph.operators import versions as R
from lodegraph.plans import oracle as O
from lodegraph.plans.adding import adder
from lodegraph.sources import views as V

QUERIES, ORACLES, add = adder()


def _two(s, d):
    return V.version(s, d, 1996), V.version(s, d, 1997)


def _diff(s, d):
    return R.diff(*_two(s, d))


_MATCH = f"select a.node_id, a.source source1, b.source source2, case when a.source=b.source then 1.0 else 0.8 end::double confidence from ({O.version(1996)}) a join ({O.version(1997)}) b on a.node_id=b.node_id"
add("exact_match_confidence", _MATCH)(lambda s, d: R.match(*_two(s, d)))
add("mapping_stats", f"select count(*) total, count(*) filter (confidence=1.0) exact, count(*) filter (confidence>=0.8) high, count(*) filter (confidence<0.8) low, round(avg(confidence),6) mean from ({_MATCH})")(lambda s, d: R.match(*_two(s, d)).agg(F.count("*").alias("total"), F.count_if(F.col("confidence") == 1.0).alias("exact"), F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if(F.col("confidence") < 0.8).alias("low"), F.round(F.avg("confidence"), 6).alias("mean")))
add("match_rate", f"select round(100.0*(select count(*) from ({_MATCH}))/(select count(*) from ({O.version(1996)})),2)::double pct")(lambda s, d: R.match(*_two(s, d)).agg(F.count("*").alias("m")).crossJoin(V.version(s, d, 1996).agg(F.count("*").alias("t"))).select(F.round(F.lit(100.0) * F.col("m") / F.col("t"), 2).alias("pct")))
add("version_status", O.DIFF)(lambda s, d: _diff(s, d))
add("status_stats_with_zeros", f"select st version_status, count(d.node_id) n from (values ('ADDED'),('DELETED'),('MODIFIED'),('UNCHANGED'),('UNKNOWN')) v(st) left join ({O.DIFF}) d on d.version_status=st group by st")(lambda s, d: s.createDataFrame([(x,) for x in ("ADDED", "DELETED", "MODIFIED", "UNCHANGED", "UNKNOWN")], "version_status string").join(_diff(s, d).groupBy("version_status").agg(F.count("*").alias("n")), "version_status", "left").select("version_status", F.coalesce("n", F.lit(0)).alias("n")))
add("added_nodes", f"select node_id from ({O.version(1997)}) where node_id not in (select node_id from ({O.version(1996)}))")(lambda s, d: V.version(s, d, 1997).join(V.version(s, d, 1996), "node_id", "left_anti").select("node_id"))
add("deleted_nodes", f"select node_id from ({O.version(1996)}) where node_id not in (select node_id from ({O.version(1997)}))")(lambda s, d: V.version(s, d, 1996).join(V.version(s, d, 1997), "node_id", "left_anti").select("node_id"))
add("merged_nodes", f"select case when len(v)=2 then node_id else node_id||'@'||v[1] end merged_id, node_id, version_status, array_to_string(v,',') versions from (select node_id, version_status, unnest(case version_status when 'ADDED' then [['V2']] when 'DELETED' then [['V1']] when 'UNCHANGED' then [['V1','V2']] else [['V1'],['V2']] end) v from ({O.DIFF}))")(lambda s, d: R.materialise(_diff(s, d)).withColumn("versions", F.array_join("versions", ",")))
add("merge_stats", f"select version_status, count(*) nodes, coalesce(sum(s1),0)::bigint before, coalesce(sum(s2),0)::bigint after from ({O.DIFF}) group by 1")(lambda s, d: _diff(s, d).groupBy("version_status").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("s1"), F.lit(0)).alias("before"), F.coalesce(F.sum("s2"), F.lit(0)).alias("after")))
add("modified_methods", f"select node_id, s1, s2 from ({O.DIFF}) where version_status in ('MODIFIED')")(lambda s, d: _diff(s, d).where("version_status in ('MODIFIED')").select("node_id", "s1", "s2"))
add("version_delta_counts", f"select (select count(*) from ({O.version(1996)})) v1, (select count(*) from ({O.version(1997)})) v2, (select count(*) from ({O.version(1997)}))-(select count(*) from ({O.version(1996)})) delta")(lambda s, d: V.versions(s, d, 1996, 1997).agg(F.count_if(F.col("yr") == 1996).alias("v1"), F.count_if(F.col("yr") == 1997).alias("v2")).withColumn("delta", F.col("v2") - F.col("v1")))
add("callers_of_modified", f"select g.src, d.node_id from ({O.DIFF}) d join ({O.GRAPH}) g on g.dst=d.node_id where version_status='MODIFIED'")(
    lambda s, d: V.part_graph(s, d).join(_diff(s, d).where("version_status = 'MODIFIED'"), F.col("dst") == F.col("node_id")).select("src", "node_id")
)
_MERGED = f"select src, edge_type, dst, side, line from (select *, row_number() over (partition by src,edge_type,dst order by side,line) r from (select 1 side, * from ({O.version_edges(1996)}) union all select 2, * from ({O.version_edges(1997)}))) where r=1"
add("merged_structural_edges", _MERGED)(lambda s, d: R.merge_edges(V.version_edges(s, d, 1996), V.version_edges(s, d, 1997)))
add("remapped_edges", f"select e.src||'@V2' src, m.node_id||'@V2' dst, count(*) n from ({O.version_edges(1997)}) e join ({O.DIFF}) m on m.node_id=e.dst where m.version_status='ADDED' group by all")(lambda s, d: (lambda e: R.remap(e, e.select(F.col("src").alias("a")).distinct().select("a", X.versioned_id(F.col("a"), F.lit("V2")).alias("b")).union(_diff(s, d).where("version_status = 'ADDED'").select("node_id", X.versioned_id(F.col("node_id"), F.lit("V2"))))).groupBy("src", "dst").agg(F.count("*").alias("n")))(V.version_edges(s, d, 1997)))


add("structural_score", f"select a.node_id, round(0.2*(1-abs(a.source-b.source)/greatest(a.source,b.source)::double),6)::double score from ({O.version(1996)}) a join ({O.version(1997)}) b on a.node_id=b.node_id")(lambda s, d: R.match(*_two(s, d)).select("node_id", F.round(R.ratio_score(F.col("source1"), F.col("source2"), 0.2), 6).alias("score")))


_SETS = "select l_suppkey k, list_sort(list(distinct l_returnflag||l_linestatus)) x from lineitem where year(l_shipdate)=%d group by 1"
add("jaccard_similarity", f"select a.k, round(len(list_intersect(a.x,b.x))/len(list_distinct(list_concat(a.x,b.x)))::double,6) score from ({_SETS % 1996}) a join ({_SETS % 1997}) b on a.k=b.k")(lambda s, d: (lambda f: f(1996, "a").join(f(1997, "b"), "k").select("k", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("score")))(lambda y, n: V.table(s, d, "lineitem").where(F.year("l_shipdate") == y).groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias(n))))


def _sides(s, d):
    """Parts of even and odd keys, as the nodes of two versions."""
    p = V.table(s, d, "part").select(V.pid("P", "p_partkey").alias("node_id"), F.lit("METHOD").alias("node_type"), "p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("signature"), F.col("p_size").alias("lines_of_code"), (F.col("p_size") % 5).alias("complexity"),
        F.split("p_type", " ").alias("called_methods"), F.split("p_name", " ").alias("accessed_fields"), F.split("p_brand", "#").alias("local_variables"))
    return p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1")


def _kinds(s, d):
    return R.structural_kinds(*_sides(s, d), ["signature", "lines_of_code"])


@add("greedy_one_to_one", "")
def _(s, d):
    """Structural matches 1:1 within blocks of equal type and size: no SQL for the rounds; tests compare with one pair at a time."""
    return R.best_mutual_kinds(_kinds(s, d), 0.5)


_SPLIT = "select p_partkey, p_size, p_type, string_split(p_type,' ') c, string_split(p_name,' ') f, string_split(p_brand,'#') v from part"
_JAC = lambda x: f"len(list_intersect(a.{x},b.{x}))/len(list_distinct(list_concat(a.{x},b.{x})))::double"


@add("structural_features", f"""select 'P'||a.p_partkey v1_id, 'P'||b.p_partkey v2_id, round(0.2+case when a.p_size%5>0 then 0.2 else 0 end+0.3*{_JAC('c')}+0.2*{_JAC('f')}+0.1*(1-abs(len(a.v)-len(b.v))/greatest(len(a.v),len(b.v))::double),6)::double score
 from ({_SPLIT}) a join ({_SPLIT}) b on a.p_type=b.p_type and a.p_size=b.p_size and a.p_partkey%2=0 and b.p_partkey%2=1""")
def _(s, d):
    return _kinds(s, d).pairs()


def _order_methods(s, d):
    """Orders as methods, of even and odd keys: their parts are called, suppliers accessed; sizes come from their lines."""
    rows = V.table(s, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_linenumber").cast("int").alias("lines_of_code"), F.count("*").cast("int").alias("complexity"), F.collect_set(V.pid("P", "l_partkey")).alias("called_methods"),
        F.collect_set(V.pid("S", "l_suppkey")).alias("accessed_fields"), F.collect_set("l_returnflag").alias("local_variables"),
    )
    own = rows.withColumn("node_id", V.pid("O", "l_orderkey"))
    return own.where("l_orderkey % 2 = 0").drop("l_orderkey"), own.where("l_orderkey % 2 = 1").drop("l_orderkey")


_BOTH = lambda x: f"len(list_intersect(a.{x},b.{x}))/len(list_distinct(list_concat(a.{x},b.{x})))::double"
_NEARER = lambda x, w: f"{w}*least(a.{x},b.{x})/greatest(a.{x},b.{x})::double"


@add("structural_candidates", f"""with m as materialized (select l_orderkey k, sum(l_linenumber) loc, count(*) cx, list(distinct l_partkey) c, list(distinct l_suppkey) f, count(distinct l_returnflag) v from lineitem group by 1),
 t as (select k, 'c'||unnest(c) t from m union all select k, 'f'||unnest(f) from m), p as materialized (select distinct a.k ak, b.k bk from t a join t b using (t) where a.k%2=0 and b.k%2=1)
 select * from (select 'O'||ak v1_id, 'O'||bk v2_id, round({_NEARER('loc', 0.2)}+{_NEARER('cx', 0.2)}+0.3*{_BOTH('c')}+0.2*{_BOTH('f')}+{_NEARER('v', 0.1)},6)::double score from p join m a on a.k=ak join m b on b.k=bk) where score>=0.5""")
def _(s, d):
    """Structural matches of methods whatever their names: every pair that shares a token and reaches the threshold."""
    return M2.structural_candidates(*_order_methods(s, d))


_SOLD = "select l_partkey, list(distinct l_suppkey) calls, list(distinct l_linenumber||l_returnflag) code from lineitem group by 1"
_ALIKE = lambda x: f"case when len(list_distinct(list_concat(coalesce(a.{x},[]),coalesce(b.{x},[]))))=0 then 1.0 else len(list_intersect(coalesce(a.{x},[]),coalesce(b.{x},[])))/len(list_distinct(list_concat(coalesce(a.{x},[]),coalesce(b.{x},[]))))::double end"


@add("weighted_similarity", f"""with m as materialized (select p_partkey k, p_name nm, p_brand sg, code, calls from part left join ({_SOLD}) on l_partkey=p_partkey)
 select * from (select 'P'||a.k a, 'P'||b.k b, round(0.3*(1-levenshtein(a.nm,b.nm)/greatest(length(a.nm),length(b.nm))::double)+0.2+0.3*{_ALIKE('code')}+0.2*{_ALIKE('calls')},6)::double score from m a join m b on a.sg=b.sg and a.k%2=0 and b.k%2=1) where score>0.8""")
def _(s, d):
    """The design's weights over name, signature, code and calls, of all pairs of even and odd parts that exceed 0.8."""
    sold = V.table(s, d, "lineitem").groupBy("l_partkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("calls"), F.collect_set(F.concat(F.col("l_linenumber").cast("string"), F.col("l_returnflag"))).alias("code"))
    p = V.table(s, d, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", V.pid("P", "p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("signature"), "code", "calls")
    return M2.similar_methods(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), 0.8).select(F.col("v1_id").alias("a"), F.col("v2_id").alias("b"), "score")


def _elements(s, d):
    return V.table(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("start_line"), F.max("l_linenumber").alias("end_line")).select(V.pid("F", "l_orderkey").alias("path"), F.concat(F.lit("E"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_partkey").cast("string")).alias("node_id"), "start_line", "end_line")


def _hunks(s, d):
    return V.table(s, d, "lineitem").select(V.pid("F", "l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), V.kind_of_hunk().alias("type")).distinct()


def _ranges(s, d):
    return L.hunk_sides(_hunks(s, d).select("path", "type", *[(F.col("line") - (1 if c.startswith("begin") else 0)).alias(c) for c in ("begin_a", "end_a", "begin_b", "end_b")]))


_OVER = f"select e.path, e.node_id, h.line, h.type from ({O.FILES}) e join ({O.HUNKS}) h on h.path=e.path and greatest(start_line, line) <= least(end_line, line)"
add("hunk_element_overlap", _OVER)(lambda s, d: L.overlapping(_elements(s, d), _hunks(s, d).withColumn("lo", F.col("line")).withColumn("hi", F.col("line")), ["path"]).select("path", "node_id", "line", "type"))
_SIDED = f"select path, type, side, line lo, line+1 hi from (select *, unnest(case type when 'INSERT' then ['V2'] when 'DELETE' then ['V1'] else ['V1','V2'] end) side from ({O.HUNKS}))"
_NEAR = f"select path, type, side, lo, distance, node_id from (select h.*, e.node_id, (abs(start_line-lo)+abs(end_line-hi))::int distance, row_number() over (partition by h.path,type,side,lo order by abs(start_line-lo)+abs(end_line-hi), e.node_id) r from ({O.FILES}) e join ({_SIDED}) h on h.path=e.path and greatest(start_line-2,lo-2)<=least(end_line+2,hi+2)) where r=1"


def _nearest(s, d):
    pairs = L.overlapping(_elements(s, d), _ranges(s, d), ["path"], slack=2)
    return L.nearest(pairs, ["path", "type", "side", "lo"], ["node_id"])


add("hunk_nearest_element", _NEAR)(lambda s, d: _nearest(s, d))
add("changed_nodes", f"select distinct side, node_id from ({_NEAR})")(lambda s, d: _nearest(s, d).select("side", "node_id").distinct())
_SEEN = "select distinct 'E'||l_orderkey||'_'||l_partkey e from lineitem where l_linenumber=l_quantity::int%7"
add("diff_edges_code_diff", f"select distinct node_id||'@V1' src, node_id||'@V2' dst, 'REFACTORED' edge_type, 0.7::double confidence from ({_NEAR}) where node_id not in ({_SEEN})")(lambda s, d: _diff_edges(s, d))


def _diff_edges(s, d):
    """Edges of changed elements that no refactoring has given one already."""
    name = F.concat(F.lit("E"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"))
    edges = V.table(s, d, "lineitem").select(name.alias("node_id"), (F.col("l_linenumber") == F.col("l_quantity").cast("int") % 7).alias("refactored")).where("refactored").select("node_id").distinct()
    pairs = _nearest(s, d).select("node_id").distinct().join(edges, "node_id", "left_anti")
    return pairs.select(X.versioned_id(F.col("node_id"), F.lit("V1")).alias("src"), X.versioned_id(F.col("node_id"), F.lit("V2")).alias("dst"), F.lit("REFACTORED").alias("edge_type"), F.lit(0.7).alias("confidence"))


_TYPES = [t for t, _, _ in R.KINDS] + ["SOMETHING_NEW"]


def _refs(s, d):
    return V.refactorings(s, d, _TYPES)


_TYPED = f"select r.*, coalesce(k.edge_type,'REFACTORED') edge_type, k.sub_type from (%s) r left join ({O.kinds()}) k on k.type=r.type"
add("refactoring_type_lookup", f"select type, edge_type, sub_type, count(*) n from ({_TYPED % O.refactorings()}) group by all")(lambda s, d: R.with_edge_type(_refs(s, d)).groupBy("type", "edge_type", "sub_type").agg(F.count("*").alias("n")))
_REF = f"select ref_id, pos, type, case when type like 'INLINE\\_%' escape '\\' then left_id else l0 end src, case when type like 'EXTRACT\\_%' escape '\\' then right_id else r0 end dst, confidence from (select *, first_value(left_id) over w l0, first_value(right_id) over w r0, min(pos) over (partition by ref_id) p0 from ({O.refactorings()}) window w as (partition by ref_id order by pos)) where pos=p0 or type like 'EXTRACT\\_%' escape '\\' or type like 'INLINE\\_%' escape '\\'"
add("refactoring_one_to_many", f"select ref_id, pos, type, src, dst, round(confidence,3) confidence from ({_REF})")(lambda s, d: R.refactoring_edges(_refs(s, d)).withColumn("confidence", F.round("confidence", 3)))
add("refactoring_histogram", f"select edge_type, count(*) n from ({_TYPED % _REF}) group by 1 order by n desc")(lambda s, d: R.with_edge_type(R.refactoring_edges(_refs(s, d))).groupBy("edge_type").agg(F.count("*").alias("n")).orderBy(F.desc("n")))
add("extracted_sources", f"select src, dst, sub_type from ({_TYPED % _REF}) where edge_type='EXTRACTED'")(lambda s, d: R.with_edge_type(R.refactoring_edges(_refs(s, d))).where("edge_type = 'EXTRACTED'").select("src", "dst", "sub_type"))
add("high_impact_changes", f"select e.dst, count(distinct g.src) callers from ({_TYPED % _REF}) e join ({O.GRAPH}) g on g.dst=e.dst where edge_type in ('CHANGED_SIGNATURE','RENAMED') group by 1 order by callers desc, 1")(lambda s, d: R.with_edge_type(R.refactoring_edges(_refs(s, d))).where("edge_type in ('CHANGED_SIGNATURE', 'RENAMED')").select("dst").distinct().join(V.part_graph(s, d), "dst").groupBy("dst").agg(F.countDistinct("src").alias("callers")).orderBy(F.desc("callers"), "dst"))
_OWNER = "select 'P'||p_partkey member, p_brand owner from part"
add("member_change_propagation", f"select a.owner src, b.owner dst, count(*) n, round(max(confidence),3) confidence from ({_REF}) e join ({_OWNER}) a on a.member=e.src join ({_OWNER}) b on b.member=e.dst group by all")(lambda s, d: R.propagate(R.refactoring_edges(_refs(s, d)), V.table(s, d, "part").select(V.pid("P", "p_partkey"), "p_brand")).groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.max("confidence"), 3).alias("confidence")))
add("evolution_edge_merge", f"select src, edge_type, dst, sum(n)::bigint occurrences, round(max(c),3) confidence, string_agg(type, ',' order by first_seq, type) types from (select src, edge_type, dst, type, count(*) n, max(confidence) c, min(ref_id*100+pos) first_seq from ({_TYPED % _REF}) group by all) group by src, edge_type, dst")(lambda s, d: C.merge_evolution(R.with_edge_type(R.refactoring_edges(_refs(s, d))).withColumn("seq", F.col("ref_id") * 100 + F.col("pos"))).withColumn("confidence", F.round("confidence", 3)).withColumn("types", F.array_join("refactoring_types", ",")).drop("refactoring_types", "seq", "ref_id", "pos", "sub_type"))
_PLACES = "select 'P'||p_partkey node_id, p_name nm, p_brand||'#'||p_name place from part"
_ON = lambda k, x: f"case when edge_type='{k}' then {x} end"


@add("edge_enrichment", f"""select ref_id, pos, e.type, e.edge_type, {_ON('RENAMED', 'o.nm')} old_name, {_ON('RENAMED', 'n.nm')} new_name, {_ON('MOVED', 'o.place')} old_location, {_ON('MOVED', 'n.place')} new_location,
 {_ON('CHANGED_SIGNATURE', 'o.place')} old_signature, {_ON('CHANGED_SIGNATURE', 'n.place')} new_signature, case when edge_type in ('EXTRACTED','INLINED','CHANGED_SIGNATURE') then sub_type end sub_kind, {_ON('REFACTORED', "'d'||ref_id")} details,
 'src/'||src||'.java:'||case when pos>0 then pos||'-' else '-' end||(pos+3)||'::'||src "left", src||'->'||dst flow from ({_TYPED % _REF}) e left join ({_PLACES}) o on o.node_id=src left join ({_PLACES}) n on n.node_id=dst""")
def _(s, d):
    edges = R.with_edge_type(R.refactoring_edges(_refs(s, d))).withColumn("description", F.concat(F.lit("d"), F.col("ref_id").cast("string")))
    nodes = V.table(s, d, "part").select(V.pid("P", "p_partkey").alias("node_id"), F.lit("METHOD").alias("node_type"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("#"), "p_name").alias("place"))
    x = R.enriched(edges, nodes)
    left = X.location(F.concat(F.lit("src/"), F.col("src"), F.lit(".java")), F.col("pos"), F.col("pos") + 3, F.col("src"))
    return x.select("ref_id", "pos", "type", "edge_type", "old_name", "new_name", "old_location", "new_location", "old_signature", "new_signature", "sub_kind", "details", left.alias("left"), X.version_flow(F.col("src"), F.col("dst")).alias("flow"))


add("self_loop_split", f"select node_id, version_status, case when version_status='UNCHANGED' and node_id in (select src from ({_REF}) where src=dst) then 'MODIFIED' else version_status end final_status from ({O.DIFF})")(lambda s, d: _diff(s, d).join(R.refactoring_edges(_refs(s, d)).where("src = dst").select(F.col("src").alias("node_id"), F.lit(True).alias("split")).distinct(), "node_id", "left").select("node_id", "version_status", F.when((F.col("version_status") == "UNCHANGED") & F.col("split"), "MODIFIED").otherwise(F.col("version_status")).alias("final_status")))

_RECENT = f"select repo, commit_id, parent_id, commit_time, k, least(51, count(*) over (partition by repo)) top from ({O.COMMITS}) where k<=51"


def _commits(s, d):
    """Orders as commits: a repository a customer, each commit the child of the one before it by date and key."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    own = V.table(s, d, "orders").select("o_orderdate", "o_orderkey", "o_custkey", V.pid("O", "o_orderkey").alias("commit_id"), F.col("o_orderstatus").alias("author"), F.col("o_orderpriority").alias("message"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("commit_time"))
    return own.withColumn("parent_id", F.lag("commit_id").over(w)).drop("o_orderdate", "o_orderkey", "o_custkey")


def _timeline(s, d):
    """The history of every repository, from its newest commit on."""
    c = _commits(s, d)
    head = V.table(s, d, "orders").groupBy(V.pid("C", "o_custkey").alias("timeline")).agg(F.max_by(V.pid("O", "o_orderkey"), F.struct("o_orderdate", "o_orderkey")).alias("commit_id"))
    return K.timeline(K.linear_history(c, head, 50), c)


add("linear_history", f"select repo timeline, commit_id, (k-1)::int depth, commit_time, left(commit_id,7) short_id from ({_RECENT})")(lambda s, d: _timeline(s, d).select("timeline", "commit_id", "depth", "commit_time", "short_id"))
add("timeline_labels", f"select repo timeline, commit_id, case when k=1 then 'V0' else 'V-'||(k-1) end label, (top-k)::int ord from ({_RECENT})")(lambda s, d: _timeline(s, d).select("timeline", "commit_id", "label", "ord"))
add("timeline_pairs", f"select repo timeline, lead(commit_id) over (partition by repo order by k) older, commit_id newer, (k-1)::int pair_ord from ({_RECENT}) qualify older is not null")(lambda s, d: K.version_pairs(_timeline(s, d)).select("timeline", "older", "newer", "pair_ord"))
add("all_commits", "select 'O'||o_orderkey commit_id from orders")(lambda s, d: K.all_commits(_commits(s, d)))
_JAVA = "case when l_returnflag='A' then '/dev/null' when l_partkey%3=0 then 'F'||l_partkey||'.txt' else 'F'||l_partkey||'.java' end"


def _file_hunks(s, d):
    """Each line of an order as a hunk: a deleted file, one that is no source, or a source file."""
    c = F.col
    new = F.when(c("l_returnflag") == "A", "/dev/null").when(c("l_partkey") % 3 == 0, F.concat(V.pid("F", "l_partkey"), F.lit(".txt"))).otherwise(F.concat(V.pid("F", "l_partkey"), F.lit(".java")))
    n = c("l_linenumber")
    ends = ((n - 1).alias("begin_a"), (n - 1 + n % 3).alias("end_a"), (n - 1).alias("begin_b"), (n - 1 + n % 2).alias("end_b"))
    return V.table(s, d, "lineitem").select(V.pid("O", "l_orderkey").alias("commit_id"), F.concat(V.pid("F", "l_partkey"), F.lit(".java")).alias("old_path"), new.alias("new_path"), F.lit(None).cast("string").alias("type"), *ends)


_ROOT = f"(select commit_id from ({O.COMMITS}) where parent_id is null)"
_FILES = f"select 'O'||l_orderkey commit_id, 'F'||l_partkey||'.java' old_path, {_JAVA} new_path, l_linenumber n from lineitem where {_JAVA} like '%.java' and 'O'||l_orderkey not in {_ROOT}"
add("file_diffs", f"select commit_id, old_path, new_path, count(*) n_hunks from ({_FILES}) group by all")(lambda s, d: K.file_diffs(_file_hunks(s, d), _commits(s, d)))
add("edit_list", f"select commit_id, new_path, n::int line, case when n%3=0 then 'INSERT' when n%2=0 then 'DELETE' else 'REPLACE' end type from ({_FILES}) where n%3>0 or n%2>0")(
    lambda s, d: K.edits(_file_hunks(s, d), _commits(s, d)).select("commit_id", "new_path", (F.col("begin_a") + 1).alias("line"), "type")
)
add("commit_stamp", f"select n.node_id, c.commit_id, c.parent_id, left(c.commit_id,7) short_id, c.author, c.message, c.commit_time from (select 'P'||l_partkey node_id, max('O'||l_orderkey) commit_id from lineitem group by 1) n left join ({O.COMMITS}) c on c.commit_id=n.commit_id")(lambda s, d: (lambda ids: K.commit_info(ids, _commits(s, d)).select("node_id", "commit_id", "parent_id", "short_id", "author", "message", "commit_time"))(V.table(s, d, "lineitem").groupBy(V.pid("P", "l_partkey").alias("node_id")).agg(F.max(V.pid("O", "l_orderkey")).alias("commit_id"))))
add("time_window_filter", "select 'O'||o_orderkey commit_id from orders where floor((epoch((select max(o_orderdate) from orders))-epoch(o_orderdate))/86400) <= 180")(lambda s, d: V.table(s, d, "orders").withColumn("t", F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).crossJoin(F.broadcast(V.table(s, d, "orders").agg(F.unix_timestamp(F.max("o_orderdate").cast("timestamp")).alias("ref")))).where(~X.outside_window(F.col("t"), F.col("ref"), 180)).select(V.pid("O", "o_orderkey").alias("commit_id")))
_STEPS = f"select node_id, yr, yr-1998 ord, case when prev is null then 'ADDED' when prev=source then 'UNCHANGED' else 'MODIFIED' end status from (select *, lag(source) over (partition by node_id order by yr) prev from ({O.VERSIONS}))"


def _steps(s, d):
    prev = F.lag("source").over(Window.partitionBy("node_id").orderBy("yr"))
    return V.versions(s, d).select("node_id", "yr", (F.col("yr") - 1998).alias("ord"), F.when(prev.isNull(), "ADDED").when(prev == F.col("source"), "UNCHANGED").otherwise("MODIFIED").alias("status"))


add("timeline_rollup", f"select node_id, string_agg(label, ',' order by ord) versions, arg_max(status, p*10-seq) status, arg_min(label,ord) first_version, arg_max(label,ord) last_version from (select node_id, ord, -ord seq, case when ord=0 then 'V0' else 'V'||ord end label, status, case status when 'ADDED' then 3 when 'DELETED' then 3 when 'MODIFIED' then 2 else 1 end p from ({_STEPS})) group by node_id")(lambda s, d: R.roll_up(_steps(s, d).select("node_id", "ord", (-F.col("ord")).alias("seq"), F.when(F.col("ord") == 0, "V0").otherwise(F.concat(F.lit("V"), F.col("ord").cast("string"))).alias("label"), "status")).withColumn("versions", F.array_join("versions", ",")))
add("timeline_edge_dedup", "select src, dst, yr::int yr from (select 'S'||l_suppkey src, 'P'||l_partkey dst, max(year(l_shipdate)) yr from lineitem where year(l_shipdate) between 1995 and 1998 group by all)")(lambda s, d: V.table(s, d, "lineitem").where(F.year("l_shipdate").between(1995, 1998)).groupBy(V.pid("S", "l_suppkey").alias("src"), V.pid("P", "l_partkey").alias("dst")).agg(F.max(F.year("l_shipdate")).alias("yr")))


_WT = "['" + "','".join(V.WALK_TYPES) + "']"
_WALK = f"""with recursive e0 as (select user_id, event_id, ts, event_type||'()' nw, lag(event_type||'()') over w old, row_number() over w r from events window w as (partition by user_id order by ts, event_id)),
 e1 as (select *, ((r-1)//2)::int no, {_WT}[event_id%{len(V.WALK_TYPES)}+1] tp from e0), last as (select user_id, max(no) top from e1 group by 1),
 e as (select e1.*, top-no depth, max(epoch(ts)::bigint) over (partition by e1.user_id, no) tm from e1 join last on last.user_id=e1.user_id),
 tgt as (select user_id, max(tm) t0, list_distinct(list(nw order by r) filter (old is not null)) seed from e where depth=0 group by 1),
 stop as (select e.user_id, min(depth) d from e join tgt on tgt.user_id=e.user_id where depth>0 and (no=0 or floor((t0-tm)/86400)>3) group by 1),
 near as (select e.*, row_number() over (partition by e.user_id order by depth, r) k, lag(depth) over (partition by e.user_id order by depth, r) pd from e left join stop on stop.user_id=e.user_id where depth between 1 and 6 and (stop.d is null or depth<stop.d) and old is not null),
 all_ as (select e.user_id, count(distinct depth) n from e left join stop on stop.user_id=e.user_id where depth between 1 and 6 and (stop.d is null or depth<stop.d) group by 1),
 f(user_id, k, tracked, before, kept) as (select user_id, 0::bigint, seed, seed, []::int[] from tgt where len(seed)>0
 union all select f.user_id, f.k+1, case when list_contains(b, nw) or list_contains(b, old) then case when not list_contains(tracked, nw) then tracked
 when tp like '%RENAME%' or tp like '%MOVE%' or tp like '%CHANGE%' then list_distinct(list_append(list_filter(tracked, lambda x: x<>nw), old)) when tp like '%EXTRACT%' or tp like '%INLINE%' then list_distinct(list_append(tracked, old)) else tracked end else tracked end,
 b, case when (list_contains(b, nw) or list_contains(b, old)) and not list_contains(kept, no) then list_append(kept, no) else kept end
 from (select f.*, n.nw, n.old, n.tp, n.no, case when n.pd is distinct from n.depth then f.tracked else f.before end b from f join near n on n.user_id=f.user_id and n.k=f.k+1) f),
 fin as (select * from f qualify row_number() over (partition by user_id order by k desc)=1),
 w as (select tgt.user_id, coalesce(tracked, []::varchar[]) tracked, coalesce(kept, []::int[]) kept, case when len(seed)>0 then coalesce(n,0) else 0 end analysed, top from tgt join last on last.user_id=tgt.user_id left join fin on fin.user_id=tgt.user_id left join all_ on all_.user_id=tgt.user_id)"""


def _walk(s, d):
    commits, refs = V.histories(s, d)
    return R.tracked_walk(commits, refs, ["user_id"], max_depth=6, max_days=3)


add("tracked_walk", _WALK + " select user_id, array_to_string(list_sort(tracked),',') tracked, array_to_string(list_transform(list_append(list_reverse(kept), top), lambda x: 'c'||x),',') commits, analysed::int analysed, len(kept)::int relevant from w")(
    lambda s, d: _walk(s, d).select("user_id", F.array_join(F.sort_array("tracked"), ",").alias("tracked"), F.array_join("commits", ",").alias("commits"), "analysed", "relevant")
)
add("filter_ratio", _WALK + " select user_id, round((analysed-len(kept))/greatest(1,analysed)::double,6) ratio from w")(lambda s, d: (lambda w: w.select("user_id", F.round(R.filter_ratio(w), 6).alias("ratio")))(_walk(s, d)))
add("set_union", f"select node_id from ({O.version(1996)}) union select node_id from ({O.version(1997)})")(lambda s, d: V.version(s, d, 1996).select("node_id").union(V.version(s, d, 1997).select("node_id")).distinct())
add("set_intersect", f"select node_id from ({O.version(1996)}) intersect select node_id from ({O.version(1997)})")(lambda s, d: V.version(s, d, 1996).select("node_id").intersect(V.version(s, d, 1997).select("node_id")))
add("set_difference", f"select node_id from ({O.version(1996)}) except select node_id from ({O.version(1997)})")(lambda s, d: V.version(s, d, 1996).select("node_id").subtract(V.version(s, d, 1997).select("node_id")))
