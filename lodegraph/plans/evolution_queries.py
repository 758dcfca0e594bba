"""Two versions merged, versions rolled up, and the rest of the commit funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import evolve as V2
from lodegraph.operators import export as E
from lodegraph.operators import graph as G
from lodegraph.operators import locate as L
from lodegraph.operators import mining as M
from lodegraph.operators import versions as R
from lodegraph.plans import oracle as O
from lodegraph.plans.adding import adder
from lodegraph.sources import views as V

QUERIES, ORACLES, add = adder()

_TYPES = [t for t, _, _ in R.KINDS] + ["SOMETHING_NEW"]


def _graphs(s, d):
    return V.version_graph(s, d, 1996), V.version_graph(s, d, 1997)


def _merged(s, d):
    g1, g2 = _graphs(s, d)
    return V2.analyse(g1, g2, V.sided_refactorings(s, d, _TYPES).drop("version"), V.version_hunks(s, d).drop("version"))


_PLACE = "'F'||({0}//40)||'.java'"
_NAMES = "['" + "','".join(_TYPES) + "']"


def _resolved(n: int, back: str, key: str) -> str:
    """Nearest node of a pair's version for each place of one side."""
    return f"""r{n} as (select q, ref_id, list(id order by pos) ids from (select s.*, n.id, row_number() over (partition by s.q, ref_id, pos order by abs(n.ls-(s.{key}%40*10+1))+abs(n.le-(s.{key}%40*10+9)), n.id) k
 from s join n on n.yr={back}-s.q and n.path={_PLACE.format('s.' + key)} and s.{key}%40*10+1-2<=n.le+2 and s.{key}%40*10+9+2>=n.ls-2) where k=1 group by all)"""


def _touched(n: int, back: str, kinds: str) -> str:
    return f"""c{n} as (select distinct q, id from (select h.q, n.id, row_number() over (partition by h.q, path0, type, lo0 order by abs(n.ls-lo0)+abs(n.le-(lo0+2)), n.id) k
 from h join n on n.yr={back}-h.q and n.path=path0 and lo0-2<=n.le+2 and lo0+2+2>=n.ls-2 where type in ({kinds})) where k=1)"""


def _pairs_sql(first: int, last: int, label: str) -> str:
    """Neighbouring years merged, from the rules: mapped pairs, resolved refactorings, diff, propagation, tracking, splits, status, ids. ``q`` 0 is the newest pair."""
    lines = f"(select *, year(l_shipdate) yr from lineitem where year(l_shipdate) between {first} and {last})"
    prev = f"(select yr, l_orderkey, l_linenumber, l_partkey, lag(l_partkey) over w prev, row_number() over w pos from {lines} window w as (partition by yr, l_orderkey order by l_linenumber,l_partkey,l_suppkey))"
    old, new = str(last - 1), str(last)
    return f"""with n as materialized (select yr, 'P'||l_partkey id, 'METHOD' nt, count(*)::varchar src, {_PLACE.format('l_partkey')} path, (l_partkey%40*10+1)::int ls, (l_partkey%40*10+9)::int le, min(p_brand) own
 from {lines} join part on p_partkey=l_partkey group by yr, l_partkey), t as (select distinct yr, own id from n),
 e as (select yr, own src, id dst, 'DECLARES' et, 0 line from n union all select yr, 'P'||prev, 'P'||l_partkey, 'CALLS', l_linenumber from {prev} where prev is not null),
 lab as (select q, {label.format(old)} l1, {label.format(new)} l2 from range({last - first}) r(q)),
 s as materialized (select {last}-yr q, l_orderkey ref_id, (pos-2)::int pos, prev pk, l_partkey qk from {prev} where prev is not null and yr>{first}),
 h as materialized (select distinct {last}-yr q, {_PLACE.format('l_partkey')} path0, case when l_returnflag='R' then 'INSERT' when l_returnflag='A' then 'DELETE' else 'REPLACE' end type, ((l_partkey*7+l_linenumber*131+l_suppkey*17)%4000+1)::int lo0 from {lines} where yr>{first}),
 {_resolved(1, old, 'pk')}, {_resolved(2, new, 'qk')}, {_touched(1, old, "'DELETE','REPLACE'")}, {_touched(2, new, "'INSERT','REPLACE'")},
 refs as (select r1.q, r1.ref_id, {_NAMES}[r1.ref_id%{len(_TYPES)}+1] type, 'order '||(r1.ref_id%5) descr, 0.5::double+(r1.ref_id%6)/10 conf, r1.ids l, r2.ids r from r1 join r2 on r2.ref_id=r1.ref_id and r2.q=r1.q),
 x as (select q, ref_id, type, descr, conf, lp, src, unnest(rr) dst, generate_subscripts(rr,1)-1 rp from (select q, ref_id, type, descr, conf, unnest(ll) src, generate_subscripts(ll,1)-1 lp, rr
 from (select *, case when type like 'INLINE\\_%' escape '\\' then l else l[1:1] end ll, case when type like 'EXTRACT\\_%' escape '\\' then r else r[1:1] end rr from refs))),
 k as ({O.kinds()}),
 fr as materialized (select q, 0 phase, ref_id, lp, rp, 0 step, src, dst, coalesce(k.edge_type,'REFACTORED') et, x.type, descr, conf from x left join k on k.type=x.type),
 pr as (select fr.q, phase, ref_id, lp, rp, 1 step, a.own src, b.own dst, 'REFACTORED' et, 'MEMBER_CHANGED' type, 'Type changed due to member refactoring: '||descr descr, conf from fr join n a on a.id=fr.src and a.yr={old}-fr.q join n b on b.id=fr.dst and b.yr={new}-fr.q),
 m as materialized (select {new}-b.yr q, a.id v1, b.id v2, a.src=b.src same, a.own o1, b.own o2, exists (select 1 from c1 where c1.q={new}-b.yr and c1.id=a.id) or exists (select 1 from c2 where c2.q={new}-b.yr and c2.id=b.id) forced from n a join n b on a.id=b.id and b.yr=a.yr+1
 union all select {new}-b.yr, a.id, b.id, true, null, null, false from t a join t b on a.id=b.id and b.yr=a.yr+1),
 df as materialized (select q, 1 phase, 0::bigint ref_id, 0 lp, 0 rp, 0 step, v1 src, v2 dst, 'REFACTORED' et, 'CODE_DIFF' type, 'code changed in diff' descr, 0.7::double conf, o1, o2 from m where forced and not exists (select 1 from fr where fr.q=m.q and fr.src=v1 and fr.dst=v2)),
 pd as (select q, phase, ref_id, lp, rp, 1 step, o1 src, o2 dst, 'REFACTORED' et, 'MEMBER_CHANGED' type, 'Type changed due to member refactoring: '||descr descr, conf from df),
 raw as materialized (select * from fr union all select * from pr union all select * exclude (o1, o2) from df union all select * from pd),
 m2 as (select m.*, not same or forced chg, exists (select 1 from raw where raw.q=m.q and raw.src=v1 and raw.dst=v2) lp from m),
 nodes as (select yr, id from n union all select yr, id from t),
 gone as materialized (select {old}-yr q, id from nodes a where yr<{last} and not exists (select 1 from nodes b where b.id=a.id and b.yr=a.yr+1)),
 come as materialized (select {new}-yr q, id from nodes a where yr>{first} and not exists (select 1 from nodes b where b.id=a.id and b.yr=a.yr-1)),
 hot as (select q, v1 id, chg or lp h from m2 union all select q, id, true from gone union all select q, id, true from come),
 tr as (select q, id, coalesce(max(h::int) over (partition by id order by q rows between unbounded preceding and 1 preceding),0)=1 tr from hot),
 st as materialized (select m2.*, l1, l2, case when chg then 'MODIFIED' when tr then 'TRACKED' when lp then 'SPLIT' else 'UNCHANGED' end st from m2 join tr on tr.q=m2.q and tr.id=m2.v1 join lab on lab.q=m2.q),
 id1 as (select q, v1 o, case when st in ('MODIFIED','TRACKED') then v1||'@'||l1 else v1 end i from st union all select g.q, id, id||'@'||l1 from gone g join lab on lab.q=g.q),
 id2 as (select q, v2 o, case when st='UNCHANGED' then v1 else v2||'@'||l2 end i from st union all select g.q, id, id||'@'||l2 from come g join lab on lab.q=g.q),
 rows_ as (select id1.q, id1.i nid, o, unnest(case st when 'UNCHANGED' then [l1, l2] else [l1] end) l, case when st in ('UNCHANGED','TRACKED') then 'UNCHANGED' else 'MODIFIED' end s from st join id1 on id1.o=v1 and id1.q=st.q
 union all select id2.q, id2.i, o, l2, case st when 'TRACKED' then 'UNCHANGED' else 'MODIFIED' end from st join id2 on id2.o=v2 and id2.q=st.q where st<>'UNCHANGED'
 union all select g.q, id||'@'||l1, id, l1, 'DELETED' from gone g join lab on lab.q=g.q union all select g.q, id||'@'||l2, id, l2, 'ADDED' from come g join lab on lab.q=g.q),
 es as (select e.q, a.i src, et, b.i dst, side, line from (select {old}-yr q, src, dst, et, 1 side, line from e where yr<{last}) e join id1 a on a.o=e.src and a.q=e.q join id1 b on b.o=e.dst and b.q=e.q
 union all select e.q, a.i, et, b.i, side, line from (select {new}-yr q, src, dst, et, 2 side, line from e where yr>{first}) e join id2 a on a.o=e.src and a.q=e.q join id2 b on b.o=e.dst and b.q=e.q),
 p as (select raw.* replace (a.i as src, b.i as dst) from raw join id1 a on a.o=raw.src and a.q=raw.q join id2 b on b.o=raw.dst and b.q=raw.q),
 quiet as (select id1.q, id1.i src, id2.i dst from st join id1 on id1.o=v1 and id1.q=st.q join id2 on id2.o=v2 and id2.q=st.q where st='TRACKED')"""


_TWO = _pairs_sql(1996, 1997, "case {0}-q when 1996 then 'V1' else 'V2' end")


@add("two_version_nodes", _TWO + " select nid node_id, o original_id, any_value(s) version_status, string_agg(l, ',' order by l) versions from rows_ group by 1,2")
def _(s, d):
    return _merged(s, d).nodes.select("node_id", "original_id", "version_status", F.array_join("versions", ",").alias("versions"))


_EDGES = " select src, et edge_type, dst, r.side side, r.line line from (select src, et, dst, min({{'q': q, 'side': side, 'line': line}}) r from es group by 1,2,3)".format()


@add("two_version_edges", _TWO + _EDGES)
def _(s, d):
    return _merged(s, d).edges.select("src", "edge_type", "dst", "side", "line")


#: Types in the order they come first, and descriptions: all of them, or the first of each pair.
_FIRSTS = """, ty as (select src, et, dst, string_agg(v, ',' order by f) t from (select src, et, dst, type v, min(struct_pack(q:=q, a:=phase, b:=ref_id, c:=lp, d:=rp, e:=step)) f from p group by all) group by 1,2,3),
 de as (select src, et, dst, string_agg(v, '|' order by f) t from (select src, et, dst, descr v, min(struct_pack(q:=q, a:=phase, b:=ref_id, c:=lp, d:=rp, e:=step)) f from {0} group by all) group by 1,2,3)
 select g.src, g.et edge_type, g.dst, n occurrences, round(c,3) confidence, ty.t types, de.t descriptions, q0 pair from (select src, et, dst, count({1}) n, max(conf) c, min(q) q0 from p group by 1,2,3) g
 join ty on ty.src=g.src and ty.et=g.et and ty.dst=g.dst join de on de.src=g.src and de.et=g.et and de.dst=g.dst"""


def _listed(e):
    return e.select("src", "edge_type", "dst", "occurrences", F.round("confidence", 3).alias("confidence"), F.array_join("refactoring_types", ",").alias("types"), F.array_join("descriptions", "|").alias("descriptions"), "from_version", "to_version")


@add("two_version_evolution", f"select * exclude (pair), 'V1' from_version, 'V2' to_version from ({_TWO + _FIRSTS.format('p', '*')})")
def _(s, d):
    return _listed(_merged(s, d).evolution)


_STATES = "select 'node' what, unnest(['ADDED','DELETED','MODIFIED','UNCHANGED']) kind union all select 'evolution', unnest(['CHANGED_SIGNATURE','EXTRACTED','INLINED','MOVED','REFACTORED','RENAMED','SIMILAR_TO','UNCHANGED'])"


@add("evolution_statistics", _TWO + f""" select v.what, v.kind, coalesce(x.n,0) n from ({_STATES}) v left join (select 'node' what, s kind, count(distinct nid) n from rows_ group by 2
 union all select 'evolution', et, count(distinct src||'>'||dst) from p group by 2) x on x.kind=v.kind and x.what=v.what""")
def _(s, d):
    return V2.statistics(_merged(s, d))


@add("merge_counters", _TWO + """, u as (select src, et, dst, min({'q': q, 'side': side, 'line': line}) r from es group by 1,2,3)
 select 'node' what, s kind, count(distinct nid) n from rows_ group by 2 union all select 'edge', et, count(*) from u group by 2 union all select 'call', 'V'||r.side, count(*) from u where et='CALLS' group by 2
 union all select 'evolution', et, count(distinct src||'>'||dst) from p group by 2""")
def _(s, d):
    return V2.counters(_merged(s, d))


#: Five versions, 1994 to 1998, as V-4 to V0.
_FIVE = _pairs_sql(1994, 1998, "case when {0}-q=1998 then 'V0' else 'V-'||(1998-({0}-q)) end")


def _timeline(s, d):
    """Versions are named by commit id in the tables; the label of one of them is its commit id, as a passthrough."""
    nodes, edges = V.version_tables(s, d, 1994, 1998)
    labels = s.createDataFrame([("V0" if y == 1998 else f"V{y - 1998}", y - 1994, str(y)) for y in range(1994, 1999)], "label string, ord int, commit_id string")
    return V2.timeline(nodes, edges, labels, V.sided_refactorings(s, d, _TYPES, 1994, 1998), V.version_hunks(s, d, 1994, 1998))


@add("timeline_graph_nodes", _FIVE + """, r as (select nid, s, q, l, case l when 'V0' then 0 else substr(l,2)::int end o, case when s in ('ADDED','DELETED') then 3 when s='MODIFIED' then 2 else 1 end p from rows_)
 select nid node_id, array_to_string(list_transform(list_sort(list(distinct struct_pack(o:=o, l:=l))), lambda x: x.l), ',') versions, arg_max(s, p*10-q) version_status, arg_min(l, o) first_version, arg_max(l, o) last_version from r group by nid""")
def _(s, d):
    return _timeline(s, d).nodes.select("node_id", F.array_join("versions", ",").alias("versions"), "version_status", "first_version", "last_version")


add("timeline_graph_edges", _FIVE + _EDGES)(lambda s, d: _timeline(s, d).edges.select("src", "edge_type", "dst", "side", "line"))


@add("timeline_graph_evolution", f"""select e.* exclude (pair), l1 from_version, l2 to_version from ({_FIVE}, fd as (select q, src, et, dst, arg_min(descr, struct_pack(a:=phase, b:=ref_id, c:=lp, d:=rp, e:=step)) descr, 0 phase, 0 ref_id, 0 lp, 0 rp, 0 step from p group by q, src, et, dst)
 {_FIRSTS.format('fd', 'distinct q')}) e join (select q, case when q=0 then 'V0' else 'V-'||q end l2, 'V-'||(q+1) l1 from range(4) r(q)) lab on lab.q=pair""")
def _(s, d):
    return _listed(_timeline(s, d).evolution.where("edge_type <> 'UNCHANGED'"))


@add("timeline_graph_unchanged", _FIVE + " select src, dst, count(*) occurrences, min(1998-q)::varchar newer from quiet group by all")
def _(s, d):
    e = _timeline(s, d).evolution.where("edge_type = 'UNCHANGED'")
    year = F.when(F.col("to_version") == "V0", 1998).otherwise(F.substring("to_version", 2, 9).cast("int") + 1998)
    return e.select("src", "dst", "occurrences", year.cast("string").alias("newer"))


@add("version_names", "select 'O'||o_orderkey commit_id, case when o_orderkey%3=0 then 'V-'||o_orderkey else 'O'||o_orderkey end \"version\" from orders")
def _(s, d):
    """Commit ids to labels of the versions that have one; others pass."""
    o = V.table(s, d, "orders").select("o_orderkey", V.pid("O", "o_orderkey").alias("commit_id"))
    names = o.where("o_orderkey % 3 = 0").select(F.concat(F.lit("V-"), F.col("o_orderkey").cast("string")).alias("label"), "commit_id")
    return V2.labelled(o.select("commit_id", F.col("commit_id").alias("version")), ["version"], names)


def _tagged(s, d):
    """Refactorings that lead from a part of one version to one of the next, and scores of likely pairs, so that every tier is met."""
    (n1, e1), (n2, e2) = (V.version_tables(s, d, y, y) for y in (1996, 1997))
    refs = R.refactoring_edges(V.refactorings(s, d, _TYPES)).where("pos = 0").select(F.col("src").alias("left_id"), F.col("dst").alias("right_id"), "type")
    ends = refs.join(n1.select(F.col("node_id").alias("left_id")), "left_id", "left_semi").join(n2.select(F.col("node_id").alias("right_id")), "right_id", "left_semi")
    # One refactoring an old and a new part, so that no choice between equal ones is left.
    first = lambda df, key, other: df.groupBy(key).agg(F.min(F.struct(other, "type")).alias("r")).select(key, f"r.{other}", "r.type")
    ends = first(first(ends, "left_id", "right_id"), "right_id", "left_id")
    like = n1.join(n2.select(F.col("node_id").alias("v2_id"), F.col("source_code").alias("source2")), F.col("node_id") == F.col("v2_id")).where("node_type = 'METHOD' and source_code <> source2").withColumns({"a": F.col("source_code").cast("double"), "b": F.col("source2").cast("double")})
    scores = like.select(F.col("node_id").alias("v1_id"), "v2_id", (F.least("a", "b") / F.greatest("a", "b")).alias("score"))
    return V2.tagged(G.Graph(n1, e1), G.Graph(n2, e2), ends, scores, threshold=0.5)


_TAGGED = f"""with a as ({O.version(1996)}), b as ({O.version(1997)}), ta as (select distinct p_brand id from part join a on a.node_id='P'||p_partkey), tb as (select distinct p_brand id from part join b on b.node_id='P'||p_partkey),
 l0 as (select src left_id, dst right_id, type from (select ref_id, pos, type, left_id src, right_id dst from ({O.refactorings()})) where pos=0 and src in (select node_id from a) and dst in (select node_id from b)),
 l1 as (select left_id, unnest(min({{'right_id': right_id, 'type': type}})) from l0 group by 1), r as (select right_id, unnest(min({{'left_id': left_id, 'type': type}})) from l1 group by 1),
 t1 as (select left_id v1_id, right_id v2_id, case when contains(type,'RENAME') then 'RENAMED' when contains(type,'MOVE') then 'MOVED' else 'MODIFIED' end mapping from r),
 t2 as (select a.node_id v1_id, b.node_id v2_id, 'MODIFIED' mapping from a join b on a.node_id=b.node_id where a.source<>b.source and least(a.source,b.source)/greatest(a.source,b.source)::double>0.5 and a.node_id not in (select v1_id from t1) and b.node_id not in (select v2_id from t1)),
 t12 as (select * from t1 union all select * from t2),
 t3 as (select a.node_id v1_id, b.node_id v2_id, 'IDENTICAL' mapping from a join b on a.node_id=b.node_id and a.source=b.source where a.node_id not in (select v1_id from t12) and b.node_id not in (select v2_id from t12) union all select ta.id, tb.id, 'IDENTICAL' from ta join tb on ta.id=tb.id),
 t as (select * from t12 union all select * from t3)
 select * from t union all select id, null, 'DELETED' from (select node_id id from a union all select id from ta) where id not in (select v1_id from t) union all select null, id, 'ADDED' from (select node_id id from b union all select id from tb) where id not in (select v2_id from t)"""
add("tagged_mapping", _TAGGED)(lambda s, d: _tagged(s, d)[0])


_YEAR_EDGES = "select p_brand src, 'P'||l_partkey dst, 'DECLARES' edge_type from lineitem join part on p_partkey=l_partkey where year(l_shipdate)={0} union all select 'P'||prev, 'P'||l_partkey, 'CALLS' from (select l_partkey, lag(l_partkey) over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey) prev from lineitem where year(l_shipdate)={0}) where prev is not null"


@add("tagged_edges", f"select src, dst, edge_type, case when count(distinct v)=2 then 'both' else min(v) end \"version\" from (select *, 'v1' v from ({_YEAR_EDGES.format(1996)}) union all select *, 'v2' from ({_YEAR_EDGES.format(1997)})) group by 1,2,3")
def _(s, d):
    return _tagged(s, d)[1]


_PATHS = f"select e.src, e.type, e.dst from (select ref_id, pos, type, src, dst from ({{0}})) e join part on 'P'||p_partkey=src where contains(p_name, 'a')"


@add("evolution_paths", _PATHS.format("select ref_id, pos, type, case when type like 'INLINE\\_%' escape '\\' then left_id else l0 end src, case when type like 'EXTRACT\\_%' escape '\\' then right_id else r0 end dst from (select *, first_value(left_id) over w l0, first_value(right_id) over w r0, min(pos) over (partition by ref_id) p0 from (" + O.refactorings() + ") window w as (partition by ref_id order by pos)) where pos=p0 or type like 'EXTRACT\\_%' escape '\\' or type like 'INLINE\\_%' escape '\\'"))
def _(s, d):
    """Old and new ends of evolution edges whose old end's name holds a text."""
    edges = R.refactoring_edges(V.refactorings(s, d, _TYPES))
    named = V.table(s, d, "part").where(F.contains("p_name", F.lit("a"))).select(V.pid("P", "p_partkey").alias("src"))
    return edges.join(named, "src", "left_semi").select("src", "type", "dst")


@add("forced_pairs", f"select a.node_id, a.node_id in (select 'P'||l_partkey from lineitem where l_returnflag='A' and l_quantity=l_linenumber) or a.node_id in (select 'P'||l_partkey from lineitem where l_returnflag='R' and l_quantity=l_linenumber) forced from ({O.version(1996)}) a join ({O.version(1997)}) b on a.node_id=b.node_id")
def _(s, d):
    mapping = R.match(V.version(s, d, 1996), V.version(s, d, 1997)).select(F.col("node_id").alias("v1_id"), F.col("node_id").alias("v2_id"))
    # A line changes what it names if its number is its quantity.
    side = F.when(F.col("l_quantity") == F.col("l_linenumber"), F.when(F.col("l_returnflag") == "A", "V1").when(F.col("l_returnflag") == "R", "V2"))
    changed = V.table(s, d, "lineitem").select(side.alias("side"), V.pid("P", "l_partkey").alias("node_id")).where("side is not null")
    return R.changed_pairs(mapping, changed).select(F.col("v1_id").alias("node_id"), "forced")


add("version_sets", f"select 'P'||p_partkey node_id, array_to_string(list_sort(list_distinct(list_concat(['V1'], coalesce(x, [])))), ',') versions from part left join (select 'P'||l_partkey id, list(distinct 'Y'||year(l_shipdate)) x from lineitem group by 1) y on y.id='P'||p_partkey")(
    lambda s, d: G.with_versions(V.table(s, d, "part").select(V.pid("P", "p_partkey").alias("node_id"), F.array(F.lit("V1")).alias("versions")), V.table(s, d, "lineitem").select(V.pid("P", "l_partkey").alias("node_id"), F.array(F.concat(F.lit("Y"), F.year("l_shipdate").cast("string"))).alias("versions"))).select("node_id", F.array_join("versions", ",").alias("versions"))
)
add("is_evolution", "select count(*)>0 is_evolution from part where p_size>49")(
    lambda s, d: G.Graph(V.table(s, d, "part").select(F.when(F.col("p_size") > 49, "ADDED").alias("version_status"), F.lit(None).cast("array<string>").alias("versions")), None).is_evolution()
)


@add("located_nodes", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'P'||p_partkey node_id from lineitem join part on p_partkey//40=l_partkey//40 and case when p_size%7=0 then abs((p_partkey%40*10+1)-(l_partkey%40*10+1))<=2 else l_partkey%40*10+1-2<=p_partkey%40*10+9+2 and l_partkey%40*10+9+2>=p_partkey%40*10+1-2 end")
def _(s, d):
    """Nodes at places: by relative path, or by the end of an absolute one; fields by their line alone."""
    lo, path = (lambda k: V.place(k)[1]), (lambda k: V.place(k)[0])
    odd = F.col("p_partkey") % 2 == 1
    nodes = V.table(s, d, "part").select(V.pid("P", "p_partkey").alias("node_id"), F.when(F.col("p_size") % 7 == 0, "FIELD").otherwise("METHOD").alias("node_type"), F.when(odd, path("p_partkey")).alias("relative_path"), F.concat(F.lit("/r/s/"), path("p_partkey")).alias("absolute_path"), lo("p_partkey").alias("line_start"), (lo("p_partkey") + 8).alias("line_end"))
    at = V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", path("l_partkey").alias("path"), lo("l_partkey").alias("lo"), (lo("l_partkey") + 8).alias("hi"))
    return L.located(nodes, at).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "node_id")


@add("affected_elements", f"select distinct e.path, e.node_id element_name from ({O.FILES}) e join lineitem on 'F'||l_orderkey=e.path where start_line<=greatest(l_linenumber+(l_partkey%3), l_linenumber+1) and l_linenumber+1<=end_line")
def _(s, d):
    n = F.col("l_linenumber")
    hunks = V.table(s, d, "lineitem").select(F.lit("c").alias("commit_id"), V.pid("F", "l_orderkey").alias("new_path"), n.alias("begin_b"), (n + F.col("l_partkey") % 3).cast("int").alias("end_b"))
    own = V.table(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("start_line"), F.max("l_linenumber").alias("end_line"))
    name = F.concat(F.lit("E"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"))
    elements = own.select(F.lit("c").alias("commit_id"), V.pid("F", "l_orderkey").alias("path"), name.alias("element_name"), F.lit("METHOD").alias("element_type"), F.lit("NEW").alias("version"), "start_line", "end_line")
    return M.affected_elements(hunks, elements).select("path", "element_name")


def _reports(s, d):
    c = F.col
    side = F.when(c("l_linestatus") == "O", "new").otherwise("old")
    x = V.table(s, d, "lineitem").select(V.pid("O", "l_orderkey").alias("commit_id"), side.alias("side"), V.pid("T", "l_linenumber").alias("test_id"), c("l_linenumber").alias("test_seq"), F.concat(F.lit("a/C"), (c("l_partkey") % 5).cast("string")).alias("class"), F.lit("m").alias("method"), F.lit("(I)V").alias("descriptor"), F.when(c("l_quantity") > 25, 1).otherwise(0).alias("covered"))
    ids = x.select("commit_id", "side", F.concat(F.lit("a.C"), F.substring("class", 4, 9), F.lit(".m(int)")).alias("method_id")).distinct()
    return x, ids


@add("coverage_pairs", """with x as (select 'O'||l_orderkey commit_id, case when l_linestatus='O' then 'new' else 'old' end side, l_linenumber t, l_partkey%5 k, max((l_quantity>25)::int) c from lineitem group by all)
 select commit_id, side, 'T'||t test_id, 'a.C'||k||'.m(int)' focal_id, (case when side='old' then max(c) over (partition by commit_id, side, k order by t) else c end)=1 covered from x""")
def _(s, d):
    return M.coverage_pairs(*_reports(s, d))


@add("coverage_outcomes", """with p as (select 'O'||l_orderkey commit_id, count(distinct l_suppkey||'/'||l_partkey) filter (l_linestatus='O' and l_quantity>25) n, count(distinct l_suppkey||'/'||l_partkey) filter (l_linestatus<>'O' and l_quantity>25) o, l_orderkey k from lineitem group by l_orderkey)
 select commit_id, case when k%11=0 then 'error' when n<2 or k%5=0 or o<2 then 'failed' else 'success' end status, case when k%11=0 then null when n<2 then 'new_coverage_less_than_2' when k%5=0 then 'failed_to_switch_to_prev_commit' when o<2 then 'old_coverage_less_than_2' end reason,
 case when k%11=0 then 'broken' end error_message from p where k%7<>0 or k%11=0""")
def _(s, d):
    pairs = V.table(s, d, "lineitem").select(V.pid("O", "l_orderkey").alias("commit_id"), V.pid("S", "l_suppkey").alias("test_id"), V.pid("P", "l_partkey").alias("focal_id"), F.when(F.col("l_linestatus") == "O", "new").otherwise("old").alias("side"), (F.col("l_quantity") > 25).alias("covered"))
    keys = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), V.pid("O", "l_orderkey").alias("commit_id")).distinct()
    switches = keys.where("k % 7 = 0").select("commit_id", F.lit("new").alias("side")).union(keys.where("k % 5 = 0").select("commit_id", F.lit("old")))
    out = M.coverage_status(pairs, switches, keys.where("k % 11 = 0").select("commit_id", F.lit("broken").alias("error_message")))
    return out.select("commit_id", "status", "reason", "error_message")


@add("progress_summary", "select c_mktsegment project, count(*) processed, count(*) filter (o_orderstatus='F') successful, 60.0::double elapsed_seconds, round(100.0*count(*)/20000,2)::double \"percent\" from orders join customer on c_custkey=o_custkey group by 1")
def _(s, d):
    return M.progress(_results(s, d), 20000, 1000.0, 1060.0)


def _results(s, d):
    o = V.table(s, d, "orders").join(V.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_mktsegment").alias("project"), V.pid("O", "o_orderkey").alias("commit_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"))


add("funnel_summary", "select count(distinct c_mktsegment) projects, count(*) processed, count(*) filter (o_orderstatus='F') successful, round(100.0*count(*) filter (o_orderstatus='F')/count(*),2)::double pct from orders join customer on c_custkey=o_custkey")(lambda s, d: M.summary(_results(s, d)))


@add("resume_recount", "select c_mktsegment project, 'O'||o_orderkey commit_id, o_orderkey%3=0 recount from orders join customer on c_custkey=o_custkey where o_orderkey>=(select max(o_orderkey) from orders o join customer c on c.c_custkey=o.o_custkey where c.c_mktsegment=customer.c_mktsegment and o_orderkey%5=0)//2")
def _(s, d):
    """The commit at a project's cursor comes again though it is done; so does any other that is done behind it."""
    o = V.table(s, d, "orders").join(V.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    commits = o.select(F.col("c_mktsegment").alias("project"), F.col("o_orderkey").alias("idx"), V.pid("O", "o_orderkey").alias("commit_id"))
    cursor = commits.where("idx % 5 = 0").groupBy("project").agg(F.floor(F.max("idx") / 2).alias("current_index")).withColumnRenamed("project", "project_name")
    return M.remaining(commits, cursor, done=commits.where("idx % 3 = 0")).select("project", "commit_id", "recount")


_RECORD = "select commit_id, coalesce(array_to_string(focal_new,','),'') fn, coalesce(array_to_string(test_old,','),'') \"to\" from (" + O.SETS + ")"


@add("valid_commit_records", _RECORD)
def _(s, d):
    path = F.when(F.col("l_returnflag") == "R", "src/test/x").otherwise("src/main/x")
    e = V.table(s, d, "lineitem").select(V.pid("O", "l_orderkey").alias("commit_id"), path.alias("path"), V.pid("P", "l_partkey").alias("element_name"), F.when(F.col("l_linestatus") == "O", "NEW").otherwise("OLD").alias("version"))
    r = E.valid_commit_records(M.commit_sets(M.classify(e)))
    return r.select(F.col("commit.sha1").alias("commit_id"), F.array_join("focal_methods.new", ",").alias("fn"), F.array_join("test_methods.old", ",").alias("to"))
