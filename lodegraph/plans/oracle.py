"""SQL fragments shared by the oracles: the driver tables as facts about code."""

METHODS = """select 'O'||o_orderkey node_id, case when o_orderpriority like '1-%' then 'TEST_METHOD' else 'SOURCE_METHOD' end kind, o_orderpriority "name", '/r/src/main/O.java' path from orders
 union all select 'P'||p_partkey, case when p_size<=5 then 'CONSTRUCTOR' when p_size>45 then 'TEST_METHOD' else 'SOURCE_METHOD' end, p_name, case when p_size%2=0 then '/r/src/test/P.java' else '/r/src/main/P.java' end from part"""
OCC = """select 'O'||l_orderkey src, 'P'||l_partkey dst, l_linenumber line, case when l_returnflag='R' then 'CONSTRUCTOR' else 'INVOCATION' end occ_kind, l_linestatus access from lineitem"""
DENSE = """select 'U'||user_id src, event_type dst, hour(ts) line, event_type occ_kind from events"""
ROUTED = f"""select o.*, s.kind src_kind, d.kind dst_kind, case when s.kind='TEST_METHOD' and (case when occ_kind='CONSTRUCTOR' then d.path not like '%/test/%' else d.kind<>'TEST_METHOD' end) then 'TESTS' else 'CALLS' end edge_type
 from ({OCC}) o join ({METHODS}) s on s.node_id=o.src join ({METHODS}) d on d.node_id=o.dst"""
GRAPH = """select distinct 'P'||prev src, 'P'||l_partkey dst from (select l_partkey, lag(l_partkey) over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey) prev from lineitem) where prev is not null and prev<>l_partkey"""


def version(year: int) -> str:
    return f"select 'P'||l_partkey node_id, count(*) source from lineitem where year(l_shipdate)={year} group by l_partkey"


VERSIONS = """select year(l_shipdate) yr, 'P'||l_partkey node_id, count(*) source from lineitem where year(l_shipdate) between 1995 and 1998 group by all"""
DIFF = f"""select coalesce(a.node_id,b.node_id) node_id, a.source s1, b.source s2, case when a.node_id is null then 'ADDED' when b.node_id is null then 'DELETED' when a.source=b.source then 'UNCHANGED' else 'MODIFIED' end version_status
 from ({version(1996)}) a full outer join ({version(1997)}) b on a.node_id=b.node_id"""
COMMITS = """select 'C'||o_custkey repo, 'O'||o_orderkey commit_id, lag('O'||o_orderkey) over (partition by o_custkey order by o_orderdate,o_orderkey) parent_id, epoch(o_orderdate)::bigint commit_time, o_orderstatus author, o_orderpriority message, row_number() over (partition by o_custkey order by o_orderdate desc,o_orderkey desc) k from orders"""


def version_edges(year: int) -> str:
    return f"select 'S'||l_suppkey src, 'P'||l_partkey dst, 'CALLS' edge_type, l_linenumber line from lineitem where year(l_shipdate)={year}"


def kinds() -> str:
    from lodegraph.operators.versions import KINDS

    rows = ",".join(f"('{t}','{e}','{s}')" for t, e, s in KINDS)
    return f"select * from (values {rows}) k(type, edge_type, sub_type)"


def refactorings() -> str:
    from lodegraph.operators.versions import KINDS

    names = [t for t, _, _ in KINDS] + ["SOMETHING_NEW"]
    listed = "[" + ",".join(f"'{t}'" for t in names) + "]"
    return f"""select l_orderkey ref_id, (pos-2)::int pos, {listed}[(l_orderkey % {len(names)}) + 1] type, 'P'||prev left_id, 'P'||l_partkey right_id, 0.5::double + (l_linenumber % 6)/10 confidence
 from (select *, lag(l_partkey) over w prev, row_number() over w pos from lineitem where year(l_shipdate)=1997 window w as (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey)) where prev is not null"""


FILES = "select 'F'||l_orderkey path, 'E'||l_orderkey||'_'||l_partkey node_id, min(l_linenumber) start_line, max(l_linenumber) end_line from lineitem group by l_orderkey, l_partkey"
HUNKS = "select distinct 'F'||l_orderkey path, l_linenumber line, case when l_returnflag='R' then 'INSERT' when l_returnflag='A' then 'DELETE' else 'REPLACE' end type from lineitem"
CHANGES = "select 'O'||l_orderkey commit_id, case when l_returnflag='R' then 'src/test/x' else 'src/main/x' end path, 'P'||l_partkey element_name, case when l_linestatus='O' then 'NEW' else 'OLD' end version from lineitem"
SETS = f"""select commit_id, list_sort(list(distinct element_name) filter (path like '%test%' and version='NEW')) test_new, list_sort(list(distinct element_name) filter (path like '%test%' and version<>'NEW')) test_old,
 list_sort(list(distinct element_name) filter (path not like '%test%' and version='NEW')) focal_new, list_sort(list(distinct element_name) filter (path not like '%test%' and version<>'NEW')) focal_old from ({CHANGES}) group by commit_id"""
SIZES = f"select commit_id, coalesce(len(focal_new),0) fn, coalesce(len(focal_old),0) fo, coalesce(len(test_new),0) tn, coalesce(len(test_old),0) \"to\" from ({SETS})"


# The code base of views.code_facts.
_TYPES = """select 'store.C'||c_custkey qn, case when c_mktsegment='BUILDING' then 'TEST_CLASS' else 'CLASS' end kind, 'pkg.N'||c_nationkey pkg,
 '/root/p/src/'||case when c_mktsegment='BUILDING' then 'test' else 'main' end||'/java/C'||(c_custkey//2)||'.java' path, case when c_custkey%4=0 then 'java.lang.Object' else 'store.S'||(c_custkey%37) end sup,
 ['store.S'||(c_custkey%7), 'java.io.Serializable'] ifs, c_custkey%11=0 anon, (c_custkey%2*50+1)::int ls, (c_custkey%2*50+50)::int le from customer
 union all select 'store.S'||s_suppkey, case when s_suppkey%3=0 then 'INTERFACE' else 'CLASS' end, 'pkg.N'||s_nationkey, '/root/p/src/main/java/S'||s_suppkey||'.java', null, [], false, 1, 100 from supplier"""
_METHODS = """select 'store.C'||o_custkey own, 'm'||(o_orderkey%9)||'(int)' sig, 'm'||(o_orderkey%9) nm, case when o_orderpriority like '1-%' then 'TEST_METHOD' else 'SOURCE_METHOD' end kind, 'store.S'||(o_orderkey%50) ret,
 ['int','store.C'||o_custkey] pt, ['n','c'] pn, ['store.S'||(o_orderkey%13)] ex, o_orderkey%2=0 ov, '/root/p/src/main/java/C'||o_custkey||'.java' path, (o_orderkey%100)::int ls, (o_orderkey%100+5)::int le from orders
 union all select 'store.S'||(p_partkey%60), case when p_size<=5 then 'S'||(p_partkey%60)||'()' else 'm'||(p_size%9)||'(int)' end, case when p_size<=5 then 'S'||(p_partkey%60) else 'm'||(p_size%9) end,
 case when p_size<=5 then 'CONSTRUCTOR' else 'SOURCE_METHOD' end, 'void', case when p_size<=5 then [] else ['int'] end, case when p_size<=5 then [] else ['n'] end, [], false,
 '/root/p/src/'||case when p_size%2=0 then 'test' else 'main' end||'/java/S.java', (p_partkey%100)::int, (p_partkey%100+3)::int from part"""
_FIELDS = """select 'store.S'||(p_partkey%60) own, 'f'||p_size nm, p_size=50 enum, (p_partkey%90)::int ln, '/root/p/src/'||case when p_size%2=0 then 'test' else 'main' end||'/java/S.java' path from part where p_size>40"""
_USES = """select 'store.C'||o_custkey||'#m'||(o_orderkey%9)||'(int)' src, 'store.S'||(l_partkey%60)||'#'||case when l_returnflag in ('R','A') then 'f'||(l_linenumber+41) when l_quantity>40 then 'S'||(l_partkey%60)||'()' else 'm'||(l_linenumber%9)||'(int)' end dst,
 case when l_returnflag='R' then 'READ' when l_returnflag='A' then 'WRITE' when l_quantity>40 then 'CONSTRUCTOR' else 'INVOCATION' end ok, l_linenumber line from lineitem join orders on o_orderkey=l_orderkey"""
CODE = f"""t0 as ({_TYPES}), t as (select * from t0 where not anon), m as (select * from ({_METHODS}) where own in (select qn from t)), f as (select * from ({_FIELDS}) where not enum and own in (select qn from t)),
 files as (select distinct path from t0 where not regexp_matches(path, 'C[0-9]*5[.]java$')),
 raw as (select 'store' node_id, 'PROJECT' node_type, null::varchar kind, 'store' "name", 'Project:store' label, null::varchar path, null::int ls, null::int le
 union all select 'pkg.N'||n_nationkey, 'PACKAGE', null, 'pkg.N'||n_nationkey, 'Package:pkg.N'||n_nationkey, null, null, null from nation where n_nationkey%12<>0
 union all select path, 'FILE', null, regexp_extract(path,'[^/]*$'), 'File:'||regexp_extract(path,'[^/]*$'), path, null, null from files
 union all select qn, 'TYPE', kind, substr(qn,7), substr(qn,7)||' ('||kind||')', path, ls, le from t
 union all select own||'#'||sig, 'METHOD', kind, nm, nm||'('||kind||')', path, ls, le from m
 union all select own||'#'||nm, 'FIELD', null, nm, nm||': int', path, ln, ln from f),
 n as (select * exclude(r) from (select *, row_number() over (partition by node_id, node_type order by ls, kind, "name", label, path, le) r from raw) where r=1),
 m1 as (select * exclude(r) from (select *, row_number() over (partition by own, sig order by ls, pt, pn, ret, ex, kind) r from m) where r=1),
 occ as (select * from ({_USES})),
 routed as (select o.*, case when s.kind='TEST_METHOD' and (case when ok='CONSTRUCTOR' then d.path not like '%/test/%' else d.kind<>'TEST_METHOD' end) then 'TESTS' else 'CALLS' end et
 from occ o join n s on s.node_id=o.src and s.node_type='METHOD' join n d on d.node_id=o.dst and d.node_type='METHOD' where ok in ('INVOCATION','CONSTRUCTOR')),
 access as (select o.* from occ o join n s on s.node_id=o.src and s.node_type='METHOD' join n d on d.node_id=o.dst and d.node_type='FIELD' where ok in ('READ','WRITE'))"""
CODE_EDGES = """select 'store' src, node_id dst, case node_type when 'PACKAGE' then 'HAS_PACKAGE' else 'CONTAINS_FILE' end edge_type, null::varchar detail, null::int "position" from n where node_type in ('PACKAGE','FILE')
 union all select distinct qn, pkg, 'IN_PACKAGE', null, null from t where pkg in (select node_id from n where node_type='PACKAGE')
 union all select distinct path, qn, 'DECLARES_TYPE', null, null from t where path in (select path from files)
 union all select own, own||'#'||sig, 'DECLARES', min(case when kind='CONSTRUCTOR' then 'constructor' else 'method' end), null from m group by own, sig
 union all select distinct own, own||'#'||nm, 'DECLARES', 'field', null from f
 union all select distinct qn, sup, 'EXTENDS', null, null from t where sup<>'java.lang.Object' and sup in (select qn from t)
 union all select distinct qn, i, 'IMPLEMENTS', null, null from (select qn, unnest(ifs) i from t) where i in (select qn from t)
 union all select * from (select m.own||'#'||m.sig src, u.up||'#'||m.sig dst, 'OVERRIDES', case when m.ov then 'annotated' else 'plain' end, null from (select own, sig, max(ov) ov from m where kind<>'CONSTRUCTOR' group by 1,2) m
 join (select distinct qn, unnest(list_append(ifs, sup)) up from t) u on u.qn=m.own where u.up in (select qn from t)) where dst in (select node_id from n where node_type='METHOD')
 union all select own||'#'||sig, p, 'USES_PARAMETER', x, (i-1)::int from (select own, sig, unnest(pt) p, unnest(pn) x, generate_subscripts(pt,1) i from m1) where p in (select qn from t)
 union all select own||'#'||sig, ret, 'RETURN_TYPE', null, null from m1 where kind<>'CONSTRUCTOR' and ret in (select qn from t)
 union all select distinct own||'#'||sig, e, 'THROWS', null, null from (select own, sig, unnest(ex) e from m1) where e in (select qn from t)"""
