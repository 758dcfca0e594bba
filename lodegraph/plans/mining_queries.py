"""Commit funnel, sinks, scalar functions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodegraph.functions import exprs as X
from lodegraph.operators import export as E
from lodegraph.operators import mining as M
from lodegraph.plans import oracle as O
from lodegraph.plans.adding import adder
from lodegraph.sources import facts as S
from lodegraph.sources import views as V
from lodegraph.sources.tables import shared_dir
from lodegraph.streaming import ingest as I

QUERIES, ORACLES, add = adder()


def _elements(s, d):
    path = F.when(F.col("l_returnflag") == "R", "src/test/x").otherwise("src/main/x")
    return V.table(s, d, "lineitem").select(V.pid("O", "l_orderkey").alias("commit_id"), path.alias("path"), V.pid("P", "l_partkey").alias("element_name"), F.when(F.col("l_linestatus") == "O", "NEW").otherwise("OLD").alias("version"), F.col("l_linenumber").alias("start_line"), F.lit("METHOD").alias("element_type"))


def _sets(s, d):
    return M.commit_sets(M.classify(_elements(s, d)))


_N = ("focal_new", "focal_old", "test_new", "test_old")
add("changed_methods_by_commit", "select commit_id, " + ", ".join(f"coalesce(array_to_string({c},','),'') {c}" for c in _N) + f" from ({O.SETS})")(lambda s, d: _sets(s, d).select("commit_id", *[F.array_join(c, ",").alias(c) for c in _N]))
add("valid_commits", f"select commit_id from ({O.SIZES}) where fn+fo>0 and tn+\"to\">0 and (fn+fo>=2 or tn+\"to\">=2)")(lambda s, d: _sets(s, d).where(M.is_valid()).select("commit_id"))
add("valid_commit_totals", f"select count(*) commits, sum(fn)::bigint focal_new, sum(fo)::bigint focal_old, sum(tn)::bigint test_new, sum(\"to\")::bigint test_old from ({O.SIZES}) where fn+fo>0 and tn+\"to\">0 and (fn+fo>=2 or tn+\"to\">=2)")(lambda s, d: _sets(s, d).where(M.is_valid()).agg(F.count("*").alias("commits"), *[F.sum(F.size(c)).alias(c) for c in _N]))
add("size_gate", f"select commit_id from ({O.SIZES}) where fn between 1 and 39 and fo between 1 and 39 and tn between 1 and 39 and \"to\" between 1 and 39")(lambda s, d: _sets(s, d).where(M.size_gate()).select("commit_id"))
add("change_record", f"select commit_id, path, count(distinct element_name) n, string_agg(distinct element_name, ',' order by element_name) names from ({O.CHANGES}) group by all")(lambda s, d: M.change_record(_elements(s, d).withColumn("end_line", F.col("start_line"))).select("commit_id", F.explode("changed").alias("path", "e")).select("commit_id", "path", F.array_distinct(F.transform("e", lambda e: e["element_name"])).alias("names")).select("commit_id", "path", F.size("names").cast("bigint").alias("n"), F.array_join(F.sort_array("names"), ",").alias("names")))


def _pairs(s, d):
    return V.table(s, d, "lineitem").select(V.pid("O", "l_orderkey").alias("commit_id"), V.pid("S", "l_suppkey").alias("test_id"), V.pid("P", "l_partkey").alias("focal_id"), F.when(F.col("l_linestatus") == "O", "new").otherwise("old").alias("side"), (F.col("l_quantity") > 25).alias("covered"))


add("covered_pairs", "select distinct 'O'||l_orderkey commit_id, 'S'||l_suppkey test_id, 'P'||l_partkey focal_id, case when l_linestatus='O' then 'new' else 'old' end side from lineitem where l_quantity>25")(lambda s, d: _pairs(s, d).where("covered").select("commit_id", "test_id", "focal_id", "side").distinct())
_STATUS = "select commit_id, case when n<2 or o<2 then 'failed' else 'success' end status, case when n<2 then 'new_coverage_less_than_2' when o<2 then 'old_coverage_less_than_2' end reason, (case when n<2 or o<2 then 0 else n end)::bigint new_pairs, (case when n<2 or o<2 then 0 else o end)::bigint old_pairs from (select 'O'||l_orderkey commit_id, count(distinct l_suppkey||'/'||l_partkey) filter (l_linestatus='O' and l_quantity>25) n, count(distinct l_suppkey||'/'||l_partkey) filter (l_linestatus<>'O' and l_quantity>25) o from lineitem group by 1)"
add("coverage_status", _STATUS)(lambda s, d: M.coverage_status(_pairs(s, d)).select("commit_id", "status", "reason", F.size("new_pairs").cast("bigint").alias("new_pairs"), F.size("old_pairs").cast("bigint").alias("old_pairs")))
add("coverage_accumulates", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, max((l_quantity>25)::int) over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey) = 1 covered from lineitem")(
    lambda s, d: V.table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "max(cast(l_quantity > 25 as int)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) = 1 as covered"))
add("progress_counters", "select c_mktsegment project, count(*) processed, count(*) filter (o_orderstatus='F') successful, round(100.0*count(*) filter (o_orderstatus='F')/count(*),2)::double pct from orders join customer on c_custkey=o_custkey group by 1")(lambda s, d: V.table(s, d, "orders").join(V.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("project")).agg(F.count("*").alias("processed"), F.count_if(F.col("o_orderstatus") == "F").alias("successful"), F.round(F.lit(100.0) * F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 2).alias("pct")))
add("resume_cursor", "select o_orderkey from orders where o_orderkey>=100 and o_orderkey not in (select l_orderkey from lineitem)")(lambda s, d: V.table(s, d, "orders").where("o_orderkey >= 100").join(V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey"))
add("upsert_latest", "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r=1")(lambda s, d: M.upsert(V.table(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value"))
add("json_props_extract", "select event_type, count(*) n, sum(json_extract_string(props,'$.k')::bigint)::bigint total from events group by 1")(lambda s, d: V.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("total")))


@add("coverage_xml_unnest", "select 'a/b/C'||(l_suppkey%7) \"class\", 'm'||l_linenumber \"method\", '(I)V' descriptor, l_quantity::int covered, count(*) n from lineitem group by all")
def _(s, d):
    xml = F.concat(F.lit('<class name="a/b/C'), (F.col("l_suppkey") % 7).cast("string"), F.lit('"><method name="m'), F.col("l_linenumber").cast("string"), F.lit('" desc="(I)V"><counter type="INSTRUCTION" covered="'), F.col("l_quantity").cast("int").cast("string"), F.lit('"/><counter type="LINE" covered="1"/></method></class>'))
    return S.report_methods(V.table(s, d, "lineitem").select(xml.alias("xml"))).groupBy("class", "method", "descriptor", "covered").agg(F.count("*").alias("n"))


@add("report_coverage_join", "select distinct 'a.b.C'||(l_suppkey%7)||'.m'||l_linenumber||'(int)' method_id from lineitem where l_quantity>45")
def _(s, d):
    x = V.table(s, d, "lineitem").select(F.concat(F.lit("C"), (F.col("l_suppkey") % 7).cast("string")).alias("c"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("m"), "l_quantity")
    report = x.select(F.concat(F.lit("a/b/"), F.col("c")).alias("class"), F.col("m").alias("method"), F.lit("(I)V").alias("descriptor"), F.when(F.col("l_quantity") > 45, 1).otherwise(0).alias("covered"))
    return M.covered(report, x.select(F.concat(F.lit("a.b."), F.col("c"), F.lit("."), F.col("m"), F.lit("(int)")).alias("method_id")).distinct())


add("revert_plan", "select l_shipmode status, action, count(*) n from (select case when l_returnflag='N' then 'A' when l_returnflag='A' then 'M' else 'D' end l_shipmode, case when l_returnflag='N' then 'delete' else 'restore' end action from lineitem) group by all")(lambda s, d: M.revert_plan(V.table(s, d, "lineitem").select(F.when(F.col("l_returnflag") == "N", "A").when(F.col("l_returnflag") == "A", "M").otherwise("D").alias("status"))).groupBy("status", "action").agg(F.count("*").alias("n")))
add("property_profile", "select k \"key\", count(*) n from (select unnest(['brand','size','type']) k, unnest([p_brand, case when p_size>10 then p_size::varchar else '' end, p_type]) v from part) where trim(v)<>'' group by 1")(lambda s, d: E.property_profile(V.table(s, d, "part").select(F.lit("METHOD").alias("node_type"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise(""), F.lit("type"), F.col("p_type")).alias("props"))).select("key", "n"))
_TEXT = "documents"


def _docs(s, d):
    return V.table(s, d, _TEXT)


def _pin(name: str, sql: str, col) -> None:
    add(name, f"select doc_id, {sql} v from documents")(lambda s, d: _docs(s, d).select("doc_id", col().alias("v")))


_pin("csv_encode", "replace(replace(replace(text,chr(92),chr(92)||chr(92)),chr(10),chr(92)||'n'),chr(9),chr(92)||'t')", lambda: X.csv_encode(F.col("text")))
_pin("csv_decode_round_trip", "text", lambda: X.csv_decode(X.csv_encode(F.col("text"))))
_pin("csv_quote", "case when contains(text,',') or contains(text,'\"') or contains(text,chr(10)) then '\"'||replace(text,'\"','\"\"')||'\"' else text end", lambda: X.csv_quote(F.col("text")))
_pin("cyclomatic_complexity", "(1" + "".join(f"+(length(text)-length(replace(text,'{p}','')))//{len(p)}" for p in X.BRANCH_LITERALS) + ")::bigint", lambda: X.complexity(F.col("text")).cast("bigint"))
_pin("truncate_statement", "case when length(text)>500 then substr(text,1,497)||'...' else text end", lambda: X.truncated(F.col("text")))
_pin("line_count", "(length(text)-length(replace(text,chr(10),''))+1)::bigint", lambda: X.lines_of_code(F.lit(1), F.size(F.split("text", "\n"))).cast("bigint"))
_pin("doc_first_sentence", "trim(regexp_extract(split_part(trim(text),'@',1), '(?s)^(?:(.*?[.?!])(?:\\s|$)|(.*)$)', 0), ' '||chr(10))", lambda: X.doc_summary(F.col("text")))
_pin("is_method_element", "contains(text,'(') and contains(text,')')", lambda: X.is_method(F.col("text")))


def _part(name: str, sql: str, col) -> None:
    add(name, f"select p_partkey, {sql} v from part")(lambda s, d: V.table(s, d, "part").select("p_partkey", col().alias("v")))


_part("simple_name", "list_last(string_split(p_brand||'.'||p_name,'.'))", lambda: X.simple_name(F.concat("p_brand", F.lit("."), "p_name")))
_CLEAN = "case p_size%7 when 0 then p_name when 1 then p_name when 2 then p_name when 3 then 'a '||p_name when 4 then '(x) '||p_name when 5 then ': x' else '' end"
_DIRTY = [("PACKAGE: ", "(int)"), (" file:", " "), ("", ": int"), ("a ", "(b): c"), ("(x) ", ""), (": x", None), (None, None)]


def _dirty():
    """Names that reach each rule, some in another case or with blanks around."""
    out = F
    for i, (before, after) in enumerate(_DIRTY):
        text = F.lit(before) if after is None else F.concat(F.lit(before), "p_name", F.lit(after))
        out = out.when(F.col("p_size") % 7 == i, text)
    return out


_part("clean_name", _CLEAN, lambda: X.clean_name(_dirty()))
_SIGNATURE = "case p_size%5 when 0 then 'm(...)' when 1 then 'C(...)' when 2 then p_brand when 3 then 'a.m(...)' else '' end"
_SIGNED = ("a.b.C.m(int)", "C(x)", None, "a.m(java.lang.X)")
_part("short_signature", _SIGNATURE, lambda: X.short_signature(F.when(F.col("p_size") % 5 == 2, F.col("p_brand")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (*_SIGNED, None)]), F.col("p_size") % 5 + 1))))
_part("jvm_descriptor", "case p_size%3 when 0 then 'I' when 1 then 'Z' else 'L'||replace('a.b.'||p_brand,'.','/')||';' end", lambda: X.jvm_descriptor(F.when(F.col("p_size") % 3 == 0, "int").when(F.col("p_size") % 3 == 1, "boolean").otherwise(F.concat(F.lit("a.b."), "p_brand"))))
_part("descriptor_prefix", "'(IL'||replace(p_brand,'.','/')||';'", lambda: F.regexp_replace(X.descriptor_prefix(F.concat(F.lit("int, "), "p_brand")), r"\)$", ""))
_part("parse_method_id", "'x.y|m'||p_size||'|int'", lambda: (lambda m: F.concat_ws("|", m["class"], m["method"], m["params"]))(X.parse_method_id(F.concat(F.lit("x.y.m"), F.col("p_size").cast("string"), F.lit("(int)")))))
_Q = "'\"'"
_part("list_format", f"case when p_size%3=0 then '' else {_Q}||p_brand||';a'||chr(92)||';b;c'||chr(92)||chr(92)||'d;;x,'||chr(92)||'n'||{_Q} end", lambda: X.list_format(F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("p_brand"), F.lit("a;b"), F.lit("c\\d"), F.lit(None).cast("string"), F.lit("x,\n")))))
_part("call_frequency", "case when p_size<=1 then 'single' when p_size<=3 then 'few' when p_size<=10 then 'several' when p_size<=20 then 'many' else 'heavy' end", lambda: X.frequency(F.col("p_size")))
_part("versioned_id", "'P'||p_partkey||'@V1'", lambda: X.versioned_id(F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 9, "@V1").otherwise("")), F.lit("V1")))
_part("ordered_list_union", "array_to_string(list_distinct([p_brand]) || case when p_brand=split_part(p_type,' ',1) then [] else [split_part(p_type,' ',1)] end, ',')", lambda: F.array_join(X.trimmed_distinct(F.array(F.concat(F.lit(" "), "p_brand"), F.split("p_type", " ")[0], F.lit(" "), "p_brand")), ","))
_part("node_context_text", "p_name||chr(10)||p_type", lambda: X.node_context(F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit("")))
_part("relative_path", "'main/'||p_name", lambda: X.relative_path(F.concat(F.lit("/root/p/main/"), "p_name"), "/root/p"))
add("test_keyword_path", "select page_id, lower(url) like '%utm%' or lower(url) like '%feed%' or lower(url) like '%ref%' v from pages")(lambda s, d: V.table(s, d, "pages").select("page_id", X.is_test_path(F.col("url"), ["utm", "feed", "ref"]).alias("v")))


def _place(s):
    return f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"


def _events(s, d):
    return I.event_stream(s, f"{d}/events.parquet")


@add("stream_resume_counts", "select event_type, count(*) n from events group by 1")
def _(s, d):
    """Counted to the end, and once more on the same checkpoint: what was read before is not read again."""
    place = _place(s)
    I.drain(I.counts(_events(s, d)), place)
    return I.drain(I.counts(_events(s, d)), place)


_SESSIONS = """select user_id, ts, sum(new) over (partition by user_id order by ts, event_id) sid from
 (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end new from events)"""


@add("stream_session_windows", f"select user_id, count(*) sessions, sum(n)::bigint events from (select user_id, sid, count(*) n from ({_SESSIONS}) group by 1,2) group by 1")
def _(s, d):
    found = I.drain(I.sessions(_events(s, d)), _place(s))
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@add("tumbling_windows", "select date_trunc('day', ts) \"day\", event_type, count(*) n from events group by all")
def _(s, d):
    found = I.drain(I.windows(_events(s, d), "1 day"), _place(s))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@add("sliding_windows", "select date_trunc('day', ts) - to_days(k::int) + to_hours(h::int) \"start\", event_type, count(*) n from events, (values (0,0),(0,12),(1,12)) v(k,h) where ts >= date_trunc('day', ts) - to_days(k::int) + to_hours(h::int) and ts < date_trunc('day', ts) - to_days(k::int) + to_hours(h::int) + interval 24 hour group by all")
def _(s, d):
    found = I.drain(I.windows(_events(s, d), "1 day", "12 hours"), _place(s))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@add("stream_upsert", "select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by event_id desc) r from events) where r=1")
def _(s, d):
    place = _place(s)
    stream = _events(s, d).select("user_id", "event_id", "event_type", "value")
    I.upsert_batches(stream, f"{place}/table", "user_id", "event_id", f"{place}/checkpoint")
    return I.latest(s, f"{place}/table", stream.schema)


@add("stream_tracked_flag", "select 'U'||user_id base_id, event_id seq, coalesce(max((event_type<>'view')::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding),0)=1 tracked from events")
def _(s, d):
    status = F.when(F.col("event_type") == "view", "UNCHANGED").otherwise("MODIFIED")
    rows = _events(s, d).select(V.pid("U", "user_id").alias("base_id"), F.col("event_id").alias("seq"), status.alias("status"))
    return I.drain(I.tracked(rows), _place(s), "append").select("base_id", "seq", "tracked")
