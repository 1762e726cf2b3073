"""Queries of the composed searches, stores, sessions, streams and text helpers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, categories, experience, fuzzy, hints, intervals, overlaps, placement, rank, search, sessions, stores, views
from ..streaming import streams, tracking
from .model import Model
from .model import with_tables as sql
from .registry import _CALLS, _GOAL, _START, _calls, _count_sql, _keywords_sql, _start, _tokens_sql, query, rounded

_FIXED = "format('{{:.2f}}', case when abs({x} * 8) = floor(abs({x} * 8)) and abs({x} * 8) % 2 = 1 then {x} + sign({x}) * 0.0001 else {x} end)"


def _fixed_sql(x: str) -> str:
    return _FIXED.format(x=f"({x})")


# -- category search -----------------------------------------------------------

_C = ["red", "large"]


def _topics(m: Model) -> DataFrame:
    """Types of parts as help topics, with the names of their parts as content."""
    return m.table("part").groupBy(F.col("p_type").alias("name")).agg(F.array_join(F.sort_array(F.collect_list("p_name")), "\n").alias("content")).select("name", F.col("name").alias("id"), "content")


_TOPICS = "topics as (select p_type as name, p_type as id, string_agg(p_name, chr(10) order by p_name) as content from part group by p_type)"


@query(f"""with {_TOPICS}, s as (select name, 2 * {_count_sql(_tokens_sql('name', 1), _C)} + {_count_sql(_tokens_sql('content', 1), _C)} as score from topics)
select 'help' as category, row_number() over (order by score desc, name)::int as rank, name as id, {_fixed_sql('score')}::double as score from s where score > 0 qualify rank <= 3""")  # fmt: skip
def r8_category_help(m: Model) -> DataFrame:
    return categories.search_category(_topics(m), "help", categories.CategoryRequest("red Large"), ("name",)).select("category", "rank", "id", "score")


@query("""with s as (select p_partkey, p_name, p_type from part where contains(lower(p_name), 'e')) select 'symbols' as category, row_number() over (order by p_partkey)::int as rank, p_partkey::varchar as id, 'name' as matched from s qualify rank <= 4""")
def r8_category_symbols_unscored(m: Model) -> DataFrame:
    rows = m.symbols().select(F.col("ord").alias("id"), "name", "kind", "ord")
    found = categories.search_category(rows, "symbols", categories.CategoryRequest("E", scored=False, most=4), ("ord",))
    return found.select("category", "rank", "id", F.array_join("matched_in", ",").alias("matched"))


@query(f"""with s as (select p_partkey, 2 * {_count_sql(_tokens_sql('p_name', 1), _C)} + 0.5 * {_count_sql(_tokens_sql('p_type', 1), _C)} as score from part)
select 'symbols' as category, row_number() over (order by score desc, p_partkey)::int as rank, p_partkey::varchar as id, {_fixed_sql('score')}::double as score from s where score > 0 qualify rank <= 3""")  # fmt: skip
def r8_category_symbols(m: Model) -> DataFrame:
    rows = m.symbols().select(F.col("ord").alias("id"), "name", "kind", "ord")
    return categories.search_category(rows, "symbols", categories.CategoryRequest("red Large"), ("ord",)).select("category", "rank", "id", "score")


_R = ["asia", "region"]


def _category_tables(m: Model) -> dict[str, DataFrame]:
    """Regions as groups with the names of their nations as notations, nations as annotations, market segments as routines."""
    notes = m.table("nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("notations"))
    groups = m.groups().join(notes.withColumnRenamed("n_regionkey", "id"), "id").select(F.col("name").alias("id"), "name", "description", "notations")
    annotations = m.table("nation").select(F.col("n_name").alias("id"), F.concat(F.lit("from region "), F.col("n_regionkey").cast("string"), F.lit(" "), "n_name").alias("text"), F.lit("note").alias("type"))
    routines = m.table("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).select(F.col("c_mktsegment").alias("id"), F.col("c_mktsegment").alias("name"), F.lit("one segment").alias("description"), F.concat(F.lit("region of "), "c_mktsegment").alias("message"), F.array(F.lit("region"), F.lit("asia asia")).alias("checklist"))
    return {"groups": groups, "annotations": annotations, "routines": routines}


def _of(texts: str) -> str:
    return _count_sql(_tokens_sql(texts, 1), _R)


_NOTES = "(select coalesce(sum(" + _count_sql(_tokens_sql("n_name", 1), _R) + "), 0) from nation where n_regionkey = r_regionkey)"
_ALL = f"""s as (select 'groups' as category, r_name as id, 2 * {_of('r_name')} + {_of("'Region ' || r_name")} + 0.8 * {_NOTES} as score from region
union all select 'routines', c_mktsegment, 2 * {_of('c_mktsegment')} + 0.8 * {_of("'region of ' || c_mktsegment")} + 0.6 * 2.2 from (select distinct c_mktsegment from customer)
union all select 'annotations', n_name, 1.5 * {_of("'from region ' || n_regionkey || ' ' || n_name")} from nation),
r as (select category, row_number() over (partition by category order by score desc, id)::int as rank, id, {_fixed_sql('score')}::double as score from s where score > 0 qualify rank <= 3)"""


@query(f"with {_ALL} select category, rank, id, score from r")
def r8_all_categories(m: Model) -> DataFrame:
    wanted = [c for c in categories.parse_categories("all") if c != "files"]
    return categories.search_categories(_category_tables(m), wanted, categories.CategoryRequest("Asia region")).select("category", "rank", "id", "score")


@query(f"with {_ALL}, c as (select category, count(*) as n, max(score) as best from r group by category) select category, n, (n >= 2 or best >= 3) as strong, (case when n >= 2 or best >= 3 then 'strong ' else 'weak ' end) || category as insight from c")
def a19_insights(m: Model) -> DataFrame:
    found = categories.search_categories(_category_tables(m), ["groups", "annotations", "routines"], categories.CategoryRequest("Asia region"))
    return categories.insights(found).select("category", "n", "strong", "insight")


def _goal_sql(extra: str = "") -> str:
    m_path, m_name = _count_sql(_tokens_sql("path"), _GOAL), _count_sql(_tokens_sql("name"), _GOAL)
    kind = " or ".join(f"contains(lower(kind), '{t}')" for t in _GOAL)
    bag = " union all ".join(f"select path, unnest({_tokens_sql(c)}) as t from {t}" for c, t in (("path", "symbol_files"), ("name", "symbols")))
    return f""", p as (select path, {m_path} as path_score from symbol_files),
    s as (select path, sum({m_name} + (case when exported then 0.3::double * {m_name} else 0.0 end) + (case when {kind} then 0.5::double else 0.0 end)) as symbol from symbols group by path),
    b as (select path, t, count(*) as n from ({bag}) where t in ({", ".join(map(repr, _GOAL))}) group by path, t), q as (select unnest({_GOAL!r}) as t),
    w as (select path, sum(1.0::double + 0.2::double * (n - 1)) as word from b join q using (t) group by path),
    scored as (select path, 4 * symbol + 3 * path_score + coalesce(word, 0) as score from p join s using (path) left join w using (path))"""


@query(sql("symbols symbol_files", _goal_sql() + f" select row_number() over (order by score desc, path)::int as rank, path, {_fixed_sql('round(score, 9)')}::double as score, '' as summary, count(*) over () as total from scored qualify rank between 6 and 10"))
def r12_find_for_goal(m: Model) -> DataFrame:
    from .registry import GOAL

    files, _ = categories.find_for_goal(m.symbol_files(), GOAL, m.symbols(), page=2, size=5)
    return files


# -- search --------------------------------------------------------------------

_SYMBOL_SCORE = "case when lower(name) = 'arg' then 1.0::double when contains(lower(name), 'arg') then 0.7::double when regexp_matches(lower(name), '(?s)a.*r.*g') then 0.3::double end"


@query(sql("symbols symbol_files", f""", s as (select *, {_SYMBOL_SCORE} as score from symbols), f as (select path, avg(score) as relevance, list(name || ' (' || kind || ')' order by ord) as l from s where score is not null group by path),
t as (select path, 1.0::double as relevance from symbol_files where contains(path, 'arg')),
h as (select coalesce(t.path, f.path) as path, greatest(coalesce(t.relevance, 0), coalesce(f.relevance, 0)) as relevance, case when t.relevance >= coalesce(f.relevance, 0) then null else l end as l from t full join f on t.path = f.path)
select row_number() over (order by relevance desc, path)::int as rank, path, round(relevance, 6) as relevance, count(*) over () as total,
coalesce(array_to_string(l[1:2], ', ') || (case when len(l) > 2 then ', +' || (len(l) - 2) || ' more' else '' end), '') as symbols from h qualify rank <= 8"""))  # fmt: skip
def r5_hybrid_page(m: Model) -> DataFrame:
    request = search.SearchRequest("arg", max_results=8, max_symbols_per_file=2)
    return rounded(search.search(m.symbol_files(), m.symbols(), request), "relevance").select("rank", "path", "relevance", "total", "symbols")


@query(sql("files label_store assignments", """, h as (select path, summary, row_number() over (order by path)::int as rank, count(*) over () as total from files where contains(path, 'src1/') qualify rank <= 10),
l as (select target as path, string_agg(distinct name, ', ' order by name) as labels from assignments join label_store on id = label_id group by target)
select rank, path, total, case when length(summary) <= 160 then summary else left(summary, 160) || '...' end as snippet, coalesce(labels, '') as labels from h left join l using (path)"""))  # fmt: skip
def r5_snippet_and_labels(m: Model) -> DataFrame:
    named = m.assignments().join(m.label_store(), F.col("label_id") == F.col("id")).select("target", F.col("name").alias("label"))
    seen = lambda df: df.withColumn("snippet", F.col("snippet"))
    files = m.files().withColumn("summary", F.regexp_replace("summary", "(?i)src1/", ""))
    request = search.SearchRequest("src1/", mode="text", max_results=10, hooks=(seen,))
    return search.search(files, m.symbols(), request, labels=named).select("rank", "path", "total", "snippet", "labels")


_NTH = """, m as (select path, line_no, instr(line, 'License')::int as "column" from lines)"""


@query(sql("files lines", f"""{_NTH}, h as (select m.*, f.doc_id % 7 as score from m join files f using (path) where "column" > 0 and f.doc_id % 3 = 0)
select row_number() over (order by score desc, line_no, path)::int as rank, path, line_no, "column" from h qualify rank <= 5"""))  # fmt: skip
def r7_scores_kind_case(m: Model) -> DataFrame:
    """Content search by file scores, in files with a symbol of a kind, case-sensitive."""
    scores = m.files().select("path", (F.col("doc_id") % 7).cast("double").alias("score"))
    symbols = m.files().where("doc_id % 3 = 0").select("path", F.lit(0).alias("ord"), F.lit("x").alias("name"), F.lit("k").alias("kind"), F.lit(1).alias("start_line"), F.lit(1 << 30).alias("end_line"))
    found = search.content_search(m.files(), symbols, "License", scores, kind="k", case_sensitive=True)
    return found.select("rank", "path", F.col("line_no").cast("bigint").alias("line_no"), "column")


@query(sql("files lines", """, h as (select path, line_no, length(regexp_extract(line, '^(.*?)(?i:licen[sc]e)', 1)) + 1 as "column" from lines where regexp_matches(line, '(?i)licen[sc]e') and line_no between 2 and 4)
select row_number() over (order by line_no, path)::int as rank, path, line_no, "column"::int as "column" from h qualify rank <= 5"""))  # fmt: skip
def r7_regex_in_symbol(m: Model) -> DataFrame:
    """Content search by a regular expression in the lines of one symbol."""
    symbols = m.files().select("path", F.lit(0).alias("ord"), F.lit("part").alias("name"), F.lit("k").alias("kind"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    found = search.content_search(m.files(), symbols, "licen[sc]e", scope="$part", use_regex=True)
    return found.select("rank", "path", F.col("line_no").cast("bigint").alias("line_no"), "column")


@query(sql("symbols", "select path, ord, name from symbols where start_line > 40 and kind = (select max(kind) from symbols)"))
def f4_find_symbols(m: Model) -> DataFrame:
    kind = m.symbols().agg(F.max("kind")).first()[0]
    return views.find_symbols(m.symbols(), F.col("start_line") > 40, kind=kind).select("path", "ord", "name")


@query(sql("files", "select row_number() over (order by path)::int as rank, path, 1.0::double as relevance, count(*) over () as total from files where (path like '%1.txt' or path like '%8.txt') and starts_with(path, 'src1/e') qualify rank <= 9999"))
def f6_extensions(m: Model) -> DataFrame:
    request = search.SearchRequest("src1/", mode="text", include_full=True, extensions=("1.txt", "8.txt"), path_prefix="src1/e")
    return search.search(m.files(), m.symbols(), request).select("rank", "path", "relevance", "total")


@query(sql("edges", ", s as (select src from edges where dst = (select min(dst) from edges)) select e.dst, count(distinct e.src) as shared from edges e semi join s on s.src = e.src where e.dst <> (select min(dst) from edges) group by e.dst"))
def j3b_shared_importers(m: Model) -> DataFrame:
    from ..operators import graph

    return graph.shared_importers(m.edges(), m.edges().agg(F.min("dst")).first()[0])


@query(f"""with n as (select 'a/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.ts' as path, p_name from part), w as (select {_tokens_sql("(select p_name from part where p_partkey = (select min(p_partkey) from part)) || '_' || (select min(p_partkey) from part)")} as q)
select path, len(list_intersect(list_distinct({_tokens_sql("regexp_extract(path, '^a/(.*)[.]ts$', 1)")}), q)) as shared from n, w where path <> (select 'a/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.ts' from part where p_partkey = (select min(p_partkey) from part)) and shared > 0 order by shared desc, path limit 20""")  # fmt: skip
def j3b_similar_names(m: Model) -> DataFrame:
    path = F.concat(F.lit("a/"), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    files = m.table("part").select(path.alias("path"), "p_partkey")
    own = files.orderBy("p_partkey").first()["path"]
    return views.similar_names(files, own).select("path", F.col("shared").cast("bigint").alias("shared"))


# -- views of a file and of the graph --------------------------------------------


@query(sql("edges nodes", f"""{_CALLS}, s as ({_START.replace('min(src)', 'min(src) as p')})
select p as path, (select string_agg(dst, ',' order by dst) from edges join nodes on path = dst where src = p) as imports, coalesce((select string_agg(src, ',' order by src) from edges join nodes on path = src where dst = p), '') as imported_by,
(select name from nodes where path = p) as symbol, coalesce((select string_agg(distinct dst_path || '$' || dst_sym, ',' order by dst_path || '$' || dst_sym) from calls where src_path = p), '') as calls,
coalesce((select string_agg(distinct src_path || '$' || src_sym, ',' order by src_path || '$' || src_sym) from calls where dst_path = p), '') as called_by, 'g' as "groups", 2 as n_members, 'good' as labels from s"""))  # fmt: skip
def j6_peek(m: Model) -> DataFrame:
    path, spark = _start(m), m.spark
    files = m.nodes().select("path", F.lit("").alias("content"))
    symbols = m.nodes().select("path", F.lit(0).alias("ord"), "name", "kind", F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(True).alias("exported"))
    members = spark.createDataFrame([("g", "file", path), ("g", "file", "other"), ("h", "file", "other")], "name string, member_type string, path string")
    groups = spark.createDataFrame([("g", "one"), ("h", "two")], "name string, description string")
    given = spark.createDataFrame([("lbl_quality", path), ("lbl_toxic", "other")], "label_id string, target string")
    row = views.peek(files, path, m.edges(), symbols, _calls(m), groups, members, labels=m.label_store(), assignments=given)
    list_ = lambda c: F.array_join(c, ",")
    first = F.col("symbols")[0]
    return row.select("path", list_("imports").alias("imports"), list_("importers").alias("imported_by"), first["name"].alias("symbol"), list_(first["calls"]).alias("calls"), list_(first["called_by"]).alias("called_by"), F.col("groups")[0]["name"].alias("groups"), F.col("groups")[0]["n_members"].cast("int").alias("n_members"), F.col("labels")[0]["name"].alias("labels"))


@query(sql("files edges label_store assignments source_members", """, p as (select min(path) as p from files where doc_id in (select doc_id from labels where quality = 1 or toxic = 1))
select p as path, (select md5(array_to_string(str_split(content, chr(10))[1:2], chr(10))) from files where path = p) as digest, (select string_agg(name, ',' order by name) from label_store where id in (select label_id from assignments where target = p)) as labels,
'group ' || split_part(p, '/', 1) as "group", (select count(*) from source_members where name = 'group ' || split_part(p, '/', 1)) as n_members, 'on all,on this' as notations, 0::bigint as dependents from p"""))  # fmt: skip
def j17_read_enriched(m: Model) -> DataFrame:
    path, spark = m.assignments().agg(F.min("target")).first()[0], m.spark
    members, name = m.source_members().withColumn("member_type", F.lit("file")), "group " + path.split("/")[0]
    groups = members.select("name").distinct().withColumn("description", F.lit("d"))
    notes = spark.createDataFrame([(name, 0, "on all", None), (name, 1, "on another", "x"), (name, 2, "on this", path), ("no group", 0, "n", None)], "name string, ord int, text string, file string")
    from ..operators import lines

    row = views.read_enriched(m.files(), path, lines.line_range(F.col("content"), 1, 2), m.edges(), groups, members, notes, m.label_store(), m.assignments())
    g = F.col("groups")[0]
    return row.select("path", F.md5("content").alias("digest"), F.array_join("labels", ",").alias("labels"), g["name"].alias("group"), g["n_members"].alias("n_members"), F.array_join(g["notations"], ",").alias("notations"), "dependents")


@query(sql("files", "select 'files' as name, (select count(*) from files where doc_id % 2 = 0) as before, (select count(*) from files) as after, (select count(*) from files where doc_id % 2 = 1) as change union all select 'sources', count(distinct source) filter (doc_id % 2 = 0), count(distinct source), count(distinct source) - count(distinct source) filter (doc_id % 2 = 0) from files"))
def a6_counts_delta(m: Model) -> DataFrame:
    of = lambda df: df.agg(F.count("*").alias("files"), F.countDistinct("source").alias("sources"))
    return views.counts_delta(of(m.files().where("doc_id % 2 = 0")), of(m.files()))


def _log(m: Model) -> DataFrame:
    """Orders as transactions: a session a customer, closed ones but for each seventh."""
    rows = m.history().select(F.lpad(F.substring("path", 2, 20), 9, "0").alias("session_id"), "ts", F.when(F.col("id") % 3 == 0, "file:create").when(F.col("id") % 3 == 1, "file:write").otherwise("file:delete").alias("action"), F.col("o_orderpriority").alias("target"), F.lit(None).cast("string").alias("to"))
    closed = rows.where(F.col("session_id").cast("bigint") % 7 > 0).groupBy("session_id").agg(F.max("ts").alias("ts")).select("session_id", "ts", F.lit("session:close").alias("action"), F.lit("").alias("target"), F.lit(None).cast("string").alias("to"))
    return rows.unionByName(closed)


_LOG = "log as (select lpad(o_custkey::varchar, 9, '0') as session_id, o_orderdate as ts, o_orderkey as id, case o_orderkey % 3 when 0 then 'file:create' when 1 then 'file:write' else 'file:delete' end as action, o_orderpriority as target from orders)"
_LAST = f"with {_LOG}, l as (select max(session_id) as session_id from log where session_id::bigint % 7 = 0), o as (select log.* from log semi join l using (session_id))"


@query(f"""{_LAST}, c as (select list_sort(list_distinct(list(target) filter (action = 'file:create'))) as created, list_sort(list_distinct(list(target) filter (action = 'file:write'))) as wrote, list_sort(list_distinct(list(target) filter (action = 'file:delete'))) as deleted, min(session_id) as session_id from o)
select session_id, array_to_string(coalesce(created, []), ',') as created, array_to_string(list_sort(list_filter(coalesce(wrote, []), lambda x: not list_contains(coalesce(created, []), x))), ',') as updated, array_to_string(coalesce(deleted, []), ',') as deleted, true as orphaned from c""")  # fmt: skip
def w8_last_session(m: Model) -> DataFrame:
    join = lambda c: F.array_join(c, ",").alias(c)
    return sessions.last_session(_log(m)).select("session_id", join("created"), F.array_join(F.sort_array("updated"), ",").alias("updated"), join("deleted"), "orphaned")


@query(f"with {_LOG} select session_id from log order by ts desc, session_id desc limit 1")
def w8_last_transaction(m: Model) -> DataFrame:
    return sessions.last_transaction(_log(m).where("action <> 'session:close'")).select("session_id")


@query(f"with {_LOG}, s as (select session_id, list_sort(list_distinct(list(target) filter (action = 'file:create'))) as c, list_sort(list_distinct(list(target) filter (action = 'file:write'))) as w from log group by session_id) select session_id, array_to_string(list_sort(list_filter(coalesce(w, []), lambda x: not list_contains(coalesce(c, []), x))), ',') as updated from s")
def x6_updated_less_created(m: Model) -> DataFrame:
    return sessions.session_summary(_log(m)).select("session_id", F.array_join(F.sort_array("updated"), ",").alias("updated"))


_ACTS = "acts as (select 's' || (event_id % 40) as session_id, event_id as id, ts, event_type, case event_id % 4 when 0 then 'file:rename' when 1 then 'group:add' when 2 then 'annotation:add:meta' else 'group:notate' end as action, 't' || (event_id % 6) as target from events)"


@query(f"with {_ACTS} select session_id, coalesce(string_agg(distinct target || '->' || target || 'x', ',' order by target || '->' || target || 'x') filter (action = 'file:rename'), '') as renamed, coalesce(string_agg(distinct target, ',' order by target) filter (action like 'group:%'), '') as \"groups\", coalesce(string_agg(distinct target, ',' order by target) filter (action like 'annotation:add%'), '') as annotations from acts group by session_id")
def a10_renames_groups_annotations(m: Model) -> DataFrame:
    n = F.col("event_id")
    action = F.when(n % 4 == 0, "file:rename").when(n % 4 == 1, "group:add").when(n % 4 == 2, "annotation:add:meta").otherwise("group:notate")
    target = F.concat(F.lit("t"), (n % 6).cast("string"))
    log = m.events().select(F.concat(F.lit("s"), (n % 40).cast("string")).alias("session_id"), "ts", action.alias("action"), target.alias("target"), F.concat(target, F.lit("x")).alias("to"))
    join = lambda c: F.array_join(c, ",").alias(c)
    return sessions.session_summary(log).select("session_id", join("renamed"), join("groups"), join("annotations"))


@query("select * from (select 'checklist' as part, row_number() over (order by case p when 'high' then 0 when 'medium' then 1 else 2 end, lpad(id, 12, '0'))::int as ord, 'do ' || id as text from (select n_nationkey::varchar as id, case n_nationkey % 3 when 0 then 'low' when 1 then 'high' else 'medium' end as p from nation where n_nationkey % 2 = 0) union all select 'counts', 1, 'files: ' || (select count(*) from documents) union all select 'help', row_number() over (order by r_name)::int, r_name from region union all select 'plugins', 1, 'first' union all select 'plugins', 2, 'second' union all select 'labels', 1, '3 labels, ' || (select count(*) filter (quality = 1) + count(*) filter (toxic = 1) from labels join documents using (doc_id)) || ' assignments')")
def a20_orient(m: Model) -> DataFrame:
    k = F.col("n_nationkey")
    items = m.table("nation").select(k.cast("string").alias("item_id"), F.when(k % 2 == 0, "session:start").otherwise("other").alias("trigger"), F.when(k % 3 == 0, "low").when(k % 3 == 1, "high").otherwise("medium").alias("priority"), F.concat(F.lit("do "), k.cast("string")).alias("text"))
    plugins = m.spark.createDataFrame([("second", 1), ("first", 9)], "text string, priority int")
    report = views.orient(m.files().agg(F.count("*").alias("files")), m.label_store(), m.assignments(), m.groups().select("name"), items, _log(m), plugins)
    return report.where("part <> 'last session'")


@query(sql("edges nodes", f"{_CALLS} select distinct ref from (select src_path || '$' || src_sym as ref from calls union select dst_path || '$' || dst_sym from calls) order by ref limit 7"))
def o14_sample_symbols(m: Model) -> DataFrame:
    return views.sample_symbols(_calls(m), 7)


@query("select p_type as id, p_brand as source from (select p_type, min(p_brand) as p_brand, list(distinct p_name) as tags from part group by p_type) where list_contains(tags, (select min(p_name) from part))")
def f20_topics_by_tag(m: Model) -> DataFrame:
    topics = m.table("part").groupBy(F.col("p_type").alias("id")).agg(F.min("p_brand").alias("source"), F.collect_set("p_name").alias("tags"))
    return views.help_topics(topics, tag=m.table("part").agg(F.min("p_name")).first()[0]).select("id", "source")


@query("select p_partkey::varchar as id from part where p_brand = (select min(p_brand) from part)")
def f22_tools_by_category(m: Model) -> DataFrame:
    tools = m.table("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("source"), F.array("p_type").alias("tags"))
    return views.help_topics(tools, source=m.table("part").agg(F.min("p_brand")).first()[0]).select("id")


# -- journeys, metrics -----------------------------------------------------------

_F = "'f' || ({} % 5)"
_STEPS_SQL = """steps as (select l_orderkey as session_id, l_linenumber as seq, case l_linenumber % 3 when 1 then 'search' when 2 then 'read' else 'write' end as kind, 'f' || (l_partkey % 5) as a, 'f' || ((l_partkey + 1) % 5) as b, 'f' || (l_suppkey % 5) as w from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem group by all)),
j as (select *, coalesce(sum((kind = 'write')::int) over (partition by session_id order by seq rows between unbounded preceding and 1 preceding), 0)::int + 1 as journey from steps),
s as (select session_id, journey, a, b, row_number() over (partition by session_id, journey order by seq)::int as step, seq from j where kind = 'search'),
r as (select session_id, journey, a as path, seq from j where kind = 'read'), t as (select session_id, journey, w as target from j where kind = 'write'),
p as (select s.session_id, s.journey, s.step, r.path from r join s on s.session_id = r.session_id and s.journey = r.journey and s.seq < r.seq and r.path in (s.a, s.b) qualify row_number() over (partition by r.session_id, r.journey, r.seq order by s.seq desc) = 1),
o as (select s.session_id, s.journey, s.step, s.a, s.b, list_distinct(list(p.path) filter (p.path is not null)) as chosen, any_value(target) as target from s left join p using (session_id, journey, step) left join t using (session_id, journey) group by all),
e as (select session_id, journey, step, case when len(chosen) > 0 then list_filter(list_distinct([a, b]), lambda x: not list_contains(chosen, x)) else [] end as rejected, coalesce(chosen, []) as selected, target from o)"""


def _steps(m: Model) -> DataFrame:
    of = lambda c, k=0: F.concat(F.lit("f"), ((F.col(c) + k) % 5).cast("string"))
    n = F.col("l_linenumber") % 3
    kind = F.when(n == 1, "search").when(n == 2, "read").otherwise("write")
    lines = m.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    events = lines.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("seq"), kind.alias("kind"), F.lit("q").alias("query"), F.when(n == 1, F.array_distinct(F.array(of("l_partkey"), of("l_partkey", 1)))).alias("results"), F.when(n == 2, of("l_partkey")).when(n == 0, of("l_suppkey")).alias("path"))
    return experience.journeys(events)


@query(f"with {_STEPS_SQL} select session_id, journey, step, array_to_string(list_sort(selected), ',') as selected, array_to_string(list_sort(rejected), ',') as rejected, target from e")
def t6_journeys(m: Model) -> DataFrame:
    join = lambda c: F.array_join(F.sort_array(c), ",").alias(c)
    return _steps(m).select("session_id", F.col("journey").cast("int").alias("journey"), F.col("step").cast("int").alias("step"), join("selected"), join("rejected"), "target")


_LIVE_SQL = _STEPS_SQL.replace(_STEPS_SQL[: _STEPS_SQL.index("\n")], """steps as (select user_id as session_id, event_id as seq, case event_id % 3 when 1 then 'search' when 2 then 'read' else 'write' end as kind, 'f' || (event_id // 3 % 5) as a, 'f' || ((event_id // 3 + 1) % 5) as b, 'f' || (event_id // 7 % 5) as w from events),""")


@query(f"with {_LIVE_SQL} select session_id, journey, step, array_to_string(list_sort(selected), ',') as selected, array_to_string(list_sort(rejected), ',') as rejected, target from e where target is not null")
def t6_journeys_live(m: Model) -> DataFrame:
    """The closed journeys of a stream over the events, each user a session."""
    of = lambda k, d=3: F.concat(F.lit("f"), ((F.floor(F.col("event_id") / d) + k) % 5).cast("string"))
    n = F.col("event_id") % 3
    kind = F.when(n == 1, "search").when(n == 2, "read").otherwise("write")
    rows = m.stream("events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.lit("q").alias("query"), F.when(n == 1, F.array(of(0), of(1))).alias("results"), F.when(n == 2, of(0)).when(n == 0, of(0, 7)).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    steps = m.streamed(tracking.journeys(rows), "journeys").where("target is not null")
    join = lambda c: F.array_join(F.sort_array(c), ",").alias(c)
    return steps.select("session_id", "journey", "step", join("selected"), join("rejected"), "target")


@query("select user_id, event_type, row_number() over (partition by user_id, event_type order by ts, event_id) = 1 as created, event_id from events")
def t4_first_seen_live(m: Model) -> DataFrame:
    """Which events of a stream are the first of their user and type."""
    rows = m.stream("events").select("user_id", "event_type", "ts", "event_id")
    return m.streamed(tracking.first_seen(rows, ["user_id", "event_type"], ["ts", "event_id"]), "first_seen").select("user_id", "event_type", "created", "event_id")


_ANTI_SQL = """wrong as (select distinct target as correct_file, x as incorrect_file, reason from (select target, unnest(rejected) as x, 'appeared_in_results_but_rejected' as reason from e where target is not null union all select target, unnest(selected), 'read_but_abandoned' from e where target is not null) where x <> target)"""


@query(f"with {_STEPS_SQL}, {_ANTI_SQL} select correct_file, incorrect_file, reason from wrong")
def t6_anti_results(m: Model) -> DataFrame:
    return experience.anti_results(_steps(m)).select("correct_file", "incorrect_file", "reason").distinct()


@query(f"with {_STEPS_SQL}, {_ANTI_SQL} select correct_file, reason from wrong where incorrect_file = 'f2'")
def f18_anti_results_of_file(m: Model) -> DataFrame:
    return experience.anti_results_for(experience.anti_results(_steps(m)), "f2").select("correct_file", "reason")


@query(f"with {_STEPS_SQL} select session_id, journey, step from e where target = 'f3'")
def f17_journeys_of_file(m: Model) -> DataFrame:
    return experience.journeys_for(_steps(m), "f3").select("session_id", F.col("journey").cast("int").alias("journey"), F.col("step").cast("int").alias("step"))


@query("select lower(p_brand) as target, array_to_string(list_sort(list_distinct(list(p_name))), ',') as usages from part group by p_brand")
def x2_merged_usages(m: Model) -> DataFrame:
    of = lambda n: m.table("part").where(F.col("p_partkey") % 2 == n).groupBy(F.lower("p_brand").alias("target")).agg(F.collect_list("p_name").alias("usages"))
    return experience.add_usages(of(0), of(1)).select("target", F.array_join(F.sort_array("usages"), ",").alias("usages"))


@query("select ref as symbol_ref, array_to_string(list_sort(list_distinct(list_concat(" + _tokens_sql("split_part(ref, '/', 1)") + ", " + _tokens_sql("split_part(ref, '/', 2)") + "))), ',') as keywords, count(*) as edits from (select 'coreUnit/' || p_type as ref from part) group by ref")
def n12_symbol_keywords(m: Model) -> DataFrame:
    events = m.table("part").select(F.concat(F.lit("coreUnit/"), "p_type").alias("symbol_ref"), F.lit("success").alias("outcome"))
    return experience.symbol_metrics(events).select("symbol_ref", F.array_join(F.array_sort(F.split("keywords", ",")), ",").alias("keywords"), "edits")


_WORDS = "w as (select 'f' || (p_partkey % 50) as path, p_name as phrase from part)"


@query(f"with {_WORDS}, q as (select path, count(*) as n from w where len(list_intersect({_keywords_sql('phrase', T.STOP_WORDS_SHORT)}, ['red', 'widget'])) >= 0.5 * greatest(2, len({_keywords_sql('phrase', T.STOP_WORDS_SHORT)})) group by path) select path, n, round(least(n / 5.0::double, 1.0), 6) as score from q")
def a13_query_history(m: Model) -> DataFrame:
    phrases = m.table("part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")).alias("path"), F.col("p_name").alias("phrase"))
    return rounded(experience.query_history(phrases, "red widget"), "score")


_SET = _keywords_sql("phrase", T.STOP_WORDS_SHORT)


@query(f"""with p as (select distinct p_brand as path, p_partkey, p_name as phrase from part), s as (select path, {_SET} as words, count(*) as n from p group by all), ps as (select path, list_sort(words) as words, sum(n) as n from s group by all),
q as (select distinct p_brand || ' ' || p_name || ' ' || p_type as request_id, p_name || ' ' || p_type as phrase from part), qs as (select distinct request_id, list_sort({_SET}) as words from q)
select request_id, path, sum(n)::bigint as n, round(least(sum(n) / 5.0::double, 1.0), 6) as score from qs join ps on len(list_intersect(qs.words, ps.words)) >= 0.4 * greatest(len(qs.words), len(ps.words)) and len(list_intersect(qs.words, ps.words)) > 0 group by request_id, path""")  # fmt: skip
def a13_histories_of_requests(m: Model) -> DataFrame:
    """All requests for parts against all names of parts, by brand."""
    part = m.table("part")
    requests = part.select(F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("request_id"), F.concat_ws(" ", "p_name", "p_type").alias("query")).distinct()
    return rounded(overlaps.query_history(requests, part.select(F.col("p_brand").alias("path"), F.col("p_name").alias("phrase")), 0.4), "score")


@query("""with e as (select event_id, 's' || (user_id % 50) as session_id, event_type as tool, ts, case when event_id % 2 = 0 then 'start' else 'complete' end as phase from events),
l as (select *, lag(ts) over w as s, lag(phase) over w as b from e window w as (partition by session_id, tool order by ts, event_id)) select session_id, tool, count(*) as n, sum(epoch_us(ts) // 1000 - epoch_us(s) // 1000)::bigint as total_ms from l where phase = 'complete' and b = 'start' group by all""")  # fmt: skip
def t7_durations(m: Model) -> DataFrame:
    events = m.table("events").select("event_id", F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("session_id"), F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("complete").alias("phase"))
    return experience.operation_durations(events).groupBy("session_id", "tool").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"))


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type as tool, count(*) as calls, count(*) filter (event_type = 'error' or value < 10) as failures, round(avg(value), 4) as mean_ms from events group by all")
def a21_tool_telemetry(m: Model) -> DataFrame:
    events = m.table("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), ((F.col("event_type") != "error") & ~(F.col("value") < 10)).alias("success"), F.col("value").alias("duration_ms"))
    found = streams.tool_telemetry(events)
    return found.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "tool", "calls", "failures", F.round("mean_ms", 4).alias("mean_ms"))


@query("""with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k""")  # fmt: skip
def t4_activity_sessions(m: Model) -> DataFrame:
    events = m.table("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return streams.activity_sessions(events, "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("with e as (select event_type, ts from events where ts > (select max(ts) from events) - interval 7 days) select event_type, count(*) as n from e group by event_type")
def t10_recent(m: Model) -> DataFrame:
    return streams.recent(m.events(), F.lit(m.events().agg(F.max("ts")).first()[0])).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""select strftime(d, '%Y-%m-%d') as start, event_type, count(*) as n from (select event_type, unnest(range(0, 7)) as k, ts from events) e, lateral (select date_trunc('day', ts) - to_days(k::int) as d) group by all""")
def t10_recent_windows(m: Model) -> DataFrame:
    return streams.recent_counts(m.events(), "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


@query(sql("symbols symbol_files ev", """, f as (select path, row_number() over (order by path) as k from symbol_files), h as (select 'brand' || (event_id % 60) as p, count(*) as n from events group by 1)
select path, round(3 + least(3 * coalesce(n, 0), 12) + least(4 * coalesce(n, 0), 16), 6)::double as raw from f left join h on h.p = 'brand' || f.k"""))  # fmt: skip
def r15_history_and_usages(m: Model) -> DataFrame:
    from pyspark.sql import Window

    number = m.symbol_files().select("path", F.row_number().over(Window.orderBy("path")).alias("k"))  # a few dozen names
    n = m.events().groupBy((F.col("event_id") % 60).alias("k")).agg(F.count("*").alias("n")).join(number, "k").select("path", "n")
    static = m.symbol_files().select("path", F.lit(3.0).alias("static"))
    return rounded(rank.assist(static, "goal", history=n, usages=n), "raw").select("path", "raw")


_META = "cat as (select path, 'domain' as category, 'src1 name' as ann_path, summary as value from files where doc_id % 2 = 0 union all select path, 'meta', 'usage.x', summary from files where doc_id % 3 = 0 union all select path, 'meta', 'other', summary from files)"
_THE = ["the", "src1"]


@query(sql("files", f", {_META}, s as (select path, sum(case when category = 'domain' then {_count_sql(_tokens_sql('value'), _THE)} + 0.5 * {_count_sql(_tokens_sql('ann_path'), _THE)} else 0 end) as domain, sum(case when ann_path = 'usage.x' then 1.5 * {_count_sql(_tokens_sql('value'), _THE)} else 0 end) as usage from cat group by path) select path, round(domain, 6)::double as domain, round(usage, 6)::double as usage from s"))
def r6_domain_and_usage(m: Model) -> DataFrame:
    f = m.files()
    row = lambda df, c, p: df.select("path", F.lit(c).alias("category"), F.lit(p).alias("ann_path"), F.col("summary").alias("value"))
    found = row(f.where("doc_id % 2 = 0"), "domain", "src1 name").unionByName(row(f.where("doc_id % 3 = 0"), "meta", "usage.x")).unionByName(row(f, "meta", "other"))
    return rounded(rank.relevance(f, "the src1", categorised=found), "domain", "usage").select("path", "domain", "usage")


# -- stores ----------------------------------------------------------------------


@query("with n as (select r_name as name, 'file' as member_type, n_name as path from nation join region on r_regionkey = n_regionkey) select name, member_type, path from n union select 'ASIA', 'file', 'NEW' union select 'ASIA', 'symbol', 'a.ts$b' union select 'ASIA', 'directory', 'dir'")
def m_groups_set_members(m: Model) -> DataFrame:
    none = m.spark.createDataFrame([], "name string, ord int, text string, file string, line int, ts bigint")
    groups = m.groups().select("name", "description", F.lit(1).cast("bigint").alias("created_at"), F.lit(1).cast("bigint").alias("updated_at"))
    first = m.group_members().where("name = 'ASIA'").first()["path"]
    return stores.set_group(groups, m.group_members(), none, "ASIA", "other", [first, "NEW", "a.ts$b", "dir/"], 5)[1]


@query("select * from (select 'ASIA' as name, 0 as ord, 'Description updated: other' as text union all select 'ASIA', 1, 'seen' union all select 'EUROPE', 0, 'own')")
def m_groups_notations(m: Model) -> DataFrame:
    old = m.spark.createDataFrame([("EUROPE", 0, "own", None, None, 1)], "name string, ord int, text string, file string, line int, ts bigint")
    groups = m.groups().select("name", "description", F.lit(1).cast("bigint").alias("created_at"), F.lit(1).cast("bigint").alias("updated_at"))
    groups, _, notes = stores.set_group(groups, m.group_members(), old, "ASIA", "other", [], 5)
    return stores.notate(groups, stores.notate(groups, notes, "ASIA", "seen", 6), "NOWHERE", "lost", 6).select("name", "ord", "text")


@query("select 'ASIA' as name, (select count(*) - 1 from nation join region on r_regionkey = n_regionkey where r_name = 'ASIA') as n")
def m_groups_remove_member(m: Model) -> DataFrame:
    first = m.group_members().where("name = 'ASIA'").first()["path"]
    return stores.remove_members(m.group_members(), "ASIA", [first, "absent"])[1]


@query("select r_name as name, (select count(*) from nation where n_regionkey = r_regionkey) as n_members, 0::bigint as n_notations from region")
def a8_list_counts(m: Model) -> DataFrame:
    none = m.spark.createDataFrame([], "name string")
    return stores.list_counts(m.groups().select("name"), "name", {"n_members": m.group_members(), "n_notations": none})


@query("select row_number() over (order by r_regionkey, r_name)::int as rank, r_name as name from region qualify rank between 3 and 4")
def o8_group_page(m: Model) -> DataFrame:
    return rank.page(m.groups(), ["id", "name"], 2, 2).select("rank", "name")


@query("select 'lbl_red_hot_1_654321' as id, 'Red hot! 1' as name union all select 'lbl_quality', 'better' union all select 'lbl_toxic', 'toxic' union all select 'lbl_unused', 'unused'")
def m_labels_create_edit(m: Model) -> DataFrame:
    return stores.edit_label(stores.create_label(m.label_store(), "Red hot! 1", 1987654321), "lbl_quality", 9, name="better")


@query("select 'lbl_' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') || '_' || lpad((p_partkey * 7919 % 1000000)::varchar, 6, '0') as id from part")
def n16_label_ids(m: Model) -> DataFrame:
    return m.table("part").select(T.label_id(F.col("p_name"), F.col("p_partkey") * 7919).alias("id"))


@query("select n_name as path, 0 as ord, 'k: old' as text from nation where n_nationkey > 1 union all select n_name, 1, 'j: 2' from nation where n_nationkey <> 1 union all select n_name, 2, 'k: new' from nation where n_nationkey = 0 union all select n_name, 0, 'k: old' from nation where n_nationkey = 1")
def m_annotations_edit(m: Model) -> DataFrame:
    """Each nation has two notes; of the first one a key is set anew, of the second one it goes, and keys that aren't there change nothing."""
    notes = F.array(F.struct(F.lit(0).alias("ord"), F.lit("k: old").alias("text")), F.struct(F.lit(1).alias("ord"), F.lit("j: 2").alias("text")))
    meta = m.table("nation").select(F.col("n_name").alias("path"), F.explode(notes).alias("a")).select("path", "a.ord", F.lit("note").alias("type"), "a.text", F.lit("info").alias("severity"))
    first, second = (r["n_name"] for r in m.table("nation").where("n_nationkey < 2").orderBy("n_nationkey").collect())
    meta = stores.remove_annotation(stores.edit_annotation(meta, first, "k", "new"), second, "j")
    return stores.remove_annotation(stores.edit_annotation(meta, second, "absent", "x"), first, "absent").select("path", "ord", "text")


@query("select r_name as name, case when r_name = 'ASIA' then 'Region ASIA' || chr(10) || 'more' when r_name = 'EUROPE' then 'Area EUROPE' else 'Region ' || r_name end as content from region where r_name <> 'AFRICA' union all select 'NEW', 'text'")
def m_help_topics(m: Model) -> DataFrame:
    topics = stores.put(m.groups().select("name", F.col("description").alias("content")), "name", name="NEW", content="text")
    topics = stores.append_text(stores.drop_key(topics, "name", "AFRICA"), "name", "ASIA", "content", "more")
    return stores.replace_text(topics, "name", "EUROPE", "content", "Region", "Area")


@query("select r_name as name, case r_name when 'ASIA' then 'a.ts,b.ts' when 'EUROPE' then '' else 'b.ts' end as files, case when r_name = 'AFRICA' then 'hello' end as message from region")
def m_routines(m: Model) -> DataFrame:
    store = m.groups().select("name", F.array(F.lit("b.ts")).alias("files"), F.lit(None).cast("string").alias("message"))
    store = stores.put(store, "name", name="AFRICA", message="hello")
    store = stores.add_to_list(stores.add_to_list(store, "name", "ASIA", "files", "a.ts"), "name", "ASIA", "files", "b.ts")
    store = stores.remove_from_list(store, "name", "EUROPE", "files", "b.ts")
    return store.select("name", F.array_join(F.sort_array("files"), ",").alias("files"), "message")


@query("select p_brand as name, case when p_brand = (select min(p_brand) from part) then 'make all' else 'run ' || p_brand end as command, case when p_brand = (select min(p_brand) from part) then 1 end::bigint as created_at, case when p_brand = (select min(p_brand) from part) then 9 end::bigint as updated_at from (select distinct p_brand from part) where p_brand <> (select max(p_brand) from part)")
def m_macros(m: Model) -> DataFrame:
    """Macros, scripts and templates are rows of one text each: one is made anew, one goes."""
    part = m.table("part")
    store = part.select(F.col("p_brand").alias("name"), F.concat(F.lit("run "), "p_brand").alias("command"), F.lit(None).cast("bigint").alias("created_at"), F.lit(None).cast("bigint").alias("updated_at")).distinct()
    first, last = part.agg(F.min("p_brand"), F.max("p_brand")).first()
    store = stores.put(stores.drop_key(store, "name", first), "name", 1, name=first, command="make")
    return stores.drop_key(stores.put(store, "name", 9, name=first, command="make all"), "name", last)


@query(sql("files", "select path, case when doc_id % 4 = 0 then 'agent ' || doc_id else summary end as summary from files where doc_id % 4 <> 1"))
def m_summaries(m: Model) -> DataFrame:
    """Summaries are set for each fourth file, in place of those it has, and those of each other fourth go."""
    f = m.files()
    store = f.select("path", "summary")
    given = f.where("doc_id % 4 = 0").select("path", F.concat(F.lit("agent "), F.col("doc_id").cast("string")).alias("summary"))
    return stores.remove(stores.upsert(store, given, ["path"]), f.where("doc_id % 4 = 1").select("path"), ["path"])


@query("select c_custkey::varchar as root, c_name as name, c_custkey % 9 + 10 * (c_custkey % 2) as opened from customer where c_custkey % 5 > 0 qualify row_number() over (order by c_custkey % 9 + 10 * (c_custkey % 2) desc, c_custkey::varchar) <= 10")
def m_projects(m: Model) -> DataFrame:
    """The register of projects: opening one again moves it to the front, removed ones go; a page of the last opened."""
    k = F.col("c_custkey")
    store = m.table("customer").select(k.cast("string").alias("root"), F.col("c_name").alias("name"), (k % 9).cast("bigint").alias("opened"))
    again = store.where(F.col("root").cast("bigint") % 2 == 1).withColumn("opened", F.col("opened") + 10)
    left = stores.remove(stores.upsert(store, again, ["root"]), store.where(F.col("root").cast("bigint") % 5 == 0).select("root"), ["root"])
    return rank.page(left, [F.desc("opened"), "root"], 1, 10).select("root", "name", "opened")


@query("select n_name as path, case when n_regionkey = 1 then 'a=2,b=1' else 'a=1,b=1' end as vals from nation")
def e9_plugin_metadata(m: Model) -> DataFrame:
    values = lambda a: F.create_map(F.lit("a"), F.lit(a), *([F.lit("b"), F.lit("1")] if a == "1" else []))
    old = m.table("nation").select(F.col("n_name").alias("path"), F.lit("p").alias("plugin"), values("1").alias("values"))
    new = m.table("nation").where("n_regionkey = 1").select(F.col("n_name").alias("path"), values("2").alias("values"))
    got = stores.merge_metadata(old, "p", new)
    return got.select("path", F.array_join(F.sort_array(F.transform(F.map_entries("values"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("vals"))


@query("""select doc_id, case when doc_id % 2 = 0 then doc_id + 0.5::double else doc_id::double end as score, source, [lang, 'x'] as tags, case when doc_id % 2 = 0 then true end as checked from documents""")
def e9_variant_metadata(m: Model) -> DataFrame:
    """What a plugin keeps on documents, of numbers, lists and objects; newer values for each second one."""
    docs = m.table("documents")
    old = docs.select(F.col("doc_id").alias("path"), F.lit("p").alias("plugin"), F.parse_json(F.to_json(F.struct(F.col("doc_id").alias("score"), F.struct("source").alias("from"), F.array("lang", F.lit("x")).alias("tags")))).alias("values"))
    new = docs.where(F.col("doc_id") % 2 == 0).select(F.col("doc_id").alias("path"), F.parse_json(F.to_json(F.struct((F.col("doc_id") + F.lit(0.5)).alias("score"), F.lit(True).alias("checked")))).alias("values"))
    get = lambda path, kind: F.try_variant_get("values", path, kind)
    return stores.merge_variants(old, "p", new).select(F.col("path").alias("doc_id"), get("$.score", "double").alias("score"), get("$.from.source", "string").alias("source"), get("$.tags", "array<string>").alias("tags"), get("$.checked", "boolean").alias("checked"))


@query("select n_nationkey::varchar as item_id, row_number() over (order by case n_nationkey % 3 when 0 then 2 when 1 then 0 else 1 end, n_nationkey::varchar)::int as rank from nation where n_nationkey % 2 = 0")
def f19_checklist(m: Model) -> DataFrame:
    k = F.col("n_nationkey")
    items = m.table("nation").select(k.cast("string").alias("item_id"), F.when(k % 2 == 0, "session:start").otherwise("other").alias("trigger"), F.when(k % 3 == 0, "low").when(k % 3 == 1, "high").otherwise("medium").alias("priority"))
    return stores.checklist(items, "session:start").select("item_id", "rank")


@query("select (select max(n_nationkey) + 1 from nation)::varchar as item_id, 'x' as priority")
def m_checklist_add(m: Model) -> DataFrame:
    items = m.table("nation").select(F.col("n_nationkey").cast("string").alias("item_id"), F.lit("low").alias("priority"))
    return stores.add_item(items, priority="x").where("priority = 'x'")


@query("select name, kind, stamp from (select case when o_orderkey % 5 = 4 then 'x' else case when o_orderkey % 2 = 0 then 'daily' else 'turn' end || '-' || strftime(o_orderdate, '%Y%m%d') || case when o_orderkey % 2 = 1 then strftime(o_orderdate, '-%H%M%S') else '' end || '.json' end as name, case when o_orderkey % 2 = 0 then 'daily' else 'turn' end as kind, case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y%m%d') else strftime(o_orderdate, '%Y%m%d-%H%M%S') end as stamp from orders) where name <> 'x'")
def f21_backups(m: Model) -> DataFrame:
    """Names of backups made by the time stamps of orders, and read again."""
    even, ts = F.col("id") % 2 == 0, F.col("ts")
    name = F.concat(F.when(even, "daily-").otherwise("turn-"), F.when(even, T.stamp(ts)).otherwise(T.stamp(ts, True)), F.lit(".json"))
    return sessions.backup_names(m.history().select(F.when(F.col("id") % 5 == 4, "x").otherwise(name).alias("name")))


@query(sql("history", "select path, id from history where path = (select min(path) from history) order by ts desc"))
def o11_history_of_file(m: Model) -> DataFrame:
    return sessions.history_of(m.history(), m.history().agg(F.min("path")).first()[0]).select("path", "id")


@query(sql("files lines", "select 'inline' as source, line_no::int as line, 'policy' as key, line as value from lines where path = (select min(path) from files) and line_no between 1 and 12 and line <> ''"))
def j8_annotations_of_symbol(m: Model) -> DataFrame:
    """The lines of files as annotations, those of the first block of the first file."""
    from .registry import _blocks

    path = m.files().agg(F.min("path")).first()[0]
    notes = search.lines_of(m.files()).where("line <> ''").select("path", F.col("line_no").alias("line"), F.lit("policy").alias("type"), F.col("line").alias("message"))
    meta = notes.select("path", "type", F.col("message").alias("text"))
    return stores.annotations_of(notes, meta, _blocks(m), path, "block0")


@query(sql("files lines", "select path, line_no::int as line, 'block' || greatest(0, (line_no - 3) // 10) as symbol from lines where contains(line, '.')"))
def j8_annotations_with_symbols(m: Model) -> DataFrame:
    """All lines with a stop as annotations, with the first block that each stands in."""
    from .registry import _blocks

    notes = search.lines_of(m.files()).where(F.contains("line", F.lit("."))).select("path", F.col("line_no").alias("line"))
    return intervals.with_symbol(notes, _blocks(m), "line").select("path", "line", "symbol")


@query(sql("files lines", ", n as (select path, line_no, line from lines where contains(lower(line), 'license')), p as (select min(path) as p from n) select 'inline' as source, line_no as line, 'policy' as key, line as value from n where path = (select p from p) union all select 'meta', null, 'owner', 'team 1' from p union all select 'meta', null, 'note', 'plain' from p"))
def f12_annotations_of_file(m: Model) -> DataFrame:
    notes = search.match_lines(m.files(), "license").select("path", F.col("line_no").cast("bigint").alias("line"), F.lit("policy").alias("type"), F.col("line").alias("message"))
    path = notes.agg(F.min("path")).first()[0]
    meta = m.spark.createDataFrame([(path, "note", "owner: team 1"), (path, "note", "plain"), ("x", "note", "k: v")], "path string, type string, text string")
    return stores.annotations_of(notes, meta, m.symbols(), path)


@query(sql("files assignments", ", more as (select distinct 'lbl_unused' as label_id, target from assignments) select label_id, count(*) as n from (select label_id, target from assignments union select label_id, target from more) group by label_id"))
def m_labels_assign(m: Model) -> DataFrame:
    given = m.assignments()
    more = given.unionByName(given.withColumn("label_id", F.lit("lbl_unused")))
    return stores.assign(given, more).groupBy("label_id").agg(F.count("*").alias("n"))


# -- rules, hints, placement ------------------------------------------------------


@query(sql("files", "select 'long' as rule_id, path as file, 'info' as severity from files where length(content) > 2000 union all select 'flag', path, 'warning' from files where doc_id % 9 = 0"))
def u6_script_rules(m: Model) -> DataFrame:
    """Rules whose results are rows, and a condition on files."""
    rows = lambda c: c.files.where(F.length("content") > 2000).select("path", F.lit(None).cast("int").alias("line"), F.lit("long").alias("what"))
    rules = [audit.Rule("long", "long", "script", "info", script=rows), audit.Rule("flag", "flag", "script", script=lambda c: F.col("doc_id") % 9 == 0), audit.Rule("none", "none", "script", script=lambda c: False)]
    return audit.audit(audit.Catalog(m.files()), rules).select("rule_id", "file", "severity")


@query(sql("edges", f"select src as file, 'imports ' || dst as message from edges where dst = (select min(dst) from edges) and not contains(src, '9')"))
def u3_forbidden_edges(m: Model) -> DataFrame:
    none = m.spark.createDataFrame([], "path string, spec string")
    rule = audit.Rule("imp", "imports", "forbidden-import", config={"forbiddenImports": [m.edges().agg(F.min("dst")).first()[0]], "exemptFiles": ["9"]})
    return audit.check(rule, audit.Catalog(m.files(), imports=none, edges=m.edges())).select("file", "message")


@query("select n_name as query, unnest(case when n = 0 then ['no-results-orientation', 'no-results-alternatives'] when n < 3 then ['few-results-broaden'] when n > 50 then ['many-results-narrow'] else [] end) as hint from (select n_name, (select count(*) from supplier where s_nationkey = n_nationkey and s_acctbal > 5000) * (n_nationkey % 4) * (n_nationkey % 4) * 6 as n from nation)")
def r16_hints(m: Model) -> DataFrame:
    counts = m.table("supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    totals = m.table("nation").join(counts, "n_nationkey", "left").select("n_name", (F.coalesce("n", F.lit(0)) * (F.col("n_nationkey") % 4) * (F.col("n_nationkey") % 4) * 6).alias("n")).collect()  # one row for each of a few searches
    return m.spark.createDataFrame([(r["n_name"], h.id) for r in totals for h in hints.hints(hints.Outcome(r["n"]))], "query string, hint string")


@query(sql("files", ", f as (select path, str_split(content, chr(10)) as l from files) select path, md5(array_to_string(list_concat(l, ['X']), chr(10))) as digest from f where path = (select min(path) from files)"))
def m_symbol_place(m: Model) -> DataFrame:
    path = m.files().agg(F.min("path")).first()[0]
    none = m.spark.createDataFrame([], "path string, ord int, name string, kind string, start_line int, end_line int")
    return placement.place(m.files(), none, path, "X", "append").select("path", F.md5("content").alias("digest"))


# -- text helpers -------------------------------------------------------------------


@query("with p as (select p_partkey, p_name, p_partkey % 5 as k from part) select p_partkey, case k when 0 then p_name when 1 then '{+ab+}' || p_name when 2 then p_name || '{+!!+}' when 3 then case when p_name = '' then '{+x+}' else '{-' || p_name || '-}{+' || repeat('#', 3) || '+}' end else left(p_name, 3) || '{+##+}' || substr(p_name, 4) end as diff from p")
def n3_inline_diffs(m: Model) -> DataFrame:
    """Equal, put before, put after, all else, put inside."""
    a, k = F.col("p_name"), F.col("p_partkey") % 5
    b = F.when(k == 0, a).when(k == 1, F.concat(F.lit("ab"), a)).when(k == 2, F.concat(a, F.lit("!!"))).when(k == 3, "###").otherwise(F.concat(F.substring(a, 1, 3), F.lit("##"), F.substring(a, 4, 1000)))
    return m.table("part").select("p_partkey", T.inline_diff(a, b).alias("diff"))


@query(sql("files", "select path, doc_id % 2 = 0 as same from files"))
def n7_same_text(m: Model) -> DataFrame:
    c = F.concat("content", F.lit("\nend"))
    other = F.when(F.col("doc_id") % 2 == 0, F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\r\n"))).otherwise(F.concat(c, F.lit("x")))
    return m.files().select("path", T.same_text(c, other).alias("same"))


@query("select p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name || '  A be Is ' || p_type), '\\s+'), lambda x: length(x) >= 2), ',') as words, array_to_string(list_sort(" + _keywords_sql("p_name || ' with this part ' || p_type", T.STOP_WORDS_SHORT) + "), ',') as short, array_to_string(list_sort(" + _keywords_sql("p_name || ' with this part ' || p_type") + "), ',') as long from part")
def n9_dialects(m: Model) -> DataFrame:
    text = F.concat("p_name", F.lit(" with this part "), "p_type")
    words = T.words_of(F.concat("p_name", F.lit("  A be Is "), "p_type"))
    return m.table("part").select("p_partkey", F.array_join(words, ",").alias("words"), F.array_join(F.array_sort(T.keywords(text, T.STOP_WORDS_SHORT)), ",").alias("short"), F.array_join(F.array_sort(T.keywords(text)), ",").alias("long"))


@query(sql("files", "select path || v as target, case v when '$run' then 'symbol' when '' then 'file' else 'directory' end as label_type, case v when '$run' then 'symbol' when '' then 'file' when '/' then 'directory' else 'file' end as member_type from files, (values (''), ('$run'), ('/'), ('/x')) t(v)"))
def n17_target_types(m: Model) -> DataFrame:
    forms = F.explode(F.array(*[F.concat("path", F.lit(v)) for v in ("", "$run", "/", "/x")]))
    return m.files().select(forms.alias("target")).select("target", T.target_type(F.col("target")).alias("label_type"), T.member_type(F.col("target")).alias("member_type"))


@query("select o_orderkey, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm ' || (s % 60) || 's' else (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' end as text from (select o_orderkey, (o_totalprice::bigint % (case when o_orderkey % 2 = 0 then 90 else 20000 end)) as s from orders)")
def n18_durations(m: Model) -> DataFrame:
    s = F.bround("o_totalprice").cast("bigint") % F.when(F.col("o_orderkey") % 2 == 0, 90).otherwise(20000)
    return m.table("orders").select("o_orderkey", T.duration(s).alias("text"))


@query("select o_orderkey, strftime(o_orderdate, '%Y%m%d') as day, strftime(o_orderdate, '%Y%m%d-%H%M%S') as second from orders")
def n19_stamps(m: Model) -> DataFrame:
    ts = F.col("o_orderdate")
    return m.table("orders").select("o_orderkey", T.stamp(ts).alias("day"), T.stamp(ts, True).alias("second"))


@query(f"select p_partkey, {_fixed_sql('p_retailprice')} as price, {_fixed_sql('p_partkey / 8.0::double')} as eighth from part")
def n20_fixed(m: Model) -> DataFrame:
    return m.table("part").select("p_partkey", T.to_fixed(F.col("p_retailprice")).alias("price"), T.to_fixed(F.col("p_partkey") / 8).alias("eighth"))


@query("select n_name, 'policy' as type, case when n_regionkey < 2 then 'error' end as severity, 'keep ' || n_name as text from nation")
def n21_annotation_text(m: Model) -> DataFrame:
    text = F.concat(F.lit("@note.policy "), F.when(F.col("n_regionkey") < 2, "[error] ").otherwise(""), F.lit("keep "), F.col("n_name"))
    parsed = stores.parse_annotation(F.col("t"))
    return m.table("nation").select("n_name", text.alias("t")).select("n_name", *[c.alias(k) for k, c in parsed.items()])


@query(sql("files", "select path, md5(array_to_string(list_transform(str_split(content, chr(10)), lambda x: case when x = '' then x else '    ' || x end), chr(10))) as digest from files"))
def n23_indent(m: Model) -> DataFrame:
    return m.files().select("path", F.md5(T.indent(F.col("content"), 4)).alias("digest"))


@query(sql("files", "select path, regexp_replace(regexp_replace('./' || replace(path, '/', '//') || '/', '/+', '/', 'g'), '^[.]/|(.)/$', '\\1', 'g') as canonical from files"))
def n15_canonical(m: Model) -> DataFrame:
    return m.files().select("path", T.canonical(F.concat(F.lit("./"), F.replace("path", F.lit("/"), F.lit("//")), F.lit("/"))).alias("canonical"))


@query("""with l as (select o_custkey::varchar as path, row_number() over (partition by o_custkey order by o_orderkey) as line_no, o_orderpriority as line from orders), n as (select * from l where abs(line_no - 3) <= 2),
s as (select *, case when line = '3-MEDIUM' then 1.0::double else 1.0::double - levenshtein(line, '3-MEDIUM')::double / greatest(length(line), 8) end as plain from n),
b as (select *, max(plain) over (partition by path) as best, case when trim(line) = '3-MEDIUM' then 0.95::double else 0.9::double * plain end as second from s),
r as (select path, line_no, case when best >= 0.8 then plain else greatest(plain, second) end as score from b) select path, line_no, round(score, 6) as score from r qualify row_number() over (partition by path order by score desc, abs(line_no - 3), line_no) = 1""")  # fmt: skip
def n5_best_line(m: Model) -> DataFrame:
    lines = sessions.versions(m.history().withColumn("path", F.substring("path", 2, 20)), "path", ["id"]).select("path", F.col("version").cast("bigint").alias("line_no"), F.col("o_orderpriority").alias("line"))
    return rounded(fuzzy.best_line(lines, "3-MEDIUM", 3, 2), "score")


@query(sql("files", "select path from files where doc_id % 2 = 0 and not (starts_with(path, 'src1/') or contains('/' || path, '/de/')) union all select path || '.7.txt.bak' from files where doc_id % 2 = 1 and not (starts_with(path, 'src1/') or contains('/' || path, '/de/'))"))
def s3_ignore_patterns(m: Model) -> DataFrame:
    """Copies with the ending .7.txt are ignored, those with more after it aren't."""
    from ..sources import ingest

    odd = F.col("doc_id") % 2 == 1
    both = m.files().select(F.explode(F.array(F.when(odd, F.concat("path", F.lit(".7.txt"))).otherwise(F.col("path")), F.when(odd, F.concat("path", F.lit(".7.txt.bak"))).otherwise(F.concat("path", F.lit(".7.txt"))))).alias("path"))
    return both.where(~ingest.ignored(F.col("path"), ["src1/**", "*.7.txt", "**/de/**"]))


@query("select n_nationkey as path, case when n_regionkey = 0 then 'id' || n_nationkey else 'p-' || row_number() over (partition by n_regionkey = 0 order by n_nationkey) end as name from nation")
def w6_numbering_with_ids(m: Model) -> DataFrame:
    from ..sources import parsers

    rows = m.table("nation").select(F.lit("f").alias("path"), F.col("n_nationkey").alias("ord"), F.lit("p").alias("tag"), (F.col("n_regionkey") == 0).alias("has_id"))
    named = parsers.number_elements(rows)
    return named.select(F.col("ord").alias("path"), F.when(F.col("has_id"), F.concat(F.lit("id"), F.col("ord").cast("string"))).otherwise(F.col("name")).alias("name"))


@query("select n_name as path, n_regionkey::double + case when n_regionkey in (0, 1) then 3 when n_regionkey in (2) then 2 when n_regionkey = 3 then 1 else 0 end + 7 - n_regionkey as score from nation")
def r14_kind_boost(m: Model) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("function", "Class", "type", "let", "other"))), F.col("n_regionkey") + 1)
    rows = m.table("nation").select(F.col("n_name").alias("path"), F.lit("xargx").alias("name"), kinds.alias("kind"))
    return search.symbol_hits(rows, "arg").select("path", "score")


@query("select n_name as id, n_name as label from nation union all select 'd/' || n_name || '.ts', n_name || '.ts' from nation")
def k3_snapshot_labels(m: Model) -> DataFrame:
    from ..sources import catalog

    names = m.table("nation").select(F.explode(F.array(F.col("n_name"), F.concat(F.lit("d/"), "n_name", F.lit(".ts")))).alias("path"))
    none = m.spark.createDataFrame([], "src string, dst string")
    return catalog.nodes_and_edges(names, none)[0]
