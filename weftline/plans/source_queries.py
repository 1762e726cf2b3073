"""Queries of scanning, parsing, storing and following, and their SQL.

Source texts are made of the rows of the given tables by a template, so that
the SQL knows what a parser must find in them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import targets
from ..functions import text as T
from ..operators import edits, graph, lines, views
from ..plugins import EVENTS, Registry
from ..sources import catalog, documents, functions, ingest, parsers, walk
from ..storage import shared_folder
from ..streaming import streams
from .model import Model
from .model import with_tables as sql
from .registry import query

TAG = "@note"
_SCRIPT = """/**
 * About {name} and more text.
 * @note.policy keep {brand} tidy
 * @note.warning mind size {size}
 * @note.tags a{size}, b
 * @note.domain.name d{size}
 * @note.domain.relevance 0.5
 * @note.meta.usage for {brand}
 */
import {{ f{next} }} from './p{next}';
import lib from "lib{size}";
// import {{ no }} from './no';
export function f{k}(x) {{
  return f{next}(x) + lib.go(x);
}}
const c{k} = {size};
export class C{k} {{
  m{k}() {{
    return f{k}(1);
  }}
}}
export interface I{k} {{ a: string }}
type T{k} = string;
export enum E{k} {{ A, B }}
"""
_COMPONENT = """<template>
<div id="a{k}"><p>x</p><br><p>y
</p></div>
</template>
<script>
props: {{ one: String, two{k}: Number }}
const emit = defineEmits(['go{k}', "stop"])
</script>
"""
_PHP = """<?php
namespace Shop\\S{k};
use Base\\Thing;
use Other\\Item as It;
include 'lib{k}.php';
final class A{k} extends Thing implements One, Two
{{
    const LIMIT = {k};
    private static $count = 0;
    public function run($x) {{ return $x; }}
    protected function stop() {{ }}
}}
function help{k}() {{ }}
"""


def _filled(template: str, **fields) -> F.Column:
    """The template with columns in its fields."""
    parts, out = template.replace("{{", "\0").replace("}}", "\1").split("{"), []
    plain = lambda s: s.replace("\0", "{").replace("\1", "}")
    for i, part in enumerate(parts):
        if i:
            name, part = part.split("}", 1)
            out.append(fields[name])
        out.append(F.lit(plain(part)))
    return F.concat(*out)


def _filled_sql(template: str, **fields) -> str:
    parts, out = template.replace("{{", "\0").replace("}}", "\1").split("{"), []
    quoted = lambda s: "'" + s.replace("\0", "{").replace("\1", "}").replace("'", "''") + "'"
    for i, part in enumerate(parts):
        if i:
            name, part = part.split("}", 1)
            out.append(f"({fields[name]})::varchar")
        out.append(quoted(part))
    return " || ".join(out)


def scripts(m: Model) -> DataFrame:
    k = F.col("p_partkey")
    content = _filled(_SCRIPT, name=F.col("p_name"), brand=F.col("p_brand"), size=F.col("p_size").cast("string"), k=k.cast("string"), next=(k + 1).cast("string"))
    return m.table("part").select(F.concat(F.lit("src/p"), k.cast("string"), F.lit(".ts")).alias("path"), content.alias("content"), k.alias("k"))


_S = "scripts as (select 'src/p' || p_partkey || '.ts' as path, " + _filled_sql(_SCRIPT, name="p_name", brand="p_brand", size="p_size", k="p_partkey", next="p_partkey + 1") + " as content, p_partkey as k, p_name, p_brand, p_size from part)"


def components(m: Model) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    return m.table("nation").select(F.concat(F.lit("v/n"), k, F.lit(".vue")).alias("path"), _filled(_COMPONENT, k=k).alias("content"))


def php_files(m: Model) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    return m.table("supplier").select(F.concat(F.lit("s"), k, F.lit(".php")).alias("path"), _filled(_PHP, k=k).alias("content"))


# -- parsers -----------------------------------------------------------------

#: kind, name before the number, first and last line, exported.
_FOUND = "(values ('function', 'f', 13, 15, true), ('constant', 'c', 16, 16, false), ('class', 'C', 17, 21, true), ('method', 'm', 18, 20, false), ('interface', 'I', 22, 22, true), ('type', 'T', 23, 23, false), ('enum', 'E', 24, 24, true)) s(kind, letter, a, b, exported)"


@query(f"with {_S} select path, letter || k as name, kind, a as start_line, b as end_line, exported from scripts, {_FOUND}")
def p1_script_symbols(m: Model) -> DataFrame:
    return parsers.symbols(scripts(m)).select("path", "name", "kind", "start_line", "end_line", "exported")


@query(f"with {_S} select path, letter || k as name, kind, a as start_line, b as end_line, exported from scripts, {_FOUND}")
def e3_symbols_in_sql(m: Model) -> DataFrame:
    """The symbols from a table function, in SQL."""
    functions.register(m.spark)
    return m.spark.sql("select f.path, s.name, s.kind, s.start_line, s.end_line, s.exported from {files} f, lateral source_symbols(f.path, f.content) s", files=scripts(m))


@query(f"with {_S} select path, i as ord, spec from (select path, unnest([0, 1]) as i, unnest(['./p' || (k + 1), 'lib' || p_size]) as spec from scripts)")
def p2_imports(m: Model) -> DataFrame:
    return parsers.imports(scripts(m))


@query(f"with {_S} select path, unnest(['f' || k, 'f' || k, 'C' || k, 'C' || k, 'm' || k]) as sym, unnest(['f' || (k + 1), 'go', 'm' || k, 'f' || k, 'f' || k]) as callee from scripts")
def p3_raw_calls(m: Model) -> DataFrame:
    return parsers.raw_calls(scripts(m)).select("path", "sym", "callee")


@query(f"with {_S} select path, unnest(['f', 'C', 'I', 'E']) || k as name from scripts")
def p4_exports(m: Model) -> DataFrame:
    return parsers.exports(scripts(m)).select("path", "name")


@query(f"with {_S} select path, unnest([3, 4, 5]) as line, unnest(['policy', 'warning', 'tags']) as type, unnest(['error', 'warning', 'info']) as severity, unnest(['keep ' || p_brand || ' tidy', 'mind size ' || p_size, 'a' || p_size || ', b']) as message, unnest(['', '', 'a' || p_size || '|b']) as tags from scripts")
def p5_annotations(m: Model) -> DataFrame:
    found = parsers.annotations(scripts(m), TAG)
    return found.select("path", "line", "type", "severity", "message", F.coalesce(F.array_join("tags", "|"), F.lit("")).alias("tags"))


@query(f"with {_S} select path, unnest([6, 7, 8]) as line, unnest(['domain', 'domain', 'meta']) as category, unnest(['name', 'relevance', 'usage']) as ann_path, unnest(['d' || p_size, '0.5', 'for ' || p_brand]) as value from scripts")
def p5_categorised(m: Model) -> DataFrame:
    return parsers.categorised(scripts(m), TAG).select("path", "line", "category", "ann_path", "value")


@query(f"with {_S} select path, 'd' || p_size as name, 0.5::double as relevance, true as searchable from scripts")
def p6_domains(m: Model) -> DataFrame:
    return parsers.domains(parsers.categorised(scripts(m), TAG)).select("path", "name", "relevance", "searchable")


@query("select 'v/n' || n_nationkey || '.vue' as path, unnest(['n' || n_nationkey, 'one', 'two' || n_nationkey, 'go' || n_nationkey, 'stop']) as name, unnest(['component', 'props', 'props', 'emits', 'emits']) as kind from nation")
def p7_components(m: Model) -> DataFrame:
    return parsers.component_symbols(components(m)).select("path", "name", "kind")


@query("""select 'v/n' || n_nationkey || '.vue' as path, unnest([0, 1, 2, 3]) as ord, unnest(['a' || n_nationkey, 'p-1', 'br-1', 'p-2']) as name, unnest(['div', 'p', 'br', 'p']) as tag, unnest([true, false, false, false]) as has_id,
unnest([2, 2, 2, 2]) as start_line, unnest([3, 2, 2, 3]) as end_line, unnest([11, length('<div id="a' || n_nationkey || '"><p>x</p>') + 1, length('<div id="a' || n_nationkey || '"><p>x</p><br>') + 1, 5]) as end_col from nation""")  # fmt: skip
def p8_elements(m: Model) -> DataFrame:
    return parsers.elements(components(m)).select("path", "ord", "name", "tag", "has_id", "start_line", "end_line", F.col("end_col").cast("bigint").alias("end_col"))


@query("""select 's' || s_suppkey || '.php' as path, unnest(['A' || s_suppkey, 'LIMIT', 'count', 'run', 'stop', 'help' || s_suppkey]) as name, unnest(['class', 'constant', 'property', 'method', 'method', 'function']) as kind,
unnest([true, true, false, true, false, true]) as exported, 'Shop\\S' || s_suppkey as namespace, unnest([null, 'A' || s_suppkey, 'A' || s_suppkey, 'A' || s_suppkey, 'A' || s_suppkey, null]) as class_name,
unnest([null, 'public', 'private', 'public', 'protected', null]) as visibility, unnest([false, false, true, false, false, false]) as static from supplier""")  # fmt: skip
def p9_php_symbols(m: Model) -> DataFrame:
    files = php_files(m)
    found = parsers.symbols(files).select("path", "ord", "name", "kind", "exported")
    return found.join(parsers.modifiers(files), ["path", "ord"]).drop("ord")


@query("""select 's' || s_suppkey || '.php' as path, unnest(['extends', 'implements', 'implements', 'use', 'use', 'include']) as kind, unnest(['Thing', 'One', 'Two', 'Base\\Thing', 'Other\\Item', 'lib' || s_suppkey || '.php']) as spec from supplier""")
def p9_php_dependencies(m: Model) -> DataFrame:
    return parsers.php_dependencies(php_files(m)).select("path", "kind", "spec")


@query(f"with {_S} select path, 'About ' || p_name || ' and more text.' as summary from scripts")
def p10_summaries(m: Model) -> DataFrame:
    return scripts(m).select("path", parsers.summary(F.col("path"), F.col("content")).alias("summary"))


def first_words(text: str) -> list[tuple]:
    """A parser of plain texts: the first word is a heading."""
    words = text.split(" ", 1)
    return [(words[0], "heading", 1, 1, 1, len(words[0]) + 1, True, None)] if words[0] else []


@query(sql("files", "select path, split_part(content, ' ', 1) as name, 'heading' as kind from files where split_part(content, ' ', 1) <> ''"))
def p12_parser_of_a_plugin(m: Model) -> DataFrame:
    registry = Registry()
    registry.add_parser(".txt", first_words)
    return registry.symbols(m.files()).select("path", "name", "kind")


# -- scanning ----------------------------------------------------------------


def _tree(m: Model) -> str:
    """A folder of text files: one for each nation, in folders by region; and what a scan leaves out."""
    root = shared_folder(m.spark, "tree")
    rows = m.table("nation").select(F.concat(F.lit("/** About the nation "), "n_name", F.lit(". */\nnation "), "n_name").alias("value"), F.col("n_regionkey").alias("r"), F.col("n_name").alias("n"))
    rows.write.partitionBy("r", "n").text(root)
    for folder in (".hidden", "node_modules", "r=9"):
        m.spark.createDataFrame([("x",)], "value string").coalesce(1).write.text(f"{root}/{folder}")
    return root


@query("select 'r=' || n_regionkey || '/n=' || n_name as dir_path, octet_length(encode('/** About the nation ' || n_name || '. */' || chr(10) || 'nation ' || n_name || chr(10)))::bigint as size from nation where n_regionkey = 2")
def s12_tree_source(m: Model) -> DataFrame:
    """One folder of a tree, listed and read by the tasks of a data source."""
    walk.register(m.spark)
    root = re.sub("^[a-z]+:/*", "/", _tree(m))
    tree = m.spark.read.format("source_tree").option("root", root).option("ignores", "*.crc\n**/_SUCCESS\n_SUCCESS").load()
    return tree.where(F.col("path").startswith("r=2/")).select(T.directory(F.col("path")).alias("dir_path"), F.octet_length("content").cast("bigint").alias("size"))


@query("select 'r=' || n_regionkey || '/n=' || n_name as dir_path, octet_length(encode('/** About the nation ' || n_name || '. */' || chr(10) || 'nation ' || n_name || chr(10)))::bigint as size from nation where n_regionkey <> 3")
def s1_scan(m: Model) -> DataFrame:
    ignores = [*ingest.DEFAULT_IGNORES, *ingest.gitignore_patterns("# own\nr=9/\n\n/r=3\n"), "**/_SUCCESS", "_SUCCESS"]
    found = ingest.listing(m.spark, _tree(m), ignores)
    return found.select(T.directory(F.regexp_replace("path", "%20", " ")).alias("dir_path"), "size")


@query("select 'r=' || n_regionkey || '/n=' || n_name as dir_path, sha256('/** About the nation ' || n_name || '. */' || chr(10) || 'nation ' || n_name || chr(10)) as content_hash from nation where n_regionkey < 2")
def s7_file_rows(m: Model) -> DataFrame:
    found = ingest.read_files(m.spark, _tree(m), TAG, ignores=["r=2/**", "r=3/**", "r=4/**", "r=9/**", "_SUCCESS"])
    return found.where("size(tags) = 0 and domain is null").select(F.regexp_replace("dir_path", "%20", " ").alias("dir_path"), "content_hash")


@query("""select kind, count(*) as n from (select case when n_regionkey = 2 then 'gone' when n_regionkey = 1 then 'changed' else 'kept' end as kind from nation) group by kind""")
def s6_rescan(m: Model) -> DataFrame:
    root, skip = _tree(m), ["r=9/**", "_SUCCESS"]
    first = ingest.read_files(m.spark, root, ignores=skip)
    cached = first.withColumns({"last_modified": F.when(F.col("path").startswith("r=1/"), F.col("last_modified") - 1).otherwise(F.col("last_modified")), "content": F.lit("old")})
    now = ingest.rescan(m.spark, root, cached, ignores=[*skip, "r=2/**"])
    both = first.select("path").join(now.select("path", "content"), "path", "left")
    kind = F.when(F.col("content").isNull(), "gone").when(F.col("content") == "old", "kept").otherwise("changed")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(sql("files", "select path, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then source || '/' || lang || '/**' else '*.' || lang end as pattern from files"))
def s4_gitignore(m: Model) -> DataFrame:
    """Lines of an ignore file, comments, folders and suffixes, to patterns."""
    n = F.col("doc_id") % 3
    line = F.when(n == 0, F.concat(F.lit("# "), "path")).when(n == 1, F.concat(F.lit(" /"), "source", F.lit("/"), "lang", F.lit("/ "))).otherwise(F.concat(F.lit("*."), "lang"))
    return m.files().select("path", ingest.gitignore_pattern(line).alias("pattern"))


@query(f"with {_S} select path, 'export function f' || k || '(x) {{' || chr(10) || '  return f' || (k + 1) || '(x) + lib.go(x);' || chr(10) || '}}' as content from scripts where k = (select min(p_partkey) from part)".replace("{{", "{").replace("}}", "}"))
def s14_symbol_content(m: Model) -> DataFrame:
    files = scripts(m)
    k = files.agg(F.min("k")).first()[0]
    return lines.symbol_content(files, parsers.symbols(files), f"src/p{k}.ts", f"f{k}")


@query(f"with {_S} select path, md5(array_to_string(str_split(content, chr(10))[13:15], chr(10))) as digest from scripts")
def s15_exact_range(m: Model) -> DataFrame:
    return scripts(m).select("path", F.md5(lines.exact_range(F.col("content"), 13, 15)).alias("digest"))


# -- stores on disk ----------------------------------------------------------


@query(sql("edges nodes", "select (select count(*) from edges) as edges, (select count(*) from nodes) as files, (select md5(min(src || '>' || dst)) from edges) as least"))
def k1_save_and_load(m: Model) -> DataFrame:
    path = shared_folder(m.spark, "catalog")
    tables = {"files": m.nodes(), "edges": m.edges()}
    for _ in range(2):  # the second time in place of the first
        catalog.save(tables, path, "root")
    assert catalog.load(m.spark, path, "other root") is None
    got = catalog.load(m.spark, path, "root")
    files = got["files"].agg(F.count("*").alias("files"))
    return got["edges"].agg(F.count("*").alias("edges"), F.md5(F.min(F.concat("src", F.lit(">"), "dst"))).alias("least")).crossJoin(files)


@query("select * from (select p_partkey || chr(9) || p_name || chr(9) || p_size as value, '{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}' as json from part)")
def k4_formats(m: Model) -> DataFrame:
    part = m.table("part").select("p_partkey", "p_name", "p_size").orderBy("p_partkey")
    number = lambda df, n: df.select(F.monotonically_increasing_id().alias("i"), F.col("value").alias(n))
    return number(catalog.compact(part), "value").join(number(catalog.as_json(part), "json"), "i").drop("i")


@query("""with t as (select rpad(p_name, (select greatest(6, max(length(p_name))) from part)::int, ' ') || ' | ' || rpad(case when p_size = 0 then '' else p_size::varchar end, (select greatest(6, max(length(p_size::varchar))) from part)::int, ' ') as value from part)
select 0 as line, rpad('p_name', (select greatest(6, max(length(p_name))) from part)::int, ' ') || ' | p_size' as value union all select 1, repeat('-', (select greatest(6, max(length(p_name))) from part)::int) || '-+-------' union all select 2, value from t""")
def k4_table_format(m: Model) -> DataFrame:
    return catalog.as_table(m.table("part").select("p_name", "p_size"))


@query(sql("files symbols edges nodes", "select 'files' as part, count(*) as n, min(path) as least from files union all select 'symbols', count(*), min(name) from symbols union all select 'imports', count(distinct src), min(src) from edges"))
def k2_export(m: Model) -> DataFrame:
    parts = graph.export(m.files(), lines.directories(m.files()), m.symbols(), m.edges(), m.edges().select(F.col("src").alias("src_path"), F.lit("x").alias("src_sym"), F.col("dst").alias("dst_path"), F.lit("y").alias("dst_sym")))
    of = lambda name, c: parts[name].agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.min(c).alias("least"))
    return of("files", "path").unionByName(of("symbols", "name")).unionByName(of("imports", "src"))


@query(sql("ev", "select path, count(*) as n, count(*) filter (outcome = 'error') as errors from ev group by path"))
def s10_event_log(m: Model) -> DataFrame:
    path = shared_folder(m.spark, "log")
    events = m.events().select("event_id", "path", "outcome")
    catalog.append_log(events.where("event_id % 2 = 0"), path)
    catalog.append_log(events.where("event_id % 2 = 1"), path)
    got = catalog.read_log(m.spark, path, "event_id bigint, path string, outcome string")
    return got.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "error").alias("errors"))


@query(sql("groups group_members", "select m.name, m.path, g.description, 'about ' || m.name as notation from group_members m join groups_ g using (name)"))
def s11_group_store(m: Model) -> DataFrame:
    path = shared_folder(m.spark, "groups.json")
    members = m.group_members().groupBy("name").agg(F.collect_list(F.struct(F.col("member_type").alias("type"), "path")).alias("members"))
    note = F.array(F.struct(F.concat(F.lit("about "), "name").alias("text"), F.lit(7).alias("timestamp")))
    whole = m.groups().join(members, "name").select("name", F.struct("name", "description", "members", note.alias("notations")).alias("g"))
    doc = whole.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.map_from_entries(F.collect_list(F.struct("name", "g"))).alias("groups"))).alias("value"))
    doc.coalesce(1).write.text(path)
    got = documents.load_groups(m.spark, path)
    notes = got["group_notations"].where("ts = 7").select("name", F.col("text").alias("notation"))
    return got["group_members"].join(got["groups"].select("name", "description"), "name").join(notes, "name").select("name", "path", "description", "notation")


@query(sql("files label_store assignments", "select label_id, target, name from assignments join label_store on id = label_id"))
def s11_label_store(m: Model) -> DataFrame:
    path = shared_folder(m.spark, "labels.json")
    labels = m.label_store().agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("id", "name")))).alias("labels"))
    given = m.assignments().agg(F.collect_list(F.struct(F.col("label_id").alias("labelId"), "target", F.col("target_type").alias("targetType"))).alias("assignments"))
    labels.crossJoin(given).select(F.to_json(F.struct("labels", "assignments")).alias("value")).coalesce(1).write.text(path)  # one row each
    got = documents.load_labels(m.spark, path)
    return got["label_assignments"].join(got["labels"].select(F.col("id").alias("label_id"), "name"), "label_id").select("label_id", "target", "name")


@query(sql("files", "select path, summary from files where doc_id % 3 = 0"))
def s11_summary_store(m: Model) -> DataFrame:
    path = shared_folder(m.spark, "summaries.json")
    rows = m.files().where("doc_id % 3 = 0").select("path", "summary", F.lit("agent").alias("source"))
    documents.document(rows, "path", "summaries").coalesce(1).write.text(path)
    return documents.load_summaries(m.spark, path).select("path", "summary")


# -- changes -----------------------------------------------------------------


def _changes(m: Model) -> DataFrame:
    """Of each ten scripts one is deleted, one renamed, one written anew without its import, and written again."""
    files, k, at = scripts(m), F.col("k"), F.timestamp_seconds(F.lit(1000))
    of = lambda n: files.where(k % 10 == n)
    row = lambda df, op, content, to=None, s=0: df.select("path", F.lit(op).alias("op"), (F.lit(None).cast("string") if to is None else to).alias("to"), content.alias("content"), (at + F.expr(f"INTERVAL {s} SECONDS")).alias("ts"))
    none = F.lit(None).cast("string")
    out = row(of(1), "delete", none)
    out = out.unionByName(row(of(3), "rename", F.col("content"), F.concat(F.lit("src/q"), k.cast("string"), F.lit(".ts"))))
    out = out.unionByName(row(of(5), "write", F.lit("first"))).unionByName(row(of(5), "write", F.concat(F.lit("export function n"), k.cast("string"), F.lit("() {}\n")), s=9))
    return out.unionByName(row(of(7).select(F.concat(F.lit("src/new"), k.cast("string"), F.lit(".ts")).alias("path"), "k"), "create", F.concat(F.lit("import { f } from './p"), (k + 1).cast("string"), F.lit("';\n"))))


def _graph_tables(m: Model, called: bool = False) -> dict[str, DataFrame]:
    """``called``: whether the calls are read, for which the symbols are read twice."""
    # Written where read several times, as a stored graph is; the texts by many tasks, as they are made of short rows.
    files = graph.written(scripts(m).select("path", "content").repartition(4 * m.spark.sparkContext.defaultParallelism, "path"))
    parsed = streams.parse_files(TAG)(files)
    if called:
        parsed["symbols"] = graph.written(parsed["symbols"])
    edges = graph.written(graph.resolve_imports(parsed["imports"], files))
    calls = graph.resolve_calls(parsed["raw_calls"], edges, parsed["symbols"])
    return {n: parsed[n] for n in ("files", "symbols", "imports", "annotations")} | {"edges": edges, "calls": calls}


#: The scripts after _changes: path, number, whether the import and the function of the template are there.
_AFTER = f"""with {_S}, after as (select path, k, true as whole from scripts where k % 10 not in (1, 3, 5) union all select 'src/q' || k || '.ts', k, true from scripts where k % 10 = 3
union all select path, k, false from scripts where k % 10 = 5),
linked as (select path as src, 'src/p' || (k + 1) || '.ts' as dst, k from after where whole union all select 'src/new' || k || '.ts', 'src/p' || (k + 1) || '.ts', null from scripts where k % 10 = 7)"""


@query(f"{_AFTER} select src, dst from linked where dst in (select path from after)")
def t3_edges_after_changes(m: Model) -> DataFrame:
    return streams.apply_changes(_graph_tables(m), _changes(m), streams.parse_files(TAG))["edges"].select("src", "dst")


@query(f"""{_AFTER}, e as (select l.src, l.dst, l.k from linked l join after a on a.path = l.dst and a.whole)
select src as src_path, 'f' || k as src_sym, dst as dst_path, 'f' || (k + 1) as dst_sym from e where k is not null""")
def t3_calls_after_changes(m: Model) -> DataFrame:
    return streams.apply_changes(_graph_tables(m, called=True), _changes(m), streams.parse_files(TAG))["calls"]


@query(f"""{_AFTER}, n as (select path, case when whole then 7 else 1 end as symbols, case when whole then 3 else 0 end as annotations, case when whole then 2 else 0 end as imports from after union all select 'src/new' || k || '.ts', 0, 0, 1 from scripts where k % 10 = 7)
select path, symbols::bigint as symbols, annotations::bigint as annotations, imports::bigint as imports from n""")
def t3_tables_after_changes(m: Model) -> DataFrame:
    new = streams.apply_changes(_graph_tables(m), _changes(m), streams.parse_files(TAG))
    out = new["files"].select("path")
    for name in ("symbols", "annotations", "imports"):
        n = new[name].groupBy("path").agg(F.count("*").alias(name))
        out = out.join(n, "path", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out


@query(f"""with {_S} select 'node:remove' as event, path, null as lines from scripts where k % 10 in (1, 3) union all select 'node:add', 'src/q' || k || '.ts', 25 from scripts where k % 10 = 3
union all select 'file:change', path, 2 from scripts where k % 10 = 5 union all select 'node:add', 'src/new' || k || '.ts', 2 from scripts where k % 10 = 7""")  # fmt: skip
def t8_watch_events(m: Model) -> DataFrame:
    return streams.watch_events(_changes(m), scripts(m))


@query("select (select count(*) from part where p_partkey % 10 <> 4)::bigint as files, true as few_parts")
def t9_update_parts(m: Model) -> DataFrame:
    """Only the parts of the tables that a change touches are rewritten."""
    path = shared_folder(m.spark, "parts")
    old = {"files": scripts(m).select("path", "content")}
    catalog.save_parted(old, path)
    stored = catalog.load_parted(m.spark, path, old)
    assert catalog.update(stored, old, path) == {"files": []}
    one = {"files": old["files"].where(~F.col("path").rlike(r"p\d*4\.ts$"))}
    first = one["files"].agg(F.min("path")).first()[0]
    done = catalog.update(catalog.load_parted(m.spark, path, old), one, path)
    again = {"files": one["files"].withColumn("content", F.when(F.col("path") == first, "new").otherwise(F.col("content")))}
    done = catalog.update(catalog.load_parted(m.spark, path, old), again, path)
    return catalog.load_parted(m.spark, path, old)["files"].agg(F.count("*").alias("files"), F.lit(len(done["files"]) == 1).alias("few_parts"))


@query(f"with {_S} select path, 'write' as op, md5(array_to_string(list_concat(list_concat(str_split(content, chr(10))[1:12], ['X', 'Y']), str_split(content, chr(10))[16:25]), chr(10))) as digest from scripts where k = (select min(p_partkey) from part) union all select path, 'delete', md5(array_to_string(list_concat(str_split(content, chr(10))[1:12], str_split(content, chr(10))[16:25]), chr(10))) from scripts where k = (select min(p_partkey) from part) union all select 'copy.ts', 'copy', md5(array_to_string(str_split(content, chr(10))[13:15], chr(10))) from scripts where k = (select min(p_partkey) from part)")
def io_symbol_edits(m: Model) -> DataFrame:
    files = scripts(m)
    k, symbols, at = files.agg(F.min("k")).first()[0], parsers.symbols(files), F.current_timestamp()
    path, name = f"src/p{k}.ts", f"f{k}"
    rows = lambda df, op: df.select("path", F.lit(op).alias("op"), F.md5(F.col("content")).alias("digest")) if op != "copy" else df.select(F.col("path"), F.lit(op).alias("op"), F.md5("content").alias("digest"))
    new = rows(edits.write_symbol(files, symbols, path, name, "X\nY", at), "write")
    return new.unionByName(rows(edits.delete_symbol(files, symbols, path, name, at), "delete")).unionByName(rows(edits.copy_symbol(files, symbols, path, name, "copy.ts", at), "copy"))


@query(f"with {_S} select op, \"to\", n from (select 'create' as op, null as \"to\", 3 as n union all select 'append', null, length(content) + 4 from scripts where k = (select min(p_partkey) from part) union all select 'copy', null, length(array_to_string(str_split(content, chr(10))[2:4], chr(10))) from scripts where k = (select min(p_partkey) from part) union all select 'rename', 'moved.ts', length(content) from scripts where k = (select min(p_partkey) from part) union all select 'delete', null, null)")
def io_file_edits(m: Model) -> DataFrame:
    files, at = scripts(m), F.current_timestamp()
    path = f"src/p{files.agg(F.min('k')).first()[0]}.ts"
    made = {"create": edits.create(files, "other.ts", "new", at), "append": edits.append_to(files, path, "more", at), "copy": edits.copy(files, path, "b.ts", at, 2, 4), "rename": edits.move(files, path, "moved.ts", at), "delete": edits.delete(files, path, at)}
    out = None
    for op, df in made.items():
        row = df.select(F.lit(op).alias("op"), "to", F.length("content").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


# -- targets, plugins, events --------------------------------------------------


_REQUESTS = ", r as (select doc_id, path, case doc_id % 4 when 0 then path when 1 then path || ':' || (doc_id + 1) when 2 then path || ':' || 3 || '-' || (doc_id + 3) else replace(replace(path, '/', '.'), '.txt', '') || '.part.txt' end as target from files)"


def _requests(m: Model) -> DataFrame:
    id_, path = F.col("doc_id"), F.col("path")
    n = id_ % 4
    dotted = F.concat(F.replace(F.replace(path, F.lit("/"), F.lit(".")), F.lit(".txt"), F.lit("")), F.lit(".part.txt"))
    target = F.when(n == 0, path).when(n == 1, F.concat(path, F.lit(":"), (id_ + 1).cast("string"))).when(n == 2, F.concat(path, F.lit(":3-"), (id_ + 3).cast("string"))).otherwise(dotted)
    return m.files().select("doc_id", "path", target.alias("target"))


@query(sql("files", _REQUESTS + """ select target, case doc_id % 4 when 3 then replace(path, '.txt', '') || '/part.txt' else path end as path,
case doc_id % 4 when 1 then doc_id + 1 when 2 then 3 end::int as first, case doc_id % 4 when 1 then doc_id + 1 when 2 then doc_id + 3 end::int as last, case when doc_id % 4 in (1, 2) then 'range' else 'file' end as type from r"""))  # fmt: skip
def f24_parse_targets(m: Model) -> DataFrame:
    p = F.col("p")
    found = _requests(m).select("target", targets.parsed(F.col("target")).alias("p"))
    return found.select("target", p["path"].alias("path"), p["start"].alias("first"), p["end"].alias("last"), p["type"].alias("type"))


@query(sql("files", """ select path || v as target, case v when '$run' then path when ':2-4' then path when '/../x' then source || '/' || lang || '/x' else path end as path, case v when '$run' then 'symbol' when ':2-4' then 'range' when '/../x' then 'directory' else 'file' end as type,
case v when '$run' then 'run' end as symbol from files, (values ('$run'), (':2-4'), ('/../x'), ('')) t(v)"""))  # fmt: skip
def f25_resolve_targets(m: Model) -> DataFrame:
    forms = F.explode(F.array(*[F.concat("path", F.lit(v)) for v in ("$run", ":2-4", "/../x", "")]))
    found = m.files().select(forms.alias("target")).select("target", targets.resolved(F.col("target")).alias("r"))
    return found.select("target", "r.path", "r.type", "r.symbol")


@query(sql("files", "select event, count(*) as n from (select case doc_id % 3 when 0 then 'file:change' when 1 then 'node:remove' else 'node:add' end as event from files) group by event"))
def t2_event_names(m: Model) -> DataFrame:
    """Events of a batch of changes to the files, of which a third is changed, a third deleted and a third not known yet; all by names that the library emits."""
    n = F.col("doc_id") % 3
    changes = m.files().select("path", F.when(n == 1, "delete").otherwise("write").alias("op"), F.lit(None).cast("string").alias("to"), "content", F.col("doc_id").alias("ts"))
    found = streams.watch_events(changes, m.files().where(n < 2))
    return found.where(F.col("event").isin(*EVENTS)).groupBy("event").agg(F.count("*").alias("n"))


@query(sql("files", "select path, length(content) as n from files where path = (select min(path) from files)"))
def f1_file_by_key(m: Model) -> DataFrame:
    path = m.files().agg(F.min("path")).first()[0]
    return views.file_row(m.files(), path).select("path", F.length("content").cast("bigint").alias("n"))
