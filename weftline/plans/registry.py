"""The registered queries of the code-graph operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, experience, fuzzy, graph, lines, rank, search, sessions, stores, trigrams
from ..storage import stage
from .model import Model
from .model import with_tables as sql

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# The requests that the queries make, fixed so that the SQL can make them too.
WORDS = "src1 en the doc_7"
SYMBOL = "arg"
GOAL = "findRedWidgetType src1 brand"
_TEXT = """select path, ((case when contains(lower(path), 'src1') then 1.0 when contains(lower(summary), 'src1') then 0.6 else 0.0 end)
  + (case when contains(lower(path), 'en') then 1.0 when contains(lower(summary), 'en') then 0.6 else 0.0 end)
  + (case when contains(lower(path), 'the') then 1.0 when contains(lower(summary), 'the') then 0.6 else 0.0 end)
  + (case when contains(lower(path), 'doc_7') then 1.0 when contains(lower(summary), 'doc_7') then 0.6 else 0.0 end))::double / 4 as relevance from files"""
_TEXT = f"(select * from ({_TEXT}) where relevance > 0)"


def _name_score(q: str, fuzzy: str = "0.3", name: str = "name") -> str:
    return f"(case when lower({name}) = '{q}' then 1.0::double when contains(lower({name}), '{q}') then 0.7::double when regexp_matches(lower({name}), '(?s){'.*'.join(q)}') then {fuzzy}::double end)"


def _tokens_sql(c: str, longer: int = 2) -> str:
    return f"list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[\\s_\\-./\\\\]+'), lambda x: length(x) > {longer}), lambda x: lower(x))"


def _count_sql(tokens: str, query: list[str]) -> str:
    one = "(case when len(list_filter({t}, lambda x: x = '{q}')) > 0 then 1.0::double + 0.2::double * (len(list_filter({t}, lambda x: x = '{q}')) - 1) else 0.0::double end)"
    return "(" + " + ".join(one.format(t=tokens, q=q) for q in query) + ")"


def _keywords_sql(c: str, stop=T.STOP_WORDS_LONG) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: length(x) > 2 and x not in ({', '.join(repr(s) for s in stop)})))"


def _overlap_sql(a: str, b: str) -> str:
    return f"(case when len({a}) = 0 or len({b}) = 0 then 0.0::double else len(list_intersect({a}, {b}))::double / greatest(len({a}), len({b})) end)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# -- search ----------------------------------------------------------------


@query(sql("files", f"select rank, path, round(relevance, 6) as relevance from (select *, row_number() over (order by relevance desc, path)::int as rank from {_TEXT}) where rank <= 10"))
def r1_text_search(m: Model) -> DataFrame:
    hits = search.text_search(m.files(), WORDS)
    return rounded(rank.page(hits, [F.desc("relevance"), "path"], 1, 10), "relevance").select("rank", "path", "relevance")


@query(sql("files", "select path, 1.0::double as relevance from files where regexp_matches(path, '(?i)SRC1/en/.*7')"))
def r2_regex_path(m: Model) -> DataFrame:
    return search.text_search(m.files(), "SRC1/en/.*7", use_regex=True)


_SYMBOL = f"(select path, avg(s) as relevance, string_agg(name, ',' order by ord) as matched from (select *, {_name_score(SYMBOL)} as s from symbols) where s is not null group by path)"


@query(sql("symbols", f"select path, round(relevance, 6) as relevance, matched from {_SYMBOL}"))
def r3_symbol_search(m: Model) -> DataFrame:
    found = search.symbol_search(m.symbols(), SYMBOL)
    return rounded(found.withColumn("matched", F.array_join(F.transform("matched", lambda s: s["name"]), ",")), "relevance")


@query(sql("symbols", "select path, 1.0::double as relevance, count(*) as n from symbols where regexp_matches(name, '(?i)^large.*e$') and kind = (select min(kind) from symbols) group by path"))
def r3r_regex_symbols(m: Model) -> DataFrame:
    kind = m.symbols().agg(F.min("kind")).first()[0]
    found = search.symbol_search(m.symbols(), "^large.*e$", [kind], use_regex=True)
    return found.select("path", "relevance", F.size("matched").cast("bigint").alias("n"))


_HYBRID = f"""t as (select path, (case when contains(path, 'arg') then 1.0 else 0.0 end)::double as relevance from symbol_files where contains(path, 'arg')),
s as {_SYMBOL}, u as (select path, relevance, 1 as first, '' as matched from t union all select path, relevance, 0, matched from s)"""


@query(sql("symbols symbol_files", f", {_HYBRID} select path, round(relevance, 6) as relevance from u qualify row_number() over (partition by path order by relevance desc, first desc) = 1"))
def r4_hybrid(m: Model) -> DataFrame:
    hits = search.merge_hits(search.text_search(m.symbol_files(), SYMBOL), search.symbol_search(m.symbols(), SYMBOL))
    return rounded(hits, "relevance").select("path", "relevance")


@query(sql("files source_members", f""", h as (select *, row_number() over (order by relevance desc, path)::int as rank, count(*) over () as total from {_TEXT} where path like 'src1/%' and path like '%.txt'),
g as (select path, string_agg(distinct name, ', ') as groups from source_members group by path)
select rank, path, round(relevance, 6) as relevance, total, groups from h join g using (path) where rank between 6 and 10"""))  # fmt: skip
def r5_search_page(m: Model) -> DataFrame:
    request = search.SearchRequest(WORDS, mode="text", extensions=(".txt",), path_prefix="src1/", page=2)
    found = search.search(m.files(), m.symbols(), request, m.source_members())
    return rounded(found, "relevance").select("rank", "path", "relevance", "total", "groups")


@query(sql("files source_members", """select f.path, m.name, 'Source ' || f.source as description, coalesce((select min_by('first of ' || g.path, g.doc_id) from files g where g.source = f.source and g.lang = 'en' and g.source <> 'src2'), 'Source ' || f.source) as first_notation from files f join source_members m on m.path = f.path where contains(lower(f.path), 'en')"""))
def j10_group_details(m: Model) -> DataFrame:
    """Hits with what their groups are; one group has no notation."""
    files = m.files()
    groups = files.select(F.concat(F.lit("group "), "source").alias("name"), F.concat(F.lit("Source "), "source").alias("description")).distinct()
    notations = files.where("lang = 'en' and source <> 'src2'").select(F.concat(F.lit("group "), "source").alias("name"), F.col("doc_id").alias("ord"), F.concat(F.lit("first of "), "path").alias("text"))
    hits = files.where(F.contains(F.lower("path"), F.lit("en"))).select("path")
    return search.hits_with_group_details(hits, m.source_members(), groups, notations).select("path", F.inline("groups"))


@query(sql("files", "select path from files where regexp_full_match(path, '(?i)src1.*en/.*7[.]txt')"))
def f5_find_by_name(m: Model) -> DataFrame:
    return search.find_by_name(m.files(), "SRC1*en/*7.txt")



@query(sql("symbols", "select path, ord, name from symbols where name = (select min(name) from symbols) order by path, ord limit 1"))
def f3_first_symbol(m: Model) -> DataFrame:
    s = m.symbols()
    return s.join(s.agg(F.min("name").alias("name")), "name").orderBy("path", "ord").limit(1).select("path", "ord", "name")


@query(sql("elements", "select path, ord, tag from elements where contains(tag, 'a') order by path, ord limit 20"))
def f9_search_elements(m: Model) -> DataFrame:
    return search.search_elements(m.elements().withColumn("name", F.col("tag")), "A", most=20).select("path", F.col("ord").cast("bigint").alias("ord"), "tag")


@query(sql("elements", "select path, ord, tag || '-' || row_number() over (partition by path, tag order by ord) as name from elements"))
def w6_element_numbering(m: Model) -> DataFrame:
    from ..sources import parsers

    return parsers.number_elements(m.elements()).select("path", F.col("ord").cast("bigint").alias("ord"), "name")


_MATCH = """, m as (select path, line_no, instr(lower(line), 'licens')::int as "column", line, lag(line) over w as before, lead(line) over w as after from lines window w as (partition by path order by line_no)),
h as (select * from m where "column" > 0)"""


@query(sql("files lines", f"""{_MATCH} select path, line_no, "column", before, after from h"""))
def r7_match_lines(m: Model) -> DataFrame:
    return search.match_lines(m.files(), "Licens").select("path", F.col("line_no").cast("bigint").alias("line_no"), "column", "before", "after")


@query(sql("files lines", f"""{_MATCH} select path, line_no, "column", before, after from h"""))
def r7_match_lines_indexed(m: Model) -> DataFrame:
    """The same lines, from the files alone that an index of trigrams names."""
    files = m.files()
    index = stage(trigrams.build(files), "grams")
    found = search.match_lines(trigrams.narrowed(files, index, trigrams.of_literal("Licens")), "Licens")
    return found.select("path", F.col("line_no").cast("bigint").alias("line_no"), "column", "before", "after")


@query(sql("files lines", "select path, line_no from lines where regexp_matches(line, 'Licensed under (the Apache|CC BY)|(MIT|Public) License[.,]')"))
def r7_regex_lines_indexed(m: Model) -> DataFrame:
    pattern = "Licensed under (the Apache|CC BY)|(MIT|Public) License[.,]"
    files = m.files()
    index = stage(trigrams.build(files), "grams")
    found = search.match_lines(trigrams.narrowed(files, index, trigrams.of_regex(pattern)), pattern, use_regex=True, case_sensitive=True)
    return found.select("path", F.col("line_no").cast("bigint").alias("line_no"))


@query(sql("files", f"select * from {_TEXT}"))
def r1_text_search_indexed(m: Model) -> DataFrame:
    files = m.files()
    index = stage(trigrams.build(files, "path", "summary"), "grams")
    return rounded(search.text_search(trigrams.narrowed(files, index, trigrams.of_search(WORDS)), WORDS), "relevance")


@query(sql("files", "select path from files where regexp_full_match(path, '(?i)src1.*en/.*7[.]txt')"))
def f5_find_by_name_indexed(m: Model) -> DataFrame:
    files, glob = m.files(), "SRC1*en/*7.txt"
    index = stage(trigrams.build(files, "path"), "grams")
    return search.find_by_name(trigrams.narrowed(files, index, trigrams.of_glob(glob)), glob)


_BLOCKS = "blocks as (select path, b as ord, 'block' || b as name, 10 * b + 1 as start_line, 10 * b + 12 as end_line from files, unnest(range(0, (len(str_split(content, chr(10))) - 1) // 10 + 1)) t(b))"


def _blocks(m: Model) -> DataFrame:
    b = F.col("ord")
    last = F.floor((F.size(F.split("content", "\n")) - 1) / 10).cast("int")  # as many as the lines need
    rows = m.files().select("path", F.explode(F.sequence(F.lit(0), last)).alias("ord"))
    return rows.select("path", "ord", F.concat(F.lit("block"), b.cast("string")).alias("name"), F.lit("block").alias("kind"), (10 * b + 1).alias("start_line"), (10 * b + 12).alias("end_line"))


@query(sql("files lines", f"{_MATCH}, {_BLOCKS} select h.path, h.line_no, min_by(name, ord) as symbol from h left join blocks b on h.path = b.path and h.line_no between start_line and end_line group by all"))
def j7_symbol_context(m: Model) -> DataFrame:
    found = search.match_lines(m.files(), "Licens").select("path", "line_no")
    return search.symbol_context(found, _blocks(m)).select("path", F.col("line_no").cast("bigint").alias("line_no"), "symbol")


@query(sql("files lines", f"""{_MATCH} select row_number() over (order by line_no, path)::int as rank, path, line_no, "column" from h where contains(path, 'src1') qualify rank between 6 and 10"""))
def r7_content_search(m: Model) -> DataFrame:
    found = search.content_search(m.files(), _blocks(m), "Licens", scope="SRC1", page=2)
    return found.select("rank", "path", F.col("line_no").cast("bigint").alias("line_no"), "column")


_AT = "instr(lower(summary), 'the') - 1"


@query(sql("files", f""", c as (select path, summary as s, {_AT} as pos, greatest({_AT} + 1 - 80, 0) as a, least({_AT} + 1 + 80, length(summary)) as b from files)
select path, case when pos < 0 then (case when length(s) <= 160 then s else left(s, 160) || '...' end)
  else (case when a > 0 then '...' else '' end) || substr(s, a + 1, b - a) || (case when b < length(s) then '...' else '' end) end as snippet from c"""))  # fmt: skip
def r10_summary_snippet(m: Model) -> DataFrame:
    return m.files().select("path", T.snippet(F.col("summary"), ["the"]).alias("snippet"))


@query(sql("files", "select path, replace(substr(content, greatest(instr(lower(content), 'licens') - 30, 1), instr(lower(content), 'licens') + 100 - greatest(instr(lower(content), 'licens') - 30, 1)), chr(10), ' ') as excerpt from files where instr(lower(content), 'licens') > 0"))
def r9_excerpt(m: Model) -> DataFrame:
    return m.files().select("path", T.excerpt(F.col("content"), "Licens").alias("excerpt")).where("excerpt is not null")


@query(sql("symbols", """, g as (select path, count(*) as n, list(name || ' (' || kind || ')' order by ord) as l from symbols group by path)
select path, array_to_string(l[1:3], ', ') || (case when n > 3 then ', +' || (n - 3) || ' more' else '' end) as symbols from g"""))  # fmt: skip
def r11_compact_symbols(m: Model) -> DataFrame:
    found = search.symbol_search(m.symbols(), "", use_regex=True)
    return found.select("path", search.compact_symbols(F.col("matched"), 3).alias("symbols"))


_Q13 = _keywords_sql("'the red brand 12 plate'")


@query(sql("symbols symbol_files", f""", h as (select path, 5.0::double * len(list_intersect({_keywords_sql("path")}, {_Q13})) as s from symbol_files
union all select path, 3.0::double * len(list_intersect({_keywords_sql("name")}, {_Q13})) from symbols) select path, sum(s) as score from h group by path having sum(s) > 0"""))  # fmt: skip
def r13_keyword_hits(m: Model) -> DataFrame:
    return search.keyword_hits(m.symbol_files(), m.symbols(), "the red brand 12 plate")


@query(sql("symbols", f"select path, sum(10 * {_name_score(SYMBOL, '0.4')}) as score, count(*) as n_symbols from symbols where {_name_score(SYMBOL, '0.4')} is not null group by path"))
def r14_symbol_hits(m: Model) -> DataFrame:
    return rounded(search.symbol_hits(m.symbols(), SYMBOL), "score")


ORACLES["r14_symbol_hits"] = ORACLES["r14_symbol_hits"].replace("sum(10 *", "round(sum(10 *", 1).replace(") as score", "), 6) as score", 1)


# -- ranking ---------------------------------------------------------------

_GOAL = T.query_tokens(GOAL)
_POLICY = "notes as (select path, line_no, line as message from lines where contains(lower(line), 'license'))"


def _relevance_sql() -> str:
    m_path, m_name = _count_sql(_tokens_sql("path"), _GOAL), _count_sql(_tokens_sql("name"), _GOAL)
    kind = " or ".join(f"contains(lower(kind), '{t}')" for t in _GOAL)
    bag = " union all ".join(f"select path, unnest({_tokens_sql(c)}) as t from {t}" for c, t in (("path", "symbol_files"), ("name", "symbols")))
    return sql(
        "symbols symbol_files",
        f""", p as (select path, {m_path} as path_score from symbol_files),
        s as (select path, sum({m_name} + (case when exported then 0.3::double * {m_name} else 0.0 end) + (case when {kind} then 0.5::double else 0.0 end)) as symbol from symbols group by path),
        b as (select path, t, count(*) as n from ({bag}) where t in ({", ".join(map(repr, _GOAL))}) group by path, t), q as (select unnest({_GOAL!r}) as t),
        w as (select path, sum(1.0::double + 0.2::double * (n - 1)) as word from b join q using (t) group by path)
        select path, round(symbol, 6) as symbol, round(path_score, 6) as path_score, round(coalesce(word, 0), 6) as word, round(4 * symbol + 3 * path_score + coalesce(word, 0), 6) as score from p join s using (path) left join w using (path)""",
    )


@query(_relevance_sql())
def r6_relevance(m: Model) -> DataFrame:
    scores = rank.relevance(m.symbol_files(), GOAL, m.symbols())
    return rounded(scores, "symbol", "path_score", "word", "score").select("path", "symbol", "path_score", "word", "score")


_LICENCE = T.query_tokens("Apache License policy text")


@query(sql("files lines", f""", {_POLICY}, s as (select path, sum(0.8::double * {_count_sql(_tokens_sql("message"), _LICENCE)}) as policy from notes group by path)
select path, round(coalesce(policy, 0), 6) as policy from files left join s using (path)"""))  # fmt: skip
def r6d_policy_component(m: Model) -> DataFrame:
    notes = search.match_lines(m.files(), "license").select("path", F.lit("policy").alias("type"), F.col("line").alias("message"))
    return rounded(rank.relevance(m.files(), "Apache License policy text", annotations=notes), "policy").select("path", "policy")


@query(sql("files", f"select row_number() over (order by {_count_sql(_tokens_sql('path'), ['src1', 'doc'])} desc, path)::int as rank, path from files qualify rank <= 10"))
def o5_relevance_top(m: Model) -> DataFrame:
    found = rank.relevance(m.files(), "src1 doc", weights={"word": 0.0})
    return rank.page(found, [F.desc("score"), "path"], 1, 10).select("rank", "path")


# -- text functions --------------------------------------------------------


@query("select a.p_partkey, round(case when greatest(length(a.p_name), length(b.p_name)) = 0 then 1.0 else 1.0::double - levenshtein(a.p_name, b.p_name)::double / greatest(length(a.p_name), length(b.p_name)) end, 6) as similarity from part a join part b on b.p_partkey = a.p_partkey + 1")
def n2_similarity(m: Model) -> DataFrame:
    part = m.table("part").select("p_partkey", "p_name")
    pairs = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")
    return pairs.select("p_partkey", F.round(T.similarity(F.col("p_name"), F.col("b")), 6).alias("similarity"))


@query(f"select p_partkey, round({_overlap_sql(_keywords_sql('p_name'), _keywords_sql(chr(39) + 'red plate part' + chr(39)))}, 6) as overlap, array_to_string({_tokens_sql('p_name', 1)}, ' ') as tokens from part")
def n11_overlap(m: Model) -> DataFrame:
    words = T.keywords(F.lit("red plate part"))
    return m.table("part").select("p_partkey", F.round(T.overlap(T.keywords(F.col("p_name")), words), 6).alias("overlap"), F.array_join(T.identifier_tokens(F.col("p_name"), 1), " ").alias("tokens"))


@query(sql("files", """select path, regexp_replace(path, '/[^/]*$', '') as directory, split_part(path, '/', 3) as name, regexp_extract(path, '(\\.[^./]+)$', 1) as extension,
trim(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '-') as slug, 'file' as target_type from files"""))  # fmt: skip
def n15_paths(m: Model) -> DataFrame:
    p = F.col("path")
    return m.files().select("path", T.directory(p).alias("directory"), T.base_name(p).alias("name"), T.extension(p).alias("extension"), T.slug(p).alias("slug"), T.target_type(p).alias("target_type"))


@query(sql("files", "select path, length(replace(regexp_replace(content, '([a-z]+)tion', '<\\1>', 'g'), 'the', 'THE')) as n, md5(replace(regexp_replace(content, '([a-z]+)tion', '<\\1>', 'g'), 'the', 'THE')) as digest from files"))
def n22_replace(m: Model) -> DataFrame:
    new = lines.replace_many(lines.replace_many(F.col("content"), [("([a-z]+)tion", "<$1>")], regex=True), [("the", "THE")])
    return m.files().select("path", F.length(new).cast("bigint").alias("n"), F.md5(new).alias("digest"))


@query(sql("files", """, l as (select path, str_split(content, chr(10)) as l from files)
select path, md5(array_to_string(l[3:5], chr(10))) as middle, md5(array_to_string(l[greatest(len(l) - 1, 1):len(l)], chr(10))) as tail from l"""))  # fmt: skip
def s13_line_ranges(m: Model) -> DataFrame:
    return m.files().select("path", F.md5(lines.line_range(F.col("content"), 3, 3)).alias("middle"), F.md5(lines.line_range(F.col("content"), -2, 250)).alias("tail"))


@query(sql("files", "select path, len(str_split(content, chr(10))) > 5 as truncated, md5(array_to_string(str_split(content, chr(10))[1:5], chr(10))) as digest from files where doc_id in (1, 2, 3)"))
def s16_read_multiple(m: Model) -> DataFrame:
    paths = [r["path"] for r in m.files().where("doc_id in (1, 2, 3)").select("path").collect()]
    return lines.head(m.files(), paths, 5).select("path", "truncated", F.md5("content").alias("digest"))


@query(sql("files", "select '.' as path, 0::bigint as file_count union all select source, 0 from files group by 1 union all select source || '/' || lang, count(*) from files group by 1"))
def s2_directories(m: Model) -> DataFrame:
    return lines.directories(m.files())


@query(sql("files", "select distinct 'src1/' || lang as path, 'directory' as type from files where source = 'src1'"))
def s17_list(m: Model) -> DataFrame:
    return lines.listing(m.files(), lines.directories(m.files()), "src1", 1)


_N6 = "Of be\nthe thing\nand the"


@query()
def n6_best_block(m: Model) -> DataFrame:
    """No SQL: DuckDB's levenshtein counts bytes; the tests compare it with brute force."""
    return rounded(fuzzy.best_block(m.files(), _N6), "score")


# -- graph -----------------------------------------------------------------

_START = "select min(src) from edges"


def _start(m: Model) -> str:
    return m.edges().agg(F.min("src")).first()[0]


@query(sql("edges nodes", f"select e.dst as path from edges e join nodes n on e.dst = n.path where e.src = ({_START})"))
def j2_imports(m: Model) -> DataFrame:
    return graph.imports(m.edges(), m.nodes(), _start(m))


@query(sql("edges nodes", "select e.src as path from edges e join nodes n on e.src = n.path where e.dst = (select min(dst) from edges)"))
def j2_importers(m: Model) -> DataFrame:
    return graph.importers(m.edges(), m.nodes(), m.edges().agg(F.min("dst")).first()[0])


@query(sql("edges nodes", f"(select dst as path, 'imports' as direction from edges where src = ({_START}) order by 1 limit 20) union all (select src, 'importers' from edges where dst = ({_START}) order by 1 limit 20)"))
def j3_related(m: Model) -> DataFrame:
    return graph.related(m.edges(), m.nodes(), _start(m))


@query(sql("edges", f", s as ({_START.replace('min(src)', 'min(src) as src')}) select b.src, count(distinct b.dst) as shared from edges a join s on a.src = s.src join edges b on a.dst = b.dst where b.src <> s.src group by b.src"))
def j3b_shared_imports(m: Model) -> DataFrame:
    return graph.shared_imports(m.edges(), _start(m))


_BFS = """ , r(path, depth) as ({start} union select e.{to}, r.depth + 1 from r join edges e on e.{of} = r.path where r.depth < {most}) select path, min(depth)::int as depth from r group by path"""


@query(sql("edges", _BFS.format(start="select min(src), 0 from edges", of="src", to="dst", most=3), recursive=True))
def g1_traverse_imports(m: Model) -> DataFrame:
    edges = graph.written(m.edges())  # each level reads them
    return graph.traverse(edges, edges.agg(F.min("src")).first()[0], "imports", 3)


@query(sql("edges", _BFS.format(start="select min(src), 0 from edges", of="dst", to="src", most=3), recursive=True))
def g1_traverse_importers(m: Model) -> DataFrame:
    edges = graph.written(m.edges())  # each level reads them
    return graph.traverse(edges, edges.agg(F.min("src")).first()[0], "importers", 3)


@query(sql("edges", _BFS.format(start="select min(src), 0 from edges", of="src", to="dst", most=3) + " having min(depth) > 0", recursive=True))
def g2_traverse_without_start(m: Model) -> DataFrame:
    edges = graph.written(m.edges())  # each level reads them
    return graph.traverse(edges, edges.agg(F.min("src")).first()[0], "imports", 3, include_start=False)


@query(sql("edges", _BFS.format(start="select min(src), 0 from edges", of="dst", to="src", most=2) + " having min(depth) > 0", recursive=True))
def g3_file_impact(m: Model) -> DataFrame:
    edges = graph.written(m.edges())
    return graph.impact(edges, _calls(m), edges.agg(F.min("src")).first()[0], 2)


def _raw_calls(m: Model) -> DataFrame:
    """Each node calls what its neighbours' first words name."""
    n = m.nodes()
    return m.edges().join(n.select(F.col("path").alias("dst"), F.col("name").alias("callee")), "dst").join(n.select(F.col("path").alias("src"), F.col("name").alias("sym")), "src").select(F.col("src").alias("path"), "sym", "callee")


def _calls(m: Model) -> DataFrame:
    return graph.resolve_calls(_raw_calls(m), m.edges(), m.nodes())


_CALLS = """, raw as (select e.src as path, a.name as sym, b.name as callee from edges e join nodes a on e.src = a.path join nodes b on e.dst = b.path),
calls as (select distinct r.path as src_path, r.sym as src_sym, e.dst as dst_path, r.callee as dst_sym from raw r join edges e on r.path = e.src join nodes n on n.path = e.dst and n.name = r.callee where r.path <> e.dst or r.sym <> r.callee)"""


@query(sql("edges nodes", f"{_CALLS} select * from calls"))
def j4_resolve_calls(m: Model) -> DataFrame:
    return _calls(m)


_PICK = "(select min(dst_path || '$' || dst_sym) from calls)"


@query(sql("edges nodes", f"{_CALLS}, ce as (select src_path || '$' || src_sym as src, dst_path || '$' || dst_sym as dst from calls), r(path, depth) as (select {_PICK}, 0 union select e.src, r.depth + 1 from r join ce e on e.dst = r.path where r.depth < 2) select path, min(depth)::int as depth from r group by path having min(depth) > 0", recursive=True))
def g4_symbol_impact(m: Model) -> DataFrame:
    calls = graph.written(_calls(m))
    target = calls.agg(F.min(F.concat_ws("$", "dst_path", "dst_sym"))).first()[0]
    return graph.impact(m.edges(), calls, target, 2)


@query(sql("edges nodes", f"{_CALLS} select dst_path || '$' || dst_sym as name, 'calls' as direction from calls where src_path || '$' || src_sym = {_PICK} union all select src_path || '$' || src_sym, 'called by' from calls where dst_path || '$' || dst_sym = {_PICK}"))
def g5_dependencies(m: Model) -> DataFrame:
    calls = graph.written(_calls(m))
    target = calls.agg(F.min(F.concat_ws("$", "dst_path", "dst_sym"))).first()[0]
    return graph.dependencies(m.edges(), calls, m.nodes(), target)


@query(sql("edges nodes", f"{_CALLS} select count(*) as n from calls where src_path <> ({_START}) and dst_path <> ({_START})"))
def g7_clear_calls(m: Model) -> DataFrame:
    return graph.without_calls_of(_calls(m), _start(m)).agg(F.count("*").alias("n"))


@query(sql("edges", f"select count(*) as n from (select src, dst from edges where src <> ({_START}) and dst <> ({_START}) union select 'x.ts', 'y.ts')"))
def g6_edit_edges(m: Model) -> DataFrame:
    more = m.spark.createDataFrame([("x.ts", "y.ts"), ("x.ts", "y.ts")], "src string, dst string")
    return graph.with_edges(graph.without_file(m.edges(), _start(m)), more).agg(F.count("*").alias("n"))


@query(sql("edges nodes", f"{_CALLS}, every as (select path, name from nodes union all select path, 'unused ' || name from nodes where p_partkey % 3 = 0) select path, name from every n where not exists (select 1 from calls where dst_path = n.path and dst_sym = n.name)"))
def f23_dead_symbols(m: Model) -> DataFrame:
    """Of the symbols, and of one more that no one calls in each third file."""
    more = m.nodes().where("p_partkey % 3 = 0").select("path", F.concat(F.lit("unused "), "name").alias("name"))
    return graph.dead_symbols(m.nodes().select("path", "name").unionByName(more), _calls(m)).select("path", "name")


@query(sql("edges", "select dst, count(*) as degree from edges group by dst order by degree desc, dst limit 20"))
def a18_hot_spots(m: Model) -> DataFrame:
    return graph.hot_spots(m.edges(), 20)


@query(sql("files symbols edges nodes", f"""{_CALLS} select (select count(*) from files) as files, (select count(distinct source || '/' || lang) + count(distinct source) + 1 from files) as directories,
(select count(*) from symbols) as symbols, (select count(*) from edges) as dependencies, (select count(*) from calls) as call_edges,
(select count(distinct src_path || '$' || src_sym) + count(distinct dst_path || '$' || dst_sym) from calls) as call_symbols"""))  # fmt: skip
def a1_stats(m: Model) -> DataFrame:
    return graph.stats(m.files(), lines.directories(m.files()), m.symbols(), m.edges(), graph.written(_calls(m)))


@query(sql("edges", "select src, string_agg(dst, ',' order by dst) as imports from edges group by src"))
def k2_export_adjacency(m: Model) -> DataFrame:
    return graph.adjacency(m.edges())


_IMPORTS = """imports as (select path, './doc_' || (doc_id + 20) as spec from files union all select path, '../de/doc_' || (doc_id + 20) || '.js' from files union all select path, 'react' from files union all select path, '@/' || lang from files),
ts as (select replace(path, '.txt', '.ts') as path from files), """


@query(sql("files", f""", {_IMPORTS} c as (select replace(path, '.txt', '.ts') as src, case when spec like './%' then regexp_replace(path, '/[^/]*$', '') || substr(spec, 2) || '.ts'
  when spec like '../%' then split_part(path, '/', 1) || '/' || regexp_extract(spec, '^../(.*)[.]js$', 1) || '.ts' end as dst from imports) select distinct src, dst from c join ts on ts.path = c.dst"""))  # fmt: skip
def j1_resolve_imports(m: Model) -> DataFrame:
    f = m.files().withColumn("path", F.replace("path", F.lit(".txt"), F.lit(".ts")))
    n = lambda k: (F.col("doc_id") + k).cast("string")
    specs = F.array(F.concat(F.lit("./doc_"), n(20)), F.concat(F.lit("../de/doc_"), n(20), F.lit(".js")), F.lit("react"), F.concat(F.lit("@/"), F.col("lang")))
    return graph.resolve_imports(f.select("path", F.explode(specs).alias("spec")), f)


# -- audit -----------------------------------------------------------------


@query(sql("files", "select path as file from files where regexp_matches(split_part(path, '/', 3), 'doc_.*7') and not contains(path, 'src1') and not contains(path, '/en/')"))
def u2_file_location(m: Model) -> DataFrame:
    rule = audit.Rule("loc", "location", "file-location", config={"pattern": "doc_*7", "allowedPaths": ["src1", "/en/"]})
    return audit.check(rule, audit.Catalog(m.files())).select("file")


_HREF = "href as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as spec from pages)"


@query(f"with {_HREF} select page_id::varchar as file, 'imports ' || spec as message from href where spec in ('/the', '/and', '/The') and not contains(page_id::varchar, '9')")
def u3_forbidden_import(m: Model) -> DataFrame:
    hrefs = m.table("pages").select(F.col("page_id").cast("string").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("spec"))
    rule = audit.Rule("imp", "imports", "forbidden-import", config={"forbiddenImports": ["/the", "/and", "/The"], "exemptFiles": ["9"]})
    return audit.check(rule, audit.Catalog(m.files(), imports=hrefs)).select("file", "message")


@query(sql("files lines", "select path as file, min(line_no)::int as line from lines where regexp_matches(line, '[Ll]icen[sc]e') group by path"))
def u4_text_pattern(m: Model) -> DataFrame:
    rule = audit.Rule("txt", "text", "text-pattern", config={"pattern": "[Ll]icen[sc]e", "regex": True})
    return audit.check(rule, audit.Catalog(m.files())).select("file", "line")


def _notes(m: Model) -> DataFrame:
    kind = F.when(F.col("line_no") % 2 == 0, "policy").otherwise("note")
    return search.match_lines(m.files(), "license").select("path", kind.alias("type"), F.col("line").alias("message"))


_ANN = ", ann as (select path, case when line_no % 2 = 0 then 'policy' else 'note' end as type, line as message from lines where contains(lower(line), 'license'))"


@query(sql("files lines", f"{_ANN} select path as file from files f where regexp_matches(path, 'src[^/]*/en/.*txt') and not exists (select 1 from ann a where a.path = f.path and type in ('policy', 'warning'))"))
def u5_required_annotation(m: Model) -> DataFrame:
    rule = audit.Rule("ann", "annotations", "required-annotation", config={"annotations": ["policy", "warning"], "filePattern": "src*/en/**txt"})
    return audit.check(rule, audit.Catalog(m.files(), annotations=_notes(m))).select("file")


@query(sql("files lines", f"""{_ANN}, v as (select 'txt' as rule_id, path as file, min(line_no)::int as line, 'error' as severity from lines where contains(line, 'License') group by path
union all select 'loc', path, null, 'warning' from files where regexp_matches(split_part(path, '/', 3), 'doc_.*7') and not contains(path, 'src1'))
select * from v where not (rule_id = 'txt' and exists (select 1 from ann a where a.path = v.file and type = 'note' and contains(message, 'Apache')))"""))  # fmt: skip
def u7_audit_with_exemption(m: Model) -> DataFrame:
    return _audited(m).select("rule_id", "file", "line", "severity")


def _audited(m: Model) -> DataFrame:
    rules = [
        audit.Rule("txt", "text", "text-pattern", "error", config={"pattern": "License", "exemptToken": "Apache"}),
        audit.Rule("loc", "location", "file-location", config={"pattern": "doc_*7", "allowedPaths": ["src1"]}),
        audit.Rule("off", "off", "text-pattern", enabled=False, config={"pattern": "e"}),
    ]
    return audit.audit(audit.Catalog(m.files(), annotations=_notes(m)), rules)


@query("select count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, count(*) filter (severity = 'info') as infos, count(*) = 0 as clean from (" + ORACLES["u7_audit_with_exemption"] + ")")
def a5_audit_summary(m: Model) -> DataFrame:
    return audit.summary(_audited(m))


# -- stores ----------------------------------------------------------------


@query(sql("groups group_members", "select name from groups_ g where exists (select 1 from group_members m where m.name = g.name and path = (select min(n_name) from nation))"))
def f13_groups_of_member(m: Model) -> DataFrame:
    return stores.groups_of_member(m.groups(), m.group_members(), "file", m.table("nation").agg(F.min("n_name")).first()[0]).select("name")


@query(sql("groups", "select name from groups_ where contains(lower(name), 'as') or contains(lower(description), 'as')"))
def f14_search_groups(m: Model) -> DataFrame:
    return stores.search_groups(m.groups(), "AS").select("name")


@query("select 5::bigint as groups, (select count(*) from nation) as members, (select count(*) from region) as notations")
def a7_group_stats(m: Model) -> DataFrame:
    return stores.group_stats(m.groups(), m.group_members(), m.groups())


@query(sql("files label_store assignments", """, s as (select target, any_value(target_type) as target_type, string_agg(name, ',' order by name) as labels from assignments join label_store on id = label_id where regexp_full_match(target, 'src[^/]*/en/.*') group by target)
select row_number() over (order by target)::int as rank, target, target_type, labels from s qualify rank between 21 and 40"""))  # fmt: skip
def f15_label_search_page2(m: Model) -> DataFrame:
    found = stores.search_labels(m.assignments(), m.label_store(), glob="src*/en/**")
    return rank.page(found, ["target"], 2, 20).select("rank", "target", "target_type", "labels")


@query(sql("files label_store assignments", "select id, name, (select count(*) from assignments where label_id = id) as n from label_store"))
def j12_label_counts(m: Model) -> DataFrame:
    return stores.label_counts(m.label_store(), m.assignments())


@query(sql("files label_store assignments", "select path, coalesce(string_agg(name, ', ' order by name), '') as labels from files left join assignments on target = path left join label_store on id = label_id where regexp_matches(path, '(?i)src1/') group by path"))
def j11_hits_with_labels(m: Model) -> DataFrame:
    named = m.assignments().join(m.label_store(), F.col("label_id") == F.col("id")).select("target", F.col("name").alias("label"))
    return search.hits_with_labels(search.text_search(m.files(), "src1/", use_regex=True).select("path"), named)


@query(sql("files source_members", "select path, string_agg(name, ', ' order by name) as groups from files join source_members using (path) where regexp_matches(path, '7') group by path"))
def j10_hits_with_groups(m: Model) -> DataFrame:
    return search.hits_with_groups(search.text_search(m.files(), "7", use_regex=True).select("path"), m.source_members())


@query(sql("files", "select path, case when doc_id % 3 = 0 then 'given ' || doc_id else summary end as summary from files"))
def j13_summary_overlay(m: Model) -> DataFrame:
    given = m.files().where("doc_id % 3 < 2").select("path", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("given "), F.col("doc_id").cast("string"))).otherwise("").alias("summary"))
    return stores.overlay_summaries(m.files(), given).select("path", "summary")


@query(sql("files assignments", "select label_id, count(*) as n from (select distinct case when label_id = 'lbl_toxic' then 'lbl_quality' else label_id end as label_id, target from assignments) group by label_id"))
def x2_migrate_labels(m: Model) -> DataFrame:
    return stores.migrate(m.assignments(), "lbl_toxic", "lbl_quality").groupBy("label_id").agg(F.count("*").alias("n"))


# -- sessions and history --------------------------------------------------

_ORDER = ["ts", "id"]


@query(sql("history", "select path, id, row_number() over (partition by path order by ts, id)::int as version from history"))
def w2_versions(m: Model) -> DataFrame:
    return sessions.versions(m.history(), "path", _ORDER).select("path", "id", "version")


@query(sql("history", "select path, id from history qualify row_number() over (partition by path order by ts desc, id desc) = 1"))
def w3_latest(m: Model) -> DataFrame:
    return sessions.latest(m.history(), "path", _ORDER).select("path", "id")


@query(sql("history", "select path, id from history qualify row_number() over (partition by path order by ts desc, id desc) <= 5"))
def w4_retention(m: Model) -> DataFrame:
    return sessions.retain(m.history(), ["path"], [F.desc("ts"), F.desc("id")], 5)[0].select("path", "id")


@query(sql("history", "select count(*) as total, count(distinct path) as files, strftime(min(ts), '%Y-%m-%d') as oldest, strftime(max(ts), '%Y-%m-%d') as newest from history"))
def a16_history_stats(m: Model) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return sessions.history_stats(m.history()).select("total", "files", day("oldest"), day("newest"))


@query(sql("ev", "select event_type, event_id, row_number() over (partition by event_type order by ts, event_id)::int as n from ev qualify (n - 1) % 10 = 0"))
def w9_hint_throttle(m: Model) -> DataFrame:
    return sessions.throttled(m.events(), "event_type", ["ts", "event_id"]).select("event_type", "event_id", "n")


@query(sql("history", """, l as (select path as session_id, ts, o_orderpriority as target, row_number() over (partition by path, o_orderpriority order by ts, id) = 1 as first, id % 7 = 0 as gone from history)
select session_id, coalesce(string_agg(distinct target, ',' order by target) filter (first), '') as created, coalesce(string_agg(distinct target, ',' order by target) filter (gone), '') as deleted, epoch(max(ts))::bigint - epoch(min(ts))::bigint as seconds from l group by session_id"""))  # fmt: skip
def a10_session_summary(m: Model) -> DataFrame:
    first = F.col("version") == 1
    log = sessions.versions(m.history().withColumn("key", F.concat("path", "o_orderpriority")), "key", _ORDER)
    log = log.select(F.col("path").alias("session_id"), "ts", F.col("o_orderpriority").alias("target"), F.lit(None).cast("string").alias("to"), F.explode(F.array_compact(F.array(F.when(first, "file:create").otherwise("file:write"), F.when(F.col("id") % 7 == 0, "file:delete")))).alias("action"))
    join = lambda c: F.array_join(c, ",").alias(c)
    return sessions.session_summary(log).select("session_id", join("created"), join("deleted"), "seconds")


@query(sql("history", "select row_number() over (order by max(ts) desc, path)::int as rank, path, count(*) as n from history group by path qualify rank between 11 and 20"))
def o9_session_page(m: Model) -> DataFrame:
    by = m.history().groupBy("path").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return rank.page(by, [F.desc("last"), "path"], 2, 10).select("rank", "path", "n")


# -- experience ------------------------------------------------------------

_NOW = "(select max(ts) from events)"


def _now(m: Model):
    return F.lit(m.events().agg(F.max("ts")).first()[0])


@query(sql("ev", f"select path, count(*) as total_ops, count(*) filter (outcome = 'success') as successes, round(avg((outcome = 'success')::int), 6) as success_rate, round(least(0.1::double * count(*) filter (ts > {_NOW} - interval 7 days), 1.0), 6) as heat, date_diff('day', max(ts)::date, {_NOW}::date)::int as days_since from ev group by path"))
def a11_file_metrics(m: Model) -> DataFrame:
    return rounded(experience.file_metrics(m.events(), _now(m)), "success_rate", "heat").drop("last_ts")


@query(sql("ev", "select 'core/' || event_type as symbol_ref, count(*) as edits, round(avg((outcome = 'success')::int), 6) as success_rate from ev group by 1"))
def a12_symbol_metrics(m: Model) -> DataFrame:
    events = m.events().withColumn("symbol_ref", F.concat(F.lit("core/"), F.col("event_type")))
    return rounded(experience.symbol_metrics(events), "success_rate").drop("keywords")


_QUESTION = "'how is the thing of and in thion'"
_RATIO = _overlap_sql(_keywords_sql(_QUESTION, T.STOP_WORDS_SHORT), _keywords_sql("phrase", T.STOP_WORDS_SHORT))


@query(sql("turns", f"select path, round(sum({_RATIO}), 6) as total, count(*) as n from turns where {_RATIO} >= 0.0001 group by path"))
def j18_phrase_matches(m: Model) -> DataFrame:
    found = experience.phrase_matches(m.turns(), _QUESTION.strip("'"), 0.0001)
    return found.groupBy("path").agg(F.round(F.sum("ratio"), 6).alias("total"), F.count("*").alias("n"))


def _words(m: Model) -> DataFrame:
    """Names of parts as phrases of failed queries."""
    return m.table("part").select(F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")).alias("path"), F.col("p_name").alias("phrase"), F.when(F.col("p_size") % 2 == 0, "read_but_abandoned").otherwise("shown").alias("reason"))


_WORDS = "w as (select 'f' || (p_partkey % 50) as path, p_name as phrase, case when p_size % 2 = 0 then 'read_but_abandoned' else 'shown' end as reason from part)"
_GREEN = _overlap_sql(_keywords_sql("'red widget'", T.STOP_WORDS_SHORT), _keywords_sql("phrase", T.STOP_WORDS_SHORT))
_PENALTY = f"select path, greatest(sum(case when reason = 'read_but_abandoned' then -3 else -1 end), -10)::int as penalty from w where {_GREEN} >= 0.5 group by path"


@query(f"with {_WORDS} {_PENALTY}")
def a15_anti_penalty(m: Model) -> DataFrame:
    return experience.anti_penalty(_words(m), "red widget")


@query(f"with {_WORDS} select path, count(*) as n, round(least(count(*)::double / 3, 1.0), 6) as score from w where {_GREEN} >= 0.4 group by path")
def a14_usage_matches(m: Model) -> DataFrame:
    return rounded(experience.usage_matches(_words(m), "red widget"), "score")


_STATIC = f"""st as (select path, sum(s) as static from (select path, 5.0::double * {_overlap_sql(_keywords_sql("'red brand plate'", T.STOP_WORDS_SHORT), _keywords_sql("path", T.STOP_WORDS_SHORT))} as s from symbol_files
union all select path, 3.0::double * {_overlap_sql(_keywords_sql("'red brand plate'", T.STOP_WORDS_SHORT), _keywords_sql("name", T.STOP_WORDS_SHORT))} from symbols) group by path)"""


def _assist_sql() -> str:
    return sql(
        "symbols symbol_files ev",
        f""", {_STATIC}, {_WORDS}, pen as ({_PENALTY}), f as (select path, row_number() over (order by path) as k from symbol_files),
        me as (select path, count(*) as total_ops, avg((outcome = 'success')::int) as success_rate, least(0.1::double * count(*) filter (ts > {_NOW} - interval 7 days), 1.0) as heat, date_diff('day', max(ts)::date, {_NOW}::date) as days_since from ev group by path),
        raw as (select st.path, (static + (case when contains(st.path, 'brand') then 0.25::double else 0.0 end) + coalesce(pen.penalty, 0)) * (case when coalesce(total_ops, 0) > 0 then
          (case when success_rate < 0.5 then 0.5 when success_rate > 0.75 then 1.5 else 1.0 end) + (case when days_since < 7 then 0.3 else 0.0 end) + heat * 0.5 else 1.0::double end) as raw
          from st join f using (path) left join pen on pen.path = 'f' || k left join me on me.path = 'u' || k)
        select path, round(raw, 6) as raw, round(least(raw / (select greatest(max(raw), 1.0) from raw), 1.0), 6) as confidence, case when raw < 3 then 'Low confidence match' else '' end as warning from raw""",
    )


@query(_assist_sql())
def r15_assist_score(m: Model) -> DataFrame:
    from pyspark.sql import Window

    number = m.symbol_files().select("path", F.row_number().over(Window.orderBy("path")).cast("string").alias("k"))  # a few dozen names
    of = lambda df, letter: df.withColumn("k", F.substring("path", 2, 20)).where(F.col("path").startswith(letter)).drop("path").join(number, "k").drop("k")
    static = rank.static_scores(m.symbol_files(), m.symbols(), "red brand plate")
    metrics, penalties = of(experience.file_metrics(m.events(), _now(m)), "u"), of(experience.anti_penalty(_words(m), "red widget"), "f")
    return rounded(rank.assist(static, "red brand plate", metrics, penalties=penalties, bias=[("red", {"brand": 0.25})]), "raw", "confidence")



@query(sql("ev", "select path, event_type, row_number() over (partition by path, event_type order by ts, event_id) = 1 as created, event_id from ev"))
def t4_create_or_update(m: Model) -> DataFrame:
    from ..streaming import streams

    return streams.first_seen(m.events(), ["path", "event_type"], ["ts", "event_id"]).select("path", "event_type", "created", "event_id")


# -- incremental scan ------------------------------------------------------


@query(sql("files", """, cached as (select path, doc_id % 5 as mtime from files where doc_id % 7 <> 0), listing as (select path, case when doc_id % 11 = 0 then -1 else doc_id % 5 end as mtime from files where doc_id % 13 <> 0)
select path, 'parse' as what from (select * from listing except select * from cached) union all select path, 'keep' from (select * from listing intersect select * from cached) union all select path, 'evict' from cached c where not exists (select 1 from listing l where l.path = c.path)"""))  # fmt: skip
def s6_incremental_diff(m: Model) -> DataFrame:
    from ..sources import ingest

    f, mtime = m.files(), F.col("doc_id") % 5
    cached = f.where("doc_id % 7 <> 0").select("path", mtime.alias("mtime"))
    listing = f.where("doc_id % 13 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, -1).otherwise(mtime).alias("mtime"))
    return ingest.incremental(listing, cached)



@query(sql("files", "select row_number() over (order by lower(path), path)::int as rank, path from files qualify rank between 21 and 40"))
def o7_list_page(m: Model) -> DataFrame:
    return rank.page(m.files().select("path"), [F.lower("path"), "path"], 2, 20).select("rank", "path")


@query(sql("files", "select path from files where doc_id % 3 = 0 or doc_id % 5 = 1"))
def s9_stale_files(m: Model) -> DataFrame:
    from ..sources import ingest

    f = m.files()
    cached = f.select("path", F.lit(10).alias("mtime"))
    listing = f.where("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 5 == 1, 11).otherwise(10).alias("mtime"))
    return ingest.stale(cached, listing).select("path")


@query(sql("symbols", "select s.path, s.ord, s.name from symbols s join (select path, min(ord) as o, min_by(name, ord) as name, min_by(start_line, ord) as a, min_by(end_line, ord) as b from symbols where path = (select min(path) from symbols) and name = (select min(name) from symbols where path = (select min(path) from symbols)) group by path) p on s.path = p.path where s.start_line > p.a and s.end_line <= p.b + 20 and s.name <> p.name"))
def f11_nested_symbols(m: Model) -> DataFrame:
    s = m.symbols()
    path = s.agg(F.min("path")).first()[0]
    name = s.where(F.col("path") == path).agg(F.min("name")).first()[0]
    first = s.where((F.col("path") == path) & (F.col("name") == name)).agg(F.min("ord")).first()[0]
    wide = s.withColumn("end_line", F.when(F.col("ord") == first, F.col("end_line") + 20).otherwise(F.col("end_line")))
    return lines.nested_symbols(wide, path, name).select("path", "ord", "name")


@query(sql("files lines", "select path, line_no as line, line as value from lines where contains(lower(line), 'apache') and contains(lower(line), 'license') order by path, line_no limit 50"))
def f10_search_annotations(m: Model) -> DataFrame:
    notes = search.match_lines(m.files(), "license").select("path", F.col("line_no").cast("bigint").alias("line"), F.lit("policy").alias("category"), F.col("line").alias("value"), F.col("line").alias("raw"))
    return stores.search_annotations(notes, "APACHE", "policy").select("path", "line", "value")


@query(sql("files", "select path, md5(array_to_string(list_filter(list_transform(str_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) as digest from files"))
def n4_normalised(m: Model) -> DataFrame:
    return m.files().select("path", F.md5(T.aggressive(F.col("content"))).alias("digest"))



@query(sql("files", "select path, len(str_split(content, chr(10))) as own, len(list_filter(list_zip(str_split(content, chr(10)), str_split(replace(content, 'the', 'the '), chr(10))), lambda p: p[1] = p[2])) as common from files"))
def a22_common_lines(m: Model) -> DataFrame:
    c = F.col("content")
    return m.files().select("path", F.size(F.split(c, "\n")).cast("bigint").alias("own"), T.common_lines(c, F.replace(c, F.lit("the"), F.lit("the "))).cast("bigint").alias("common"))


@query(sql("edges nodes", "select path as id, path as label from nodes"))
def k3_snapshot_nodes(m: Model) -> DataFrame:
    from ..sources import catalog

    return catalog.nodes_and_edges(m.nodes(), m.edges())[0]


@query(sql("files label_store assignments", "select id, name from label_store where id in (select label_id from assignments where target = (select min(target) from assignments))"))
def f16_labels_of_target(m: Model) -> DataFrame:
    target = m.assignments().agg(F.min("target")).first()[0]
    return stores.labels_of(m.assignments(), m.label_store(), target).select("id", "name")


@query(sql("edges", "select dst, degree, round(least(degree::double / (select greatest(max(n), 1) from (select count(*) as n from edges group by dst)), 1.0), 6) as confidence from (select dst, count(*) as degree from edges group by dst)"))
def w7_confidence(m: Model) -> DataFrame:
    degrees = m.edges().groupBy("dst").agg(F.count("*").alias("degree"))
    return rounded(rank.confidence(degrees, "degree"), "confidence")


@query(sql("files", "select path, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: length(x) > 2 and x not in (" + ", ".join(map(repr, T.STOP_WORDS_LONG)) + ")))), ' ') as words from files"))
def n9_keywords(m: Model) -> DataFrame:
    return m.files().select("path", F.array_join(F.array_sort(T.keywords(F.col("content"))), " ").alias("words"))


@query(sql("files", "select path, length(content) + 3 as n, md5(content || (case when content = '' or content like '%' || chr(10) then '' else chr(10) end) || 'end') as digest from files".replace("length(content) + 3", "length(content || (case when content = '' or content like '%' || chr(10) then '' else chr(10) end)) + 3")))
def io_append(m: Model) -> DataFrame:
    new = lines.append(F.col("content"), "end")
    return m.files().select("path", F.length(new).cast("bigint").alias("n"), F.md5(new).alias("digest"))


@query(sql("files", "select path, md5(array_to_string(list_concat(list_concat(l[1:1], ['NEW', 'LINES']), l[4:len(l)]), chr(10))) as digest from (select path, str_split(content, chr(10)) as l from files)"))
def io_replace_lines(m: Model) -> DataFrame:
    return m.files().select("path", F.md5(lines.replace_lines(F.col("content"), F.lit(2), F.lit(3), F.lit("NEW\nLINES"))).alias("digest"))


from . import source_queries, tool_queries  # noqa: E402, F401  they register more
