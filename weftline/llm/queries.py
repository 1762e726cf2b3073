"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_middle, filter_audit, langid, license_scan, ngram_join, packing, pii, quality, secret_scan, token_files, topk, url_filter
from .common import table

QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.score_quality(docs).select("row.doc_id", *columns)


def _rules_sql() -> str:
    tests = []
    for r in quality.RULES:
        value = quality.METRICS[r.metric]
        bounds = [f"{value} < {r.low}::double"] * (r.low > float("-inf")) + [f"{value} > {r.high}::double"] * (r.high < float("inf"))
        tests.append(f"(n_words >= {max(r.from_words, 1)} and ({' or '.join(bounds)}))")
    return " or ".join(tests)


_stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
#: Named for reuse in the SQL of the pipeline: documents with features and verdict, all columns kept.
QUALITY_CTE = f"""
q_words as (
  select row_number() over () as rid, d.*, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
         list_filter(str_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents d),
q_windows as (select rid, i, array_to_string(words[i:i+4], ' ') as s from q_words, unnest(range(1, len(words) - 3)) t(i)),
q_twice as (select rid, i from q_windows qualify count(*) over (partition by rid, s) >= 2),
q_steps as (select rid, least(5, i - lag(i, 1, -5) over (partition by rid order by i)) as n from q_twice),
q_covered as (select rid, sum(n)::bigint as n from q_steps group by rid),
q_features as (
  select w.*, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::bigint as n_symbols, len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
         len(list_filter(words, lambda x: x in ({_stop})))::bigint as n_stop_words
  from q_words w left join q_covered c using (rid)),
q_base as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from q_features),
q_judged as (select *, not base_failed and not ({_rules_sql()}) as kept from q_base)
"""
ORACLES["op1_quality_rules"] = f"with {QUALITY_CTE} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from q_judged"


BPE_RANKS, BPE_JSON = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.count_tokens(docs, bpe.vocabulary_path(BPE_RANKS))


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bpe.vocabulary_path(BPE_RANKS)
    encoded = bpe.encode_texts(table(spark, sf_dir, "documents"), path)
    decoded = bpe.decode_ids(encoded, path)
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens")
    return decoded.select("row.doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0, 5)


ORACLES["op7_exact_top_k"] = """
with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.rid, q.vec_id as query_id, c.vec_id, (case when len(q.v) = 0 then 0 else list_dot_product(q.v, c.v) end)::bigint as score
      from v q join v c on q.rid <> c.rid and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by rid order by score desc, vec_id)::int as rank from s) where rank <= 5
"""

URL_RULES = (
    url_filter.host_path_rule("block", "com", "/en/"),
    url_filter.host_path_rule("allow", "example.com", "/en/7"),
    url_filter.host_path_rule("allow", "net", "/de/"),
    url_filter.host_path_rule("block", "example.net", "/de/8"),
    url_filter.host_path_rule("block", "org", "/es/"),
    url_filter.pattern_rule("pills", "block", r"^[^/]*\bcheap-pills\b", "cheap", "pills"),
    url_filter.pattern_rule("bets", "block", r"^[^/]*\bfree-bets\b", "free", "bets"),
    url_filter.pattern_rule("link farm", "block", r"^[^/]*\bspam-farm\b", "spam", "farm"),
    url_filter.pattern_rule("ad tracker", "block", r"^[^/]*\bads-track\b", "ads", "track"),
)


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, URL_RULES)
    named = F.when(F.col("tier") == 1, F.col("rule"))
    return judged.select("row.page_id", "host", "path", named.alias("rule"), "verdict")


_fits = "(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')"
ORACLES["op8_url_filters"] = """
with u as (select page_id, coalesce(url, '') as url from pages),
h as (select page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from u),
r as (select *, case when {e8} then 'example.net/de/8' when {e7} then 'example.com/en/7' when {c} then 'com/en/' when {n} then 'net/de/' when {o} then 'org/es/' end as rule from h)
select page_id, host, path, rule,
       case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' when rule in ('example.com/en/7', 'net/de/') then 'allow'
            when regexp_matches(host, '\\b(cheap-pills|free-bets|spam-farm|ads-track)\\b') then 'block' else 'allow' end as verdict
from r
""".format(**{k: _fits.format(h=h, p=p) for k, h, p in (("e8", "example.net", "/de/8"), ("e7", "example.com", "/en/7"), ("c", "com", "/en/"), ("n", "net", "/de/"), ("o", "org", "/es/"))}).replace("\\\\", "\\")


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = packing.pack_digests(docs, bpe.vocabulary_path(BPE_JSON))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


ORACLES["op9_ngram_join"] = """
with recursive d as (select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
g as (select distinct rid, array_to_string(w[i:i + 4], ' ') as s from d, unnest(range(1, greatest(len(w) - 3, 2))) t(i) where len(w) > 0),
n as (select rid, count(*) as n from g group by rid),
p as (select a.rid as x, b.rid as y, count(*) as c from g a join g b using (s) where a.rid <> b.rid group by all),
e as (select x, y from p join n a on a.rid = x join n b on b.rid = y where c >= 0.8 * (a.n + b.n - c)),
r as (select rid as x, rid as y from d union select r.x, e.y from r join e on e.x = r.y),
c as (select r.x as rid, min(d.doc_id) as class_id from r join d on d.rid = r.y group by r.x),
l as (select x as rid, count(*) as n from e group by x)
select doc_id, class_id, coalesce(l.n, 0)::bigint as n_links from d join c using (rid) left join l using (rid)
"""


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    found = langid.identify(docs, langid.train(docs, ~out), keep=("doc_id",))
    return found.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan_secrets(docs, repository=F.concat_ws("/", "source", "lang"))
    n_live = F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secret_scan.render(F.col("spans")).alias("spans"), n_live)


def _secrets_sql() -> str:
    """Spans by the lengths of what lies between matches; the kinds are numbered as KINDS."""
    letters = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join((*map(letters, ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")))
    assign = "(?:" + names + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = (assign, "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9+/_-]{32,}")
    found = " union all ".join(f"select rid, {k} as kind, regexp_extract_all(t, '{p}') as m, regexp_split_to_array(t, '{p}') as s from d" for k, p in enumerate(patterns))
    kinds = "[" + ", ".join(f"'{k}'" for k in secret_scan.KINDS) + "]"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce('=' || source, '?') as owner, '=' || concat_ws('/', source, lang) as repository from documents),
f as ({found}),
a as (select rid, kind, m[i] as m, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as first from f, unnest(range(1, len(m) + 1)) u(i)),
v as (select rid, kind, first::bigint as first, (first + length(m))::bigint as last, case when kind = 0 then regexp_extract(m, '{assign}', 1) else m end as value from a),
base as (select * from v where kind < 3 and (kind > 0 or length(value) >= 6)),
keys as (select * from v k where kind = 3 and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[a-z]') and not exists (select 1 from base b where b.rid = k.rid and b.first < k.last and b.last > k.first)),
spans as (select * from base union all select * from keys),
live as (select value from spans join d using (rid) group by value having count(distinct owner) < {secret_scan.EXAMPLE_OWNERS} and count(distinct repository) < {secret_scan.EXAMPLE_REPOSITORIES}),
told as (select s.*, l.value is not null as live, {kinds}[kind + 1] || ':' || first || ':' || last as span from spans s left join live l using (value)),
r as (select rid, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, string_agg(span, ',' order by first, kind) filter (kind < 3) as base,
  string_agg(span, ',' order by first, kind) filter (kind < 3 or live) as spans, count(*) filter (live) as n_live from told group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live
from d left join r using (rid)
"""


ORACLES["op2_secret_scans"] = _secrets_sql()


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_pii(docs, pii.train(docs))
    return found.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.render("base"), 256).alias("base_sha256"), pii.render("spans").alias("spans"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_audited = {
    "kept": "(mask & seen) = 0", "removed": "(mask & bit) > 0 and (mask & (seen - bit)) = 0", "redundant": "(mask & bit) > 0 and (mask & (seen - bit)) > 0", "unique_fails": "mask = bit",
    "good_lost": "good and (mask & bit) > 0 and (mask & (seen - bit)) = 0", "toxic_lost": "toxic and (mask & bit) > 0 and (mask & (seen - bit)) = 0",
}
ORACLES["op11_filter_audit"] = f"""
with recursive d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, min(doc_id) over (partition by t) as least from d),
l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
m as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::int
         + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(least < w.doc_id, false)::int as mask
  from w left join l using (doc_id)),
c as (select part, mask, good, toxic, count(*) as n from m group by all),
f as (select substr('ABCDE', k::int, 1) as name, 1 << (k::int - 1) as bit from range(1, 6) t(k)),
o as (select '' as so_far, 0 as seen union all select so_far || name, seen + bit from o join f on (seen & bit) = 0),
p as (select so_far as filter_order from o where length(so_far) = 5),
s as (select filter_order, k::int as step, 1 << (instr('ABCDE', substr(filter_order, k::int, 1)) - 1)::int as bit,
             list_sum(list_transform(range(1, k + 1), lambda j: 1 << (instr('ABCDE', substr(filter_order, j::int, 1)) - 1)::int))::int as seen from p, range(1, 6) t(k)),
a as (select part, filter_order, step, bit, {", ".join(f"coalesce(sum(n) filter ({v}), 0)::bigint as {k}" for k, v in _audited.items())} from c, s group by part, filter_order, step, bit)
select part, filter_order, step, {", ".join(_audited)}, (sum(removed) over (partition by part, bit))::bigint as shapley from a
"""


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = F.sha2(fill_middle.restore_text(F.col("output"), F.col("form")), 256)
    return cut.select("row.doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), restored.alias("restored_sha256"))


ORACLES["op12_fill_in_middle"] = """
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
h as (select *, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
             case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substring(t, 1, a) as prefix, substring(t, a + 1, b - a) as middle, substring(t, b + 1) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else t end) as output_sha256, sha256(t) as restored_sha256
from p
"""


@query
def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _licenses_sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "list_filter(regexp_split_to_array(" + lower + ", '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    k, band = license_scan.K, license_scan.BAND
    stands = lambda p: "list_filter(range(1, len(w) + 1), lambda i: " + " and ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p.split(" "))) + ")"
    templates = ", ".join("({}, '{}', '{}')".format(no, t.label, t.text.replace("'", "''")) for no, t in enumerate(license_scan.TEMPLATES))
    places = ", ".join(f"{stands(p)} as p{i}" for i, (_, p) in enumerate(license_scan.PHRASES))
    every = " || ".join(f"p{i}" for i in range(len(license_scan.PHRASES)))
    base = "list_filter([" + ", ".join(f"case when len(p{i}) > 0 then '{label}' end" for i, (label, _) in enumerate(license_scan.PHRASES)) + "], lambda x: x is not null)"
    return f"""
with d as (select row_number() over () as rid, doc_id, {words.format("coalesce(text, '')")} as w from documents),
t as (select no, label, {words.format("x")} as w from (values {templates}) t(no, label, x)),
tg as (select no, label, len(w) - {k - 1} as n, i - 1 as place, array_to_string(w[i:i + {k - 1}], ' ') as g from t, unnest(range(1, len(w) - {k - 2})) u(i)),
dg as (select rid, i - 1 as pos, array_to_string(w[i:i + {k - 1}], ' ') as g from d, unnest(range(1, len(w) - {k - 2})) u(i)),
m as (select distinct rid, no, label, n, place, pos - place as diagonal from dg join tg using (g)),
a as (select distinct rid, no, diagonal as anchor from m),
c as (select rid, no, label, anchor, count(distinct place)::double / any_value(n) as share from a join m using (rid, no) where diagonal between anchor - {band} and anchor + {band} group by rid, no, label, anchor),
s as (select rid, max(share) as share, list(distinct label) filter (share >= {license_scan.LEAST_SHARE}) as labels from c group by rid),
b as (select rid, doc_id, len(w)::bigint as n_words, {places} from d),
p as (select rid, doc_id, n_words, {every} as p, {base} as base from b)
select doc_id, n_words, len(p)::bigint as n_base, (list_min(p) - 1)::bigint as first_word, (list_max(p) - 1)::bigint as last_word, array_to_string(list_sort(base), ',') as base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') as labels, case when len(p) > 0 then 1.0::double else coalesce(share, 0.0)::double end as score
from p left join s using (rid)
"""


ORACLES["op13_license_scans"] = _licenses_sql()
