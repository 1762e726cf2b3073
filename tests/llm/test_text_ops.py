"""Quality rules, byte-level BPE, token counts and packing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import bpe, packing, quality, queries, token_files, topk, url_filter

TEXTS = [
    (1, "the cat sat on the mat and the cat sat on the mat again today"),
    (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (4, "same id twice"),
    (5, "a b c d e a b c d e f g"), (6, "line one\nline one\n\nother\nline one"),
    (7, "naïve café ½ x² 中文字 😀 it's we'll  two   spaces \n\n end "), (8, "word " * 9000), (None, "<|endoftext|> #*$%&|<>"),
    (9, "é" * 3000), (10, "1234567890" * 500),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, length string")


def naive_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts(docs):
    got = quality.score_quality(docs).select("row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = naive_quality(r["text"])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_filter_keeps_columns(spark, docs):
    clash = docs.withColumnRenamed("ids", "n_words").withColumnRenamed("length", "kept")
    got = quality.filter_quality(clash)
    assert got.columns == ["doc_id", "text", "n_words", "kept"]
    assert quality.score_quality(docs.limit(0)).count() == 0


def test_codec_equals_library(docs):
    c = bpe.codec(bpe.vocabulary_path("byte_bpe_50k.tiktoken"))
    for _, t in TEXTS:
        t = t or ""
        for chunk, overlap in ((16384, 256), (64, 16), (7, 3)):
            ids = np.frombuffer(c.encode(t, chunk, overlap), "<u4").tolist()
            assert ids == c.encoding.encode_ordinary(t)
        assert c.decode(c.encode(t)) == t.encode()


def test_json_vocabulary_is_the_same():
    a, b = (bpe.read_ranks(bpe.vocabulary_path(n))[0] for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    assert a == b


def test_encode_and_decode(docs):
    path = bpe.vocabulary_path("byte_bpe_50k.tiktoken")
    got = bpe.decode_ids(bpe.encode_texts(docs, path, keep=("doc_id", "text")), path).select("row.text", "ids", "bytes").collect()
    c = bpe.codec(path)
    for t, ids, raw in got:
        assert np.frombuffer(bytes(ids), "<u4").tolist() == c.encoding.encode_ordinary(t or "")
        assert bytes(raw).decode() == (t or "")


def test_token_counts(spark, docs):
    path = bpe.vocabulary_path("byte_bpe_50k.tiktoken")
    c = bpe.codec(path)
    want = Counter((i, len(c.encoding.encode_ordinary(t or ""))) for i, t in TEXTS)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in token_files.count_tokens(docs, path).collect()) == want
    assert token_files.count_tokens(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("block", [1, 3, 8])
def test_separator_scan_over_files(spark, tmp_path, monkeypatch, block):
    rng, want = np.random.default_rng(block), set()
    cases = {"a": [], "b": [0], "c": [5, 6], "d": [0, 0, 5, 0], "e": rng.integers(0, 3, 40).tolist(), "f": [1] * 20 + [0], "g": rng.integers(0, 2, 5000).tolist()}
    for name, tokens in cases.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(tokens, "<u2").tobytes())
        start = no = 0
        for k, t in enumerate(tokens + ([0] if tokens and tokens[-1] else [])):
            if t == 0:
                want.add((name, no, start, k - start))
                start, no = k + 1, no + 1
    monkeypatch.setattr(token_files, "READ", 2)
    ends = token_files.file_ends(token_files.list_token_files(spark, str(tmp_path)), 0, block)
    got = token_files.scan_separators(ends)
    rows = [(r["file"].rsplit("/", 1)[1][0], r["doc_no"], r["start"], r["n_tokens"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_separator_scan_of_a_file_over_2_gb(spark, tmp_path):
    with open(tmp_path / "x.bin", "wb") as f:  # zeros but for a few separators, and an odd last byte
        for at in (3, 1_200_000_000, 1_200_000_010):
            f.seek(2 * at)
            f.write(np.array([7], "<u2").tobytes())
        f.write(b"\0")
    got = token_files.scan_separators(token_files.file_ends(token_files.list_token_files(spark, str(tmp_path)), 7))
    assert sorted((r["doc_no"], r["start"], r["n_tokens"]) for r in got.collect()) == [(0, 0, 3), (1, 4, 1_199_999_996), (2, 1_200_000_001, 9)]


@pytest.mark.parametrize("seed", range(4))
def test_pack_plan_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [65, 40, 64, 8][seed], 3000)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan, held = packing.pack_plan(counts, 64), Counter()
    for way, many in plan:
        assert many > 0 and sum(n * a for n, a in way.items()) <= 64
        held.update({n: a * many for n, a in way.items()})
    assert held == counts
    best_fit = sum(m for _, m in packing._best_fit(counts, 64))
    assert sum(m for _, m in plan) <= 1.005 * best_fit + 1


def test_packing(docs):
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, 128).collect()
    want = Counter()
    for i, t in TEXTS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        at = [0, *range(len(ids) % 128 or 128, len(ids) + 1, 128)] if len(ids) > 128 else [0, len(ids)]
        want.update((i, k, a, b - a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in rows) == want
    ends = {}
    for s, o, n in sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows):
        assert o == ends.get(s, 0)
        ends[s] = o + n
    assert max(ends.values()) <= 128
    digests = packing.pack_digests(docs, path, 128).collect()
    assert Counter(r["ids_crc32"] for r in digests) == Counter(zlib.crc32(bytes(r["ids"])) for r in rows)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_ids_equal_the_tokenizers_library():
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for text in [*(t for _, t in TEXTS), "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "\n <|endoftext|>  y<|endoftext", "<|end<|endoftext|>oftext|>"]:
        assert np.frombuffer(bpe.codec(path).encode(text or ""), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("blocks", [(512, 16384), (3, 7)])
def test_exact_top_k(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=9)]) for i in range(160)]
    rows += [(0, rows[0][1]), (7, rows[7][1]), (200, None), (201, [1.0] * 8 + [None]), (202, [float("nan")] * 9), (203, [float("inf")] * 9), (None, [1.0] * 9), (250, [1.0, 2.0])]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0, 5, queries_in_block=blocks[0], candidates_in_block=blocks[1]).collect()
    ok = [(k, i, np.floor(256 * np.array(v))) for k, (i, v) in enumerate(rows[:162])] + [(162, 250, np.array([256.0, 512.0]))]
    want = []
    for k, i, v in ok:
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for n, j, w in ok if n != k and len(w) == len(v))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert Counter(map(tuple, got)) == Counter(want)
    empty = vectors.limit(0)
    assert topk.exact_top_k(empty, F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("size", [1e6, 3e7, 1e15, 3e38, 1e300])
def test_top_k_of_large_components(spark, size):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (size if i % 3 else 1)]) for i in range(120)]
    rows += [(200 + i, [size, -size, float(i % 4), 1 / 512, 0.0, size]) for i in range(40)] + [(300, []), (350, []), (350, [])]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0, 5, queries_in_block=3, candidates_in_block=50).collect()
    whole = [[math.floor(Fraction(x) * 256) for x in v] for _, v in rows]
    want = []
    for k, (i, _) in enumerate(rows):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[k], w)), j) for n, ((j, _), w) in enumerate(zip(rows, whole)) if n != k and len(w) == len(whole[k]))[:5]
            want += [(i, r + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, j) in enumerate(best)]
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("size", [1.0, 1e9])
def test_pairs_under_the_cutoff_drop_out_before_all_lists_are_multiplied(size):
    rng = np.random.default_rng(3)
    q, c = np.floor(rng.normal(size=(20, 16)) * 4096) * size, np.floor(rng.normal(size=(400, 16)) * 4096) * size
    c[100:] /= 4096
    c[100:] = np.floor(c[100:])
    table = lambda **names: pa.table({**{k: pa.array(v) for k, v in names.items()}})
    lists = lambda m: [[float(x) / topk.UNIT for x in r] for r in m]
    cut = np.sort(q @ c.T, axis=1)[:, -5]
    block = topk._Block(table(qrid=np.arange(20), query_id=np.arange(20), qv=lists(q), cutoff=cut), table(rid=np.arange(400), vec_id=np.arange(400), v=lists(c)), 4)
    assert block.exact == (size == 1.0)
    scaled = cut if block.exact else np.ldexp(cut / topk.UNIT**2, -block.exponent)
    i, j, total, may = block.reaching(scaled)
    assert len(i) == 20 and len(j) < 100 and total.shape == may.shape == (20, len(j))  # the small ones went
    want = {(a, b) for a, b in zip(*np.nonzero(q @ c.T >= cut[:, None]))}
    got = {(i[a], j[b]) for a, b in zip(*np.nonzero(may))}
    assert want <= got and len(got) < 300


def test_url_filters(spark):
    rules = [url_filter.host_path_rule("block", "com", "/en/"), url_filter.host_path_rule("allow", "example.com", "/en/7"), url_filter.pattern_rule("pills", "block", r"^[^/]*\bcheap-pills\b", "cheap", "pills")]
    cases = [
        (None, "", "", None, "allow"), ("no scheme.com/en/", "", "", None, "allow"), ("http://X.EXAMPLE.com/en/71?q=/en/", "x.example.com", "/en/71", "example.com/en/7", "allow"),
        ("https://example.com/en/8#a", "example.com", "/en/8", "com/en/", "block"), ("https://notexample.com/EN/8", "notexample.com", "/EN/8", None, "allow"), ("https://com/en/", "com", "/en/", "com/en/", "block"),
        ("ftp://cheap-pills.example.net", "cheap-pills.example.net", "", "pills", "block"), ("http://a://b/c", "a:", "//b/c", None, "allow"), ("http://xcheap-pills.net/", "xcheap-pills.net", "/", None, "allow"), ("", "", "", None, "allow"), ("https://example.communism/en/", "example.communism", "/en/", None, "allow"), ("http://É.com/en/\nx", "É.com", "/en/\nx", "com/en/", "block"),
    ]
    df = spark.createDataFrame([(c[0], "clash") for c in cases] * 2, "url string, host string")
    got = url_filter.judge_urls(df, rules).select("row.url", "host", "path", "rule", "verdict").collect()
    assert Counter(map(tuple, got)) == Counter(cases * 2)
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    assert url_filter.judge_urls(df, []).where("verdict = 'allow'").count() == len(cases) * 2
    for few in (1, 100):  # as a table, of any number of rules
        with pytest.MonkeyPatch.context() as m:
            m.setattr(url_filter, "RULES_IN_PLAN", few)
            m.setattr(url_filter, "RULES_BROADCAST", few)
            many = rules + [url_filter.host_path_rule("block", f"h{i}.test", "/x/") for i in range(150)]
            assert Counter(map(tuple, url_filter.judge_urls(df, many).select("row.url", "host", "path", "rule", "verdict").collect())) == Counter(cases * 2)
    long = spark.createDataFrame([("http://a.com/" + "x-" * 200_000 + "?q",), ("http://b.com/en/" + "y/" * 200_000,)], "url string")
    assert [r["verdict"] for r in url_filter.judge_urls(long, rules).select("verdict").collect()] == ["allow", "block"]
    plan = url_filter.judge_urls(df, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_registered_url_rules(spark):
    cases = [
        ("http://a.com/en/1", "com/en/", "block"), ("http://a.com/en/7", "com/en/", "block"), ("http://example.com/en/7", "example.com/en/7", "allow"), ("http://x.example.com/en/70", "example.com/en/7", "allow"),
        ("http://a.net/de/8", "net/de/", "allow"), ("http://example.net/de/1", "net/de/", "allow"), ("http://example.net/de/8", "example.net/de/8", "block"), ("http://w.example.net/de/80", "example.net/de/8", "block"),
        ("http://a.org/es/", "org/es/", "block"), ("http://a.org/en/", None, "allow"), ("http://spam-farm.net/de/1", "net/de/", "allow"), ("http://spam-farm.net/fr/1", None, "block"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "url string")
    judged = url_filter.judge_urls(df, queries.URL_RULES).select("row.url", F.when(F.col("tier") == 1, F.col("rule")), "verdict").collect()
    assert Counter(map(tuple, judged)) == Counter(cases)


@pytest.mark.parametrize(("long", "overlap"), [(700, 40), (60, 8), (5, 1)])
def test_long_texts_are_dealt_in_chunks(spark, long, overlap):
    path = bpe.vocabulary_path("byte_bpe_50k.tiktoken")
    rng = random.Random(4)
    parts = ["word", " ", "  \n", "é", "'ll", "12", "中", "!?", "<|endoftext|>", "x" * 90, " " * 70, "\u2003"]
    rows = [*TEXTS[:7], (20, "".join(rng.choice(parts) for _ in range(1500))), (20, "".join(rng.choice(parts) for _ in range(300))), (21, "a" * 3000), (22, " " * 2001), (23, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, ids string")
    c = bpe.codec(path)
    got = bpe.encode_texts(df, path, long=long, overlap=overlap, chunk=64)
    want = Counter((i, tuple(c.encoding.encode_ordinary(t or ""))) for i, t in rows)
    assert Counter((r["row"]["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in got.collect()) == want
    back = Counter((r["row"]["doc_id"], bytes(r["bytes"])) for r in bpe.decode_ids(got, path).collect())
    assert back == Counter((i, (t or "").encode()) for i, t in rows)
    assert bpe.encode_texts(df.limit(0), path).count() == 0


def test_plans_are_near_the_lower_bound():
    rng = np.random.default_rng(6)
    assert packing.lower_bound({}) == 0 and packing.lower_bound({600: 3, 500: 1, 400: 5}) == 5 and packing.lower_bound({1024: 2, 1: 1}) == 3
    for lengths in (rng.integers(1, 1025, 20_000), rng.integers(1, 300, 20_000), np.minimum(rng.lognormal(5, 1.2, 20_000).astype(int) + 1, 1024)):
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        used, least = sum(m for _, m in packing.pack_plan(counts)), packing.lower_bound(counts)
        assert least <= used <= 1.005 * least + 1, (used, least)


def test_digests_are_of_little_endian_ids(docs):
    path = bpe.vocabulary_path("byte_bpe_50k.tiktoken")
    got = bpe.encode_texts(docs.where("doc_id = 1"), path).select(F.sha2("ids", 256)).first()[0]
    ids = bpe.codec(path).encoding.encode_ordinary(TEXTS[0][1])
    assert got == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
