"""Filter audit, fill-in-middle and license scans against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import fill_middle, filter_audit, license_scan

# -- filter audit --------------------------------------------------------------

LONG = " ".join(f"w{i}" for i in range(210))


def fails(text, seen_smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": seen_smaller,
    }


def audited(rows, labels):
    """One row for each part, order and step, by applying the filters one after the other."""
    docs = [(i, t or "", p or "", fails(t or "", i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows))) for i, t, p in rows]
    is_one = lambda i, k: any(r[0] == i and r[k] == 1 for r in labels if i is not None)
    out, removed_by = [], Counter()
    for part in {d[2] for d in docs}:
        mine = [d for d in docs if d[2] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [d for d in left if d[3][name]]
                early = [d for d in mine if d[3][name] and d not in left]
                left = [d for d in left if not d[3][name]]
                removed_by[part, name] += len(gone)
                only = sum(d[3][name] and sum(d[3].values()) == 1 for d in mine)
                early = sum(d[3][name] for d in mine) - len(gone)
                out.append([part, order, step, len(left), len(gone), early, only, sum(is_one(d[0], 1) for d in gone), sum(is_one(d[0], 2) for d in gone)])
    return Counter((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


def audit_rows():
    rng = random.Random(3)
    texts = [None, "", LONG, LONG + " #", LONG.upper(), "same " * 300, "a b c", LONG + " é", " \t\x0b\x0c\r\n", "x|" * 50_000, "ÀÉ " * 200]
    rows = [(i, rng.choice(texts), rng.choice(["s", "t", None, "", "hot", "hot"])) for i in rng.sample(range(1000), 150)]
    rows += [(0, LONG, "s"), (0, LONG, "t"), (0, LONG, "s"), (0, "a b c", "s"), (None, LONG, "s"), (None, LONG, "s"), (None, None, None)] + rows[:5]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 1000, 2)] + [(0, 0, 1), (0, None, None), (None, 1, 1), (rows[0][0], 1, None)]
    return rows, [(i, q, None if t is None else int(t)) for i, q, t in labels]


@pytest.mark.parametrize("held", [1, 5000, filter_audit.HELD])
def test_filter_audit(spark, held):
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, source string, mask string, n int").repartition(5)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit_filters(docs, known, held=held).collect()
    assert Counter(map(tuple, got)) == audited(rows, labels)


def test_filter_audit_of_collisions_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "fingerprint_of", lambda data: 7)  # one chain for all texts
    routed = list(filter_audit._route([(3, "s", "x"), (1, "s", "y"), (2, "t", "x"), (2, "t", "x")], 100))
    assert Counter(filter_audit._settle(routed)) == Counter([(3, "s", 17, 1), (1, "s", 1, 1), (2, "t", 1, 2)])
    monkeypatch.undo()
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_filters(docs, labels).count() == 0
    one = spark.createDataFrame([("b", LONG, 1), ("a", LONG, 2)], "doc_id string, text string, source int")
    assert {tuple(r) for r in filter_audit.failed_filters(one).collect()} == {("b", "1", 16, 1), ("a", "2", 0, 1)}
    assert filter_audit.audit_filters(one, labels.limit(0).withColumn("doc_id", F.lit("x"))).where("good_lost > 0").count() == 0


# -- fill-in-middle ------------------------------------------------------------

FIM_TEXTS = [
    None, "", "a", "é", "😀", "naïve 中文 😀 text", "<P>", "x<S>y", "<M", "a < b <P <S <M > P>", "<", ">", "P>", "\n", " lead  two\n\nlines \n", "word " * 40_000, "é" * 99_999, "tab\tand\x0bvt\x00nul",
    "<S" * 30, "S>" * 30, "\r\n" * 9,
]


def units_of(text, unit):
    if unit == "characters":
        return list(text)
    if unit == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return re.findall(r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", text)


def cut_text(key, text, unit="characters"):
    text, h = text or "", hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = units_of(text, unit)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(("unit", "most"), [("characters", fill_middle.BYTES), ("characters", 7), ("words", 50), ("lines", 50)])
def test_fill_in_middle(spark, unit, most):
    rows = [(i, t) for i, t in enumerate(FIM_TEXTS * 6)] + [(3, "twice"), (3, "twice"), (None, "no id"), (-5, "less")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id bigint, text string, n string, output string")
    cut = fill_middle.fill_in_middle(docs, unit=unit, most=most, keep=("doc_id", "n", "output"))
    got = cut.select("row.doc_id", "n", "form", "prefix_units", "middle_units", "output", fill_middle.restore_text(F.col("output"), F.col("form")).alias("restored")).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((i, *cut_text(i, t, unit)) for i, t in rows)
    assert Counter((r["doc_id"], r["restored"]) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_cuts_of_a_slice_of_a_batch():
    texts = pa.array(["skipped é", "añb", "", "cd"], pa.large_string()).slice(1)
    n, cuts, pieces = fill_middle.cut_rows(texts, np.array([[5, 2], [9, 9], [1, 2]]), "characters")
    assert (n.tolist(), cuts.tolist(), pieces.to_pylist()) == ([3, 0, 2], [[1, 2], [0, 0], [1, 2]], ["a", "ñ", "b", "", "", "", "c", "d", ""])


# -- license scans -------------------------------------------------------------


def words_of(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def scanned(text, templates=license_scan.TEMPLATES, k=license_scan.K, band=license_scan.BAND, least=license_scan.LEAST_SHARE):
    w = words_of(text)
    places = [(i, label) for label, phrase in license_scan.PHRASES for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    base = sorted({label for _, label in places})
    runs = {}
    for i in range(len(w) - k + 1):
        runs.setdefault(tuple(w[i : i + k]), []).append(i)
    best, found = 0.0, set()
    for t in templates:
        tw = words_of(t.text)
        n = len(tw) - k + 1
        at = {(i - j, j) for j in range(max(n, 0)) for i in runs.get(tuple(tw[j : j + k]), [])}
        for anchor in {d for d, _ in at}:
            share = len({j for d, j in at if abs(d - anchor) <= band}) / n
            best = max(best, share)
            found |= {t.label} if share >= least else set()
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), base, sorted(set(base) | found), 1.0 if at else best


MIT, BSD = (next(t.text for t in license_scan.TEMPLATES if t.label == label and len(t.text) > 200) for label in ("mit", "bsd"))


def license_texts():
    rng = random.Random(5)
    words = MIT.split()
    changed = words.copy()
    changed[20:20] = ["really", "and", "truly"]
    changed[60] = "altered"
    del changed[40:42]
    scattered = [x for j in range(0, len(words) - 4, 4) for x in [*words[j : j + 4], *"this is other text".split()]]
    return [
        None, "", " ", "mit", "mit license", "MIT-License; the mit license. MIT\nLICENSE", "mıt license", "émit license", "general public license apache license apache license", MIT, MIT.upper(), " ".join(changed), " ".join(scattered),
        "x y " * 300 + MIT + " and then " + BSD + " tail " * 50 + MIT, " ".join(words[: len(words) // 2]), "Licensed under CC BY-NC 4.0.", "licensed under cc by nc 3", "the software is the software is " * 400, "Licensed under the Apache  License,\tVersion 2.0",
        " ".join(rng.choice(words) for _ in range(400)), "word " * 60_000 + "apache license", "版权 mit license 中文", (MIT + " ") * 30, "license mit license license",
    ]


def test_license_scans(spark):
    rows = [(i, t) for i, t in enumerate(license_texts())] + [(3, MIT), (3, MIT), (None, "apache license")]
    docs = spark.createDataFrame([(*r, "clash", {"a": 1}) for r in rows], "doc_id bigint, text string, labels string, rid map<string, int>").repartition(3)
    got = license_scan.scan_licenses(docs, keep=("doc_id", "labels", "rid")).select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    flat = lambda r: tuple(tuple(x) if isinstance(x, list) else x for x in r)
    assert Counter(map(flat, got)) == Counter(flat((i, *scanned(t))) for i, t in rows)
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
    plan = license_scan.scan_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_spans(spark):
    words = MIT.split()
    docs = spark.createDataFrame([(1, "a b c " + MIT + " d e " + BSD), (2, " ".join(words[:30] + ["new", "words"] + words[30:])), (3, (MIT + " ") * 3), (4, "nothing")], "doc_id bigint, text string")
    spans = {r["doc_id"]: [(s["first"], s["last"], s["label"]) for s in r["spans"]] for r in license_scan.scan_licenses(docs).select("row.doc_id", "spans").collect()}
    n, m = len(words_of(MIT)), len(words_of(BSD))
    assert spans == {1: [(3, 2 + n, "mit"), (5 + n, 4 + n + m, "bsd")], 2: [(0, n + 1, "mit")], 3: [(k * n, k * n + n - 1, "mit") for k in range(3)], 4: []}


def test_templates_that_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(license_texts()[:16])], "doc_id bigint, text string")
    shown = lambda: Counter(str(r) for r in license_scan.scan_licenses(docs).collect())
    want = shown()
    monkeypatch.setattr(license_scan, "FEW", 0)
    assert shown() == want
    assert [r["labels"] for r in license_scan.scan_licenses(docs, templates=[license_scan.Template("x", "too short"), license_scan.Template("y", "Licensed under CC BY-NC")]).where("row.doc_id = 15").collect()] == [["y"]]
