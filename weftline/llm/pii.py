"""Personal data by patterns and a skip-chain conditional random field.

The patterns of the fixed kinds give the base spans. They, whole numbers and
addresses that are similar to one, and other tokens that hold a digit or ``@``
are the nodes of the field; neighbours in the text and, over any distance,
repeated or similar nodes share potentials. Loopy message passing makes their
labels consistent in each document, so that a number or address that no pattern
takes gets the kind of its like elsewhere in the document, in one span. Similar
are equal letters and digits, whatever stands between them (up to three blanks
between groups of digits), and for a phone its last digits, without or with
zeros before them. Base spans always stay, as evidence and in the result.

The weights of nodes, neighbours and similar nodes are fitted together, by
pseudo-likelihood, on a bounded sample of documents. As the patterns take each
of their spans, the sample says nothing on other forms of a span; so copies of
some spans in other forms, labelled with their kind, and numbers of the same
forms that are like no span, labelled none, are put into the sample's texts.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: none
#: Documents of the sample, and nodes of one of them, that the weights are fitted on; spans of one that are put in again in other forms.
SAMPLE, TOKENS, AGAIN = 2000, 200, 3
FEATURES = 4096
STEPS, BATCH, RATE, PENALTY = 6000, 128, 0.3, 1e-4
ROUNDS, DAMPING = 12, 0.5
#: A token gets a span if its label has this probability.
SURE = 0.9
#: Least characters of letters and digits to be similar to another, and least last digits of a phone where they don't begin with a group of it.
LEAST, SUFFIX = 4, 7

# The characters of an address before the @, and the patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")

_DIGITS = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\s<>()\[\]\"']+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ has one run of local characters before it, so a scan over the @ finds the leftmost matches in linear time."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start: leftmost non-overlapping in each kind, failing matches dropped."""
    found = [(0, a, b) for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return found
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return found


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


@dataclass
class Token:
    start: int
    end: int
    shape: str
    norm: str
    before: str
    label: int = 0


def _shape(token: str) -> str:
    """Digits as 9, letters as a, with runs of more than four cut."""
    out = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", token))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1+", out)[:40]


def _norm(text: str) -> str:
    return re.sub(r"[\W_]", "", text).lower()


def _keys(text: str, base: list[tuple[int, int, int]]) -> tuple[dict[str, str], dict[str, str]]:
    """What is similar to the base spans: digits of numbers, and letters and digits of addresses, each with the norm of its span. Of a phone the last
    SUFFIX digits or more are similar too, and its last blank-parted pieces of LEAST digits or more. The first span of a key has it."""
    numbers: dict[str, str] = {}
    mails: dict[str, str] = {}
    suffixes: list[tuple[str, str]] = []
    for kind, a, b in base:
        norm = _norm(text[a:b])
        if len(norm) < LEAST:
            continue
        if kind == 0:
            mails.setdefault(norm, norm)
            continue
        numbers.setdefault(norm, norm)
        if kind == 3:
            ends = [_norm(part) for part in text[a:b].split()]
            sizes = {n for k in range(1, len(ends)) if (n := len("".join(ends[k:]))) >= LEAST} | set(range(SUFFIX, len(norm)))
            suffixes += [(norm[-n:], norm) for n in sorted(sizes)]
    for key, norm in suffixes:  # equal digits come before a suffix
        numbers.setdefault(key, norm)
    return numbers, mails


def _similar(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, norm of the base span) of whole numbers and addresses that are similar to a base span, outside of them, the longest from the left."""
    numbers, mails = _keys(text, base)
    taken = sorted((a, b) for _, a, b in base)
    out: list[tuple[int, int, str]] = []
    found: list[tuple[int, int, str]] = []
    if numbers:
        longest = max(map(len, numbers))
        groups = [m.span() for m in _GROUP.finditer(text)]
        # Whether the group belongs to the same run as the one before it: few blanks and no letter between them.
        joins = [False] * len(groups)
        for k in range(1, len(groups)):
            gap = text[groups[k - 1][1] : groups[k][0]]
            joins[k] = not any(c.isalnum() for c in gap) and sum(c.isspace() for c in gap) <= 3
        k = 0
        while k < len(groups):
            start, best, digits, j = groups[k][0], None, "", k
            if start == 0 or not text[start - 1].isalnum():
                while j < len(groups) and (j == k or joins[j]) and len(digits) <= longest + 3:
                    digits += text[groups[j][0] : groups[j][1]]
                    end = groups[j][1]
                    if end == len(text) or not text[end].isalnum():
                        bare = digits.lstrip("0")  # of a trunk or exit code
                        norm = numbers.get(digits) or (numbers.get(bare) if len(bare) >= SUFFIX else None)
                        best = (j, end, norm) if norm else best
                    j += 1
            if best:
                j, end, norm = best
                inside = text[start:end]
                if start and text[start - 1] == "(" and inside.count(")") > inside.count("("):
                    start -= 1
                if start and text[start - 1] == "+":
                    start -= 1
                found.append((start, end, norm))
                k = j
            k += 1
    if mails:
        # An address may stand with blanks around its marks: a word up to the @, and words from it. How far is looked is bounded by the longest base address alone.
        longest, reach = max(map(len, mails)), max(b - a for k, a, b in base if KINDS[k] == "email")
        for m in re.finditer(r"@", text):
            before = m.start()
            while before and text[before - 1].isspace():
                before -= 1
            left = text[max(0, before - reach - 1) : before]
            start, best, letters = before - len(re.search(r"[^\s,;:<>()\[\]\"']*\Z", left)[0]), None, 0
            for w in _WORD.finditer(text, m.start()):
                letters += sum(c.isalnum() for c in w[0])
                if letters > longest or w.start() > m.start() and "@" in w[0]:
                    break
                end = w.start() + len(w[0].rstrip(".,;:!?"))
                norm = mails.get(_norm(text[start:end]))
                best = (start, end, norm) if norm else best
            if best:
                found.append(best)
    i, last = 0, 0
    for a, b, norm in sorted(found, key=lambda x: (x[0], -x[1])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= last and not any(a < y for _, y in itertools.takewhile(lambda x: x[0] < b, itertools.islice(taken, i, None))):  # noqa: B023
            out.append((a, b, norm))
            last = b
    return out


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> list[Token]:
    """The nodes of the field in order: base spans, whole numbers and addresses similar to one, and the other tokens that hold a digit or @."""
    whole: list[tuple[int, int, str, int]] = []
    for a, b, k in sorted((a, b, k) for k, a, b in base):
        rest = max(a, whole[-1][1]) if whole else a  # spans of two kinds may overlap
        if rest < b:
            whole.append((rest, b, _norm(text[a:b]), k + 1))
    whole = sorted(whole + [(a, b, norm, 0) for a, b, norm in _similar(text, base)])
    out: list[Token] = []

    def add(a: int, b: int, norm: str, label: int) -> None:
        head = text[max(0, a - 24) : a].split()
        out.append(Token(a, b, _shape(text[a:b]), norm, head[-1].lower().strip(":") if head else "", label))

    at = 0
    for s, e, norm, label in [*whole, (len(text), len(text), "", 0)]:
        for m in _NODE.finditer(text, at, s):
            raw = m[0].strip(".,;:!?()[]{}<>\"'")
            if raw:
                a = m.start() + m[0].find(raw)
                add(a, a + len(raw), _norm(raw), 0)
        if s < e:
            add(s, e, norm, label)
        at = e
    return out


@lru_cache(100_000)
def _place(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % FEATURES


def _features(tokens: list[Token], k: int) -> list[int]:
    t = tokens[k]
    near = lambda j: tokens[j].shape if 0 <= j < len(tokens) and abs(tokens[j].start - t.start) < 40 else ""
    digits = t.norm if t.norm.isdigit() and t.norm.isascii() else ""
    check = f"l{_luhn(digits)}" if 13 <= len(digits) <= 19 else "l"
    return [_place(n) for n in (check, "s" + t.shape, "b" + t.before[:40], f"d{min(20, t.shape.count('9'))}", "@" if "@" in t.shape else "-", f".{t.shape.count('.')}", "p" + near(k - 1), "n" + near(k + 1), "1")]


@dataclass
class Field:
    """Weights: of a node's features by label, of the labels of a node (rows) and the next one, and of those of two similar nodes."""

    unary: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, LABELS)))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((LABELS, LABELS)))
    skip: np.ndarray = field(default_factory=lambda: np.eye(LABELS) * 4.0)


def _neighbours(tokens: list[Token]) -> list[tuple[int, int]]:
    """Nodes next to each other, less than 40 characters apart, if they aren't similar."""
    return [(k, k + 1) for k, (x, y) in enumerate(itertools.pairwise(tokens)) if y.start - x.end < 40 and not (x.norm == y.norm and len(x.norm) >= LEAST)]


def _ties(tokens: list[Token]) -> list[tuple[int, int]]:
    """Skip edges of the field: each token with the nearest similar ones in base spans before and after it, so that evidence is one edge away
    from every repeat; where a group has none in a base span, with the last similar one. At most two edges a token."""
    groups: dict[str, list[int]] = {}
    for k, t in enumerate(tokens):
        if len(t.norm) >= LEAST:
            groups.setdefault(t.norm, []).append(k)
    out = []
    for members in groups.values():
        known = [k for k in members if tokens[k].label]
        if not known:
            out += list(zip(members, members[1:]))
            continue
        i = 0
        for k in members:
            while i < len(known) and known[i] < k:
                i += 1
            if not tokens[k].label:
                out += [(j, k) for j in known[max(0, i - 1) : i + 1]]
    return out


def marginals(tokens: list[Token], model: Field) -> np.ndarray:
    """Label probabilities by loopy message passing; tokens in base spans are evidence."""
    chain, skip = _neighbours(tokens), _ties(tokens)
    score = np.array([model.unary[_features(tokens, k)].sum(axis=0) for k in range(len(tokens))])
    known = np.array([t.label for t in tokens])
    score[known > 0] = -50.0
    score[known > 0, known[known > 0]] = 0.0
    pairs = np.array(chain + skip, int).reshape(-1, 2)
    potential = np.exp(np.stack([model.chain] * len(chain) + [model.skip] * len(skip))) if len(pairs) else np.zeros((0, LABELS, LABELS))
    src = np.concatenate([pairs[:, 0], pairs[:, 1]])
    dst = np.concatenate([pairs[:, 1], pairs[:, 0]])
    potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
    message = np.full((len(src), LABELS), -math.log(LABELS))
    for _ in range(ROUNDS if len(src) else 0):
        belief = score.copy()
        np.add.at(belief, dst, message)
        cavity = belief[src] - message[back]
        cavity = np.exp(cavity - cavity.max(axis=1, keepdims=True))
        new = np.einsum("ei,eij->ej", cavity, potential)
        new = np.log(new / new.sum(axis=1, keepdims=True) + 1e-30)
        change = np.abs(new - message).max()
        message = DAMPING * message + (1 - DAMPING) * new
        if change < 1e-4:
            break
    belief = score.copy()
    np.add.at(belief, dst, message)
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], model: Field) -> list[tuple[int, int, int]]:
    """Spans of nodes outside the base spans that the field labels, and whose similar nodes all have that kind: those in
    base spans, or, where a group has none there, those that repeat."""
    if not _DIGITS.search(text) and "@" not in text:
        return []
    tokens = tokens_of(text, base)
    groups: dict[str, list[int]] = {}
    for k, t in enumerate(tokens):
        if len(t.norm) >= LEAST:
            groups.setdefault(t.norm, []).append(k)
    groups = {n: g for n, g in groups.items() if len(g) > 1 and not all(tokens[k].label for k in g)}
    if not groups:
        return []
    p = marginals(tokens, model)
    out = []
    for members in groups.values():
        kinds = {tokens[k].label for k in members if tokens[k].label} or {int(p[k].argmax()) if p[k].max() >= SURE else 0 for k in members}
        for k in members:
            best = int(p[k].argmax())
            if not tokens[k].label and best and best in kinds and p[k][best] >= SURE and (len(kinds) == 1 or 0 not in kinds):
                out.append((best - 1, tokens[k].start, tokens[k].end))
    return out


def _chosen(text: str, nodes: list[int]) -> list[int]:
    """At most TOKENS of the nodes in order, by a hash from anywhere in the text."""
    if len(nodes) <= TOKENS:
        return nodes
    seed = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return sorted(sorted(nodes, key=lambda k: hashlib.blake2b(seed + k.to_bytes(8, "little"), digest_size=8).digest())[:TOKENS])


def _in_groups(digits: str, rng: random.Random) -> str:
    """The digits in one or more groups, as numbers are written."""
    by, cut = rng.choice(("", "", " ", "-", ".", "/")), []
    while digits:
        n = len(digits) if not by or len(digits) <= 4 else rng.choice((3, 4))
        cut, digits = [*cut, digits[:n]], digits[n:]
    return by.join(cut)


def _other_form(span: str, kind: int, rng: random.Random) -> str:
    if kind == 0:
        local, _, domain = span.rpartition("@")
        return rng.choice((f"{local} @ {domain}", f"{local}@ {domain}", f"{local} @{domain}", local + "@" + domain.replace(".", " . ")))
    if kind == 1:
        return rng.choice((" ", "-", "_", " . ")).join(span.split("."))
    digits = "".join(_DIGITS.findall(span))
    if kind == 3 and len(digits) > SUFFIX:
        digits = digits[-rng.randint(SUFFIX, len(digits)) :]
    return _in_groups(digits, rng)


def _unlike(form: str, rng: random.Random) -> str:
    """Other digits and letters in the same form."""
    return "".join(rng.choice("0123456789") if "0" <= c <= "9" else rng.choice("abcdefghijklmnopqrstuvwxyz") if "a" <= c <= "z" else c for c in form)


def _with_other_forms(text: str, base: list[tuple[int, int, int]]) -> tuple[str, dict[tuple[int, int], int]]:
    """The text with other forms of some spans and numbers unlike them, and the labels of what was put in, by place."""
    rng = random.Random(text)
    gaps = [m.start() for m in re.finditer(" ", text)]
    taken = sorted((a, b) for _, a, b in base)
    gaps = [g for g in rng.sample(gaps, min(len(gaps), 60)) if not any(a < g < b for a, b in taken)] or [len(text)]
    put: list[tuple[int, str, int]] = []
    for kind, a, b in rng.sample(base, min(AGAIN, len(base))):
        form = _other_form(text[a:b], kind, rng)
        put += [(rng.choice(gaps), form, kind + 1), (rng.choice(gaps), _unlike(_other_form(text[a:b], kind, rng), rng), 0)]
    parts, labels, at, shift = [], {}, 0, 0
    for g, form, label in sorted(put):
        parts += [text[at:g], " ", form, ","]
        labels[(g + shift + 1, g + shift + 1 + len(form))] = label
        at, shift = g, shift + len(form) + 2
    return "".join([*parts, text[at:]]), labels


def examples(text: str) -> tuple[list[Token], list[int]]:
    """The nodes of a text with other forms put in, and their labels: -1 where it isn't known."""
    text, made = _with_other_forms(text, base_spans(text))
    tokens = tokens_of(text, base_spans(text))
    taken = {t.norm for t in tokens if t.label and len(t.norm) >= LEAST}
    inside = lambda t: next((label for (a, b), label in made.items() if a <= t.start and t.end <= b), None)
    labels = []
    for t in tokens:
        given = inside(t)
        if t.label:
            labels.append(t.label)
        elif t.norm in taken and len(t.norm) >= LEAST:  # no pattern takes it, though it takes a similar one
            labels.append(given if given else -1)
        else:
            labels.append(0)
    return tokens, labels


def _learned(at: np.ndarray, label: np.ndarray, before: np.ndarray, after: np.ndarray, similar: np.ndarray) -> Field:
    """Weights by pseudo-likelihood: each node's label given those of its neighbours (-1: none known) and, counted by label, of its similar nodes."""
    model = Field(skip=np.zeros((LABELS, LABELS)))
    squares = [np.full_like(w, 1e-6) for w in (model.unary, model.chain, model.skip)]
    rng, order = np.random.default_rng(0), np.empty(0, np.int64)
    for _ in range(STEPS):
        if not len(order):
            order = rng.permutation(len(label))
        k, order = order[:BATCH], order[BATCH:]
        p, n = before[k], after[k]
        z = model.unary[at[k]].sum(axis=1) + np.where(p[:, None] >= 0, model.chain[p], 0) + np.where(n[:, None] >= 0, model.chain.T[n], 0) + similar[k] @ model.skip
        g = np.exp(z - z.max(axis=1, keepdims=True))
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(k)), label[k]] -= 1
        g /= len(k)
        unary, chain = np.zeros_like(model.unary), np.zeros_like(model.chain)
        np.add.at(unary, at[k], g[:, None, :])
        np.add.at(chain, p[p >= 0], g[p >= 0])
        np.add.at(chain.T, n[n >= 0], g[n >= 0])
        skip = similar[k].T @ g
        for w, square, step in zip((model.unary, model.chain, model.skip), squares, (unary, chain, skip + skip.T), strict=True):
            step = step + PENALTY * w * (step != 0)
            square += step * step
            w -= RATE * step / np.sqrt(square)
    return model


def train(docs: DataFrame, text: str = "text") -> Field:
    """Weights from the base spans of about SAMPLE distinct texts that have a digit or @, chosen by a hash, and of TOKENS nodes of each, from all over it."""
    rows = docs.select(F.col(f"`{text}`").alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = rows.select(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    # Copies count once: else a large group of them comes whole or not at all.
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE / max(1, n))).distinct()
    names, kinds = ["order", "at", "label", "before", "after", "similar"], [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                tokens, labels = examples(t)
                after = dict(_neighbours(tokens))
                before = {y: x for x, y in after.items()}
                similar = np.zeros((len(tokens), LABELS))
                for x, y in _ties(tokens):
                    for k, other in ((x, y), (y, x)):
                        if labels[other] >= 0:
                            similar[k, labels[other]] += 1
                order = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "little")
                of = lambda links, k: labels[links[k]] if k in links else -1
                out += [(order, _features(tokens, k), labels[k], of(before, k), of(after, k), np.minimum(similar[k], 2).tolist()) for k in _chosen(t, [k for k, x in enumerate(labels) if x >= 0])]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names)

    got = rows.mapInArrow(run, "order bigint, at array<int>, label int, before int, after int, similar array<double>").toArrow()
    if not got.num_rows:
        return Field()
    order = np.argsort(got["order"].to_numpy(), kind="stable")  # the nodes of a text come together, in their order
    of = lambda n: np.array(got[n].to_pylist())[order]
    return _learned(of("at"), of("label"), of("before"), of("after"), of("similar"))


def find_pii(docs: DataFrame, model: Field, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` in a struct ``row``, counts of the base spans by
    kind, ``base`` and ``spans``: arrays of (kind, start, end) by kind and
    start, in code points. A null text counts as empty; rows are judged each
    for itself, repeated or not, by their whole texts; an empty table gives
    one; other columns are dropped."""
    rows = packed(docs.select(*[F.col(f"`{k}`") for k in keep]), "row") if text in keep else None
    rows = rows.withColumn("text", F.col(f"row.`{text}`")) if rows is not None else docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for b in batches:
            base, every = [], []
            for t in b.column(1).to_pylist():
                spans = base_spans(t or "")
                base.append(listed(spans))
                every.append(listed(sorted(spans + added_spans(t or "", spans, model.value))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(every, span)], ["row", "base", "spans"])

    kind = "array<struct<kind:int,start:bigint,end:bigint>>"
    schema = rows.select("row").withColumns({"base": F.array().cast(kind), "spans": F.array().cast(kind)}).schema
    found = rows.mapInArrow(run, schema)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.withColumns({f"n_{name}": count(k) for k, name in enumerate(KINDS)})


def render(spans: str):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
