"""Language identification by sparse multinomial logistic regression.

Texts are TF-IDF vectors of character n-grams. The weights are trained with
follow-the-regularised-leader under elastic-net penalties; a temperature fitted
on rows kept from the training calibrates the probabilities. Document
frequencies are counted over all labelled rows; the weights are fitted on a
bounded sample of PER_LANGUAGE distinct texts a language, chosen by a hash of
the text, which also parts the rows for the temperature and orders the steps.

Any number of languages can be learned: up to CLASSES are the classes of one
regression. More are written as codes: a regression for each place of the code
tells its CLASSES values apart, two languages differ in one place at least, and
the language whose values have the best mean log-probability is predicted. So
weights and the state of the fit grow with the logarithm of the languages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

DIMS = 1 << 15
ORDERS = 3
#: Distinct texts a language for the fit, and texts in all, but at least about one a language; classes of one regression.
PER_LANGUAGE, IN_ALL, CLASSES = 300, 12_000, 256
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> tuple[np.ndarray, bool]:
    """Code points of the lowered text with a space for each run of other characters than letters, and whether there are letters."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[a]
    if not letter.any():
        return a[:0], False
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter stands for its run
    a = np.where(letter, a, np.uint32(32))[keep]
    space = np.array([32], np.uint32)
    return np.concatenate([space, a] if a[-1] == 32 else [space, a, space]), True


def _counts(a: np.ndarray) -> np.ndarray:
    h, parts = a * np.uint32(0x9E3779B1), []
    for order in range(ORDERS):
        parts.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(17))
        if order + 1 < ORDERS:
            h = (h[:-1] + np.uint32(order + 1)) * np.uint32(0x01000193) ^ a[order + 1 :] * np.uint32(0xC2B2AE35)
    return np.bincount(np.concatenate(parts), minlength=DIMS)


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(math.sqrt(float(x @ x)), 1e-12)


def codes_of(languages: int, classes: int) -> np.ndarray:
    """A code of classes for each language, one column a regression: the number
    itself if it is a class, else its digits to the base ``classes`` and as
    many hashes of it, which make a wrong digit weigh less."""
    number = np.arange(languages, dtype=np.uint64)
    if languages <= classes:
        return number.astype(np.int64)[:, None]
    digits, rest = [], number
    while not digits or rest.any():
        digits.append(rest % classes)
        rest = rest // classes
    hashes = [((number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * i + 3) >> np.uint64(33)) % classes for i in range(len(digits))]
    return np.stack(digits + hashes, axis=1).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    codes: np.ndarray  # languages x regressions: their classes
    weights: list[np.ndarray]  # of each regression: DIMS x classes, mostly zero
    bias: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A score of each language: its logit, or the mean log-probability of its code's classes."""
        found = [x @ w[at] + b for w, b in zip(self.weights, self.bias, strict=True)]
        if len(found) == 1:
            return found[0][self.codes[:, 0]]
        return sum(np.log(np.maximum(_softmax(z), 1e-30))[self.codes[:, i]] for i, z in enumerate(found)) / len(found)

    def predict(self, text: str | None) -> tuple[str, float]:
        a, any_letter = _codes(text or "")
        if not any_letter or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*_vector(_counts(a), self.idf)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias: per-coordinate follow-the-regularised-leader steps."""
    z, n = np.zeros((DIMS + 1, languages)), np.zeros((DIMS + 1, languages))

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) > L1, w, 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, DIMS), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = np.concatenate([weights(np.arange(i, min(i + 1024, DIMS + 1))).astype(np.float32) for i in range(0, DIMS + 1, 1024)])
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section."""

    def loss(log_t):
        z = logits / math.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).mean())

    a, b, r = math.log(0.01), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def _excerpts(text: str, salt: int) -> list[str]:
    """The whole text and two short windows of it, for short texts to be learned too."""
    out = [text]
    for k, size in enumerate((30, 120)):
        if len(text) > 2 * size:
            at = (salt * 2654435761 + k * 40503) % (len(text) - size)
            out.append(text[at : at + size])
    return out


def train(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang") -> Model:
    """Learns from rows of ``docs`` where ``may_learn`` holds, and text and lang are not null.

    Only text and lang are learned from; repeated rows count as often as they
    come in the document frequencies and once in the fit. Without such rows
    the model knows no language. Very long texts are learned from whole, with
    two short windows. Other columns are ignored. The driver holds the names of
    the languages, the sample, one regression's state (134 MB at most) and the weights of all.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.coalesce(may_learn, F.lit(False)).alias("may")).where("may and text is not null and lang is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("texts")).collect()
    count = {r["lang"]: max(1, r["texts"]) for r in found}
    languages = sorted(count)
    if not languages:
        return Model([], np.ones(DIMS), codes_of(0, CLASSES), [np.zeros((DIMS, 0))], [np.zeros(0)])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                a, any_letter = _codes(t)
                if any_letter:
                    seen += _counts(a) > 0
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["k", "n"])

    total = sum(r["n"] for r in found)
    found = rows.select("text").mapInArrow(frequencies, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(DIMS)
    frequency[found["k"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + total) / (1 + frequency)) + 1

    each = max(1, min(PER_LANGUAGE, IN_ALL // len(languages)))
    shares = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(languages, pa.string()), "share": pa.array([min(1.0, each / count[k]) for k in languages])}))
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod("hash", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("text", "lang", "hash").distinct()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, k, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for i, part in enumerate(_excerpts(t, h)):
                    a, any_letter = _codes(part)
                    if any_letter:
                        counts = _counts(a)
                        at = np.flatnonzero(counts)
                        out.append((k, h, i, at.astype(np.int32), counts[at].astype(np.int32)))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], ["lang", "hash", "part", "at", "n"])

    sample = chosen.mapInArrow(vectors, "lang string, hash bigint, part int, at array<int>, n array<int>").toArrow().sort_by([("hash", "ascending"), ("lang", "ascending"), ("part", "ascending")])
    number = {k: i for i, k in enumerate(languages)}
    fit, kept = [], []
    for k, h, at, n in zip(sample["lang"].to_pylist(), sample["hash"].to_pylist(), sample["at"], sample["n"], strict=True):
        at, n = at.values.to_numpy(), n.values.to_numpy()
        x = (1 + np.log(n)) * idf[at]
        (kept if h % 5 == 1 else fit).append((at, x / np.linalg.norm(x), number[k]))
    codes = codes_of(len(languages), CLASSES)
    fits = [fit_ftrl([(at, x, int(code[y])) for at, x, y in fit or kept], int(code.max()) + 1) for code in codes.T]
    model = Model(languages, idf.astype(np.float32), codes, [w for w, _ in fits], [b for _, b in fits])
    if kept:
        model.temperature = fit_temperature(np.array([model.logits(at, x) for at, x, _ in kept]), np.array([y for _, _, y in kept]))
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all) in a struct ``row``, with lang_pred and score.

    A null text or one without a letter is ``und`` with score 0. Rows are
    judged each for itself by their whole text alone, of languages that tie the
    first by name; an empty table gives one.
    """
    rows = packed(docs if keep is None else docs.select(*[F.col(f"`{k}`") for k in keep]), "row")
    if keep is not None and text not in keep:
        rows = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    else:
        rows = rows.withColumn("text", F.col(f"row.`{text}`"))
    model = docs.sparkSession.sparkContext.broadcast(model)  # DIMS * CLASSES weights a regression at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["row", "lang_pred", "score"])

    schema = rows.select("row").withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).schema
    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; so for null ids, which nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))
