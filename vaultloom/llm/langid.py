"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased letters (any run of other characters is one space) are hashed into `buckets`
counts; a text is its log counts times inverse document frequency, scaled to length 1. Document frequencies cover every
learnable row and are summed per task before they are shuffled. Weights are fitted by follow-the-regularised-leader with
elastic-net penalties on a hash-chosen sample of about `per_language` rows of each language (the only sample here; its
bound is this parameter), whose feature counts, not texts, go to the driver; a fifth of it is kept to set the temperature
of the softmax. The model, buckets x languages floats, goes out with the tasks.

Defined results: null text and text without a letter get `und` and score 0; so does every text if there is no learnable row;
rows with null text or language aren't learned from; ids may repeat or be null (null counts as the empty text in splits);
other columns are kept or ignored as asked; an empty table gives no rows; texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, pieces

UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of a text's 1- to 3-grams; None if it has no letter. buckets is a power of two."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    a = codes * np.uint32(0x9E3779B1)
    two = (a[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + a[1:]
    three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + a[2:]
    hashed = np.concatenate((a * np.uint32(0x165667B1) >> shift, two * np.uint32(0x27220A95) >> shift, three * np.uint32(0x9E3779B1) >> shift))
    counts = np.bincount(hashed, minlength=buckets)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    temperature: float = 1.0

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts).astype(np.float32) * self.idf[found]
        return x / np.float32(math.sqrt(float((x * x).sum())) or 1.0)

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(found, counts) @ self.weights[found]

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = gram_counts(text, len(self.idf)) if text and self.languages else None
        if grams is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*grams) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, languages: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """FTRL-proximal over (buckets, values, language) rows: weights are solved from the sums z and n of their gradients."""
    z, n = np.zeros((buckets, languages)), np.zeros((buckets, languages))
    order = np.random.default_rng(7)

    def solve(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            found, x, y = rows[k]
            zs, ns = z[found], n[found]
            w = solve(zs, ns)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha
            z[found] = zs + g - sigma * w
            n[found] = ns + g * g
    return solve(z, n).astype(np.float32)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log likelihood, by golden section on its logarithm."""

    def loss(t: float) -> float:
        p = softmax(logits / math.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    low, high, ratio = -4.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def remainder(doc_id: str, by: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


def trained(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, held_out: int = 0, buckets: int = 1 << 15, per_language: int = 600) -> Model:
    """Learns from the rows whose crc32(doc_id) mod `folds` is not `held_out`."""
    known = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (remainder(doc_id, folds) != held_out))
    known = known.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(buckets, np.float32), np.zeros((buckets, 0), np.float32))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(buckets, np.int64), 0
        for b in pieces(batches, "text"):
            for t in b.column(0).to_pylist():
                grams = gram_counts(t, buckets)
                if grams is not None:
                    total[grams[0]] += 1
                    rows += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], rows))], ["bucket", "n"])

    sums = known.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counted = {r["bucket"]: r["n"] for r in sums}
    rows = counted.pop(-1, 0)
    idf = np.full(buckets, math.log(1 + rows) + 1, np.float32)
    for bucket, n in counted.items():
        idf[bucket] = math.log((1 + rows) / (1 + n)) + 1

    spread = 1 << 30
    rate = F.lit(0)
    for language, n in sizes.items():
        rate = F.when(F.col("lang") == language, int(spread * min(1.0, per_language / n))).otherwise(rate)
    key = F.xxhash64(F.lit("sample"), "doc_id")
    sample = known.where(F.pmod(key, F.lit(spread)) < rate).select("text", "lang", (F.pmod(F.shiftright(key, 32), F.lit(5)) == 0).alias("tune"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            grams = [gram_counts(t, buckets) for t in b.column(0).to_pylist()]
            b = b.filter(pa.array([g is not None for g in grams], pa.bool_()))
            grams = [g for g in grams if g is not None]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([g[0].astype("<u4").tobytes() for g in grams], pa.binary()), pa.array([g[1].astype("<u4").tobytes() for g in grams], pa.binary())], ["lang", "tune", "found", "counts"])

    got = sample.mapInArrow(features, "lang string, tune boolean, found binary, counts binary").toArrow()
    model = Model(languages, idf, np.zeros((buckets, len(languages)), np.float32))
    at = {language: k for k, language in enumerate(languages)}
    data = [(np.frombuffer(r["found"], "<u4").astype(np.int64), np.frombuffer(r["counts"], "<u4"), at[r["lang"]], r["tune"]) for r in got.to_pylist()]
    data.sort(key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))  # the tasks' order doesn't matter
    learn = [(f, model.vector(f, c).astype(np.float64), y) for f, c, y, tune in data if not tune] or [(f, model.vector(f, c).astype(np.float64), y) for f, c, y, _ in data]
    model.weights = follow_the_leader(learn, buckets, len(languages))
    tune = [(model.logits(f, c), y) for f, c, y, tune in data if tune]
    if tune:
        model.temperature = temperature(np.array([x for x, _ in tune], np.float64), np.array([y for _, y in tune]))
    return model


def identified(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The kept columns, and the predicted language and its calibrated probability under the given names."""
    plain = df.select(*keep, F.col(text).alias("_text"))
    types = ", ".join(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "_text"):
            found = [model.predict(t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*keep, pred, score])

    return plain.mapInArrow(run, f"{types}, `{pred}` string, `{score}` double")


def accepted(df: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df whose language is recognised with a probability of at least `least`; all its columns."""
    plain, names = numbered(df)
    marked = identified(plain, model, f"_c{names.index(text)}", tuple(plain.columns))
    return marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*plain.columns).toDF(*names)
