"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed character 1- to 3-grams of the whole lower-cased text (everything that is no letter
is a space), weighted by logarithmic term frequency and inverse document frequency and
scaled to unit length. Document frequencies are counted over all learnable documents; the weights are
fitted by follow-the-regularised-leader with elastic-net penalties on a bounded sample of them,
and one temperature is then calibrated on a part of the sample that the fit has not seen.

Defined results: null text, and text without a letter, is `und` with score 0; so is every
text if nothing can be learned from; rows with null lang teach nothing; equal scores go
to the first language in sorted order; repeated rows get equal rows; an empty table gives no rows; other
columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import materialise, text_slices, tidied, tidy

DIM = 1 << 13
#: Documents from which the weights are fitted and the temperature is calibrated, at most, and bytes of their texts.
SAMPLE, BYTES = 6_000, 48 << 20
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document may not be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            low = c.lower()
            table[p] = ord(low) if len(low) == 1 else p
    return table


def grams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term counts (one row per text) and whether a text has a letter."""
    n = len(offsets) - 1
    points = _letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(lead, offsets)
    one = points * np.uint32(0x9E3779B1)
    two = (points[:-1] * np.uint32(0x85EBCA6B)) ^ (one[1:] >> np.uint32(3))
    three = (two[:-1] * np.uint32(0xC2B2AE35)) ^ (one[2:] >> np.uint32(5))
    ids = [((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(19) for x in (one, two * np.uint32(0x27D4EB2F), three)]
    counts = np.zeros((n, DIM), np.int32)
    some = np.zeros(n, bool)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b > a:
            some[i] = bool((points[a:b] != 32).any())
            joined = np.concatenate([x[a : max(a, b - k)] for k, x in enumerate(ids)])
            counts[i] = np.bincount(joined, minlength=DIM)
    return counts, some


#: Texts whose dense counts are held at a time.
ROWS = 64


def gram_runs(offsets: np.ndarray, data: np.ndarray):
    """grams() of at most ROWS texts at a time."""
    for a in range(0, len(offsets) - 1, ROWS):
        some = offsets[a : a + ROWS + 1]
        yield grams(some - some[0], data[some[0] : some[-1]])


#: log(1 + count); larger counts are rare and computed.
_LOG = np.log1p(np.arange(1 << 12)).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = _LOG[np.minimum(counts, len(_LOG) - 1)]
    if counts.size and counts.max() >= len(_LOG):
        large = counts >= len(_LOG)
        x[large] = np.log1p(counts[large])
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    return x


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return weighted(counts, self.idf) @ self.weights + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return softmax(self.logits(counts) / self.temperature)

    def judge(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text of a run the likeliest language, its probability (0 without a letter) and whether it has a letter."""
        best, score, some = [], [], []
        for counts, letters in gram_runs(offsets, data):
            p = self.probabilities(counts)
            best.append(p.argmax(axis=1))
            score.append(np.where(letters, p.max(axis=1), 0.0).astype(np.float64))
            some.append(letters)
        return np.concatenate(best), np.concatenate(score), np.concatenate(some)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


Sparse = list[tuple[np.ndarray, np.ndarray]]


def dense(rows: Sparse) -> np.ndarray:
    x = np.zeros((len(rows), DIM), np.float32)
    for i, (at, value) in enumerate(rows):
        x[i, at] = value
    return x


def ftrl(rows: Sparse, y: np.ndarray, k: int, epochs: int = 6, batch: int = 16, alpha: float = 0.6, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, seed: int = 3):
    """Weights and bias by per-coordinate FTRL-proximal on the multinomial log loss."""
    z = np.zeros((DIM + 1, k), np.float32)
    g2 = np.zeros_like(z)
    penalty = np.full((DIM + 1, 1), l1, np.float32)
    penalty[-1] = 0  # the bias is free

    def weights():
        w = -(z - np.sign(z) * penalty) / ((beta + np.sqrt(g2)) / alpha + l2)
        return np.where(np.abs(z) <= penalty, 0, w).astype(np.float32)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            x = np.hstack([dense([rows[j] for j in some]), np.ones((len(some), 1), np.float32)])
            w = weights()
            p = softmax(x @ w)
            p[np.arange(len(some)), y[some]] -= 1
            g = x.T @ p / len(some) * 4
            sigma = (np.sqrt(g2 + g * g) - np.sqrt(g2)) / alpha
            z += g - sigma * w
            g2 += g * g
    w = weights()
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the smallest log loss."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 80))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def texts_counts(texts: list) -> Sparse:
    """Features and counts of each text."""
    out = []
    for _, _, offsets, data in text_slices(pa.array(texts, pa.string()), 1 << 20):
        for counts, _ in gram_runs(offsets, data):
            for row in counts:
                at = np.flatnonzero(row)
                out.append((at.astype(np.int16), row[at]))
    return out


def fit(texts: list, langs: list[str], frequency: np.ndarray | None = None, total: int = 0) -> Model | None:
    """A model of the sampled texts; document frequencies from all of `total` documents, if given."""
    names = sorted(set(langs))
    if not names:
        return None
    rows = texts_counts(texts)
    if frequency is None:
        frequency, total = np.zeros(DIM), len(rows)
        for at, _ in rows:
            frequency[at] += 1
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32)
    for i, (at, count) in enumerate(rows):
        x = np.log1p(count).astype(np.float32) * idf[at]
        rows[i] = (at, x / max(1e-9, float(np.sqrt((x * x).sum()))))
    y = np.array([names.index(x) for x in langs])
    order = np.random.default_rng(11).permutation(len(y))
    kept = order[: len(order) // 5] if len(order) >= 50 else order[:0]
    fitted = order[len(kept) :]
    weights, bias = ftrl([rows[i] for i in fitted], y[fitted], len(names))
    logits = [dense([rows[i] for i in kept[j : j + 64]]) @ weights + bias for j in range(0, len(kept), 64)]
    model = Model(names, idf, weights, bias)
    if logits:
        model.temperature = calibrate(np.concatenate(logits), y[kept])
    return model


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs, and their number."""

    def rows(batches):
        seen, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for _, _, offsets, data in text_slices(batch.column(0), 1 << 20):
                for counts, _ in gram_runs(offsets, data):
                    seen += (counts > 0).sum(axis=0)
                n += len(offsets) - 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["feature", "n"])

    found = docs.select("text").mapInArrow(tidied(rows), "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    frequency, total = np.zeros(DIM), 0
    for feature, n in found:  # DIM + 1 rows at most
        if feature < 0:
            total = n
        else:
            frequency[feature] = n
    return frequency, total


def sample(docs: DataFrame, columns: list[str], most: int, seed: int = 41, most_bytes: int = BYTES) -> list:
    """`most` rows at most, of so many bytes of text at most, the same ones for the same rows: those of the smallest seeded hashes.

    Hashes and lengths alone are ranked first, so that texts reach the driver only of the rows that are taken,
    however many rows share an identifier or have none.
    """
    at = F.xxhash64(F.lit(seed), "doc_id")
    bound = docs.select(at.alias("at")).orderBy("at").limit(most).agg(F.max("at")).first()[0]
    if bound is None:
        return []
    near = docs.where(at <= bound).select(*columns, at.alias("at"), F.xxhash64(*columns).alias("tie"))
    near = materialise(near, "sample")
    ranked = near.select("at", "tie", F.octet_length(columns[0]).alias("bytes")).orderBy("at", "tie").limit(most).collect()
    taken, total = 0, 0
    while taken < len(ranked) and (not taken or total + ranked[taken]["bytes"] <= most_bytes):
        total += ranked[taken]["bytes"]
        taken += 1
    last = (ranked[taken - 1]["at"], ranked[taken - 1]["tie"])
    upto = (F.col("at") < last[0]) | ((F.col("at") == last[0]) & (F.col("tie") <= last[1]))
    found = near.where(upto).orderBy("at", "tie").limit(taken).toLocalIterator()
    return [tuple(r)[:-2] for r in found]


def train(docs: DataFrame, most: int = SAMPLE) -> Model | None:
    learnable = docs.where(~held_out()).where("lang is not null and text is not null")
    rows = sample(learnable, ["text", "lang"], most)
    if not rows:
        return None
    frequency, total = frequencies(learnable)
    model = fit([r[0] for r in rows], [r[1] for r in rows], frequency, total)
    del rows
    tidy()  # the driver lives on too
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights a language

    def rows(batches):
        model = sent.value
        for batch in batches:
            for lo, hi, offsets, data in text_slices(batch.column(2), 1 << 20):
                n = hi - lo
                if model is None:
                    names, scores = [UNKNOWN] * n, np.zeros(n)
                else:
                    best, scores, some = model.judge(offsets, data)
                    names = [model.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(names, pa.string()), pa.array(scores)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return docs.mapInArrow(tidied(rows), "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def accepted(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """docs without those that have no letter or of whose language the model is less than `least` sure.

    Texts alone go to Python and a flag comes back.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))

    def sure(text: pa.Array) -> pa.Array:
        model, keep = sent.value, np.zeros(len(text), bool)
        if model is not None:
            for lo, hi, offsets, data in text_slices(text, 1 << 20):
                _, scores, some = model.judge(offsets, data)
                keep[lo:hi] = some & (scores >= least)
        tidy()
        return pa.array(keep)

    return docs.where(F.arrow_udf(sure, T.BooleanType())("text"))
