"""Toxicity: a convolutional text classifier over hashed word embeddings.

Each word is the sum of three learned vectors: that of the hashed word and those of its hashed first
four and five bytes, which carry the stem of inflected forms. Filters over one, two and three
neighbouring words are max-pooled over the whole text; a logistic layer gives the logit.
All of it is trained by back-propagation in numpy on all labelled documents that may be learned from.

These are dealt to shards by their identifiers. Every round each shard goes on from the same parameters, by
Adam over its own documents, and the shards' results are averaged by documents; an embedding row is averaged over
those shards alone that have met its word. A single shard runs through in one round.

Thresholds are calibrated by language on the fifth of the documents that the fit leaves out, counted by logits in steps
of 1/1024. The language is predicted from the text by a classifier of its own (see langid), averaged over the same shards, so
that no column but the text enters a score; the score moves each language's threshold to 0.3.

Defined results: null and empty texts are scored as texts without words; a text's score depends on that text alone
(up to the rounding of single precision); without a positive and a negative
label to learn from every score is 0; labels of rows without a document, and null labels, teach
nothing; of repeated labels each counts, with one of the texts that share the doc_id; repeated documents get equal scores; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import langid
from shelfmark.llm.common import bounded, discard, materialise, small_batches, text_slices, tidied, word_hashes

BUCKETS, STEMS, WIDTH, FILTERS, SPANS = 1 << 15, 1 << 14, 8, 8, (1, 2, 3)
#: Labelled documents of a shard, about, and bytes of texts that a task learns from at a time; nothing is left out.
SHARD, BYTES = 4_096, 16 << 20
#: Epochs of a single shard; rounds, and epochs in each, of several.
EPOCHS, ROUNDS, LOCAL = 12, 3, 2
THRESHOLD = 0.3
#: Rows of the embedding table: words, stems of four and five bytes, and a zero row between texts.
ROWS = BUCKETS + 2 * STEMS + 1
PAD = ROWS - 1


def tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the words of a run of texts, (n, 3), two pads after each text; where texts begin."""
    names, stems, first = word_hashes(offsets, data, (4, 5))
    rows = np.empty((len(names), 3), np.int32)
    rows[:, 0] = (names >> np.uint64(64 - 15)).astype(np.int32)
    for k, stem in enumerate(stems):
        rows[:, k + 1] = BUCKETS + k * STEMS + (stem >> np.uint64(64 - 14)).astype(np.int32)
    n = len(offsets) - 1
    count = np.diff(first)
    begin = first[:-1] + 2 * np.arange(n)
    out = np.full((len(names) + 2 * n, 3), PAD, np.int32)
    out[np.arange(len(names)) + 2 * np.repeat(np.arange(n), count)] = rows
    return out, np.append(begin, len(out))


def _starting(seed: int):
    rng = np.random.default_rng(seed)
    p = {"embed": (rng.standard_normal((ROWS, WIDTH)) * 0.02).astype(np.float32)}
    p["embed"][PAD] = 0
    for w in SPANS:
        p[f"filter{w}"] = (rng.standard_normal((w, WIDTH, FILTERS)) * 0.4).astype(np.float32)
        p[f"bias{w}"] = np.zeros(FILTERS, np.float32)
    p["out"] = np.abs(rng.standard_normal(FILTERS * len(SPANS)) * 0.3).astype(np.float32)
    p["last"] = np.zeros(1, np.float32)
    return p


def forward(p: dict, rows: np.ndarray, begin: np.ndarray, keep: bool = False):
    """Logits of the texts; with keep also what the gradient needs."""
    x = p["embed"][rows[:, 0]] + p["embed"][rows[:, 1]] + p["embed"][rows[:, 2]]
    pooled, where = [], []
    for w in SPANS:
        # a text's windows end with its pads: none that would reach into the next text is pooled, and a text
        # without words has no window of three, whose filters give 0
        y = x @ p[f"filter{w}"][0]
        for j in range(1, w):
            y[:-j] += x[j:] @ p[f"filter{w}"][j]
        for j in range(1, w):
            y[begin[1:] - j] = -np.inf
        pooled.append(np.maximum.reduceat(y, begin[:-1], axis=0) + p[f"bias{w}"])
        if keep:
            where.append(np.stack([a + y[a:b].argmax(axis=0) for a, b in zip(begin[:-1], begin[1:])]))
    h = np.maximum(np.concatenate(pooled, axis=1), 0)
    logit = h @ p["out"] + p["last"]
    return (logit, h, where) if keep else logit


def _gradient(p: dict, rows: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray):
    logit, h, where = forward(p, rows, begin, keep=True)
    d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / len(y)).astype(np.float32)
    g = {"out": h.T @ d, "last": np.array([d.sum()], np.float32)}
    dh = np.outer(d, p["out"]) * (h > 0)
    at, grads = [], []
    for i, w in enumerate(SPANS):
        dy = dh[:, i * FILTERS : (i + 1) * FILTERS]
        g[f"bias{w}"] = dy.sum(axis=0)
        g[f"filter{w}"] = np.zeros_like(p[f"filter{w}"])
        for j in range(w):
            # a text without words has no window of three; its gradient there is 0
            some = rows[np.minimum(where[i] + j, len(rows) - 1)]  # (texts, filters, 3)
            x = p["embed"][some].sum(axis=2)
            g[f"filter{w}"][j] = np.einsum("tf,tfd->df", dy, x)
            at.append(some.reshape(-1, 3))
            grads.append((dy[:, :, None] * p[f"filter{w}"][j].T[None]).reshape(-1, WIDTH))
    return g, np.concatenate(at), np.concatenate(grads)


def opening(seen: np.ndarray, size: np.ndarray, seed: int = 9) -> dict:
    """Parameters to begin with: the first embedding direction is the log odds of the word's documents.

    seen counts the documents of either class with each embedding row, size those of either class.
    """
    p = _starting(seed)
    share = (seen + 0.5) / (size[:, None] + 1)
    odds = np.log(share[1] / share[0]) * np.minimum(1, seen.sum(axis=0) / 4)
    p["embed"][:, 0] += (0.2 * np.clip(odds, -3, 3)).astype(np.float32)
    p["embed"][PAD] = 0
    return p


def fit(p: dict, rows: list, y: np.ndarray, weight: np.ndarray, epochs: range, of: int, batch: int = 32, rate: float = 0.02, seed: int = 9):
    """Parameters after some of `of` epochs by Adam, and the embedding rows met; rows that a batch does not touch stay as they are."""
    p = {k: x.copy() for k, x in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    met = np.zeros(ROWS, bool)
    rng, step = np.random.default_rng([seed, epochs.start]), 0
    for epoch in epochs:
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            begin = np.append(0, np.cumsum([len(rows[k]) for k in some]))
            g, at, grads = _gradient(p, np.concatenate([rows[k] for k in some]), begin, y[some], weight[some])
            step += 1
            lr = rate * (1 - epoch / of) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, x in g.items():
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.001 * (x * x - v[k])
                p[k] -= lr * m[k] / (np.sqrt(v[k]) + 1e-7)
            ids, back = np.unique(at.ravel(), return_inverse=True)
            total = np.zeros((len(ids), WIDTH), np.float32)
            np.add.at(total, back, np.repeat(grads, 3, axis=0))
            total += 1e-5 * p["embed"][ids]
            m["embed"][ids] += 0.1 * (total - m["embed"][ids])
            v["embed"][ids] += 0.001 * (total * total - v["embed"][ids])
            p["embed"][ids] -= lr * m["embed"][ids] / (np.sqrt(v["embed"][ids]) + 1e-7)
            p["embed"][PAD] = 0
            met[ids] = True
    return p, met


@dataclass
class Model:
    parameters: dict
    langs: langid.Model | None
    #: Logit at which a text of a language counts as toxic; None: any other.
    thresholds: dict = field(default_factory=dict)
    scale: float = 1.0

    def languages(self, offsets, data) -> list:
        if self.langs is None:
            return [None] * (len(offsets) - 1)
        out = []
        for counts, some in langid.gram_runs(offsets, data):
            best = self.langs.logits(counts).argmax(axis=1)
            out += [self.langs.langs[b] if s else None for b, s in zip(best.tolist(), some.tolist())]
        return out

    def scores(self, offsets, data) -> np.ndarray:
        logit = forward(self.parameters, *tokens(offsets, data)).astype(np.float64)
        middle = self.thresholds[None]
        at = np.array([self.thresholds.get(x, middle) for x in self.languages(offsets, data)])
        z = (logit - at) * self.scale + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def best_threshold(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Midway in the widest of the gaps between logits at which the F1 measure is best."""
    order = np.argsort(-logit, kind="stable")
    z, w, t = logit[order], weight[order], y[order]
    hit, said = np.cumsum(w * t), np.cumsum(w)
    f1 = 2 * hit / (said + (w * t).sum())
    last = np.append(z[1:] != z[:-1], True)
    after = np.append(z[1:], z[-1] - 1)
    good = np.flatnonzero(last & (f1 >= f1[last].max() - 1e-9))
    k = good[np.argmax(z[good] - after[good])]
    return float((z[k] + after[k]) / 2)


@dataclass
class Chunk:
    """Labelled documents of one shard: texts, languages, labels of either class, and whether they calibrate."""

    texts: list
    langs: list
    labels: np.ndarray
    kept: np.ndarray

    def tokens(self, which: np.ndarray) -> list:
        rows = []
        for _, _, offsets, data in text_slices(pa.array([self.texts[i] for i in which], pa.string())):
            got, begin = tokens(offsets, data)
            rows += [got[a:b] for a, b in zip(begin[:-1], begin[1:])]
        return rows

    def spoken(self) -> tuple[list, list]:
        """Texts that teach a language, and theirs."""
        some = [i for i, lang in enumerate(self.langs) if lang is not None and self.texts[i]]
        return [self.texts[i] for i in some], [self.langs[i] for i in some]


def _chunks(batches):
    """The shards of a task, in order, each with its number; one of more than BYTES comes in parts."""
    shard, held, size = None, [], 0
    close = lambda: Chunk([r[1] for r in held], [r[2] for r in held], np.array([r[3:5] for r in held], float), np.array([r[5] for r in held], bool))
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            n = len(r[1]) * 2  # about its bytes
            if held and (r[0] != shard or size + n > 2 * BYTES):
                yield shard, close()
                held, size = [], 0
            shard, size = r[0], size + n
            held.append(r)
    if held:
        yield shard, close()


#: Values of a vector that are summed together.
BLOCK = 1 << 14


def _summed(table: DataFrame, work) -> np.ndarray | None:
    """The sum of the vectors (single precision) that work() makes of the chunks; None without any.

    Tasks add up theirs, then blocks of all tasks are added, in order of shards so that the sum is the same each time.
    """

    def rows(batches):
        total, first = None, None
        for shard, chunk in _chunks(batches):
            v = work(chunk).astype(np.float64)
            total, first = (v, shard) if total is None else (total + v, first)
        if total is not None:
            total = total.astype(np.float32)
            parts = [total[a : a + BLOCK].tobytes() for a in range(0, len(total), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([first] * len(parts), pa.int64()), pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary())], ["first", "block", "part"]
            )

    def add(found: pa.Table) -> pa.Table:
        found = found.sort_by("first")
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in found["part"])
        return pa.table({"block": found["block"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    parts = table.mapInArrow(tidied(rows), "first bigint, block int, part binary")
    found = sorted(parts.groupBy("block").applyInArrow(add, "block int, part binary").collect())
    return np.concatenate([np.frombuffer(r["part"], np.float64) for r in found]) if found else None


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """All documents with labels that may be learned from, written in order of shards: shard, text, lang, labels 0, labels 1, kept, at.

    Of documents that share an identifier one text counts. kept marks the fifth that calibrates, if there are enough.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where(~langid.held_out()).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1"))
    n, negative, positive = known.agg(F.count("*"), F.count_if(F.col("n0") > 0), F.count_if(F.col("n1") > 0)).first()
    if not negative or not positive:
        return None
    shards = -(-n // SHARD)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang").where(~langid.held_out())
    own = own.join(bounded(known, n), "doc_id").withColumn("shard", F.pmod(F.xxhash64(F.lit(43), "doc_id"), F.lit(shards)))
    own = own.repartition(shards, "shard").groupBy("shard", "doc_id", "n0", "n1").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("own"))
    kept = (F.pmod(F.xxhash64(F.lit(44), "doc_id"), F.lit(5)) == 4) & F.lit(positive >= 20)
    own = own.select("shard", "own.text", "own.lang", "n0", "n1", kept.alias("kept"), F.xxhash64(F.lit(45), "doc_id").alias("at"))
    return materialise(own.sortWithinPartitions("shard", "at"), "toxic-labelled")


def _languages(table: DataFrame, frequency: np.ndarray, total: int) -> langid.Model | None:
    """A classifier of the languages, fitted in each shard and averaged."""
    names = sorted(r[0] for r in table.where("lang is not null and text <> ''").select("lang").distinct().collect())
    if not names:
        return None
    idf = (np.log((1 + total) / (1 + frequency)) + 1).astype(np.float32)

    def work(chunk):
        texts, langs = chunk.spoken()
        if not texts:
            return np.zeros((langid.DIM + 1) * len(names) + 1)
        rows = []
        for at, count in langid.texts_counts(texts):
            x = np.log1p(count).astype(np.float32) * idf[at]
            rows.append((at, x / max(1e-9, float(np.sqrt((x * x).sum())))))
        place = {x: i for i, x in enumerate(names)}
        weights, bias = langid.ftrl(rows, np.array([place[x] for x in langs]), len(names))
        return np.concatenate([weights.ravel(), bias, [1.0]]) * len(texts)

    found = _summed(table, work)
    weights = (found[:-1] / found[-1]).reshape(langid.DIM + 1, len(names)).astype(np.float32)
    return langid.Model(names, idf, weights[:-1], weights[-1])


def _counted(chunk: Chunk) -> np.ndarray:
    """Documents of either class with each embedding row; of either class; chunks; documents with each gram; documents of a known language."""
    fitted = np.flatnonzero(~chunk.kept)
    seen = np.zeros((2, ROWS))
    for r, n in zip(chunk.tokens(fitted), chunk.labels[fitted]):
        seen[:, np.unique(r)] += n[:, None]
    frequency, texts = np.zeros(langid.DIM), chunk.spoken()[0]
    for at, _ in langid.texts_counts(texts):
        frequency[at] += 1
    return np.concatenate([seen.ravel(), chunk.labels[fitted].sum(axis=0), [1], frequency, [len(texts)]])


def _round(table: DataFrame, p: dict, size: np.ndarray, epochs: range, of: int) -> dict:
    """Parameters after a round: those of all shards, averaged by documents."""
    sent = table.sparkSession.sparkContext.broadcast(p)
    rest = [k for k in sorted(p) if k != "embed"]

    def work(chunk):
        before, docs = sent.value, np.flatnonzero(~chunk.kept)
        at, y = np.nonzero(chunk.labels[docs])  # a document with labels of both classes counts in both
        if not len(at):
            return np.zeros(ROWS * (WIDTH + 1) + sum(before[k].size for k in rest) + 1)
        tokens = chunk.tokens(docs)
        weight = (chunk.labels[docs[at], y] * 0.5 * size.sum() / size[y]).astype(np.float32)
        after, met = fit(before, [tokens[i] for i in at], y.astype(np.float32), weight, epochs, of)
        vectors = [(after["embed"] - before["embed"]).ravel(), met, *[after[k].ravel() for k in rest], [1.0]]
        return np.concatenate(vectors) * len(at)

    found = _summed(table, work)
    sent.unpersist()
    met = found[ROWS * WIDTH : ROWS * (WIDTH + 1)]
    out = {"embed": (p["embed"] + found[: ROWS * WIDTH].reshape(ROWS, WIDTH) / np.maximum(met, 1)[:, None]).astype(np.float32)}
    at = ROWS * (WIDTH + 1)
    for k in rest:
        out[k] = (found[at : at + p[k].size] / found[-1]).reshape(p[k].shape).astype(np.float32)
        at += p[k].size
    return out


#: Steps of a logit, and logits beyond which all count as one.
STEPS, FAR = 1024, 64


def _logits(table: DataFrame, model: Model, kept: bool) -> list:
    """(language predicted, logit, label, documents) of the documents that calibrate, or of all."""
    sent = table.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        model = sent.value
        for _, chunk in _chunks(batches):
            some = np.flatnonzero(chunk.kept) if kept else np.arange(len(chunk.texts))
            for lo, hi, offsets, data in text_slices(pa.array([chunk.texts[i] for i in some], pa.string())):
                logit = forward(model.parameters, *tokens(offsets, data)).astype(np.float64)
                step = np.rint(np.clip(logit, -FAR, FAR) * STEPS).astype(np.int32)
                n = chunk.labels[some[lo:hi]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(model.languages(offsets, data), pa.string()), pa.array(step), pa.array(n[:, 0]), pa.array(n[:, 1])], ["lang", "step", "n0", "n1"])

    found = table.mapInArrow(tidied(rows), "lang string, step int, n0 bigint, n1 bigint").groupBy("lang", "step").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return [(r["lang"], r["step"] / STEPS, t, n) for r in found.orderBy("lang", "step").collect() for t, n in ((0, r["n0"]), (1, r["n1"])) if n]


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    with small_batches(docs.sparkSession):
        table = labelled(docs, labels)
        if table is None:
            return None
        try:
            return _trained(table)
        finally:
            discard(table)


def _trained(table: DataFrame) -> Model | None:
    size = np.zeros(2)
    for every in (False, True):
        if not size.all():  # few labels have a document: all of these are fitted to, then
            table = table.withColumn("kept", F.lit(False)) if every else table
            counted = _summed(table, _counted)
            if counted is None:
                return None
            seen, size, chunks, frequency, spoken = np.split(counted, [2 * ROWS, 2 * ROWS + 2, 2 * ROWS + 3, len(counted) - 1])
    if not size.all():
        return None
    p = opening(seen.reshape(2, ROWS), size)
    rounds, local = (1, EPOCHS) if chunks[0] == 1 else (ROUNDS, LOCAL)
    for k in range(rounds):
        p = _round(table, p, size, range(k * local, (k + 1) * local), rounds * local)
    model = Model(p, _languages(table, frequency, int(spoken[0])))
    judged = _logits(table, model, True)
    if len({t for _, _, t, _ in judged}) < 2:
        judged = _logits(table, model, False)
    spoken, logit, t, weight = (np.array(x) for x in (np.array([r[0] for r in judged], object), *([r[i] for r in judged] for i in (1, 2, 3))))
    middle = model.thresholds[None] = best_threshold(logit, t, weight)
    away = np.abs(logit - middle)
    order = np.argsort(away, kind="stable")
    half = np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)
    model.scale = 3.0 / max(1e-3, float(away[order][half]))
    for name in sorted({x for x in spoken if x is not None}):
        some = spoken == name
        n = weight[some & (t == 1)].sum()
        if n >= 10 and weight[some & (t == 0)].sum() >= 10:
            model.thresholds[name] = float((best_threshold(logit[some], t[some], weight[some]) * n + middle * 10) / (n + 10))
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # the size of the tables, whatever the input

    def rows(batches):
        model = sent.value
        for batch in batches:
            for lo, hi, offsets, data in text_slices(batch.column(2)):
                s = model.scores(offsets, data) if model is not None else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), langid.held_out().alias("held_out"), "text")
    return docs.mapInArrow(tidied(rows), "doc_id bigint, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
