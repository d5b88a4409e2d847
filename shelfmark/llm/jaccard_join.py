"""Exact Jaccard self-join of word n-gram sets by universe partitioning and pigeonhole.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text's set holds its distinct runs of five
words, or its whole word sequence if it has fewer. Sets link at Jaccard similarity of 80 % or more.

Sets x and y of similarity p % or more differ in at most (100 - p) (|x| + |y|) / (100 + p)
elements. Hashing deals the universe into m segments, m fixed by size band; a set is looked up
in its own band and in the lower bands that can hold a partner.

* In bands of short sets a segment is indexed with all its one-deletion neighbours, so that segments which
  differ by one element still meet: a whole segment is worth two differing elements, its exact key one.
* In bands of long sets m exceeds the largest number of differing elements, and segments meet when equal.

Which segments to pay for is decided by cost: m leaves a surplus, for which each set gives up keys, those of
empty segments first and then those that most sets have, by their counted frequency. A short set gives up the
deletions of a segment for one, the segment for two. The rarest key that two linked sets share is kept by both.

Sets that meet are compared by parity bitmaps (each differing element flips one bit, so the
bitmaps never differ in more bits than the sets in elements); pairs that pass are verified
on the sets themselves. First each set of a bucket meets the bucket's smallest one; verified links give
components. Buckets that still hold several components then compare members across components, in
blocks of bounded size, and send the nearest pairs of each two components, one at first and more in later
rounds, until no two components have a pair that was not tested. Sets of one component need no further
comparison, so copies and near copies are never expanded into all pairs, and no link between components is lost.

Equal sets are one node, named by a 64-bit hash; a second hash and the size check that no two sets share a
name (otherwise the join starts again with another seed). Elements are 64-bit hashes of the five
words: two different shingles of one pair collide with probability below 2^-38 even for sets of 20,000.

Defined results: null, empty and blank texts have the empty set, link with nothing and are their own
component; a row with null doc_id links with nothing and has a null component; repeated rows
are equal sets; ties do not arise; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded, discard, matching, materialise, mix, text_key, text_slices, tidied, word_hashes

WORDS, PERCENT = 5, 80
GROWTH = 1.5
#: Sets up to this size use one-deletion neighbours.
SHORT = 27
#: Bits of the bitmap that rides along with a bucket's rows, and members of a block.
COARSE, BLOCK = 1024, 2048
_ODD = [np.uint64(x | 1) for x in np.random.default_rng(5).integers(1 << 40, 1 << 63, 64).tolist()]


# --- sets ------------------------------------------------------------------------


def shingle_sets(offsets, data, size: int = WORDS, seed: int = 0):
    """The sorted set of each text of a run, as 64-bit hashes."""
    name, _, first = word_hashes(offsets, data)
    name = name ^ np.uint64(seed)
    runs = np.zeros(0, np.uint64)
    if len(name) >= size:
        runs = name[: len(name) - size + 1] * _ODD[0]
        for j in range(1, size):
            runs = runs + name[j : len(name) - size + 1 + j] * _ODD[j]
        runs = mix(runs)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            x = np.sort(runs[a : b - size + 1])
            yield x[np.append(True, x[1:] != x[:-1])]
        elif b > a:
            total = np.uint64(b - a)
            for j in range(b - a):
                total = total + mix(name[a + j : a + j + 1] + np.uint64(j)) * _ODD[size + j]
            yield mix(total)
        else:
            yield np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a set; the first is its name."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ _ODD[60]).sum(dtype=np.uint64)
    both = mix(np.array([a, b], np.uint64) + np.uint64(len(s)))
    return int(both[0].astype(np.int64)), int(both[1].astype(np.int64))


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of elements by their low bits, in four to eight bits an element or COARSE bits."""
    bits = max(COARSE, 1 << (4 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(x: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of fewer bytes of the same set."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def most_different(a, b, percent: int = PERCENT):
    """Elements in which linked sets of these sizes differ at most."""
    return (100 - percent) * (a + b) // (100 + percent)


# --- signatures ------------------------------------------------------------------


@lru_cache(maxsize=None)
def band_edges(upto: int) -> tuple[int, ...]:
    edges = [0, 1]
    while edges[-1] < upto:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * GROWTH))))
    return tuple(edges)


#: Bands whose segments are indexed with their one-deletion neighbours.
SHORT_BANDS = sum(1 for top in band_edges(SHORT)[1:] if top <= SHORT)


@lru_cache(maxsize=100_000)
def lookups(n: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """Where a set of n elements goes: (band, segments, what it may leave out).

    A segment that is left out costs two in a short band, one in others; its deletions alone cost one.
    Bands in which a linked set would have to be equal are left out, as equal sets are one node.
    """
    edges = band_edges(1 << max(1, n).bit_length())
    least = -(-percent * n // 100)
    own = next(i for i in range(len(edges) - 1) if edges[i] < n <= edges[i + 1])
    out = []
    for band in range(own, -1, -1):
        top = edges[band + 1]
        if band < own and top < least:
            break
        partner = 100 * n // percent if band == own else top  # the largest partner met in this band
        differ = most_different(n, partner, percent)
        if not differ:
            continue
        worst = most_different(top, 100 * top // percent, percent)
        if band < SHORT_BANDS:
            out.append((band, worst + 2, 2 * (worst + 2) - differ - 1))
        else:
            segments = worst + 1 + max(2, -(-3 * top // 100))
            out.append((band, segments, segments - differ - 1))
    return out


# Marks of signature rows: band in bits 24 to 29; in short bands a flag for keys of empty segments,
# one for whole segments, the segment's number and what may be left out, in others the latter alone.
HOT, EMPTY, WHOLE = 1 << 30, 1 << 17, 1 << 16


def signatures(s: np.ndarray, percent: int = PERCENT):
    """Per lookup of a set: keys and their marks."""
    for band, m, spare in lookups(len(s), percent):
        salt = mix(np.arange(band * 1_000_003 + 1, band * 1_000_003 + 1 + m, dtype=np.uint64))
        segment = (((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)  # sorted, as s is
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        present = segment[first]
        element = mix(s ^ _ODD[61])
        total = np.zeros(m, np.uint64)
        total[present] = np.add.reduceat(element, first)
        if band >= SHORT_BANDS:
            spare -= m - len(present)
            # a set with more empty segments than it may leave out is looked up by those too
            keys = mix(total + salt) if spare < 0 else mix(total[present] + salt[present])
            yield keys, np.full(len(keys), (band << 24) | max(0, spare), np.int32)
            continue
        size = np.bincount(segment, minlength=m)
        keys = np.concatenate([mix(total + salt), mix(total[segment] - element + salt[segment])])
        of = np.concatenate([np.arange(m), segment])
        whole = np.arange(len(keys)) < m
        empty = np.where(whole, size[of] == 0, size[of] == 1)
        # keys of empty segments are the first to go, in an order that all sets share
        gone = np.flatnonzero(empty)
        gone = gone[np.argsort(keys[gone])]
        cost = np.cumsum(1 + whole[gone])
        fits = int(np.searchsorted(cost, spare, side="right"))
        spare = spare - int(cost[-1]) if len(cost) and fits == len(cost) else 0 if len(cost) else spare
        keep = np.ones(len(keys), bool)
        keep[gone[:fits]] = False
        marks = (band << 24) | spare | (of << 8) | whole * WHOLE | empty * EMPTY
        yield keys[keep], marks[keep].astype(np.int32)


# --- the join --------------------------------------------------------------------


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _summary(docs: DataFrame, size: int, seed: int) -> DataFrame:
    def rows(batches):
        seen = set()
        for batch in batches:
            names = batch.column(0)
            for lo, hi, offsets, data in text_slices(batch.column(1)):
                out = []
                for s in shingle_sets(offsets, data, size, seed):
                    if not len(s):
                        out.append((0, None, None, None))
                        continue
                    node, check = node_of(s)
                    out.append((len(s), node, check, None if node in seen else bitmap(s)))
                    seen.add(node)
                n, node, check, bits = zip(*out)
                yield _batch({"doc_id": names[lo:hi], "text_key": batch.column(2)[lo:hi], "n": pa.array(n, pa.int64()),
                              "node": pa.array(node, pa.int64()), "check": pa.array(check, pa.int64()), "bits": pa.array(bits, pa.binary())})

    return docs.select("doc_id", "text", "text_key").mapInArrow(
        tidied(rows), "doc_id bigint, text_key bigint, n bigint, node bigint, check bigint, bits binary"
    )


class _Frequent:
    """Finds the keys that a task sends very often, in bounded memory.

    Counters shared by many keys single out suspects; those alone are counted exactly. A key is called
    frequent from its third row after that on, so that its first rows always take the common way.
    """

    LIMIT, COUNTERS = 64, 1 << 20

    def __init__(self):
        self.counters, self.exact = np.zeros(self.COUNTERS, np.int32), {}

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys & np.uint64(self.COUNTERS - 1)).astype(np.int64)
        np.add.at(self.counters, at, 1)
        out = np.zeros(len(keys), bool)
        for i in np.flatnonzero(self.counters[at] > self.LIMIT).tolist():
            k = int(keys[i])
            n = self.exact.get(k, 0)
            out[i] = n >= 2
            self.exact[k] = n + 1
        return out


def _signature_rows(docs: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """(key, node, mark) of all distinct sets of each task."""

    def rows(batches):
        seen, frequent = set(), _Frequent()
        for batch in batches:
            for _, _, offsets, data in text_slices(batch.column(0)):
                keys, nodes, marks, sizes = [], [], [], []
                for s in shingle_sets(offsets, data, size, seed):
                    if not len(s):
                        continue
                    node = node_of(s)[0]
                    if node in seen:
                        continue
                    seen.add(node)
                    for k, mark in signatures(s, percent):
                        keys.append(k)
                        nodes.append(node)
                        marks.append(mark)
                        sizes.append(len(k))
                if keys:
                    key, mark = np.concatenate(keys), np.concatenate(marks)
                    mark[frequent(key)] |= HOT
                    yield _batch({"key": pa.array(key.view(np.int64)), "node": pa.array(np.repeat(np.array(nodes, np.int64), sizes)), "mark": pa.array(mark)})

    return docs.where("doc_id is not null").select("text").mapInArrow(tidied(rows), "key bigint, node bigint, mark int")


def _shared(batches):
    """Of sorted rows those whose key another row has, or that are marked frequent; equal rows once.

    Holds no more than a batch and the row before it.
    """
    last, sent = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if last is not None:
            columns = [np.append(a, b) for a, b in zip(last, columns)]
        key, node, mark = columns
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (mark[1:] != mark[:-1]))
        key, node, mark = key[new], node[new], mark[new]
        same = key[1:] == key[:-1]
        out = np.append(False, same) | np.append(same, False) | (mark >= HOT)
        held = last is not None and sent
        last, sent = [x[-1:] for x in (key, node, mark)], bool(out[-1])
        if held:
            out[0] = False
            sent = sent or len(out) == 1
        if out.any():
            yield _batch({"key": pa.array(key[out]), "node": pa.array(node[out]), "mark": pa.array(mark[out] & (HOT - 1))})


def _rarest(shared: DataFrame) -> DataFrame:
    """(key, node): of each lookup the rows that its set keeps, the most frequent keys left out.

    Linked sets share a key in every segment in which they are near, and the rarest of those keys is the last
    that either of them could leave out. All order keys alike: those of empty segments, then by
    how many sets have them. What a set may leave out in all is less than what those segments cost.
    """
    band = F.shiftright("mark", 24)
    by = Window.partitionBy("node", "band").orderBy(F.col("n").desc(), F.col("key"))
    long = shared.where(band >= SHORT_BANDS).withColumn("band", band).withColumn("cost", F.row_number().over(by))
    long = long.where("cost > (mark & 16777215)")
    short = shared.where(band < SHORT_BANDS).select(
        "*", band.alias("band"), F.expr("(mark >> 8) & 255").alias("segment"), F.expr(f"mark & {WHOLE} <> 0").alias("whole"),
        F.expr(f"mark & {EMPTY} <> 0").alias("empty"),
    )
    order = [F.col("empty").desc(), F.col("n").desc(), F.col("key")]
    earlier = Window.partitionBy("node", "band", "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("node", "band").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a segment costs two once it is left out whole, and one as soon as a deletion of it is
    paid = F.coalesce(F.max(F.when(F.col("whole"), 2).otherwise(1)).over(earlier), F.lit(0))
    short = short.withColumn("step", F.greatest(F.when(F.col("whole"), 2).otherwise(1) - paid, F.lit(0)))
    short = short.withColumn("cost", F.sum("step").over(upto)).where("cost > (mark & 255)")
    return long.select("key", "node").unionByName(short.select("key", "node")).distinct()


def _close(percent: int):
    """Filter of pairs by bitmaps; never drops a linked pair."""

    def rows(batches):
        for batch in batches:
            x, y, nx, ny, bx, by = (batch.column(i).to_pylist() for i in range(6))
            keep = []
            for a, b, p, q in zip(nx, ny, bx, by):
                if 100 * min(a, b) < percent * max(a, b):
                    keep.append(False)
                    continue
                u, v = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
                size = min(len(u), len(v))
                differ = int(np.bitwise_count(fold(u, size) ^ fold(v, size)).sum())
                keep.append(differ <= most_different(a, b, percent))
            mask = pa.array(keep, pa.bool_())
            yield _batch({"x": batch.column(0).filter(mask), "y": batch.column(1).filter(mask)})

    return rows


def _linked(percent: int):
    """Filter of pairs by their sets."""

    def rows(batches):
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            mask = pa.array(keep, pa.bool_())
            yield _batch({"x": batch.column(0).filter(mask), "y": batch.column(1).filter(mask)})

    return rows


def _sides(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the table's columns for x and for y."""
    for side in ("x", "y"):
        named = table.select(F.col("node").alias(side), *[F.col(c).alias(c + side) for c in columns])
        pairs = pairs.join(named, side)
    return pairs.select("x", "y", *[c + side for c in columns for side in ("x", "y")])


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, percent: int, seed: int) -> DataFrame:
    """Of distinct pairs of nodes (x, y) the linked ones."""
    wanted = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    wanted = materialise(nodes.select("node", "rep").join(wanted, "node"), "join-wanted")
    n = wanted.count()
    some = docs.join(bounded(wanted.select(F.col("rep").alias("doc_id")), n), "doc_id", "left_semi")

    def rows(batches):
        seen = set()
        for batch in batches:
            for _, _, offsets, data in text_slices(batch.column(0)):
                found = [(node_of(s)[0], s) for s in shingle_sets(offsets, data, size, seed) if len(s)]
                found = [x for x in found if not (x[0] in seen or seen.add(x[0]))]
                yield _batch({"node": pa.array([x[0] for x in found], pa.int64()),
                              "elements": pa.array([x[1].tobytes() for x in found], pa.binary())})

    sets = some.select("text").mapInArrow(tidied(rows), "node bigint, elements binary")
    # repeated doc_ids may bring other texts, and equal ones from several tasks
    sets = sets.join(bounded(wanted.select("node"), n), "node", "left_semi").dropDuplicates(["node"])
    sets = materialise(sets, "join-sets")
    links = materialise(_sides(pairs, sets, ["elements"]).mapInArrow(tidied(_linked(percent)), "x bigint, y bigint"), "join-links")
    discard(wanted, sets)
    return links


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes of the edges (x, y); root is the component's smallest node.

    Large-star and small-star rounds: each joins nodes to the smallest of their neighbours, until
    every node hangs on its root. Written after each round.
    """
    edges = materialise(edges.where("x <> y").distinct(), "components")
    for _ in range(most_rounds):
        both = edges.union(edges.select("y", "x")).toDF("u", "v")
        least = _least(both, F.least("u", F.min("v")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        down = materialise(large.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")), "components-large")
        least = _least(down, F.min("v"))
        small = down.join(least, "u")
        small = small.select(F.col("v").alias("x"), F.col("m").alias("y")).union(least.select("u", "m")).where("x <> y").distinct()
        found = materialise(small, "components")
        same = F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))
        if found.agg(F.count(F.lit(1)), same).first() == edges.agg(F.count(F.lit(1)), same).first():
            discard(down, found)
            break
        discard(down, edges)
        edges = found
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).union(edges.select("y", "y").distinct())


def _least(pairs: DataFrame, least) -> DataFrame:
    """(u, m), written: both sides of the join with it come from exchanges, so that a hub's rows are split."""
    found = materialise(pairs.groupBy("u").agg(least.alias("m")), "components-least")
    return bounded(found, found.count())


def _groups(batches, keys: int):
    """Tables of the rows with equal values in the first columns, out of sorted batches."""
    parts: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in range(keys)]
        if parts and any(parts[-1].column(k)[-1].as_py() != columns[k][0] for k in range(keys)):
            yield pa.concat_tables(parts).combine_chunks()
            parts = []
        new = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            parts.append(table.slice(a, b - a))
            if b < table.num_rows:
                yield pa.concat_tables(parts).combine_chunks()
                parts = []
    if parts:
        yield pa.concat_tables(parts).combine_chunks()


def _best(found: list, most: int) -> list:
    """Of candidates (roots a and b, difference, x, y) the `most` nearest of each pair of roots, and which pairs have more."""
    a, b, differ, x, y, cut = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((y, x, differ, b, a))
    a, b, differ, x, y, cut = (c[order] for c in (a, b, differ, x, y, cut))
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    count = np.diff(np.append(first, len(a)))
    cut = np.repeat(np.logical_or.reduceat(cut, first) | (count > most), count)
    keep = np.arange(len(a)) - np.repeat(first, count) < most
    return [tuple(c[keep] for c in (a, b, differ, x, y, cut))]


def _across(percent: int, most: int):
    """Pairs of different components within buckets, or between two blocks of one, by coarse bitmaps.

    For each two components the `most` nearest pairs; cut says that there are more.
    """

    def pairs(table: pa.Table):
        _, i, j, block, node, root, n = (table.column(k).to_numpy() for k in range(7))
        bits = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint64).reshape(-1, COARSE // 64)
        same = i[0] == j[0]
        left = np.flatnonzero(block == i[0])
        right = left if same else np.flatnonzero(block == j[0])
        found: list = []
        for at in range(0, len(left), 128):
            some = left[at : at + 128]
            far = root[some][:, None] != root[right][None, :]
            if same:
                far &= some[:, None] < right[None, :]
            far &= 100 * np.minimum(n[some][:, None], n[right][None, :]) >= percent * np.maximum(n[some][:, None], n[right][None, :])
            p, q = np.nonzero(far)
            p, q = some[p], right[q]
            for k in range(0, len(p), 100_000):
                u, v = p[k : k + 100_000], q[k : k + 100_000]
                differ = np.bitwise_count(bits[u] ^ bits[v]).sum(axis=1, dtype=np.int64)
                good = differ <= most_different(n[u], n[v], percent)
                u, v, differ = u[good], v[good], differ[good]
                if len(u):
                    a, b, x, y = root[u], root[v], node[u], node[v]
                    found.append((np.minimum(a, b), np.maximum(a, b), differ, np.minimum(x, y), np.maximum(x, y), np.zeros(len(u), bool)))
                    found = _best(found, most) if len(found) > 8 else found
        return _best(found, most)[0] if found else None

    def rows(batches):
        for table in _groups(batches, 3):
            found = pairs(table)
            if found is not None:
                yield _batch({"x": pa.array(found[3]), "y": pa.array(found[4]), "cut": pa.array(found[5])})

    return rows


def _coarse(batches):
    for batch in batches:
        out = [fold(np.frombuffer(x, np.uint8), COARSE // 8).tobytes() for x in batch.column(2).to_pylist()]
        yield _batch({"node": batch.column(0), "n": batch.column(1), "coarse": pa.array(out, pa.binary())})


def _rows(docs: DataFrame, size: int, percent: int, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, text_key, n, node, component_id, and keeper, the component's first node of that id."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), text_key(F.col("text")).alias("text_key"))
    summary = materialise(_summary(docs, size, seed), "join-summary")
    nodes = summary.where("node is not null and doc_id is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.min("n").alias("n"),
        F.expr("min(n) <> max(n) or min(check) <> max(check)").alias("clash"),
    )
    nodes = materialise(nodes, "join-nodes")
    if nodes.where("clash").limit(1).count():
        return _rows(docs, size, percent, seed + 1)
    rows = _signature_rows(docs, size, percent, seed)
    # the rows of a frequent key are spread; which of them are shared is known without seeing them together
    rows = rows.repartition("key", F.when(F.col("mark") >= HOT, F.pmod(F.xxhash64("node"), F.lit(256))).otherwise(-1))
    rows = rows.sortWithinPartitions("key", "node", "mark")
    shared = materialise(rows.mapInArrow(tidied(_shared), "key bigint, node bigint, mark int"), "join-shared")
    counts = materialise(shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "join-counts")
    kept = materialise(_rarest(shared.join(counts, "key")), "join-kept")
    discard(shared, counts)
    heads = kept.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    heads = materialise(heads, "join-heads")
    buckets = materialise(kept.join(heads, "key"), "join-buckets")
    discard(kept, heads)
    met = buckets.select("node").distinct()
    full = summary.where("bits is not null").select("node", "n", "bits")
    full = materialise(full.join(met, "node", "left_semi").groupBy("node").agg(F.min("n").alias("n"), F.min("bits").alias("bits")), "join-bits")
    stars = buckets.where("head <> node").select(F.col("head").alias("x"), F.col("node").alias("y")).distinct()
    stars = materialise(_sides(stars, full, ["n", "bits"]).mapInArrow(tidied(_close(percent)), "x bigint, y bigint"), "join-stars")
    links = _verify(stars, docs, nodes, size, percent, seed)
    roots = materialise(components(links), "join-roots")
    roots = _link_components(buckets.where("members > 2"), roots, full, docs, nodes, size, percent, seed)
    members = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = members.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("first"))
    named = members.join(firsts, "root").select("node", F.col("first.rep").alias("component_id"), F.col("first.node").alias("keeper"))
    named = materialise(named, "join-named")
    found = summary.select("doc_id", "text_key", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    return found.join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def _link_components(buckets, roots, full, docs, nodes, size: int, percent: int, seed: int) -> DataFrame:
    """The roots after the links between components that meet in a bucket.

    In each round a bucket sends, for each two components, their nearest pairs that the bitmaps let pass; those not
    tested yet are verified, and links join their components. Rounds send 1, 16, 256, ... pairs, until
    none was held back, so that a pair that was refuted makes way for the next and no link is lost.
    """
    pair, tested, most = "x bigint, y bigint, cut boolean", None, 1
    coarse = materialise(full.mapInArrow(tidied(_coarse), "node bigint, n bigint, coarse binary"), "join-coarse")
    while True:
        placed = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = materialise(placed.select("key", "node", "root", "members"), "join-placed")
        mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        mixed = materialise(mixed, "join-mixed")
        open_ = placed.join(mixed, "key", "left_semi")
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        open_ = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        open_ = open_.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root")
        open_ = open_.join(coarse, "node").select("key", "i", "j", "block", "node", "root", "n", "coarse")
        open_ = open_.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        found = open_.mapInArrow(tidied(_across(percent, most)), pair).groupBy("x", "y").agg(F.max("cut").alias("cut"))
        found = materialise(found, "join-across")
        discard(placed, mixed)
        fresh = found.select("x", "y")
        if tested is not None:
            fresh = materialise(fresh.join(tested, ["x", "y"], "left_anti"), "join-fresh")
        close = _sides(fresh, full, ["n", "bits"]).mapInArrow(tidied(_close(percent)), "x bigint, y bigint")
        more = _verify(materialise(close, "join-close"), docs, nodes, size, percent, seed)
        if more.limit(1).count():
            edges = roots.select(F.col("node").alias("x"), F.col("root").alias("y")).union(more)
            roots = materialise(components(edges), "join-roots")
        if not found.where("cut").limit(1).count():
            return roots
        tested = fresh if tested is None else materialise(tested.union(fresh), "join-tested")
        most *= 16


def link(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _rows(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; all columns stay.

    Of texts that share this doc_id the one of the smaller node stays. Rows that repeat the document that stays
    stay with it, as do rows without shingles or doc_id.
    """
    found = materialise(_rows(docs, size, percent), "join-result")
    dropped = found.where("doc_id <> component_id or node <> keeper").select("doc_id", "text_key")
    return matching(docs, dropped, dropped.count(), "left_anti")


#: The rows of link() in DuckDB SQL, by all pairs that share a shingle and the closure of their links.
ORACLE_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents),
s as (
  select doc_id, case when len(words) >= 5 then list_distinct([array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)])
    when len(words) > 0 then [array_to_string(words, ' ')] else [] end as shingles
  from w),
n as (select doc_id, len(shingles)::bigint as n_shingles from s),
e as (select doc_id, unnest(shingles) as shingle from s),
c as (select a.doc_id as x, b.doc_id as y, count(*) as common from e a join e b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * common >= 80 * (a.n_shingles + b.n_shingles - common)),
r as (select doc_id, doc_id as reached from n union select r.doc_id, l.y from r join l on l.x = r.reached)
select r.doc_id, any_value(n_shingles) as n_shingles, min(reached) as component_id from r join n on n.doc_id = r.doc_id group by r.doc_id
"""
