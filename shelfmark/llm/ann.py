"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Rows are dealt to shards of bounded size by a hash of their identifier. In each shard, vectors get one more
component that brings all of them to the largest norm, so that the nearest by distance is the one with the largest
inner product. Points enter the graph in growing batches: a greedy search from the entry points
proposes neighbours, and relaxed pruning keeps those edges that no kept edge shortens by the
factor ALPHA. Queries run a beam search in every shard, many side by side in numpy; what they find is
scored in double precision on the original vectors and merged by score.

Equal vectors are one point of the graph and carry their smallest identifiers, as many as an answer
can hold, so a vector that very many rows share costs no more than another.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do
rows with null identifier; vectors of different lengths are not compared; of rows that repeat an
identifier the one with the greatest vector counts; equal scores go to the smaller identifier; a query with
fewer candidates than neighbours asked for gets all; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded, materialise

#: Points of a shard, on average; queries that are searched together, and that one task takes through one shard.
SHARD, BLOCK, GROUP = 16_384, 256, 262_144
DEGREE, ROOM, BEAM, ALPHA, ENTRIES = 32, 48, 80, 1.2, 8


def _distances(x: np.ndarray, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances from each row of `to` to the points ids (rows, k)."""
    d = x[ids]
    d -= to[:, None, :]
    return np.einsum("qkd,qkd->qk", d, d)


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, to: np.ndarray, beam: int, width: int = 4):
    """The `beam` nearest points found for each row of `to`: ids (-1: none) and distances, nearest first.

    In every round each row expands its `width` nearest points that it has not expanded.
    """
    n, q = len(x), len(to)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # the place of missing neighbours
    k = min(beam, len(entries))
    first = np.broadcast_to(entries, (q, len(entries)))
    d = _distances(x, first, to)
    order = np.argsort(d, axis=1)[:, :k]
    ids[:, :k], dist[:, :k], done[:, :k] = np.take_along_axis(first, order, 1), np.take_along_axis(d, order, 1), False
    seen[:, entries] = True
    live = np.arange(q)
    while len(live):
        waiting = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(waiting, min(width, beam - 1), axis=1)[:, :width]
        use = np.isfinite(np.take_along_axis(waiting, pick, 1))
        some = use.any(axis=1)
        live, pick, use = live[some], pick[some], use[some]
        if not len(live):
            break
        done[live[:, None], pick] = True
        near = graph[np.where(use, ids[live[:, None], pick], -1)].reshape(len(live), -1)  # the last row holds none
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[live[:, None], near]] = n
        seen[live[:, None], near] = True
        near = np.sort(near, axis=1)[:, : max(1, int((near < n).sum(axis=1).max()))]
        d = np.where(near < n, _distances(x, np.minimum(near, n - 1), to[live]), np.inf)
        every_d = np.concatenate([dist[live], d], axis=1)
        every = np.concatenate([ids[live], np.where(near < n, near, -1)], axis=1)
        over = np.concatenate([done[live], near >= n], axis=1)
        best = np.argpartition(every_d, beam - 1, axis=1)[:, :beam]
        dist[live], ids[live], done[live] = (np.take_along_axis(a, best, 1) for a in (every_d, every, over))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(x: np.ndarray, points: np.ndarray, ids: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """At most `degree` diverse neighbours of each point out of its candidates ids (-1: none)."""
    ids = np.where(ids == points[:, None], -1, ids)
    order = np.argsort(ids, axis=1)
    ids = np.take_along_axis(ids, order, 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    d = np.where(ids < 0, np.inf, _distances(x, np.maximum(ids, 0), x[points]))
    out = np.full((len(points), degree), -1, np.int64)
    rows = np.arange(len(points))
    for k in range(degree):
        best = d.argmin(axis=1)
        found = np.isfinite(d[rows, best])
        if not found.any():
            break
        kept = ids[rows, best]
        out[found, k] = kept[found]
        between = _distances(x, np.maximum(ids, 0), x[np.maximum(kept, 0)])
        d[alpha * alpha * between <= d] = np.inf
        d[rows, best] = np.inf
    return out


def build(x: np.ndarray, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The graph (a last row holds no neighbours) and the entry points."""
    n = len(x)
    graph = np.full((n + 1, ROOM), -1, np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    middle = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    entries = np.unique(np.append(order[: ENTRIES - 1], middle))
    order = np.concatenate([entries, order[~np.isin(order, entries)]])
    at = len(entries)
    for i, p in enumerate(entries):
        graph[p, : len(entries) - 1] = np.delete(entries, i)
    while at < n:
        batch = order[at : at + min(max(8, at), 1024)]
        ids, _ = beam_search(x, graph, entries, x[batch], BEAM)
        # points of one batch do not see each other; the nearest in it are candidates too
        inner = x[batch] @ x[batch].T
        np.fill_diagonal(inner, -np.inf)
        k = min(16, len(batch) - 1)
        ids = np.concatenate([ids, batch[np.argpartition(-inner, k - 1, axis=1)[:, :k]]], axis=1) if k > 0 else ids
        near = robust_prune(x, batch, ids)
        graph[batch] = -1
        graph[batch, :DEGREE] = near
        _backward(x, graph, batch, near)
        at += len(batch)
    return graph, entries


def _backward(x: np.ndarray, graph: np.ndarray, batch: np.ndarray, near: np.ndarray) -> None:
    """Add the reverse of the batch's edges; points without room are pruned."""
    src = np.repeat(batch, near.shape[1])
    dst = near.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    points, first, count = np.unique(dst, return_index=True, return_counts=True)
    place = np.arange(len(dst)) - np.repeat(first, count)
    new = np.full((len(points), int(count.max()) if len(count) else 0), -1, np.int64)
    new[np.repeat(np.arange(len(points)), count), place] = src
    every = np.sort(np.concatenate([graph[points], new], axis=1), axis=1)[:, ::-1]
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
    every = np.sort(every, axis=1)[:, ::-1]
    held = (every >= 0).sum(axis=1)
    fits = held <= ROOM
    graph[points[fits]] = every[fits][:, :ROOM] if every.shape[1] >= ROOM else np.pad(every[fits], ((0, 0), (0, ROOM - every.shape[1])), constant_values=-1)
    full = np.flatnonzero(~fits)
    for i in range(0, len(full), 512):
        some = full[i : i + 512]
        wide = every[some][:, : int(held[some].max())]
        graph[points[some]] = -1
        graph[points[some], :DEGREE] = robust_prune(x, points[some], wide)


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    """x with the component that brings it to the largest norm."""
    rest = np.sqrt(np.maximum(0.0, largest * largest - (x * x).sum(axis=1)))
    return np.hstack([x, rest[:, None]]).astype(np.float32)


def index(vectors: np.ndarray, names: np.ndarray, k: int, largest: float) -> dict:
    """A shard's index: distinct vectors, their smallest k + 1 names, graph and entries."""
    order = np.argsort(names, kind="stable")
    vectors, names = np.ascontiguousarray(vectors[order]), names[order]
    whole = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, group = np.unique(whole, return_index=True, return_inverse=True)
    by = np.argsort(group, kind="stable")
    rank = np.empty(len(group), np.int64)
    count = np.bincount(group)
    rank[by] = np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count)
    some = rank <= k
    distinct = vectors[first]
    graph, entries = build(lift(distinct, largest))
    return {"vectors": distinct, "group": group[some], "names": names[some], "graph": graph, "entries": entries}


def search(found: dict, queries: np.ndarray, names: np.ndarray, k: int, largest: float, beam: int = BEAM):
    """(query name, name, score) of each query's nearest, k at least if the shard has them."""
    vectors, group, held = found["vectors"], found["group"], found["names"]
    count = np.bincount(group, minlength=len(vectors))
    begin = np.cumsum(count) - count
    by = np.lexsort((held, group))
    held = held[by]
    if "lifted" not in found:
        found["lifted"] = lift(vectors, largest)
    x, out = found["lifted"], []
    for at in range(0, len(queries), BLOCK):
        q, own = queries[at : at + BLOCK], names[at : at + BLOCK]
        to = np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32)
        ids, _ = beam_search(x, found["graph"], found["entries"], to, beam)
        lacking = np.where(ids >= 0, count[np.maximum(ids, 0)], 0).sum(axis=1) < min(k + 1, len(held))
        for i in range(len(q)):
            mine = np.arange(len(vectors)) if lacking[i] else ids[i][ids[i] >= 0]
            score = np.einsum("kd,d->k", vectors[mine], q[i])
            spread = np.repeat(np.arange(len(mine)), count[mine])
            rows = np.repeat(begin[mine] - (np.cumsum(count[mine]) - count[mine]), count[mine]) + np.arange(len(spread))
            name, s = held[rows], score[spread]
            other = name != own[i]
            name, s = name[other], s[other]
            best = np.lexsort((name, -s))[:k]
            out.append((np.full(len(best), own[i]), name[best], s[best]))
    return tuple(np.concatenate(a) if out else np.zeros(0) for a in (zip(*out) if out else ((), (), ())))


def valid(vector: str) -> Column:
    """Vectors that take part."""
    return F.expr(
        f"coalesce(size({vector}) > 0 and not exists({vector}, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists({vector}, x -> x <> 0), false)"
    )


def nearest(table: DataFrame, is_query: Column, k: int = 20, name: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query holds."""
    rows = table.select(F.col(name).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("vec_id is not null").where(valid("v"))
    rows = rows.groupBy("vec_id").agg(F.max("v").alias("v"), F.max("asks").alias("asks")).withColumn("dim", F.size("v"))
    rows = materialise(rows, "ann-rows")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest"), F.count_if("asks").alias("asking"))
    sizes = sizes.select(
        "dim", F.col("largest") * 1.000001 + 1e-30, F.ceil(F.col("n") / shard).cast("int"), F.ceil(F.col("asking") / GROUP).cast("int")
    ).toDF("dim", "largest", "shards", "parts")
    sizes = materialise(sizes, "ann-sizes")
    placed = rows.join(bounded(sizes, sizes.count()), "dim")  # a row per vector length

    def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        found = index(np.array(pdf["v"].tolist(), np.float64), pdf["vec_id"].to_numpy(), k, first["largest"])
        kinds = {"vectors": np.float64, "group": np.int64, "names": np.int64, "graph": np.int32, "entries": np.int64}
        row = {c: first[c] for c in ("dim", "shard", "parts", "largest")}
        return pd.DataFrame([row | {c: found[c].astype(t).tobytes() for c, t in kinds.items()}])

    shards = placed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    index_columns = "vectors binary, `group` binary, names binary, graph binary, entries binary"
    graphs = shards.groupBy("dim", "shard").applyInPandas(build_shard, f"dim int, shard int, parts int, largest double, {index_columns}")
    graphs = materialise(graphs, "ann-graphs").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = placed.where("asks").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    # each task gets a shard's index once, and then its queries
    keys = ["dim", "shard", "part"]
    both = graphs.select(*keys, F.lit(0).alias("kind"), "largest", "vectors", "group", "names", "graph", "entries").unionByName(
        asked.select(*keys, F.lit(1).alias("kind"), "vec_id", "v"), allowMissingColumns=True
    )
    both = both.repartition(*keys).sortWithinPartitions(*keys, "kind")

    def ask(batches):
        found, key = None, None
        for pdf in batches:
            kind = pdf["kind"].to_numpy()
            cuts = [0, *np.flatnonzero(kind == 0).tolist(), len(pdf)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                some = pdf.iloc[a:b]
                if not len(some):
                    continue
                if some["kind"].iloc[0] == 0:
                    g, some = some.iloc[0], some.iloc[1:]
                    key, dim = (g["dim"], g["shard"], g["part"]), int(g["dim"])
                    found = {
                        "vectors": np.frombuffer(g["vectors"], np.float64).reshape(-1, dim), "group": np.frombuffer(g["group"], np.int64),
                        "names": np.frombuffer(g["names"], np.int64), "entries": np.frombuffer(g["entries"], np.int64),
                        "graph": np.frombuffer(g["graph"], np.int32).reshape(-1, ROOM).astype(np.int64), "largest": g["largest"],
                    }
                if not len(some):
                    continue
                assert key == tuple(some[c].iloc[0] for c in keys), "queries of a shard follow its index"
                asked_by, near, score = search(found, np.array(some["v"].tolist(), np.float64), some["vec_id"].to_numpy(np.int64), k, found["largest"])
                yield pd.DataFrame({"query_id": asked_by.astype(np.int64), "vec_id": near.astype(np.int64), "score": score})

    found = both.mapInPandas(ask, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
