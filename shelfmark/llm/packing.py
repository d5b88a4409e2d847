"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

A document is its token ids and an end id; one longer than a sequence is cut into full pieces, of which
the first may be shorter. The sum-of-squares rule puts a piece where the sum, over all residual
gaps, of the squared number of open bins with that gap becomes smallest.

The rule looks at lengths alone, so it runs on the histogram of all lengths, at most `capacity`
numbers, and not on documents. Lengths take turns: each round places an equal share of the pieces of every
length, so that long and short pieces meet in proportion; a share is one piece where there are
few, and goes to its gap at once where there are many. Of plans in few and in many
rounds the tightest is taken. Bins of one gap are held as ranges of bin numbers, so that the plan's
size depends on the number of lengths and not on that of documents. Each piece then finds its place in the plan by
its rank among the pieces of its length. Ranks are counted by written partition: a piece's
rank within partition and length, plus the counts of the partitions before. No task ever holds the
pieces of a length, and the packing is as tight as one over all documents at once.

Defined results: null text is empty and has only its end id; repeated rows are packed each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import bounded, materialise, text_slices, tidied, tidy
from shelfmark.llm.tokenize import encoder, forget

CAPACITY, END = 1024, 2
#: Shares of lengths that a plan places at most.
STEPS = 1 << 18
#: Bytes of text that a task looks at together; those and the encoder's cache where workers must stay small.
RUN, SMALL_RUN, SMALL_CACHE = 6 << 20, 1 << 18, 12 << 20

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n > 0 tokens."""
    first = (n - 1) % capacity + 1
    return [first] + [capacity] * ((n - first) // capacity)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, lasting: bool = True) -> DataFrame:
    """One row per piece, numbered within its partition and length.

    lasting: the worker keeps the encoder's cache for its next task; without it the cache is small and goes with the
    task, so that its memory is free for other stages.
    """

    def cut(batches):
        encode, part = encoder(path, 0 if lasting else SMALL_CACHE), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, hi, offsets, data in text_slices(batch.column(1), RUN if lasting else SMALL_RUN):
                ids, at = encode(offsets, data)
                ids = ids.astype("<u4")
                tail = np.array([end], "<u4").tobytes()
                out = []
                for name, a, b in zip(names[lo:hi], at[:-1].tolist(), at[1:].tolist()):
                    raw, start = ids[a:b].tobytes() + tail, 0
                    for k, size in enumerate(piece_lengths(b - a + 1, capacity)):
                        nth = seen.get(size, 0)
                        seen[size] = nth + 1
                        out.append((name, k, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), part, nth))
                        start += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )
        if not lasting:
            del encode
            forget(path)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(tidied(cut), PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 64):
    """Places for histogram[length] pieces of each length, and the number of bins.

    Each round deals an equal share of every length, longest first. Of a share of several pieces those that the
    sum-of-squares rule would put first are put at once: all of it, or as many as the best gap has bins.
    The plan's rows are (length, first rank, count, first bin, offset): the count pieces from that rank
    on go to as many bins from the first on, each at the offset.
    """
    open_bins: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by gap: ranges [first bin, count]
    number = np.zeros(capacity + 1, np.int64)
    rows, bins = [], 0
    for turn, length in ((t, n) for t in range(rounds) for n in sorted(histogram, reverse=True)):
        rank = histogram[length] * turn // rounds
        todo = histogram[length] * (turn + 1) // rounds - rank
        while todo:
            # what the sum of squares gains by one piece into each gap; a new bin's gap has no count itself
            gain = 2 * (np.append(0, number[1 : capacity + 1 - length]) - number[length:]) + 2
            gain[0] = 1 - 2 * number[length]  # a bin that becomes full leaves the sum
            gain[number[length:] == 0] = np.iinfo(np.int64).max
            gap = length + int(np.argmin(gain))
            fresh = 2 * number[capacity - length] + 1 if length < capacity else 0
            if number[gap] == 0 or gain[gap - length] >= fresh:
                gap, count = capacity, todo
                ranges = [[bins, count]]
                bins += count
            else:
                count = min(todo, int(number[gap]))
                number[gap] -= count
                ranges, need = [], count
                while need:
                    first, have = open_bins[gap][-1]
                    used = min(have, need)
                    if used == have:
                        open_bins[gap].pop()
                    else:
                        open_bins[gap][-1] = [first + used, have - used]
                    ranges.append([first, used])
                    need -= used
            left = gap - length
            for first, have in ranges:
                rows.append((length, rank, have, first, capacity - gap))
                rank += have
            if left:
                open_bins[left] += ranges
                number[left] += count
            todo -= count
    return np.array(rows, np.int64).reshape(-1, 5), bins


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY):
    """The plan with the fewest bins of those in 1, 2, 4, ... rounds; the fewer lengths, the more rounds."""
    most = max(1, STEPS // max(1, len(histogram)))
    plans = (plan(histogram, capacity, 1 << k) for k in range(most.bit_length()))
    return min(plans, key=lambda found: found[1])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, lasting: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, path, capacity, end, lasting), "pack-pieces")
    counts = cut.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    counts = materialise(counts, "pack-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "before")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    rows, _ = best_plan(histogram, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    tidy()  # the driver lives on too
    sent = spark.sparkContext.broadcast(rows)  # bounded by the number of lengths and steps
    ranked = cut.join(counts, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )

    def place(batches):
        table = sent.value
        # one sorted key of length and rank; ranks stay below 2^50
        key = (table[:, 0] << 50) + table[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(key, (length << 50) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        tidied(place), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
