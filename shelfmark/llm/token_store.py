"""Token ids in word-aligned Simple-8b files.

A 64-bit word holds a selector in its top four bits and, below, as many ids as the selector
says, of equal width:

    selector   0   1   2   3   4   5   6   7   8   9  10  11  12  13
    ids        1   2   3   4   5   6   7   8  10  12  15  20  30  60
    bits      60  30  20  15  12  10   8   7   6   5   4   3   2   1

An id of 2^20 - 1 or more is an escape: its place holds 2^20 - 1 and the id itself goes, as 32
bits, to the frame's escape list. Ids are cut into blocks of 256; words do not cross
blocks, and a frame holds the word offset of each block, so that blocks are encoded and decoded side by
side in numpy.

A frame (little endian): the bytes `S8B1`, then 64-bit counts of documents, ids, blocks, words and escapes;
document identifiers (64 bits) and a byte each for whether it is null; ids of each document (64 bits); word
offsets of the blocks (32 bits); words; escapes (32 bits).

Frames are rows of a Parquet folder, so that Spark's commit protocol covers lost executors and
repeated tasks and any file system will do: shard, frame, first (ids in the shard before), n_ids, payload.
Shards ascend by doc_id, and rows within a shard too.

Defined results: null text is empty, so a document has its end id only; null doc_ids come first; rows
with one doc_id stand next to each other, by text; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import scratch, text_slices, tidied
from shelfmark.llm.tokenize import RUN, encoder

COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
WIDTHS = 60 // COUNTS
BLOCK = 256
ESCAPE = (1 << 20) - 1
MAGIC = b"S8B1"
#: Ids after which a frame ends with its document.
FRAME = 1 << 18
FRAMES = "shard int, frame int, first bigint, n_ids bigint, payload binary"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word offsets of the blocks, words and escapes of unsigned 32-bit ids."""
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    escapes = ids[ids >= ESCAPE].astype("<u4")
    values = np.minimum(ids, ESCAPE)
    blocks = -(-n // BLOCK)
    bits = np.zeros(blocks * BLOCK + 64, np.uint8)
    bits[:n] = np.maximum(1, np.ceil(np.log2(values + 1))).astype(np.uint8)
    padded = np.zeros(blocks * BLOCK + 64, np.uint64)
    padded[:n] = values
    # widest id among the next 1, 2, 4 ... ids, and so of any number
    spans = {1: bits}
    for k in (2, 4, 8, 16, 32):
        half = spans[k // 2]
        spans[k] = half.copy()
        spans[k][: -k // 2] = np.maximum(half[: -k // 2], half[k // 2 :])
    best = np.zeros(len(bits), np.uint8)
    for s, (count, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist())):
        k = 1 << (count.bit_length() - 1)
        widest = spans[k].copy()
        if count > k:
            widest[: -(count - k)] = np.maximum(widest[: -(count - k)], spans[k][count - k :])
        best[widest <= width] = s
    # every block takes a step at a time; a word may not pass its block's end
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    end = np.minimum(at + BLOCK, n)
    fits = np.searchsorted(COUNTS, np.arange(BLOCK + 1), side="right") - 1
    live = np.arange(blocks)
    sizes = np.zeros(blocks, np.int64)
    owner, words = [], []
    while len(live):
        here = at[live]
        s = np.minimum(best[here], fits[end[live] - here])
        word = s.astype(np.uint64) << np.uint64(60)
        for k in np.unique(s).tolist():
            rows = np.flatnonzero(s == k)
            x = padded[here[rows, None] + np.arange(COUNTS[k])]
            shift = (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
            word[rows] |= np.bitwise_or.reduce(x << shift, axis=1)
        words.append(word)
        owner.append(live)
        sizes[live] += 1
        at[live] = here + COUNTS[s]
        live = live[at[live] < end[live]]
    if not blocks:
        return np.zeros(0, "<u4"), np.zeros(0, "<u8"), escapes
    owner, words = np.concatenate(owner), np.concatenate(words)
    order = np.argsort(owner, kind="stable")  # a block's words stay in the order of their steps
    return (np.cumsum(sizes) - sizes).astype("<u4"), words[order].astype("<u8"), escapes


def decode(n: int, words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The n ids of all blocks."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    start = np.cumsum(count) - count
    out = np.zeros(n, np.uint64)
    for k in np.unique(selector).tolist():
        rows = np.flatnonzero(selector == k)
        shift = (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
        out[start[rows, None] + np.arange(COUNTS[k])] = (words[rows, None] >> shift) & np.uint64((1 << int(WIDTHS[k])) - 1)
    out[out == ESCAPE] = escapes
    return out.astype("<u4")


def pack_frame(names: list, sizes: list[int], ids: np.ndarray) -> bytes:
    offsets, words, escapes = encode(ids)
    head = MAGIC + struct.pack("<5q", len(names), len(ids), len(offsets), len(words), len(escapes))
    null = np.array([x is None for x in names], np.uint8)
    return b"".join(
        [head, np.array([x or 0 for x in names], "<i8").tobytes(), null.tobytes(), np.array(sizes, "<i8").tobytes(),
         offsets.tobytes(), words.tobytes(), escapes.tobytes()]
    )


def read_frame(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Identifiers, number of ids of each document, and all ids."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token frame")
    docs, n, blocks, words, escapes = struct.unpack_from("<5q", payload, 4)
    at, found = 44, []
    for kind, k in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<u4", blocks), ("<u8", words), ("<u4", escapes)):
        found.append(np.frombuffer(payload, kind, k, at))
        at += found[-1].nbytes
    names = [None if gone else x for x, gone in zip(found[0].tolist(), found[1].tolist())]
    return names, found[2], decode(n, found[4], found[5])


def read_block(payload: bytes, block: int) -> np.ndarray:
    """The ids of one block alone, if its frame has no escapes."""
    docs, n, blocks, words, _ = struct.unpack_from("<5q", payload, 4)
    at = 44 + 17 * docs
    offsets = np.append(np.frombuffer(payload, "<u4", blocks, at), words)
    part = np.frombuffer(payload, "<u8", words, at + 4 * blocks)[offsets[block] : offsets[block + 1]]
    return decode(min(BLOCK, n - block * BLOCK), part, np.zeros(0, "<u4"))


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2) -> None:
    """Encode every whole text, append the end id and write the frames in ascending doc_id order."""

    def frames(batches):
        encode_texts, shard = encoder(tokenizer), TaskContext.get().partitionId()
        names, sizes, runs, held, first, frame = [], [], [], 0, 0, 0

        def flush():
            nonlocal names, sizes, runs, held, first, frame
            ids = np.concatenate(runs)
            row = [[shard], [frame], [first], [len(ids)], [pack_frame(names, sizes, ids)]]
            first, frame = first + len(ids), frame + 1
            names, sizes, runs, held = [], [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                ["shard", "frame", "first", "n_ids", "payload"],
            )

        tail = np.array([end], np.int32)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, offsets, data in text_slices(batch.column(1), RUN):
                ids, at = encode_texts(offsets, data)
                for name, a, b in zip(keys[lo:hi], at[:-1].tolist(), at[1:].tolist()):
                    names.append(name)
                    sizes.append(b - a + 1)
                    runs += [ids[a:b], tail]
                    held += b - a + 1
                    if held >= FRAME:
                        yield flush()
        if names:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).repartitionByRange("doc_id")
    ordered.sortWithinPartitions("doc_id", "text").mapInArrow(tidied(frames), FRAMES).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    frames = spark.read.schema(FRAMES).parquet(path)
    # one row a shard, so this window holds as many rows as the files have shards
    shards = frames.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def documents(batches):
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, sizes, ids = read_frame(payload)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(base + begins, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    based = frames.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("first")).alias("base"), "payload")
    return based.mapInArrow(tidied(documents), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def store(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write the files to the scratch folder and read them back."""
    path = scratch(docs.sparkSession, "token-store")
    write(docs, path, tokenizer, end)
    return read(docs.sparkSession, path)
