"""Packing documents into sequences of fixed capacity by minimum bin slack.

A document is cut into pieces of the full capacity and a remainder. The remainders' lengths make a histogram of at
most `capacity` numbers, whatever the corpus; on it the driver plans. The longest length left opens a window; a
subset-sum over bitsets (one bit a sum, each length with the count left of it, in binary portions) finds the
multiset that fills the window closest to capacity, backtracking gives its counts, and the same multiset is used
as often as the counts left allow. Every use empties some length below its need, so plans are bounded by the
capacity too, not by the corpus. A remainder then finds its window by arithmetic: its rank among the remainders of
its length lies in the stretch of ranks that one multiset uses. Ranks come from counts by (length, hash block) and
a window inside each block, so a length that a third of all documents share is spread over all tasks.

Defined results: a null or empty text is the end token alone; repeated rows are packed each; an empty table gives
no sequence; other columns are ignored. Reruns give the same sequences up to the order of identical rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, staged
from .tokens import CHUNK, MEMORY_WORDS, OVERLAP, VOCABULARY, encoded

CAPACITY = 2048
END = 1


def best_fill(counts: dict[int, int], room: int) -> Counter:
    """The multiset of the lengths left whose sum comes closest to room, from below."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            new = (reach | reach << length * k) & mask
            if new != reach:
                steps.append((length, k, reach))
                reach = new
            left, k = left - k, k * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, Counter()
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] += k
            at -= length * k
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Multisets of lengths and how many windows each fills."""
    counts, made = {k: v for k, v in histogram.items() if v}, []
    while counts:
        first = max(counts)
        counts[first] -= 1
        used = best_fill(counts, capacity - first)
        counts[first] += 1
        used[first] += 1
        times = min(counts[x] // k for x, k in used.items())
        made.append((used, times))
        for x, k in used.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
    return made


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece."""
    key, tail = (vocabulary, CHUNK, OVERLAP, MEMORY_WORDS), np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, found in encoded(batches, key):
            rows = []
            for doc, x in zip(ids, found, strict=True):
                x += tail
                n = len(x) // 4
                rows += [(doc, s, min(capacity, n - s), zlib.crc32(x[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every row of docs, each with its sequence_id and offset there."""
    spark = docs.sparkSession
    blocks = 4 * partitions(spark)
    cut = staged(pieces(docs, vocabulary, capacity, end).withColumn("_block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks))), "pieces")
    sizes = staged(cut.groupBy("length", "_block").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most

    used: dict[int, int] = {}
    keys, table, sequence = [], [], 0
    for fill, times in plan(histogram, capacity):
        offset = 0
        for length in sorted(fill, reverse=True):
            k, rank = fill[length], used.get(length, 0)
            keys.append(length << 48 | rank)
            table.append((rank, k, sequence, offset))
            used[length], offset = rank + k * times, offset + k * length
        sequence += times
    order = np.argsort(np.array(keys, np.int64))
    stretch, rows = np.array(keys, np.int64)[order], np.array(table, np.int64).reshape(-1, 4)[order]

    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1).join(first, ["length", "_block"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + F.col("_rank")).alias("_rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b.pop("_rank").to_numpy()
            x = rows[np.searchsorted(stretch, length << 48 | rank, side="right") - 1]
            nth = rank - x[:, 0]
            yield b.assign(sequence_id=x[:, 2] + nth // x[:, 1], offset=x[:, 3] + nth % x[:, 1] * length)

    return ranked.mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
