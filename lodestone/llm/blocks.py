"""Blocks of documents that ask distributed tables about their keys.

Some operators need, for each of many small keys inside each document, something that only the whole corpus tells:
a count, the first document that has it. One row a key would multiply the input. Here documents are gathered into
blocks; a block sends each bucket of the key space one blob with its distinct keys, sorted; a bucket merges the
blobs of all blocks and answers each with one value a key, in the key's order. Equal keys are merged inside a block
before anything is shuffled, so a key that a third of all documents hold costs its bucket one entry a block.

Everything travels as (block, bucket, data) rows; a block's own data has bucket -1.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SCHEMA = "block long, bucket int, data binary"
_U64 = np.uint64


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays to one compressed blob."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(f"{a.dtype.str}:{a.shape[0]}")
        # bytes of like weight together: small numbers in wide types then cost little
        body.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if a.dtype.itemsize > 1 else a.tobytes())
    h = ",".join(head).encode()
    return len(h).to_bytes(4, "little") + h + zstandard.ZstdCompressor(level=level).compress(b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    body, at, out = zstandard.ZstdDecompressor().decompress(blob[4 + n :]), 0, []
    for part in blob[4 : 4 + n].decode().split(","):
        kind, size = part.split(":")
        kind, size = np.dtype(kind), int(size)
        raw = np.frombuffer(body, np.uint8, size * kind.itemsize, at)
        at += size * kind.itemsize
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, size).T).view(kind).reshape(-1) if kind.itemsize > 1 else raw.view(kind))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> _U64(32))) * _U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U64(32))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys in ascending order are in ascending buckets."""
    return ((keys >> _U64(32)) * _U64(buckets) >> _U64(32)).astype(np.int64)


def deltas(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences, which compress."""
    return np.diff(keys, prepend=_U64(0)).astype(np.uint64)


def pieces(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of the buckets that an ascending array has: never more than it has keys, however many there are."""
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(buckets) else np.zeros(0, np.int64)
    yield from zip(buckets[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(buckets)], strict=True) if len(starts) else ()


def frame(rows: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "bucket", "data"]).astype({"block": "int64", "bucket": "int32"})


def release(spark) -> None:
    """Let go of the plans of what has been written by now; Spark's cleaner then deletes their shuffle files.

    It works beside the driver, and some plans are only let go in a second round: the waits keep the next stage's files
    from lying beside those of the one before.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def gather(docs: DataFrame, limit: int, weigh: Callable, build: Callable) -> DataFrame:
    """Staged rows (block, -1, data). docs: doc_id, text; weigh(text) sums to about limit in a block; build(ids, texts) makes data."""
    from pyspark import TaskContext

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([-1], pa.int32()), pa.array([build(ids, texts)], pa.binary())], names=["block", "bucket", "data"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                t = t.as_py() or b""
                ids.append(i.as_py())
                texts.append(t)
                size += weigh(t)
                if size >= limit:
                    yield row()
                    n, ids, texts, size = n + 1, [], [], 0
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text"), "UTF-8").alias("text"))
    return staged(rows.mapInArrow(run, SCHEMA), "blocks")


def each_block(rows: DataFrame, work: Callable[[int, dict[int, bytes]], list]) -> DataFrame:
    """work(block, its data by bucket) over rows grouped by block."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return frame(work(int(part["block"].iloc[0]), dict(zip(part["bucket"].tolist(), part["data"], strict=True))))

    return rows.groupBy("block").applyInPandas(run, SCHEMA)


def map_blocks(blocks: DataFrame, work: Callable[[int, bytes], list]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, data in zip(b["block"].tolist(), b["data"], strict=True):
                yield frame(work(block, data))

    return blocks.mapInPandas(run, SCHEMA)


def answer(requests: DataFrame, merge: Callable[[int, list[int], list[bytes]], list]) -> DataFrame:
    """merge(bucket, blocks, blobs) over requests grouped by bucket; gives (block, bucket, data) rows."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return frame(merge(int(part["bucket"].iloc[0]), part["block"].tolist(), part["data"].tolist()))

    return requests.groupBy("bucket").applyInPandas(run, SCHEMA)


def buckets_for(blocks: DataFrame, size: int = 2 << 20) -> int:
    """Buckets in proportion to the blocks' data, so that a bucket's memory is the same at every size."""
    total = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    return max(1, -(-total // size))
