"""SimHash near-duplicates by multi-index hashing.

Fingerprints (64 bits over word shingles) are cut into two segments of 32 bits. Of two fingerprints that differ in
at most 2 bits, either one segment is equal in both, or each differs by exactly one bit. So each fingerprint is
looked up in the table of the first segment by itself and by every value that has one zero bit set (the Hamming
ball of radius 1, each pair met from one side only), and in the table of the second segment by itself; every match
is verified by the distance of the whole fingerprints. Only distinct fingerprints take part: copies add nothing,
and a fingerprint has at most 2,080 others within distance 2, so links stay in proportion to the fingerprints.
Components are found on the fingerprints that have a link.

Defined results: a null or empty text has fingerprint zero; repeated rows and ties share the fingerprint and the
component; a component's id is its smallest doc_id that isn't null, null if there is none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components

SEED = 42
DISTANCE = 2


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(total: np.ndarray, n: int) -> int:
    """The bits that more than half of n hashes have, as a signed long."""
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: bytes, width: int) -> int:
    ws = text.lower().split()
    if not ws:
        return 0
    n = max(1, len(ws) - width + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        grams = [b" ".join(ws)]
    elif width == 3:
        grams = [a + b" " + b + b" " + c for a, b, c in zip(ws, ws[1:], ws[2:])]
    else:
        grams = [b" ".join(ws[i : i + width]) for i in range(n)]
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        total += votes(np.fromiter((digest(g, SEED) for g in grams[at : at + (1 << 16)]), np.uint64))
    return majority(total, n)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and _fp, the fingerprint as a signed long. A scan; texts go to Python in Arrow batches."""
    names = ["doc_id", "_fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py() or b"", width) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text"), "UTF-8").alias("t")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def links(fps: DataFrame) -> DataFrame:
    """Pairs a, b of the distinct fingerprints in column _fp that differ in at most DISTANCE bits, each pair once."""
    cut = fps.select("_fp", F.shiftrightunsigned("_fp", 32).alias("hi"), F.col("_fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))
    ball = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.pow(F.lit(2.0), i).cast("long"))
    clear = F.filter(ball, lambda bit: F.col("hi").bitwiseAND(bit) == 0)
    near = cut.select(F.col("_fp").alias("a"), F.explode(F.transform(clear, lambda bit: F.col("hi").bitwiseOR(bit))).alias("seg"), F.lit(1).alias("kind"))
    same_hi = cut.select(F.col("_fp").alias("a"), F.col("hi").alias("seg"), F.lit(0).alias("kind"))
    same_lo = cut.select(F.col("_fp").alias("a"), F.col("lo").alias("seg"), F.lit(2).alias("kind"))
    tables = cut.select(F.col("_fp").alias("b"), F.explode(F.array(F.struct(F.col("hi").alias("seg"), F.lit(0).alias("part")), F.struct(F.col("lo").alias("seg"), F.lit(2).alias("part")))).alias("t")).select("b", "t.*")
    probes = near.union(same_hi).union(same_lo).withColumn("part", F.when(F.col("kind") == 2, 2).otherwise(0))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    other_lo = F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(0xFFFFFFFF)))
    met = probes.join(tables, ["seg", "part"]).where(
        (distance <= DISTANCE)
        & F.when(F.col("kind") == 0, F.col("a") < F.col("b")).when(F.col("kind") == 1, other_lo == 1).otherwise((F.col("a") < F.col("b")))
    )
    return met.select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, _fp and component_id of every row of docs."""
    made = staged(fingerprints(docs, width), "fingerprints")
    each = made.groupBy("_fp").agg(F.min("doc_id").alias("first"))
    comps = staged(connected_components(links(each)), "components")
    named = each.join(comps, each["_fp"] == comps["node"], "left").select("_fp", "first", F.coalesce("component", "_fp").alias("c"))
    smallest = named.groupBy("c").agg(F.min("first").alias("component_id"))
    by_fp = named.join(smallest, "c").select("_fp", "component_id")
    return made.join(by_fp, "_fp").select("doc_id", "_fp", "component_id")
