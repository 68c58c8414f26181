"""Near copies of documents: sets of word shingles whose Jaccard similarity is SIMILARITY or more.

Texts meet first by SimHash: every text has op2's 64-bit fingerprint, over these shingles, and op2's search (segments and
Hamming balls) finds the fingerprints that differ in at most 2 bits. Such a pair is linked if its whole sets are similar.

Copies of similarity 0.8 differ in more bits than can be searched for, so sets meet in a second way too.
Every document's set of shingles has ROWS * BANDS minima of random orders (MinHash). Two sets of similarity s agree on
a band of ROWS minima with probability s ** ROWS, so they meet in at least one of the bands with probability
1 - (1 - s ** ROWS) ** BANDS: 0.997 at 0.8. Every pair that meets, in either way, is verified by the similarity of the whole sets. The
groups are the components of the verified pairs.

Only distinct sets take part: copies add nothing. Up to ALL_PAIRS sets in one place of a band are all compared with
each other. In a larger place they would be too many: there, sets are dealt at random, in each band anew, into parts of
about PART that are compared with each other, which holds large groups of near copies together. What such places leave open is
then decided exactly. Of all sets that are in any of them, words (shingles) are put in order, rarest first, by a sketch of their
counts; two similar sets have their first common word early in both, the earlier the less their sizes differ from what
their overlap allows. So sets meet by such a word and the bucket of their size, and only where they aren't in one
component yet. What thousands of texts have from one template stands last in this order and brings no two of them together.

Defined results: null and empty texts have the empty set and are one group; a text of fewer words than a shingle is one
shingle; shingles are told apart by 32-bit hashes; rows equal in doc_id and text are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import discard, order_id, staged
from .components import connected_components

SEED = 42
SIMILARITY = 0.8
ROWS, BANDS = 5, 15
ALL_PAIRS, PART = 16, 6
#: The sketch has so many counters, whatever the corpus; sizes of one bucket differ by less than SIZE_STEP.
SKETCH, SLICES = 1 << 21, 32
SIZE_STEP = 1.06
#: SIMILARITY as a fraction.
_P, _Q = 4, 5
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 12
#: Tables staged on the way have no more files than one for so many documents, LEAST_FILES where that is fewer.
DOCS_A_FILE, LEAST_FILES = 5000, 12


def runs(text: bytes, width: int) -> np.ndarray:
    """64-bit hashes of the runs of width words, one by one."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    n = max(1, len(ws) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(ws[i : i + width]), SEED) for i in range(n)), np.uint64, n)


def shingles(h: np.ndarray) -> np.ndarray:
    """The distinct ones of the hashes h, ascending in their upper half, which tells them apart."""
    return h[np.unique(h >> np.uint64(32), return_index=True)[1]]


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of the hashes h, repeats included, as op2 makes it."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += simhash.votes(h[at : at + (1 << 16)])
    return simhash.majority(total, len(h))


def bands(h: np.ndarray) -> list[int]:
    """A hash of the minima of each band."""
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    upper = h & np.uint64(0xFFFFFFFF00000000)
    for at in range(0, len(h), _CHUNK):
        np.minimum(low, np.multiply.outer(_ODD, upper[at : at + _CHUNK] >> np.uint64(32) | upper[at : at + _CHUNK]).min(axis=1), out=low)
    return [xxhash.xxh64_intdigest(low[k : k + ROWS].tobytes(), k) - (1 << 63) for k in range(0, len(low), ROWS)]


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets of distinct 32-bit hashes."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """_id, _th, _fp (a hash of the set), sim (its text's SimHash), bands and set of each row. A scan; texts go to Python in Arrow batches."""
    names = ["_id", "_th", "_fp", "sim", "bands", "set"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sims, places, sets = [], [], [], []
            for t in b.column(2):
                every = runs(t.as_py() or b"", width)
                h = shingles(every)
                data = (h >> np.uint64(32)).astype("<u4").tobytes()
                fps.append(xxhash.xxh64_intdigest(data, SEED) - (1 << 63))
                sims.append(fingerprint(every))
                places.append(bands(h) if len(h) else [])
                sets.append(data)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fps, pa.int64()), pa.array(sims, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=names)

    key = [order_id(F.col("doc_id")).alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_th")]
    return docs.select(*key, F.encode(F.col("text"), "UTF-8").alias("t")).mapInArrow(run, "_id long, _th long, _fp long, sim long, bands array<long>, set binary")


def _places(each: DataFrame) -> DataFrame:
    return each.select("_fp", F.posexplode("bands").alias("band", "place"))


def _near_fingerprints(each: DataFrame) -> DataFrame:
    """Pairs a, b (a < b) of sets whose fingerprints differ in at most simhash.DISTANCE bits, by op2's search.

    A fingerprint's smallest set stands for it: it meets the others of its fingerprint, and those that stand for near ones.
    """
    of = each.select("_fp", F.col("first.sim").alias("sim"))
    stands = of.groupBy("sim").agg(F.min("_fp").alias("set"))
    side = lambda name, to: stands.select(F.col("sim").alias(name), F.col("set").alias(to))
    near = simhash.links(stands.select(F.col("sim").alias("_fp"))).join(side("a", "x"), "a").join(side("b", "y"), "b")
    same = of.join(stands, "sim").where("_fp <> set").select(F.col("set").alias("a"), F.col("_fp").alias("b"))
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(same)


def _met(each: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs a, b (a < b) of the sets _fp that meet in a band, each pair once. large: places of many sets, with their count."""
    part = F.coalesce(F.pmod(F.xxhash64("_fp", "band"), F.ceil(F.col("count") / PART)), F.lit(0))
    parts = _places(each).join(large, ["band", "place"], "left").groupBy("band", "place", part.alias("part")).agg(F.sort_array(F.collect_list("_fp")).alias("in")).where(F.size("in") > 1)
    first = parts.select(F.posexplode("in").alias("i", "a"), "in")
    return first.select("a", F.explode(F.slice("in", F.col("i") + 2, F.size("in"))).alias("b")).distinct()


def _of(made: DataFrame, each: DataFrame, nodes: DataFrame) -> DataFrame:
    """_fp and set of the sets in nodes, each once. made: rows of _sets; each: _fp, bands and first, a row that has the set."""
    rows = each.join(nodes, "_fp", "left_semi").select("first._id", "first._th")
    return made.join(rows, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select("_fp", "set")


def links(made: DataFrame, each: DataFrame, met: DataFrame, files: int) -> DataFrame:
    """The pairs a, b of met whose sets are similar."""
    met = staged(met, "met", files)
    nodes = met.select(F.col("a").alias("_fp")).union(met.select("b")).distinct()
    sets = staged(_of(made, each, nodes), "sets", files)
    with_a = met.join(sets.select(F.col("_fp").alias("a"), F.col("set").alias("x")), "a")
    both = with_a.join(sets.select(F.col("_fp").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [similarity(x.as_py(), y.as_py()) >= SIMILARITY for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    found = staged(both.mapInArrow(run, "a long, b long"), "similar", files)
    discard(made.sparkSession, met)
    discard(made.sparkSession, sets)
    return found


def _slot(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint32(32 - SKETCH.bit_length() + 1)).astype(np.int64)


def sketch(sets: DataFrame) -> np.ndarray:
    """SKETCH counters of words: no word's is below the number of sets that have it."""
    width = SKETCH // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            for x in b.column(0):
                np.add.at(total, _slot(np.frombuffer(x.as_buffer(), "<u4")), 1)
        parts = [zstandard.compress(total[k * width : (k + 1) * width].tobytes(), 1) for k in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def add(key, part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in part["counts"])
        return pd.DataFrame({"slice": [key[0]], "counts": [np.minimum(total, np.iinfo(np.int32).max).astype("<i4").tobytes()]}).astype({"slice": "int32"})

    made = sets.select("set").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary")
    rows = {r["slice"]: np.frombuffer(r["counts"], "<i4") for r in made.collect()}  # SLICES rows
    return np.concatenate([rows.get(k, np.zeros(width, "<i4")) for k in range(SLICES)])


def _size_bucket(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(SIZE_STEP) + 1e-9).astype(np.int32)


def meeting_words(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """probe, word, size bucket, n, most: the rows by which a set of words meets others.

    In the order of their counts, a set of n words whose first word in common with one of m is its i-th has at most n - i
    in common with it, and needs (n + m) * _P / (_P + _Q). With probe 0 a set is found under its own size by larger ones, of
    `most` words at most; with probe 1 it looks for smaller ones. Words that no other set has are left out.
    """
    n, often = len(words), counts[_slot(words)]
    order = np.lexsort((words, often))
    place = np.arange(n)
    most = (_P + _Q) * (n - place) // _P - n
    shared = often[order] > 1
    own = np.flatnonzero(shared & (most >= n))
    least = -(-_P * n // _Q)
    to = np.minimum(most, n)
    look = np.flatnonzero(shared & (to >= least))
    low, high = int(_size_bucket(np.array([least]))[0]), _size_bucket(to[look])
    times = high - low + 1
    at = np.repeat(look, times)
    bucket = low + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    probe = np.concatenate([np.zeros(len(own), np.int8), np.ones(len(at), np.int8)])
    where = np.concatenate([own, at])
    buckets = np.concatenate([np.full(len(own), int(_size_bucket(np.array([n]))[0]), np.int32), bucket.astype(np.int32)])
    return probe, words[order][where].astype(np.int64), buckets, np.full(len(where), n, np.int32), np.where(probe == 0, most[where], to[where]).astype(np.int32)


def _open_pairs(made: DataFrame, each: DataFrame, large: DataFrame, comps: DataFrame, files: int) -> DataFrame:
    """Pairs a, b of sets in large places that can be similar and aren't in one component. Exact."""
    crowd = _places(each).join(large, ["band", "place"], "left_semi").select("_fp").distinct()
    sets = staged(_of(made, each, crowd).join(comps, F.col("_fp") == comps["node"], "left").select("_fp", F.coalesce("component", "_fp").alias("c"), "set"), "crowd", files)
    counts = sketch(sets)
    names = ["_fp", "c", "probe", "word", "bucket", "n", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fp, c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows = meeting_words(np.frombuffer(x.as_buffer(), "<u4"), counts)
                k = len(rows[0])
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, fp)), pa.array(np.full(k, c)), *map(pa.array, rows)], names=names)

    rows = staged(sets.mapInArrow(run, "_fp long, c long, probe tinyint, word long, bucket int, n int, most int"), "words")
    live = rows.groupBy("word", "bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("probe").alias("p"), F.max("probe").alias("q")).where("lo < hi and p < q").select("word", "bucket")
    found = rows.where("probe = 0").select("word", "bucket", F.col("_fp").alias("b"), F.col("c").alias("cb"), F.col("n").alias("m"), F.col("most").alias("most_b"))
    looks = rows.where("probe = 1").join(live, ["word", "bucket"], "left_semi").select("word", "bucket", F.col("_fp").alias("a"), "c", "n", "most")
    pairs = looks.join(found, ["word", "bucket"]).where("c <> cb and m <= most and n <= most_b and (m < n or b < a)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(made: DataFrame, each: DataFrame, files: int) -> DataFrame:
    """node, component of every set _fp that has a similar one. files: of each table staged on the way, at most."""
    spark = made.sparkSession
    large = staged(_places(each).groupBy("band", "place").count().where(F.col("count") > ALL_PAIRS), "large", files)
    met = _near_fingerprints(each).union(_met(each, large)).distinct()
    comps = staged(connected_components(links(made, each, met, files), files), "components", files)
    if large.isEmpty():
        return comps
    more = links(made, each, _open_pairs(made, each, large, comps, files), files)
    of = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = staged(connected_components(between, files), "joined", files)
    moved = comps.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    alone = joined.join(comps.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
    made = staged(moved.union(alone.select("node", "component")), "components", files)
    discard(spark, comps)
    return made


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of docs without all but one document of each group: the smallest (doc_id, text hash) stays.

    Rows equal in doc_id and text are one document; one of them stays.
    """
    named = docs.select(F.struct("*").alias("_row"), order_id(F.col("doc_id")).alias("_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_th"))
    made = staged(_sets(docs, width), "shingles")
    files = max(LEAST_FILES, made.count() // DOCS_A_FILE)
    each = staged(made.groupBy("_fp").agg(F.min(F.struct("_id", "_th", "sim")).alias("first"), F.first("bands").alias("bands")), "each", files)
    comps = groups(made, each, files)
    best = each.select("_fp", "first").join(comps, F.col("_fp") == comps["node"], "left").groupBy(F.coalesce("component", "_fp").alias("c")).agg(F.min("first").alias("first"))
    keep = best.select("first._id", "first._th")
    one = Window.partitionBy("_id", "_th").orderBy("_id")
    return named.join(keep, ["_id", "_th"], "left_semi").withColumn("_n", F.row_number().over(one)).where("_n = 1").select("_row.*")
