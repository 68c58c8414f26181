"""Exact repeats of 50 bytes across documents, by suffix arrays per shard and merging between shards.

1. Documents are gathered into blocks (the shards). In each 50-byte window the smallest hash among its 20-byte
   grams is its anchor; windows in a row with one anchor make a run. Equal windows have equal anchors, so a window
   can only be repeated under its own anchor.
2. A block asks the anchors' buckets about its distinct runs, by anchor and digest of the run's text. Where all
   runs of an anchor have one text, the smallest document of that text decides for the run as a whole. Where texts
   differ (at the ends of shared passages, at edits), the run's windows have to be compared.
3. For those a block builds a suffix array by Larsson-Sadakane refinement (groups of suffixes that are told apart
   are left alone) and Kasai common prefixes; neighbours with 50 common bytes are one group, with its smallest
   document. Groups go, sorted, to buckets, which merge the shards by binary search and answer with the smallest
   document that has the string.
4. Bytes covered by a window that a smaller document has go; the rest is kept.

All windows of all texts take part. Every decision is exact up to collisions of hashes: an anchor's 64 bits and a digest's 48
in step 2; in step 4, within a bucket, 64 bits, and with the bucket's choice by a second hash log2(buckets) bits more. A hot
string costs a bucket one entry a block.

Defined results: a null or empty text has nothing to remove, as has a text of under 50 bytes; documents of equal
doc_id don't remove from each other; a null doc_id is larger than any other; other columns are ignored. A block
holds at least one whole document, which bounds memory by the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import answer, bucket_of, buckets_for, deltas, each_block, gather, map_blocks, mix, pack, pieces, release, unpack
from .common import LAST_ID, staged

MATCH, GRAM = 50, 20
BLOCK_BYTES = 1 << 20
_U64 = np.uint64
_BASE = 0xD1342543DE82EF95  # odd, 5 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES = np.random.default_rng(20).integers(0, 1 << 63, (2, 256)).astype(np.uint64) * _U64(2) + _U64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between calls."""
    if base not in _powers or len(_powers[base]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        p = np.ones(size, np.uint64)
        done = 1
        while done < size:
            p[done : 2 * done] = p[:done] * _U64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = p
    return _powers[base][:n]


class Hashes:
    """Hashes of any ranges of a byte array."""

    def __init__(self, text: np.ndarray, table: int = 0):
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_TABLES[table][text] * _power(_BASE, len(text)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.sums)
        return mix((self.sums[end] - self.sums[start]) * _power(_INVERSE, n)[start])

    def grams(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:-width]) * _power(_INVERSE, n)) if n > 0 else np.zeros(0, np.uint64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Block:
    """A block's documents as one byte array, and the runs of windows under their anchors."""

    def __init__(self, data: bytes):
        ids, null, sizes, self.text = unpack(data)
        self.ids, self.null, self.sizes = ids, null, sizes
        self.order = np.where(null, LAST_ID, ids)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    def runs(self):
        """lo, hi (first and last window start), anchor hash and text digest of each run, and its document's place."""
        n, width = len(self.text), MATCH - GRAM + 1
        if n < MATCH:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64), none
        hashes = Hashes(self.text)
        grams = hashes.grams(GRAM)
        low = _sliding_min((grams & ~_U64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64), width)
        anchor = (low & _U64(0xFFFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)[: len(anchor)]
        valid = np.zeros(len(anchor), bool)
        inside = np.diff(self.starts) >= MATCH
        step = np.zeros(n + 1, np.int32)
        step[self.starts[:-1][inside]] += 1
        np.add.at(step, self.starts[1:][inside] - MATCH + 1, -1)
        valid = np.cumsum(step)[: len(anchor)] > 0
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        lo = np.flatnonzero(first)
        end = np.minimum.reduceat(np.where(valid, n, np.arange(len(anchor))), lo) if len(lo) else lo
        after = np.append(lo[1:], len(anchor))
        hi = np.minimum(after, np.where(end < n, end, len(anchor))) - 1
        # anchors are minima, so small: mixed again they spread over the buckets
        return lo, hi, mix(grams[anchor[lo]]), hashes.of(lo, hi + MATCH), doc[lo]


def _pairs(order, gram, digest):
    """Distinct (anchor, digest) in ascending order: an index of each pair's smallest document, and each run's pair."""
    at = np.lexsort((order, digest, gram))
    new = np.ones(len(at), bool)
    new[1:] = (gram[at][1:] != gram[at][:-1]) | (digest[at][1:] != digest[at][:-1])
    pair = np.empty(len(at), np.int64)
    pair[at] = np.cumsum(new) - 1
    return at[new], pair


def _six(x: np.ndarray) -> np.ndarray:
    return x >> _U64(16)


def _build(ids, texts) -> bytes:
    null = np.array([i is None for i in ids], bool)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    return pack(np.array([i or 0 for i in ids], np.int64), null, np.array([len(t) for t in texts], np.int64), joined, level=6)


def _ask_runs(buckets: int):
    def work(block: int, data: bytes):
        b = Block(data)
        _, _, gram, digest, doc = b.runs()
        if not len(gram):
            return []
        one, _ = _pairs(b.order[doc], gram, _six(digest))
        gram, digest, order = gram[one], _six(digest[one]), b.order[doc[one]]
        return [(block, k, pack(deltas(gram[s:e]), digest[s:e], order[s:e])) for k, s, e in pieces(bucket_of(gram, buckets))]

    return work


def _merge_runs(bucket: int, blocks: list[int], blobs: list[bytes]):
    parts = [unpack(x) for x in blobs]
    gram = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    digest = np.concatenate([p[1] for p in parts])
    order = np.concatenate([p[2] for p in parts])
    at = np.lexsort((digest, gram))
    g, d = gram[at], digest[at]
    new_gram = np.append(True, g[1:] != g[:-1])
    new = new_gram | np.append(True, d[1:] != d[:-1])
    low = np.minimum.reduceat(order[at], np.flatnonzero(new))[np.cumsum(new) - 1]
    texts = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_gram))[np.cumsum(new_gram) - 1]
    least, several = np.empty_like(order), np.empty(len(order), bool)
    least[at], several[at] = low, texts > 1
    ends = np.cumsum([len(p[1]) for p in parts])
    # the answer is told as a difference from what the block knows: mostly zero
    return [(b, bucket, pack(order[e - len(p[1]) : e] - least[e - len(p[1]) : e], several[e - len(p[1]) : e])) for b, p, e in zip(blocks, parts, ends, strict=True)]


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their next `depth` bytes, and each position's rank (equal where those bytes are).

    Larsson-Sadakane: the order by 7 bytes is refined by the ranks further on; only positions whose group isn't
    a single one are sorted again. A position past the end ranks before all others.
    """
    n, first = len(text), min(7, depth)
    padded = np.append(text.astype(np.uint64) + _U64(1), np.zeros(first, np.uint64))
    key = np.zeros(n, np.uint64)
    for k in range(first):
        key = key << _U64(9) | padded[k : n + k]
    sa = np.argsort(key)
    head = np.append(True, key[sa][1:] != key[sa][:-1])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    done = first
    while done < depth:
        step = min(done, depth - done)
        single = head & np.append(head[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        pos = sa[slots]
        further = pos + step
        second = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        group = rank[pos]
        o = np.argsort(group * (n + 1) + second)
        pos, second, group = pos[o], second[o], group[o]
        sa[slots] = pos
        new = np.append(True, (group[1:] != group[:-1]) | (second[1:] != second[:-1]))
        head[slots] = new
        rank[pos] = np.maximum.accumulate(np.where(new, slots, 0))
        done += step
    return sa, rank


def kasai(text: np.ndarray, sa: np.ndarray, limit: int, stride: int = 16) -> np.ndarray:
    """Common prefix of each suffix in sa with the one before it, up to limit bytes.

    Kasai's bound (the prefix at a position is at most one shorter than at the position before) is carried through
    runs of `stride` positions; all runs advance together. Suffixes that agree up to the limit are in no order, so
    there the bound holds only if the neighbour moved on by one still comes first.
    """
    n = len(text)
    padded = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
    eight = np.zeros(n, np.uint64)
    for k in range(8):
        eight = eight << _U64(8) | padded[k : n + k]
    place = np.empty(n + 1, np.int64)
    place[sa], place[n] = np.arange(n), n
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    found = np.zeros(n, np.int64)
    for k in range(stride):
        i = np.arange(k, n, stride)
        j = before[i]
        h = np.zeros(len(i), np.int64)
        if k:
            last = found[i - 1]
            h = np.where((last >= limit) & (place[before[i - 1] + 1] > place[i]), 0, np.maximum(last - 1, 0))
        h[j < 0] = 0
        most = np.minimum(limit, n - np.maximum(i, j))
        live = np.flatnonzero((j >= 0) & (h < most))
        while len(live):
            x = eight[i[live] + h[live]] ^ eight[j[live] + h[live]]
            h[live] += sum((x < _U64(1 << 8 * k)).astype(np.int64) for k in range(8))
            live = live[(x == 0) & (h[live] < most[live])]
        h = np.where(j >= 0, np.minimum(h, most), 0)
        found[i] = h
    return found[sa]


def _in_a_row(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray):
    """Runs of one document that follow each other without a gap, as one."""
    if not len(lo):
        return lo, hi, doc
    new = np.append(True, (lo[1:] != hi[:-1] + 1) | (doc[1:] != doc[:-1]))
    return lo[new], hi[np.append(np.flatnonzero(new)[1:], len(lo)) - 1], doc[new]


def _open_windows(lo: np.ndarray, hi: np.ndarray):
    """Window starts of runs [lo, hi], and each start's place in the runs' texts laid end to end; text ranges too."""
    n = hi - lo + 1
    run = np.repeat(np.arange(len(lo)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return lo[run] + inside, (np.cumsum(n + MATCH - 1) - (n + MATCH - 1))[run] + inside, run


def _groups(digest: np.ndarray, second: np.ndarray, buckets: int):
    """Distinct strings by (bucket, digest): an index of each, and each window's."""
    bucket = bucket_of(second, buckets)
    at = np.lexsort((digest, bucket))
    new = np.ones(len(at), bool)
    new[1:] = (digest[at][1:] != digest[at][:-1]) | (bucket[at][1:] != bucket[at][:-1])
    which = np.empty(len(at), np.int64)
    which[at] = np.cumsum(new) - 1
    return at[new], which, bucket


def _decide_runs(buckets: int):
    def work(block: int, data: dict[int, bytes]):
        b = Block(data.pop(-1))
        lo, hi, gram, digest, doc = b.runs()
        order = b.order[doc]
        one, pair = _pairs(order, gram, _six(digest)) if len(gram) else (lo, lo)
        told = [unpack(data[k]) for k in sorted(data)]
        least = order[one] - np.concatenate([t[0] for t in told]) if told else order[one]
        several = np.concatenate([t[1] for t in told]) if told else np.zeros(0, bool)
        gone = least[pair] < order if len(gram) else np.zeros(0, bool)
        left = ~gone & several[pair] if len(gram) else gone
        open_lo, open_hi, open_doc = _in_a_row(lo[left], hi[left], doc[left])
        rows = [(block, -2, pack(*_in_a_row(lo[gone], hi[gone], doc[gone])[:2], open_lo, open_hi, open_doc))]
        if left.any():
            starts, place, run = _open_windows(open_lo, open_hi)
            text = np.concatenate([b.text[s : e + MATCH] for s, e in zip(open_lo.tolist(), open_hi.tolist(), strict=True)])
            sa, _ = suffix_array(text, MATCH)
            same = kasai(text, sa, MATCH) >= MATCH
            group = np.empty(len(text), np.int64)
            group[sa] = np.cumsum(~same)
            # of each group of windows: its smallest document, and a window that stands for it
            mine, owner = group[place], b.order[open_doc][run]
            at = np.lexsort((owner, mine))
            first = at[np.append(True, mine[at][1:] != mine[at][:-1])]
            s = starts[first]
            d, second = Hashes(b.text).of(s, s + MATCH), Hashes(b.text, 1).of(s, s + MATCH)
            one, _, bucket = _groups(d, second, buckets)
            d, who, bucket = d[one], owner[first][one], bucket[one]
            rows += [(block, k, pack(deltas(d[x:y]), who[x:y])) for k, x, y in pieces(bucket)]
        return rows

    return work


def _merge_shards(bucket: int, blocks: list[int], blobs: list[bytes]):
    """Each shard's sorted strings are found in the merged ones by binary search; the smallest document wins."""
    parts = [(np.cumsum(d, dtype=np.uint64), who) for d, who in map(unpack, blobs)]
    merged = np.unique(np.concatenate([d for d, _ in parts]))
    least = np.full(len(merged), LAST_ID, np.int64)
    places = [np.searchsorted(merged, d) for d, _ in parts]
    for at, (_, who) in zip(places, parts, strict=True):
        least[at] = np.minimum(least[at], who)
    return [(b, bucket, pack(who - least[at])) for b, at, (_, who) in zip(blocks, places, parts, strict=True)]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(buckets: int, texts: bool):
    def work(part: pd.DataFrame) -> pd.DataFrame:
        data = dict(zip(part["bucket"].tolist(), part["data"], strict=True))
        b = Block(data.pop(-1))
        lo, hi, open_lo, open_hi, open_doc = unpack(data.pop(-2))
        if len(open_lo):
            starts, _, run = _open_windows(open_lo, open_hi)
            d, second = Hashes(b.text).of(starts, starts + MATCH), Hashes(b.text, 1).of(starts, starts + MATCH)
            one, which, _ = _groups(d, second, buckets)
            owner = b.order[open_doc][run]
            least = np.full(len(one), LAST_ID, np.int64)
            np.minimum.at(least, which, owner)
            if data:
                least -= np.concatenate([unpack(data[k])[0] for k in sorted(data)])
            gone = starts[least[which] < owner]
            lo, hi = np.concatenate([lo, gone]), np.concatenate([hi, gone])
        step = np.zeros(len(b.text) + 1, np.int32)
        np.add.at(step, lo, 1)
        np.add.at(step, hi + MATCH, -1)
        covered = np.cumsum(step)[:-1] > 0
        rows = []
        for k in range(len(b.sizes)):
            s, e = b.starts[k], b.starts[k + 1]
            c, t = covered[s:e], b.text[s:e]
            kept = t[~c].tobytes() if c.any() else t.tobytes()
            spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum())
            rows.append((None if b.null[k] else int(b.ids[k]), int(e - s), int(c.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])])
        return out.astype({"doc_id": pd.ArrowDtype(pa.int64())}) if b.null.any() else out

    return work


def dedup_substrings(docs: DataFrame, texts: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs; with texts also kept, the bytes left."""
    spark = docs.sparkSession
    blocks = gather(docs, block_bytes, len, _build)
    buckets = buckets_for(blocks)
    first = answer(map_blocks(blocks, _ask_runs(buckets)), _merge_runs)
    decided = staged(each_block(blocks.union(first), _decide_runs(buckets)), "runs")
    release(spark)
    second = answer(decided.where(F.col("bucket") >= 0), _merge_shards)
    rows = blocks.union(decided.where(F.col("bucket") == -2)).union(second)
    return rows.groupBy("block").applyInPandas(_finish(buckets, texts), RESULT + (", kept binary" if texts else ""))
