"""LM scoring by a hierarchical Pitman-Yor process over words: bigram restaurants that share the unigram restaurant.

Each context word u has a restaurant in which the words after it are customers; every table there sends a customer
to the parent, the unigram restaurant, whose base is uniform over the training words and one unknown word:

    P(w)   = (t_w - d m_w + (s0 + d m) / (V + 1)) / (s0 + t)
    P(w|u) = (c_uw - d t_uw + (s1 + d t_u) P(w)) / (s1 + c_u)

with c customers, t tables and m tables of the parent, and discount d = 1/2 in both.

Seating is sampled by Gibbs. A restaurant's new tables depend on its other dishes by the factor (s + d)(s + 2d) ... of
the number of its tables alone; a gamma variable x with shape s / d + tables takes its place, given which dishes
are independent: a dish of c customers has t tables with weight S(c, t) (d x P)^t, S being the generalised Stirling
numbers, which have a closed form at d = 1/2. So a sweep draws x for each restaurant, then all its dishes' tables from
their exact conditionals, for any number of customers. ROUNDS seatings alternate with the parent: it takes the tables
of the last sweep as customers, is seated in the same way, and its new probabilities are those of the next seating.
The strength s1 is drawn after each seating from its conditional on the grid STRENGTHS. Predictive probabilities are
averaged: the parent's over the rounds, the restaurants' own parts over the last seating's sweeps after the burn-in
(they are linear in the numbers of tables, so those are averaged).

Documents are gathered into blocks. A block tells the contexts' buckets its distinct word pairs once; a bucket merges
them into its restaurants, which stay, and notes the places of each block's pairs. A round moves words only: a bucket
asks the words' buckets for the parent's values of its words, seats its restaurants, and sends the tables. In the end the
blocks get their pairs' probabilities and their words' counts, and score their documents by themselves. Pairs of contexts that make
up more than 1 in HOT_SHARE of the corpus (there can't be more than HOT_SHARE of them) are dealt by both words.
Their x is drawn alike in all buckets, from their tables over all buckets after the seating before, which a table
of that bounded size tells; so dishes in different buckets are sampled as those in one; the same totals stand in their predictive probabilities. All pairs of all documents take
part; nothing is pruned.

Defined results: a null or empty text is one end token; a null doc_id is written as the empty text for the hash
and so trains; repeated rows train and are scored each; ties don't arise, as nothing is ranked; a very long text is
one block's; other columns are ignored; an empty table gives no rows. Words are told apart by 64-bit hashes, in pairs
by 48 bits of each beside the bucket. Probabilities of pairs travel as 16-bit logarithms (steps of 0.07 %). The same
table, partitioned alike, gives the same scores (the sampler is seeded by bucket and round).
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SCHEMA, answer, bucket_of, buckets_for, deltas, frame, gather, map_blocks, mix, pack, pieces, release, unpack
from .common import discard, staged

BLOCK_BYTES = 16 << 20
FOLDS, HELD = 7, 2
DISCOUNT, PARENT_STRENGTH = 0.5, 10.0
STRENGTHS = 0.25 * 2.0 ** np.arange(16)
#: Sweeps of a seating, of the last one, and those of the last one that are not averaged.
SWEEPS, LAST_SWEEPS, BURN_IN, ROUNDS = 3, 6, 2, 4
SEED = 29
#: Weights in memory at once while tables are drawn.
SLICE = 1 << 17
HOT_SHARE = 4096
#: Hashes that no word is likely to have: the end of a text as a word, its start as a context.
END = np.uint64(xxhash.xxh64_intdigest(b"\x00end", 1))
START = np.uint64(xxhash.xxh64_intdigest(b"\x00start", 1))
#: Pairs' own probabilities and contexts' weights travel as logarithms in steps of 2 ** (1 / FINE) (0.07 %).
FINE = 512
#: Blocks below zero in rows: totals of a bucket, hot words, restaurants, hot contexts' totals, words of the parent;
#: tables or words of bucket k are -TABLES - k, values from the words' bucket k are -VALUES - k.
SUMS, HOT, SEATS, HOT_SUMS, WORDS = -1, -2, -3, -4, -5
TABLES, VALUES = 1 << 40, 1 << 41
#: Buckets of answers about words are told from those about pairs by this.
WORD_MARK = 1 << 30
_U64 = np.uint64
_SIX = _U64(16)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def _build(ids, texts) -> bytes:
    """Documents as local word numbers, in the order of first occurrence (0 is the end), which compress; the words by hash, ascending, and the numbers' places there."""
    number = defaultdict(itertools.count(1).__next__)
    streams, sizes = [], []
    for t in texts:
        ws = t.lower().split()
        streams.append(np.fromiter(map(number.__getitem__, ws), np.int32, len(ws)))
        streams.append(np.zeros(1, np.int32))
        sizes.append(len(ws) + 1)
    words = np.empty(len(number) + 1, np.uint64)
    words[0] = END
    words[1:] = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in number), np.uint64, len(number))
    words, place = np.unique(words, return_inverse=True)
    tokens = np.concatenate(streams)
    null = np.array([i is None for i in ids], bool)
    held = np.array([held_out(i) for i in ids], bool)
    return pack(np.array([i or 0 for i in ids], np.int64), null, held, np.array(sizes, np.int64), deltas(words), place.astype(np.int32), tokens)


class Block:
    def __init__(self, data: bytes):
        self.ids, self.null, self.held, self.sizes, gaps, place, tokens = unpack(data)
        self.tokens = place[tokens]
        self.words = np.cumsum(gaps, dtype=np.uint64)
        self.train = np.repeat(~self.held, self.sizes)

    def counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.words))

    def pairs(self, hot: np.ndarray, buckets: int):
        """Distinct (context, word) by bucket, context and word hash: u, w (local; u may be -1), count in training, bucket; each token's pair."""
        n = len(self.words)
        u = np.empty(len(self.tokens), np.int64)
        u[1:] = self.tokens[:-1]
        starts = np.cumsum(self.sizes) - self.sizes
        u[starts] = n
        key, which = np.unique(u * (n + 1) + self.tokens, return_inverse=True)
        count = np.bincount(which[self.train], minlength=len(key))
        u, w = key // (n + 1), key % (n + 1)
        hashes = np.append(self.words, START)
        bucket_by_word = bucket_of(mix(hashes), buckets)
        hot_word = np.isin(hashes, hot)
        bucket = bucket_by_word[u]
        both = hot_word[u]
        bucket[both] = bucket_of(mix(hashes[u[both]] ^ mix(hashes[w[both]])), buckets)
        at = np.argsort(bucket, kind="stable")  # contexts and words are in hash order but for START
        back = np.empty(len(at), np.int64)
        back[at] = np.arange(len(at))
        return u[at], w[at], count[at], bucket[at], back[which], hashes


def _ask_counts(buckets: int):
    def work(block: int, data: bytes):
        b = Block(data)
        c = b.counts()
        return [(block, k, pack(deltas(b.words[s:e]), c[s:e])) for k, s, e in pieces(bucket_of(b.words, buckets))]

    return work


def _merge_counts(bucket: int, blocks: list[int], blobs: list[bytes]):
    """Rows SUMS: words in training and their tokens; HOT: words that may be hot; WORDS: the parent's state, of all blocks' words."""
    parts = [(np.cumsum(d, dtype=np.uint64), c) for d, c in map(unpack, blobs)]
    words, place = np.unique(np.concatenate([d for d, _ in parts]), return_inverse=True)
    total = np.bincount(place, np.concatenate([c for _, c in parts]), len(words)).astype(np.int64)
    top = np.flatnonzero(total * HOT_SHARE > total.sum())
    state = pack(deltas(words), total, total.astype(np.float32), np.zeros(len(words), np.float32))
    return [(SUMS, bucket, pack(np.array([np.count_nonzero(total), total.sum()], np.int64))), (HOT, bucket, pack(words[top], total[top])), (WORDS, bucket, state)]


def _told(data: dict[int, bytes], k: int = 0) -> np.ndarray:
    return np.concatenate([unpack(data[x])[k] for x in sorted(data)])


def _ask_pairs(buckets: int, hot: np.ndarray):
    """Each distinct pair, by context and word, with its count here."""

    def work(block: int, data: bytes):
        u, w, count, bucket, _, hashes = Block(data).pairs(hot, buckets)
        rows = []
        for k, s, e in pieces(bucket):
            first = np.flatnonzero(np.append(True, u[s + 1 : e] != u[s : e - 1]))
            said, place = np.unique(w[s:e], return_inverse=True)
            rows.append((block, k, pack(deltas(hashes[u[s:e][first]] >> _SIX), np.diff(np.append(first, e - s)).astype(np.int32), place.astype(np.int32), deltas(hashes[said] >> _SIX), count[s:e].astype(np.int32))))
        return rows

    return work


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: Stirling's series beyond 8."""
    y, low = np.asarray(x, float), np.ones(np.shape(x))
    for _ in range(8):
        low, y = low * np.where(y < 8, y, 1.0), np.where(y < 8, y + 1, y)
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.91893853320467274 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - np.log(low)


def draw_tables(count: np.ndarray, rate: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables t of dishes of count customers (1 or more), with weight S(count, t) rate ** t.

    S are the generalised Stirling numbers of discount 1/2: S(c, t + 1) / S(c, t) = 4 (c - t) / (t (2c - t - 1)). The
    weights fall on both sides of one mode; all t within 9 of its roots and 12 are weighed, the rest is below 1e-12.
    """
    out = np.ones(len(count))
    many = np.flatnonzero(count > 1)
    c, rate = count[many].astype(float), rate[many]
    b = 2 * c - 1 + 4 * rate
    mode = np.clip(np.ceil(8 * rate * c / (b + np.sqrt(np.maximum(b * b - 16 * rate * c, 0)))), 1, c)
    reach = np.ceil(9 * np.sqrt(mode)) + 12
    low, high = np.maximum(1, mode - reach), np.minimum(c, mode + reach)
    n = (high - low + 1).astype(np.int64)
    done = np.cumsum(n)
    at = 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + SLICE, side="right")))
        k = n[at:to]
        starts = np.cumsum(k) - k
        which = np.repeat(np.arange(len(k)), k)
        t = low[at:to][which] + (np.arange(len(which)) - starts[which])
        here, own = c[at:to][which], rate[at:to][which]
        with np.errstate(divide="ignore"):
            step = np.log(4 * own * np.maximum(here - t, 0) / (t * np.maximum(2 * here - t - 1, 0.5)))
        step = np.where(np.isfinite(step), step, 0.0)
        total = np.append(0.0, np.cumsum(step))[:-1]
        weight = total - total[starts][which]
        weight = np.exp(weight - np.maximum.reduceat(weight, starts)[which])
        run = np.cumsum(weight)
        before = np.append(0.0, run[starts[1:] - 1])
        chosen = np.searchsorted(run, before + rng.random(len(k)) * (run[starts + k - 1] - before), side="right")
        out[many[at:to]] = t[np.clip(chosen, starts, starts + k - 1)]
        at = to
    return out


def seat(count: np.ndarray, group: np.ndarray, base: np.ndarray, strength: float, sweeps: int, burn_in: int, seed, given: np.ndarray | None = None):
    """Numbers of tables of each dish by Gibbs sweeps over all restaurants: their mean after the burn-in, and the last ones.

    count: customers of a dish (0: none); group: its restaurant; base: its parent probability; given: the gamma
    variables of restaurants that lie in several buckets, nan for the others.
    """
    rng = np.random.default_rng(seed)
    n = int(group.max()) + 1 if len(group) else 0
    tables = np.minimum(count, 1).astype(float)
    seen = np.flatnonzero(count > 0)
    mean = np.zeros(len(count))
    for sweep in range(sweeps):
        x = rng.standard_gamma(strength / DISCOUNT + np.bincount(group, tables, n))
        if given is not None:
            x = np.where(np.isnan(given), x, given)
        tables[seen] = draw_tables(count[seen], DISCOUNT * x[group[seen]] * base[seen], rng)
        if sweep >= burn_in:
            mean += tables / (sweeps - burn_in)
    return mean, tables


def log_likelihoods(customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Of each strength in STRENGTHS, up to a constant: summed over restaurants of these customers and tables."""
    used = customers > 0
    c, t = customers[used].astype(float), tables[used].astype(float)
    return np.array([(log_gamma(s / DISCOUNT + t) - log_gamma(s + c)).sum() + len(c) * float(log_gamma(np.array([s]))[0] - log_gamma(np.array([s / DISCOUNT]))[0]) for s in STRENGTHS])


class Restaurants:
    """A bucket's contexts and words, ascending; of each pair, by context and word, their places and its customers in training."""

    def __init__(self, data: bytes):
        gaps, sizes, self.w, self.count, words = unpack(data)
        self.contexts, self.words = np.cumsum(gaps, dtype=np.uint64), np.cumsum(words, dtype=np.uint64)
        self.u = np.repeat(np.arange(len(sizes)), sizes)


def _word_rows(bucket: int, words: np.ndarray, buckets: int, values: np.ndarray) -> list:
    """Rows to the words' buckets, from a bucket."""
    return [(-TABLES - bucket, k, pack(deltas(words[s:e]), values[s:e])) for k, s, e in pieces(bucket_of(words << _SIX, buckets))]


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0).astype(np.int32)


def _merge_pairs():
    """Row SEATS: the bucket's restaurants. Rows of blocks: the places of their pairs and contexts there."""

    def work(bucket: int, blocks: list[int], blobs: list[bytes]):
        parts = [unpack(x) for x in blobs]
        names = np.concatenate([np.repeat(np.cumsum(p[0], dtype=np.uint64), p[1]) for p in parts])
        contexts, u = np.unique(names, return_inverse=True)
        del names
        words, w = np.unique(np.concatenate([np.cumsum(p[3], dtype=np.uint64)[p[2]] for p in parts]), return_inverse=True)
        key, which = np.unique(u * len(words) + w, return_inverse=True)
        del u, w
        total = np.bincount(which, np.concatenate([p[4] for p in parts]), len(key)).astype(np.int64)
        sizes = np.bincount(key // len(words), minlength=len(contexts)).astype(np.int32)
        rows = [(SEATS, bucket, pack(deltas(contexts), sizes, (key % len(words)).astype(np.int32), total, deltas(words)))]
        ends = np.cumsum([len(p[2]) for p in parts])
        for b, p, e in zip(blocks, parts, ends, strict=True):
            rows.append((b, bucket, pack(_steps(which[e - len(p[2]) : e]), _steps(np.searchsorted(contexts, np.cumsum(p[0], dtype=np.uint64))))))
        return rows

    return work


def _names(seats: DataFrame, buckets: int) -> DataFrame:
    """Rows to the words' buckets: the words of each bucket's restaurants."""

    def run(batches):
        for b in batches:
            for bucket, data in zip(b["bucket"].tolist(), b["data"], strict=True):
                words = Restaurants(data).words
                yield frame(_word_rows(bucket, words, buckets, np.zeros(len(words), np.int64)))

    return seats.mapInPandas(run, SCHEMA)


def _short(x: np.ndarray) -> np.ndarray:
    """Values from 0 up as 16-bit logarithms; 0 stays 0."""
    return np.where(x > 0, np.clip(np.rint(np.log2(np.maximum(x, 1e-30)) * FINE), -32767, 32767), -32768).astype(np.int16)


def _long(x: np.ndarray) -> np.ndarray:
    return np.where(x > -32768, np.exp2(x / FINE), 0.0)


def _seat_bucket(buckets: int, hot: np.ndarray, strength: float, number: int, last: bool, parent: tuple[float, float], before: tuple | None = None):
    """Seating `number` of a bucket's restaurants under the parent's values of its words.

    parent: (a, b) where a word of value v has the probability (v + a) / b. before: hot contexts, their customers and tables
    over all buckets in the seating before (none in the first). Row HOT_SUMS has the hot contexts' totals here. Not last: rows of
    tables by word, to the parent; row SUMS with the log likelihoods of the strengths from the other contexts. Last:
    answers to the blocks, each pair's own probability and each context's weight of the parent (0 for a hot one, whose
    tables are told by all buckets).
    """

    def work(bucket: int, blocks: list[int], blobs: list[bytes]):
        data = dict(zip(blocks, blobs, strict=True))
        r = Restaurants(data.pop(SEATS))
        value = np.concatenate([unpack(data[k])[0] for k in sorted(data, reverse=True) if k < 0] or [np.zeros(0)]).astype(float)
        base = (value + parent[0]) / parent[1]
        n = len(r.contexts)
        shared = np.isin(r.contexts, hot >> _SIX)
        given, customers, others = np.full(n, np.nan), np.bincount(r.u, r.count, n), np.zeros(n)
        told = dict(zip(before[0].tolist(), zip(before[1], before[2], strict=True), strict=True)) if before is not None else {}
        for k in np.flatnonzero(shared):
            name = int(r.contexts[k])
            customers[k], others[k] = told.get(name, (customers[k], 0.0))
            given[k] = np.random.default_rng([SEED, number, name]).standard_gamma(strength / DISCOUNT + others[k])
        mean, now = seat(r.count, r.u, base[r.w], strength, LAST_SWEEPS if last else SWEEPS, BURN_IN, [SEED, number, bucket], given)
        here, tables = np.bincount(r.u, r.count, n), np.bincount(r.u, mean if last else now, n)
        hot_sums = (HOT_SUMS, bucket, pack(r.contexts[shared], here[shared], tables[shared]))
        if not last:
            sent = np.bincount(r.w, now, len(r.words)).astype(np.int64)
            logs = log_likelihoods(here[~shared], tables[~shared])
            return [hot_sums, *_word_rows(bucket, r.words, buckets, sent), (SUMS, bucket, pack(logs))]
        own = _short(np.maximum(r.count - DISCOUNT * mean, 0) / (strength + customers)[r.u])
        weight = _short(np.where(shared, 0.0, (strength + DISCOUNT * tables) / (strength + customers)))
        places = ((b, [np.cumsum(x, dtype=np.int64) for x in unpack(y)]) for b, y in data.items() if b >= 0)
        return [hot_sums, *((b, bucket, pack(own[which], weight[at])) for b, (which, at) in places)]

    return work


def _first_values(bucket: int, blocks: list[int], blobs: list[bytes]):
    """Before any seating a word's value is its count; rows to the buckets that have named words."""
    data = dict(zip(blocks, blobs, strict=True))
    gaps, _, value, _ = unpack(data[WORDS])
    words = np.cumsum(gaps, dtype=np.uint64) >> _SIX
    return [(WORDS, bucket, data.pop(WORDS)), *_values(bucket, data, words, value)]


def _values(bucket: int, data: dict[int, bytes], words: np.ndarray, value: np.ndarray) -> list:
    found = lambda x: value[np.searchsorted(words, np.cumsum(unpack(x)[0], dtype=np.uint64))]
    return [(-VALUES - bucket, -b - TABLES, pack(found(x).astype(np.float32))) for b, x in data.items()]


def _parent(number: int, n_words: int, x: float, parent: tuple[float, float]):
    """The parent's seating: its customers are the tables sent; x its gamma variable; parent: how values told until now.

    State: words, their counts in training, their values, and their probabilities summed over the rounds until now (not the counts of the start).
    Row SUMS has the customers and tables here.
    """

    def work(bucket: int, blocks: list[int], blobs: list[bytes]):
        data = dict(zip(blocks, blobs, strict=True))
        gaps, count, before, summed = unpack(data.pop(WORDS))
        words = np.cumsum(gaps, dtype=np.uint64) >> _SIX
        customers = np.zeros(len(words), np.int64)
        for y in data.values():
            named, sent = unpack(y)
            customers[np.searchsorted(words, np.cumsum(named, dtype=np.uint64))] += sent
        tables = np.where(customers > 0, draw_tables(np.maximum(customers, 1), np.full(len(words), DISCOUNT * x / (n_words + 1)), np.random.default_rng([SEED, number, bucket, 1])), 0)
        value = customers - DISCOUNT * tables
        if number:
            summed = summed + ((before + parent[0]) / parent[1]).astype(np.float32)
        state = (WORDS, bucket, pack(gaps, count, value.astype(np.float32), summed))
        return [state, *_values(bucket, data, words, value), (SUMS, bucket, pack(np.array([customers.sum(), tables.sum()])))]

    return work


def _mean_parent(number: int, parent: tuple[float, float]):
    """Blocks' words against the parent's last state: their counts in training, and their probabilities, averaged over the rounds."""

    def work(bucket: int, blocks: list[int], blobs: list[bytes]):
        gaps, count, value, summed = unpack(blobs[blocks.index(WORDS)])
        words, mean = np.cumsum(gaps, dtype=np.uint64), (summed + (value + parent[0]) / parent[1]) / max(number, 1)
        asked = ((b, np.searchsorted(words, np.cumsum(unpack(y)[0], dtype=np.uint64))) for b, y in zip(blocks, blobs, strict=True) if b >= 0)
        return [(b, WORD_MARK + bucket, pack(count[at], mean[at].astype(np.float32))) for b, at in asked]

    return work


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(buckets: int, hot: np.ndarray, total: int, n_words: int, strength: float, hot_rows: tuple):
    names, customers, tables = hot_rows

    def work(part: pd.DataFrame) -> pd.DataFrame:
        data = dict(zip(part["bucket"].tolist(), part["data"], strict=True))
        b = Block(data.pop(-1))
        known = {k: data.pop(k) for k in list(data) if k >= WORD_MARK}
        count, parent = _told(known), _told(known, 1)
        u, w, _, bucket, which, hashes = b.pairs(hot, buckets)
        told = [unpack(data[k]) for k in sorted(data)]
        at_run = np.cumsum(np.append(True, (u[1:] != u[:-1]) | (bucket[1:] != bucket[:-1]))) - 1
        own, weight = (_long(np.concatenate([t[k] for t in told])) for k in (0, 1))
        weight = weight[at_run]
        shared = np.flatnonzero(np.isin(hashes[u], hot))
        at = np.searchsorted(names, hashes[u[shared]] >> _SIX)
        weight[shared] = (strength + DISCOUNT * tables[at]) / (strength + customers[at])
        p = own + weight * parent[w]
        log_p = np.log10(p)[which]
        log_base = np.log10((count + 1) / (total + n_words + 1))[b.tokens]
        starts = np.cumsum(b.sizes) - b.sizes
        add = lambda x: np.add.reduceat(x, starts)
        out = pd.DataFrame({
            "doc_id": pd.array(np.where(b.null, 0, b.ids), dtype="int64"), "held_out": b.held, "n_tokens": b.sizes,
            "n_known": add((count[b.tokens] > 0).astype(np.int64)), "train_tokens": np.int64(total), "base_score": add(log_base), "score": add(log_p),
        })
        if b.null.any():
            out["doc_id"] = out["doc_id"].astype(pd.ArrowDtype(pa.int64())).mask(b.null)
        return out

    return work


def _sums(rows: DataFrame) -> list[float]:
    """The SUMS rows' arrays of numbers, summed place by place in Spark."""

    def run(batches):
        for b in batches:
            for x in b["data"]:
                v = unpack(x)[0].astype(float)
                yield pd.DataFrame({"k": np.arange(len(v)), "v": v})

    sums = rows.where(F.col("block") == SUMS).mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    return [r["v"] for r in sums.orderBy("k").collect()]  # as many as a bucket's row has


def _numbers(rows: DataFrame, names: tuple[str, ...], above: float = -1) -> DataFrame:
    """Blobs of arrays (hashes first) as rows of numbers; only those whose second is above a bound."""

    def run(batches):
        for b in batches:
            for x in b["data"]:
                arrays = unpack(x)
                arrays = [a[arrays[1] > above] for a in arrays]
                yield pd.DataFrame({n: a.view(np.int64) if a.dtype == np.uint64 else a.astype(float) for n, a in zip(names, arrays, strict=True)})

    return rows.mapInPandas(run, ", ".join(f"{n} {'long' if k == 0 else 'double'}" for k, n in enumerate(names)))


def _hot(rows: DataFrame, total: int) -> np.ndarray:
    """Hashes of the contexts that are dealt by both words, ascending: words of more than 1 in HOT_SHARE tokens, and the start."""
    often = _numbers(rows, ("word", "n"), total / HOT_SHARE).collect()  # fewer than HOT_SHARE rows
    return np.unique(np.append(np.array([r["word"] for r in often], np.int64).view(np.uint64), START))


def _hot_totals(rows: DataFrame):
    """Customers and tables of each hot context over all buckets; as many rows as there are hot contexts."""
    sums = _numbers(rows, ("word", "c", "t")).groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect()
    names = np.array([r["word"] for r in sums], np.int64).view(np.uint64)
    at = np.argsort(names)
    return names[at], np.array([r["c"] for r in sums], float)[at], np.array([r["t"] for r in sums], float)[at]


def _strength(rows: DataFrame, hot: tuple, seed: int) -> float:
    """Drawn from its conditional on the grid: the likelihoods of all buckets and of the hot contexts."""
    logs = np.array(_sums(rows) or np.zeros(len(STRENGTHS))) + log_likelihoods(hot[1], hot[2])
    p = np.exp(logs - logs.max())
    return float(np.random.default_rng([SEED, seed]).choice(STRENGTHS, p=p / p.sum()))


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """rounds: 2 or more. doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of docs."""
    spark = docs.sparkSession
    blocks = gather(docs, block_bytes, len, _build)
    buckets = buckets_for(blocks)
    ask_words = map_blocks(blocks, _ask_counts(buckets))
    counts = staged(answer(ask_words, _merge_counts), "counts")
    release(spark)
    n_words, total = map(int, _sums(counts) or (0, 0))
    hot = _hot(counts.where(F.col("block") == HOT), total)
    made = staged(answer(map_blocks(blocks, _ask_pairs(buckets, hot)), _merge_pairs()), "restaurants")
    release(spark)

    seats, places, sent, state = made.where(F.col("block") == SEATS), made.where("block >= 0"), _names(made.where(F.col("block") == SEATS), buckets), counts.where(F.col("block") == WORDS)
    parent, strength, seated, hot_before = (1.0, float(total + n_words + 1)), 1.0, float(n_words), None
    old = [counts]
    for number in range(rounds):
        x = float(np.random.default_rng([SEED, number]).standard_gamma(PARENT_STRENGTH / DISCOUNT + seated))
        values = staged(answer(sent.union(state), _parent(number - 1, n_words, x, parent) if number else _first_values), "values")
        if number:
            customers, seated = _sums(values) or (0.0, 0.0)
            parent = ((PARENT_STRENGTH + DISCOUNT * seated) / (n_words + 1), PARENT_STRENGTH + customers)
        state = values.where(F.col("block") == WORDS)
        asked = seats.union(values.where(F.col("block") <= -VALUES))
        for done in old:
            discard(spark, done)
        release(spark)
        if number == rounds - 1:
            break
        tables = staged(answer(asked, _seat_bucket(buckets, hot, strength, number, False, parent, hot_before)), "tables")
        hot_before = _hot_totals(tables.where(F.col("block") == HOT_SUMS))
        strength = _strength(tables, hot_before, number)
        sent, old = tables.where(F.col("block") <= -TABLES), [values, tables]
        release(spark)
    answers = staged(answer(asked.union(places), _seat_bucket(buckets, hot, strength, number, True, parent, hot_before)), "answers")
    hot_rows = _hot_totals(answers.where(F.col("block") == HOT_SUMS))
    discard(spark, made)
    release(spark)
    words = answer(ask_words.union(state), _mean_parent(rounds - 1, parent))
    rows = blocks.union(answers.where("block >= 0")).union(words)
    return rows.groupBy("block").applyInPandas(_score(buckets, hot, total, n_words, strength, hot_rows), RESULT)
