import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import blocks, registry, suffixes

from .rows import SCHEMA, frame, rows, wide


def test_arrays_travel_unchanged():
    made = [np.arange(5, dtype=np.uint64), np.zeros(0, np.int64), np.array([True, False]), np.array([1.5, -2.0], np.float32)]
    assert all(a.dtype == b.dtype and np.array_equal(a, b) for a, b in zip(made, blocks.unpack(blocks.pack(*made)), strict=True))


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array_and_common_prefixes(seed):
    r = random.Random(seed)
    for depth in (3, 8, 13, 50):
        b = bytes(r.choice((b"a", b"ab", b"abcdefgh")[seed % 3]) for _ in range(r.randint(1, 300)))
        text = np.frombuffer(b, np.uint8)
        sa, rank = suffixes.suffix_array(text, depth)
        cut = [b[i : i + depth] for i in range(len(b))]
        assert [cut[i] for i in sa] == sorted(cut)
        common = suffixes.kasai(text, sa, depth, stride=7)
        for i in range(1, len(b)):
            x, y = cut[sa[i]], cut[sa[i - 1]]
            assert (rank[sa[i]] == rank[sa[i - 1]]) == (x == y)
            assert common[i] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def brute(data):
    first = {}
    docs = [(r[0] if r[0] is not None else 1 << 70, (r[1] or "").encode()) for r in data]
    for d, t in docs:
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for r, (d, t) in zip(data, docs, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        out.append((r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passages(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    pool = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(12)]
    data = []
    for i in range(90):
        parts = []
        for _ in range(r.randint(1, 6)):
            p = r.choice(pool)
            a, b = sorted(r.sample(range(len(p)), 2))
            parts.append(r.choice([p, p[a:b], " ".join(word() for _ in range(r.randint(1, 30)))]))
        data.append((r.randint(0, 70), r.choice(["", " ", "é"]).join(parts), "en", "s", 1))
    data += [(200 + i, "z" * r.randint(40, 130), "en", "s", 1) for i in range(6)]
    return data


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, monkeypatch, seed):
    data = passages(seed) + (rows() if seed == 0 else [])
    monkeypatch.setattr(registry, "_read", lambda *a: frame(spark, data).repartition(3))
    assert Counter(map(tuple, registry.op5_suffix_dedup(spark, "").collect())) == brute(data)


def test_many_small_blocks(spark):
    data = passages(9)
    made = suffixes.dedup_substrings(frame(spark, data).repartition(5), block_bytes=1500, texts=True)
    got = made.collect()
    assert Counter(tuple(r)[:5] for r in got) == brute(data)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_clashing_names_and_empty_table(spark):
    assert suffixes.dedup_substrings(wide(spark)).count() == len(rows())
    assert suffixes.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0
