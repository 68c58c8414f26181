import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import hpylm, registry

from .rows import SCHEMA, frame, rows, wide

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return [*WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)})), None]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def test_base_columns(spark, monkeypatch):
    data = rows(150)
    monkeypatch.setattr(registry, "_read", lambda *a: frame(spark, data))
    c = Counter(w for r in data if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for r in data:
        ws = tokens(r[1])
        want[r[0]].append((held(r[0]), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)))
    got = registry.op1_hpylm(spark, "").collect()
    assert len(got) == len(data)
    for g in got:
        w = want[g.doc_id][0]
        assert tuple(g)[1:5] == w[:4] and abs(g.base_score - w[4]) < 1e-6 * max(1, -w[4]) and g.score < 0


def probabilities(spark, data, texts, **kw):
    """P of the last word of each text after its other words, from scores of the text with and without it."""
    ids = [i for i in range(10_000, 90_000) if held(i)]
    ask = [(ids[k], t, "en", "s", 1) for k, t in enumerate(texts)]
    got = {r.doc_id: r.score for r in hpylm.score(frame(spark, data + ask), **kw).collect()}
    return [got[ids[k]] for k in range(len(texts))]


def test_probabilities_sum_to_one(spark):
    """All that can follow the start of a text sums to one, from the scores of texts alone.

    With e the end's probability after a word and K[y, z] = P(z|y) e[z] / e[y], a quotient of scores of texts, that
    everything sums to one after each word gives 1 / e; the words' probabilities at the start follow, and with the
    empty text's they must sum to one.
    """
    vocab = ["ab", "cd", "ef", "gh", "unknown"]
    r = np.random.default_rng(2)
    data = [(i, " ".join(r.choice(vocab[:4], int(r.integers(1, 12)), p=[0.5, 0.3, 0.15, 0.05])), "en", "s", 1) for i in range(200) if not held(i)]
    texts = ["", *vocab, *[f"ab {y}" for y in vocab], *[f"ab {y} {z}" for y in vocab for z in vocab]]
    s = np.array([10**x for x in probabilities(spark, data, texts)])
    empty, single, pair, triple = s[0], s[1:6], s[6:11], s[11:].reshape(5, 5)
    k = triple / pair[:, None]
    over_e = np.linalg.solve(np.eye(5) - k, np.ones(5))
    assert np.all(over_e > 1)
    assert abs((single * over_e).sum() + empty - 1) < 5e-3
    follows = k * over_e[None, :] / over_e[:, None]
    assert np.allclose(follows.sum(axis=1) + 1 / over_e, 1) and follows[0, 0] > follows[0, 3] > follows[0, 4]


def stirling(n):
    """Logarithms of the generalised Stirling numbers of discount 1/2, by their recurrence."""
    row, t = np.full(n + 2, -np.inf), np.arange(n + 2)
    row[1] = 0
    for c in range(1, n):
        row = np.logaddexp(np.append(-np.inf, row[:-1]), np.log(np.maximum(c - 0.5 * t, 1e-300)) + row)
    return row


def rising(s, n):
    """s (s + d) ... (s + (t - 1) d), as logarithms, for t from 0."""
    return np.append(0, np.cumsum(np.log(s + 0.5 * np.arange(n + 1))))


@pytest.mark.parametrize("n, rate", [(2, 0.1), (7, 3.0), (60, 0.02), (60, 40.0), (400, 5.0), (1000, 900.0)])
def test_tables_have_their_exact_law(n, rate):
    t = np.arange(n + 2)
    w = stirling(n) + t * np.log(rate)
    p = np.exp(w - w.max())
    p /= p.sum()
    m = 40_000
    got = hpylm.draw_tables(np.full(m, n), np.full(m, rate), np.random.default_rng(8))
    share = np.bincount(got.astype(int), minlength=n + 2) / m
    assert np.abs(share - p).max() < 0.012
    assert abs(got.mean() - (p * t).sum()) < 0.03 * max(1, (p * t).sum() ** 0.5)


def test_seating_has_the_exact_posterior():
    """Restaurants of two dishes: the chain's tables against the posterior of the restaurant, summed out."""
    s, m = 1.5, 20_000
    for n, p in (((60, 1), (0.3, 0.02)), ((16, 9), (0.05, 0.2)), ((200, 40), (0.01, 0.001))):
        log = [stirling(k) + np.arange(k + 2) * np.log(q) for k, q in zip(n, p, strict=True)]
        both = log[0][1:-1, None] + log[1][None, 1:-1] + rising(s, sum(n) + 2)[np.arange(1, n[0] + 1)[:, None] + np.arange(1, n[1] + 1)[None, :]]
        w = np.exp(both - both.max())
        w /= w.sum()
        want = [(w.sum(axis=1) * np.arange(1, n[0] + 1)).sum(), (w.sum(axis=0) * np.arange(1, n[1] + 1)).sum()]
        count, group, base = np.tile(n, m), np.repeat(np.arange(m), 2), np.tile(p, m)
        _, last = hpylm.seat(count, group, base, s, 12, 6, 3)
        got = last.reshape(m, 2).mean(axis=0)
        assert np.all(np.abs(got - want) < 0.02 * np.array(want) + 0.02), (n, got, want)
        var = last.reshape(m, 2).var(axis=0)[0]
        assert abs(var - (w.sum(axis=1) * np.arange(1, n[0] + 1) ** 2).sum() + want[0] ** 2) < 0.1 * var + 0.02


def test_log_gamma():
    x = np.array([0.25, 0.5, 1, 2.5, 7.9, 8, 30.25, 1e6])
    assert np.allclose(hpylm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_predictive_is_a_distribution():
    """One restaurant by hand: predictive probabilities over the vocabulary and the unknown word sum to one."""
    count = np.array([40, 7, 2, 1, 0])
    base = np.array([0.4, 0.3, 0.2, 0.05, 0.05])
    t, _ = hpylm.seat(count, np.zeros(5, int), base, 1.5, 8, 2, 1)
    assert t[4] == 0 and abs(t[3] - 1) < 1e-9 and np.all(t[:3] > 1 - 1e-9) and np.all(t <= count + 1e-9)
    p = (count - hpylm.DISCOUNT * t + (1.5 + hpylm.DISCOUNT * t.sum()) * base) / (1.5 + count.sum())
    assert abs(p.sum() - 1) < 1e-9


def test_held_out_perplexity_beats_unigrams(spark):
    r = np.random.default_rng(4)
    step = {i: r.choice(60, 4) for i in range(60)}
    data = []
    for i in range(300):
        w, x = [], int(r.integers(60))
        for _ in range(40):
            w.append(f"w{x}")
            x = int(r.choice(step[x]))
        data.append((i, " ".join(w), "en", "s", 1))
    got = [g for g in hpylm.score(frame(spark, data)).collect() if g.held_out]
    assert len(got) > 20
    assert sum(g.score for g in got) > 0.6 * sum(g.base_score for g in got)


def test_many_blocks_score_alike(spark):
    data = rows(80)
    one = {(r.doc_id, r.n_tokens): r.score for r in hpylm.score(frame(spark, data).coalesce(1)).collect()}
    many = {(r.doc_id, r.n_tokens): r.score for r in hpylm.score(frame(spark, data).repartition(5), block_bytes=4000).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-4 * max(1, abs(one[k])) for k in one)


def test_hot_contexts_are_put_together(spark, monkeypatch):
    data = rows(80)
    whole = {(r.doc_id, r.n_tokens): r.score for r in hpylm.score(frame(spark, data)).collect()}
    monkeypatch.setattr(hpylm, "_hot", lambda rows, total: np.array([hpylm.START], np.uint64))
    alone = {(r.doc_id, r.n_tokens): r.score for r in hpylm.score(frame(spark, data)).collect()}
    assert all(abs(whole[k] - alone[k]) < 0.05 * abs(whole[k]) for k in whole)


def test_nothing_trains(spark):
    data = [(i, "ab cd", "en", "s", 1) for i in range(30) if held(i)]
    got = hpylm.score(frame(spark, data)).collect()
    assert len(got) == len(data) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)


def test_clashing_names_and_empty_table(spark):
    assert hpylm.score(wide(spark)).count() == len(rows())
    assert hpylm.score(spark.createDataFrame([], SCHEMA)).count() == 0
