"""The bootstrap of personal data against a plain version of the same graph."""

import random
from collections import Counter, defaultdict

from lodestone.llm import pii, registry

from .rows import frame


def brute(texts, rounds=pii.ROUNDS):
    """Spans added, by the definition: all patterns, counted over all texts, dictionaries for the graph."""
    met, freq = [], Counter()
    for n, t in enumerate(texts):
        met += [(n, *e) for e in pii.scan(t)[1]]
        freq.update([pii.START, f"{pii.START} {pii.START}"])
        before = pii.START
        for raw in t.replace("\t", " ").replace("\n", " ").split(" "):
            if raw:
                for w in [pii._plain(raw), *([pii._label(raw)] if pii._label(raw) else [])]:
                    freq.update([w, f"{before} {w}"])
                before = pii._plain(raw)
    edges = defaultdict(Counter)
    seed = {}
    for _, k, _, _, one, two, i, s in met:
        for p in {one, two}:
            edges[k, p][i] += 1
            seed[k, p, i] = s or seed.get((k, p, i), False)
    score, sure = {}, {}
    for _ in range(rounds):
        sure = {}
        for (k, p), of in edges.items():
            if len(of) < pii.MIN_SEEDS or not freq[p]:
                continue
            own = {i: 1.0 if seed[k, p, i] else score.get((k, i), 0.0) for i in of}
            c = min(1.0, sum(n * own[i] for i, n in of.items()) / (freq[p] + 1))
            if sum(x >= pii.MIN_CONFIDENCE for x in own.values()) >= pii.MIN_SEEDS:
                sure[k, p] = c
        score = {}
        for (k, p), c in sure.items():
            for i in edges[k, p]:
                if not seed[k, p, i]:
                    score[k, i] = max(score.get((k, i), 0), c)
    good = {x for x, c in sure.items() if c >= pii.MIN_CONFIDENCE}
    added = defaultdict(set)
    for n, k, a, b, one, two, _, s in met:
        if (not s or k == pii.SECRET) and {(k, one), (k, two)} & good:
            added[n].add((k, a, b))
    return added


def corpus(seed=5):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(60)]
    number = lambda: f"{r.randint(200, 999)} {r.randint(200, 999)} {r.randint(1000, 9999)}"
    texts = []
    for i in range(240):
        ws = [r.choice(vocab) for _ in range(r.randint(0, 30))]
        kind = i % 8
        put = {
            0: f"call me +1 ({r.randint(200, 999)}) 555-{i:04d}",
            1: f"call me {number()}",
            2: f"ring us on {number()}",  # shown by discovered numbers alone, below
            3: f'token = "{r.getrandbits(160):040x}"',
            4: f"seen {r.getrandbits(160):040x}" if i % 3 else "",
            5: f"mail: bob{i}@mail.example.com",
            6: f"mail: amy{i} [at] site{i} [dot] org",
            7: f"tel:{r.randint(200, 999)}-867-{i:04d}" if i % 3 else f"tel:+1-555-867-{i:04d}",
        }[kind]
        at = r.randint(0, len(ws))
        texts.append(" ".join([*ws[:at], put, *ws[at:]]))
    shared = [f"call me 555 000 {n:04d}" for n in range(6)] + [f"ring us on 555 000 {n:04d} now" for n in range(6)]
    decoys = [f"{w} {r.randint(10**15, 10**16)}" for w in vocab for _ in range(2)] + ["ab", "", "x" * 5000 + " call me 999 888 7777", "9" * 400]
    return texts + shared + decoys


def test_the_graph_against_brute_force(spark):
    texts = corpus()
    want = brute(texts)
    data = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: {(x["kind"], x["start"], x["end"]) for x in r.added} for r in pii.find(frame(spark, data)).collect()}
    assert len(got) == len(texts)
    assert {i: v for i, v in got.items() if v} == {i: v for i, v in want.items() if v}
    kinds = Counter(k for v in got.values() for k, _, _ in v)
    assert kinds["phone"] > 50 and kinds["secret"] >= 30 and kinds["email"] >= 25
    # numbers under everyday words, and hashes that nothing announces as secret in confidence, are left alone
    assert not any(got[i] for i in range(len(texts) - len(texts[252:]), len(texts)) if texts[i][:1] in "abcdefg" and "call" not in texts[i])


def test_patterns_that_only_discovered_identifiers_show(spark):
    data = [(i, f"w{i} call me +1 (555) 123-{4000 + i} x{i}", "en", "s", 1) for i in range(40)]
    data += [(100 + i, f"call me 555 867 {4000 + i} y{i}", "en", "s", 1) for i in range(20)]
    data += [(200 + i, f"z{i} hotline is 555 867 {4000 + i} y{i}", "en", "s", 1) for i in range(20)]
    data += [(300, "the hotline is (555) 999 1234 at night", "en", "s", 1), (301, "sum of 555 999 1234 at night", "en", "s", 1)]
    got = {r.doc_id: [(x["kind"], x["start"], x["end"]) for x in r.added] for r in pii.find(frame(spark, data)).collect()}
    assert got[100] == [("phone", 8, 20)] and got[203] == [("phone", 14, 26)]
    assert got[300] == [("phone", 15, 29)] and got[301] == []
    assert got[0] == []


def test_long_words_and_lists(spark):
    data = [(i, f"numbers: +1 555 100 {1000 + i}, +1 555 200 {1000 + i}", "en", "s", 1) for i in range(5)]
    data += [(50, "numbers: 555 300 1000, 555 300 1001; (555) 300-1002", "en", "s", 1), (51, "y" * 300 + " 555 300 9999", "en", "s", 1), (52, "@" * 3000 + "1" * 3000, "en", "s", 1)]
    got = {r.doc_id: sorted((x["start"], x["end"]) for x in r.added) for r in pii.find(frame(spark, data)).collect()}
    assert got[50] == [(9, 21), (23, 35), (37, 51)] and got[51] == [] and got[52] == []


def test_secrets_and_extra_columns(spark, monkeypatch):
    data = [(i, f'k{i} token = "{i + 10**20:040x}" z', "en", "s", 1) for i in range(8)]
    monkeypatch.setattr(registry, "_read", lambda *a: frame(spark, data))
    got = {r.doc_id: r for r in registry.op8_pii(spark, "").collect()}
    assert got[3].spans == "secret:12:52" and got[3].n_added == 1 and got[3].n_phone == 0
