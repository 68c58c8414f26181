"""The pipeline's near-duplicate removal against all pairs' similarities."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import common, components, nearcopies, simhash

from .rows import SCHEMA, frame, rows, wide


def shingle_set(t, width=5):
    ws = (t or "").encode().lower().split()
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def brute_keep(data):
    """Keys (doc_id or None last, text) that stay: the smallest of each component of pairs of similarity 0.8 and more."""
    docs = sorted({(1 << 62 if r[0] is None else r[0], r[1] or "") for r in data})
    sets, root = [shingle_set(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {docs[i] for i in range(len(docs)) if find(i) == i}


def stayed(df):
    return [(1 << 62 if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect()]


def planted(r, n_words, changed):
    ws = [f"w{r.randrange(5000)}" for _ in range(n_words)]
    near = list(ws)
    for k in range(changed):
        near[(2 * k + 1) * n_words // (2 * changed)] = f"new{k}"
    return " ".join(ws), " ".join(near)


@pytest.mark.parametrize(("n_words", "changed"), [(400, 1), (400, 4), (400, 8), (1000, 5), (120, 2)])
def test_planted_copies_go(spark, n_words, changed):
    r = random.Random(n_words + changed)
    data = []
    for i in range(40):
        a, b = planted(r, n_words, changed)
        data += [(i, a, "en", "s", 1), (1000 + i, b, "en", "s", 1)]
    x, y = shingle_set(data[0][1]), shingle_set(data[1][1])
    assert 0.8 <= len(x & y) / len(x | y) <= 0.98
    got = {d for d, _ in stayed(corpus_pipeline.near_dedup(spark, frame(spark, data), ""))}
    assert set(range(40)) <= got and len(got) <= 41  # 2.5 % of the copies may stay


def test_less_similar_texts_stay(spark):
    r = random.Random(1)
    data = []
    for i in range(20):
        a, b = planted(r, 400, 16)  # similarity 0.67
        data += [(i, a, "en", "s", 1), (1000 + i, b, "en", "s", 1)]
    assert len(stayed(corpus_pipeline.near_dedup(spark, frame(spark, data), ""))) == 40


def test_awkward_rows(spark):
    data = rows(120)
    want = brute_keep(data)
    got = stayed(corpus_pipeline.near_dedup(spark, frame(spark, data), ""))
    assert len(got) == len(set(got)) and set(got) == want
    kept = corpus_pipeline.near_dedup(spark, wide(spark), "")
    assert kept.columns == wide(spark).columns and set(stayed(kept)) == brute_keep(rows())
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_a_large_group_is_one(spark):
    """600 near copies of one text, 0.8 to 0.95 from each other: places of the bands are dealt in parts."""
    r = random.Random(2)
    ws = [f"w{r.randrange(5000)}" for _ in range(300)]
    data = []
    for i in range(600):
        mine = list(ws)
        for k in r.sample(range(300), 2):
            mine[k] = f"n{i}x{k}"
        data.append((i, " ".join(mine), "en", "s", 1))
    assert {d for d, _ in stayed(corpus_pipeline.near_dedup(spark, frame(spark, data), ""))} == {0}


def test_bands_recall():
    """Share of pairs of similarity 0.8 that meet in a band: 1 - (1 - 0.8 ** 5) ** 15 = 0.997."""
    r = np.random.default_rng(3)
    met = 0
    for _ in range(400):
        h = np.unique(r.integers(0, 1 << 62, 500, dtype=np.uint64) << np.uint64(1))
        met += bool(set(nearcopies.bands(h[:450])) & set(nearcopies.bands(h[50:])))
    assert met >= 0.98 * 400


def template_corpus(families, words, own, changed, seed=5):
    """Texts that share a template of so many words, each with `own` of its own, and for each a copy with some of these changed."""
    r = random.Random(seed)
    template = [f"t{r.randrange(5000)}" for _ in range(words)]
    data = []
    for i in range(families):
        mine = [f"o{i}x{k}" for k in range(own)]
        near = list(mine)
        for k in range(changed):
            near[(2 * k + 1) * own // (2 * changed)] = f"c{i}x{k}"
        half = words // 2
        data += [(i, " ".join(template[:half] + mine + template[half:]), "en", "s", 1), (100_000 + i, " ".join(template[:half] + near + template[half:]), "en", "s", 1)]
    return data


@pytest.mark.parametrize(("families", "words", "own", "changed"), [(5, 350, 75, 3), (100, 350, 75, 6), (1000, 350, 75, 4), (1000, 380, 75, 8)])
def test_copies_among_texts_of_one_template(spark, families, words, own, changed):
    """Strangers are as similar as 0.67 to 0.70; recall mustn't fall with their number."""
    data = template_corpus(families, words, own, changed)
    a, b, c = (shingle_set(data[i][1]) for i in (0, 1, 2))
    assert 0.8 <= len(a & b) / len(a | b) < 1 and 0.6 < len(a & c) / len(a | c) < 0.8
    got = {d for d, _ in stayed(corpus_pipeline.near_dedup(spark, frame(spark, data), ""))}
    assert set(range(families)) <= got
    assert len(got) - families <= 0.01 * families


def test_meeting_words_miss_no_similar_pair():
    r = np.random.default_rng(4)
    counts = np.full(nearcopies.SKETCH, 5, np.int32)
    counts[: nearcopies.SKETCH // 2] = r.integers(2, 900, nearcopies.SKETCH // 2)
    for _ in range(300):
        n = int(r.integers(1, 300))
        base = np.unique(r.integers(0, 1 << 32, n, dtype=np.uint64)).astype(np.uint32)
        cut, more = int(r.integers(0, len(base) // 5 + 1)), int(r.integers(0, n // 6 + 1))
        other = np.unique(np.concatenate([base[cut:], r.integers(0, 1 << 32, more, dtype=np.uint64).astype(np.uint32)]))
        both = len(np.intersect1d(base, other))
        keys = []
        for x in (base, other):
            probe, word, bucket, size, most = nearcopies.meeting_words(x, counts)
            keys.append([{(w, g): m for p, w, g, m in zip(probe, word, bucket, most, strict=True) if p == k} for k in (0, 1)])
        met = any(a[1][k] >= len(y) and b[0][k] >= len(x) for (x, a), (y, b) in (((base, keys[0]), (other, keys[1])), ((other, keys[1]), (base, keys[0]))) for k in set(a[1]) & set(b[0]))
        if both >= 0.8 * (len(base) + len(other) - both):
            assert met


@pytest.mark.parametrize("seed", [9716001, 80069001, 124527001, 178898001])
def test_near_fingerprints_meet(spark, seed):
    """Similarity 0.8, no band of minima in common, fingerprints 2 bits apart at most: op2's search brings them together."""
    ws = [f"w{seed}x{i}" for i in range(13)]
    texts = [" ".join(ws), " ".join([*ws[:-1], "z"])]
    runs = [nearcopies.runs(t.encode(), 5) for t in texts]
    assert not set.intersection(*(set(nearcopies.bands(nearcopies.shingles(h))) for h in runs))
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    assert [nearcopies.fingerprint(h) for h in runs] == prints and ((prints[0] ^ prints[1]) & (1 << 64) - 1).bit_count() <= 2
    x, y = map(shingle_set, texts)
    assert 5 * len(x & y) >= 4 * len(x | y)
    data = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    assert stayed(corpus_pipeline.near_dedup(spark, frame(spark, data), "")) == [(0, texts[0])]


def test_small_tables_are_in_few_files(spark, monkeypatch):
    """However many shuffle partitions there are, tables staged on the way have a file for so many documents, not one a partition."""
    made = []

    def staged(df, name, files=None):
        table = common.staged(df, name, files)
        made.append((name, len(table.inputFiles())))
        return table

    for module in (nearcopies, components):
        monkeypatch.setattr(module, "staged", staged)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        data = template_corpus(40, 350, 75, 6)
        got = {d for d, _ in stayed(corpus_pipeline.near_dedup(spark, frame(spark, data), ""))}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == set(range(40))
    assert {"each", "met", "similar", "edges", "components", "crowd", "joined"} <= {name for name, _ in made}
    assert [x for x in made if x[1] > nearcopies.LEAST_FILES] == []
