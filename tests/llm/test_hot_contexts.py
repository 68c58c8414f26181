"""Hot contexts dealt over many buckets are seated as in one."""

import numpy as np

from lodestone.llm import hpylm

from .rows import frame


def scores(spark, monkeypatch, data, buckets):
    monkeypatch.setattr(hpylm, "buckets_for", lambda blocks: buckets)
    return {r.doc_id: r.score for r in hpylm.score(frame(spark, data)).collect()}


def test_many_buckets_score_as_one(spark, monkeypatch):
    """A hot word with a predictable successor: its dish's own tables aren't multiplied by the buckets."""
    r = np.random.default_rng(6)
    data = []
    for i in range(60):
        ws = []
        for _ in range(400):
            ws += ["hot", "next"] if r.random() < 0.7 else ["hot", f"w{int(r.zipf(1.5)) % 300}"]
        data.append((i, " ".join(ws), "en", "s", 1))
    one, many = scores(spark, monkeypatch, data, 1), scores(spark, monkeypatch, data, 60)
    assert one.keys() == many.keys()
    assert max(abs(one[k] / many[k] - 1) for k in one) < 0.01
