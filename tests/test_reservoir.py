"""Samples of fixed size: batches, streams and merged parts agree."""

import hashlib

from lodestone.streaming import events as E
from lodestone.streaming import reservoir

ROWS = [(i, "abc"[i % 3] if i % 7 else None, f"t{i}") for i in range(300)] + [(5, "c", "t5"), (5, "c", "a smaller one"), (None, "a", "no id")]


def brute(rows, size):
    out = {}
    for i, k, t in rows:
        if i is not None:
            out.setdefault(k, {}).setdefault(i, []).append(t)
    name = lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest()
    return {(i, k, min(ts[i])) for k, ts in out.items() for i in sorted(ts, key=name)[:size]}


def test_sample_and_merge(spark):
    df = spark.createDataFrame(ROWS, "id long, k string, t string")
    got = reservoir.sample(df, ["k"], "id", 9)
    assert {tuple(r) for r in got.collect()} == brute(ROWS, 9) and got.count() == 36
    parts = [reservoir.sample(df.where(f"pmod(hash(id), 3) = {m}"), ["k"], "id", 9) for m in range(3)]
    whole = reservoir.sample(parts[0].union(parts[1]).union(parts[2]), ["k"], "id", 9)
    assert {tuple(r) for r in whole.collect()} == brute(ROWS, 9)
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
    assert reservoir.sample(df.limit(0), ["k"], "id", 9).count() == 0


def test_stream_keeps_the_same_sample(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id long, k string, t string")
    for m in range(4):
        df.where(f"pmod(id, 4) = {m} or (id is null and {m} = 0)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    buffer = reservoir.ReplayBuffer(str(tmp_path / "buffer"), ["k"], "id", 9, 0.3, lambda mixed, batch: seen.append((mixed.where("not replayed").count(), mixed.where("replayed").count())))
    buffer.run(E.file_stream(spark, str(tmp_path / "in"), 1))
    assert {tuple(r) for r in buffer.read(spark).collect()} == brute(ROWS, 9)
    assert len(seen) == 4 and seen[0][1] == 0 and all(old == int(new * 0.3) for new, old in seen[1:])
    before = buffer.read(spark).count()
    buffer.write(df.where("id < 50"), 3)  # the last batch again, with other rows: it replaces itself
    assert buffer.read(spark).count() == before
