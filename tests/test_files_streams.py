"""Sources, sinks and streams: round trips, and streams that go on over new files."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files
from lodestone.streaming import events as E


def test_pairs(spark, tmp_path):
    lines = [json.dumps({"pair_id": str(i), "anchor": f"a{i}", "subject": "x" if i % 2 else "y", "confidence": 0.5}) for i in range(6)]
    (tmp_path / "p.jsonl").write_text("\n\n".join(lines) + "\nnot json\n")
    assert files.read_pairs(spark, str(tmp_path)).count() == 6
    assert files.read_pairs(spark, str(tmp_path), "x").count() == 3
    assert files.read_pairs(spark, str(tmp_path), "x", 2).count() == 2


def test_loose_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"content": "' + "long " * 10 + '\x01", "n": 1}, {"content": "short"}]')
    (tmp_path / "b.json").write_text('{"content": "' + "other " * 10 + '"}')
    (tmp_path / "c.json").write_text("broken {")
    got = files.read_loose_json(spark, str(tmp_path)).collect()
    assert sorted(r["item"]["content"][:4] for r in got) == ["long", "othe"]


def test_manifest_and_cache(spark, tmp_path):
    for name, text in [("bio/notes/a.txt", "1"), ("bio/textbooks/deep/b.PDF", "2"), ("bio/notes/c.exe", "3"), ("bio/other/d.txt", "4")]:
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    m = files.read_manifest(spark, str(tmp_path))
    assert sorted((r["subject"], r["category"]) for r in m.collect()) == [("bio", "notes"), ("bio", "textbooks")]
    assert files.not_cached(m, m.where("category = 'notes'")).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "ü"), (2, None, None), (3, " ", "z")], "id long, subject string, text string")
    files.write_json_lines(df, str(tmp_path / "l"))
    lines = [json.loads(x) for p in (tmp_path / "l").glob("part*") for x in p.read_text().splitlines()]
    assert {"id": 2, "subject": None, "text": None} in lines and len(lines) == 3
    files.write_by_key(df, str(tmp_path / "k"), F.col("subject"))
    got = spark.read.json(str(tmp_path / "k")).groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in got} == {"a": 1, "GENERIC": 2}


def test_versions(spark, tmp_path):
    root = str(tmp_path / "v")
    with pytest.raises(ValueError):
        files.read_version(spark, root)
    assert [files.create_version(spark.range(n), root) for n in (3, 5)] == [1, 2]
    (tmp_path / "v" / "version=v3").mkdir()  # cut off before it was done
    assert files.versions(spark, root) == [1, 2] and files.read_version(spark, root).count() == 5 and files.read_version(spark, root, 1).count() == 3
    assert files.create_version(spark.range(7), root) == 3


def event_rows(spark, rows, path):
    spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "cast(t as timestamp_ntz) as ts", "user_id", "event_type", "value").coalesce(1).write.parquet(path)


def test_stream_goes_on(spark, tmp_path):
    event_rows(spark, [(1, "2024-01-01 00:10:00", 1, "view", 1.0), (2, "2024-01-01 01:10:00", 1, "view", 2.0)], str(tmp_path / "in" / "a"))
    read = lambda: E.file_stream(spark, str(tmp_path / "in" / "*"))
    go = lambda: {r["start"] % 86400 // 3600: (r["n"], r["total"]) for r in E.drain(E.windowed(read(), "1 hour"), ["start"], f"file://{tmp_path}/out").collect()}
    assert go() == {0: (1, 1.0), 1: (1, 2.0)}
    event_rows(spark, [(3, "2024-01-01 01:20:00", 1, "view", 5.0)], str(tmp_path / "in" / "b"))
    assert go() == {0: (1, 1.0), 1: (2, 7.0)}


def test_sessions_and_once(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1, "view", 1.0), (1, "2024-01-01 00:05:00", 1, "view", 1.0), (2, "2024-01-01 02:00:00", 1, "view", 1.0), (3, "2024-01-09 00:00:00", 1, "view", 1.0)]
    event_rows(spark, rows, str(tmp_path / "in"))
    got = sorted((r["start"] % 86400, r["n"]) for r in E.drain(E.sessions(E.file_stream(spark, str(tmp_path / "in")), "30 minutes")).collect())
    assert got == [(0, 2), (7200, 1)]
    assert sorted(r["event_id"] for r in E.drain(E.once(E.file_stream(spark, str(tmp_path / "in")), "event_id")).collect()) == [1, 2, 3]


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    out = f"file://{tmp_path}/out"
    assert E.drain(E.watch_folder(spark, str(tmp_path / "in")), path=out).count() == 1
    (tmp_path / "in" / "b.txt").write_text("two")
    assert E.drain(E.watch_folder(spark, str(tmp_path / "in")), path=out).count() == 2
