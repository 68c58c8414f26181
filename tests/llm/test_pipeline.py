"""Every stage of the corpus pipeline, and all of them in a row, against brute-force versions.

The near-duplicate stage has more tests in test_near_copies.
"""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .rows import SCHEMA, frame, rows, wide
from .test_near_copies import brute_keep
from .test_quality_words import brute_judge, prose
from .test_text_operators import brute_lines, brute_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FAR = 1 << 70


def corpus():
    """Clean texts of two languages, near copies at similarities from 0.8 up, repeated lines, junk, awkward rows."""
    r = random.Random(21)
    data = []
    for i in range(40):
        data.append((i, prose(r, ("en", "fr")[i % 2], r.randint(60, 300)), ("en", "fr")[i % 2], f"s{i % 3}", 1))
    shared = "\n".join(f"shared line {k} of the text that is in many of them" for k in range(5))
    data += [(100 + i, prose(r, "en", 150) + "\n" + shared, "en", "s1", 1) for i in range(6)]
    for i in range(8):  # one line each, as repeated lines go before near copies do
        ws = prose(r, "en", 300).split()
        near = [f"new{k}" if k % 120 == 60 + i else w for k, w in enumerate(ws)]
        data += [(200 + i, " ".join(ws), "en", "s2", 1), (300 + i, " ".join(near), "en", None, 1)]
    data += [(400 + i, " ".join(r.choice("#$%|<>") * 3 + "ab" for _ in range(150)), "en", "s1", 1) for i in range(4)]
    data += [(500, None, None, None, None), (501, "", "en", "s0", 0), (None, prose(r, "en", 100), "en", "s0", 1), (502, prose(r, "fr", 6000), "fr", "s2", 1), data[0]]
    return data


def key(r):
    return (FAR if r[0] is None else r[0], r[1])


def many(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def want_quality(data):
    kept = {i: k for i, (k, _, _) in brute_judge(data).items()}
    return [r for r in data if kept[r[0]]]


def want_lines(data):
    made = brute_lines(data)
    out = []
    for r in data:
        text, n, gone = made[(FAR if r[0] is None else r[0], r[1] or "")]
        if not gone or gone < n:
            out.append((r[0], text if gone else r[1], *r[2:]))
    return out


def want_near(data):
    keep, seen, out = brute_keep(data), set(), []
    for r in data:
        k = (1 << 62 if r[0] is None else r[0], r[1] or "")
        if k in keep and k not in seen:
            seen.add(k)
            out.append(r)
    return out


def want_mix(data, copies):
    """Sums by source near their targets, no row more than 3 times, rows of one id alike."""
    sizes, taken = Counter(), Counter()
    for r in data:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] += n
        taken[r[3]] += n * copies[r[0], r[1]] / max(1, sum(key(x) == key(r) for x in data))
    want, largest = brute_targets(sizes), max(len(WORD.findall(r[1] or "")) for r in data)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes), (taken, want)
    assert all(c <= 3 * sum(key(x) == (FAR if i is None else i, t) for x in data) for (i, t), c in copies.items())


def want_pack(rows_of, tokenizer):
    """rows_of: texts by how often each is packed. Pieces cover each text's ids, sequences are full but for the last ones."""

    def check(pieces):
        streams = defaultdict(Counter)
        for (i, t), n in rows_of.items():
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            streams[i][tuple((s, min(2048, len(ids) - s), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048))] += n
        want = Counter((i, *p) for i, of in streams.items() for parts, n in of.items() for p in parts for _ in range(n))
        assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
        at = defaultdict(list)
        for p in pieces:
            at[p.sequence_id].append((p.offset, p.length))
        for x in at.values():
            x.sort()
            assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[-1][0] + x[-1][1] <= 2048

    return check


def test_stages_one_by_one(spark, tmp_path):
    data = corpus()
    docs = frame(spark, data)
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    data = want_quality(data)
    assert many(kept) == Counter((r[0], r[1]) for r in data) and len(data) >= 50
    cut = corpus_pipeline.line_dedup(spark, frame(spark, data), "")
    assert cut.columns == docs.columns
    data = want_lines(data)
    assert many(cut) == Counter((r[0], r[1]) for r in data)
    one = corpus_pipeline.near_dedup(spark, frame(spark, data), "")
    data = want_near(data)
    assert many(one) == Counter((r[0], r[1]) for r in data) and not {300, 301, 302} & {r[0] for r in data}
    mixed = corpus_pipeline.mix_sources(spark, frame(spark, data), "")
    assert mixed.columns == docs.columns
    copies = many(mixed)
    want_mix(data, copies)
    assert copies == many(corpus_pipeline.mix_sources(spark, frame(spark, data).repartition(3), ""))
    packed = corpus_pipeline.pack(spark, mixed, "").collect()
    want_pack(copies, tokenizer())(packed)


def tokenizer():
    import public_tokenizers

    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def test_all_in_a_row(spark, tmp_path):
    """run() keeps what the brute-force versions keep, one after another."""
    frame(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    data = want_near(want_lines(want_quality(corpus())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(p.doc_id for p in got if p.start == 0)
    ids = Counter(r[0] for r in data)
    assert set(copies) <= set(ids) and all(n <= 3 * ids[i] for i, n in copies.items())
    tokens = {r[0]: len(tokenizer().encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in data}
    assert all(p.doc_tokens == tokens[p.doc_id] for p in got)
    assert sum(p.length for p in got) == sum(tokens[i] * n for i, n in copies.items())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_clashing_names_and_empty_tables(spark, stage):
    """Columns with the operators' inner names stay as they are; an empty table gives an empty one."""
    got = stage(spark, wide(spark), "")
    assert got.columns == wide(spark).columns
    assert {(r["_row"], r["size"], r["kept"]) for r in got.collect()} <= {("r", 1, "k")}
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_awkward_rows_go_through(spark, tmp_path):
    frame(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
