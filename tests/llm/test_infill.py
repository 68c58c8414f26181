"""Fill-in-the-middle against a plain version, and exact round trips."""

import hashlib
import re

import numpy as np
import pytest

from lodestone.llm import infill

from .rows import WIDE, frame, rows

EXTRA = [(2000, "a\n<P\nb<", "en", "s", 1), (2001, "x <S> y\nz", "en", "s", 1), (2002, "\n\n\n", "en", "s", 1), (2003, "<<P<S\n>é<M\n é>", "en", "s", 1), (2004, "no feed", "en", "s", 1), (2005, "P>\nS>\nM>\n<", "en", "s", 1), (2006, "日本\n語<\n" * 50, "en", "s", 1)]


def brute(doc_id, text, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in infill.SENTINELS):
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 5, 1 << 20])
def test_like_the_plain_version_and_back(spark, chunk):
    data = [r for r in rows() + EXTRA if chunk > 1 or len(r[1] or "") < 2000]
    made = infill.restore(infill.transform(frame(spark, data), chunk=chunk), chunk=chunk).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[5]))
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((brute(r[0], r[1]) for r in data), key=key)
    text = {(r[0], brute(r[0], r[1])[5]): r[1] or "" for r in data}
    assert all(r["restored"] == text[r["doc_id"], r["output"]] for r in made)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_clashing_columns_and_no_rows(spark):
    wide = spark.createDataFrame([(*r, "r", 1, "h", "w", "k", "f", "i", "b") for r in rows()], WIDE)
    assert infill.transform(wide).count() == len(rows())
    assert infill.restore(infill.transform(frame(spark, []))).collect() == []


def test_transitions_count_characters_units_and_sentinels():
    a = infill.Automaton()
    for text in ("", "é\n", "<P>", "<<P>x<S><M>\n\n日本<P", "<P\n>"):
        data = np.frombuffer(text.encode(), np.uint8)
        for chunk in (1, 2, 3, 100):
            made, last = a.scan(data, chunk)
            found = made.sum(axis=0).tolist() if len(made) else [0, 0, 0]
            assert found == [len(text), text.count("\n"), sum(text.count(s) for s in infill.SENTINELS)]
            assert (last == 0) == (text == "" or text.endswith("\n"))
    with pytest.raises(ValueError, match="sentinel"):
        infill.Automaton(("<P>", "<PP>", "<M>"))


def test_rate_leaves_some_plain(spark):
    made = infill.transform(frame(spark, [(i, f"a{i}\nb\nc", "en", "s", 1) for i in range(300)]), rate=50).collect()
    assert 100 < sum(r["form"] == "plain" for r in made) < 200
