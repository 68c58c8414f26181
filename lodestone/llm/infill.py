"""Fill-in-the-middle: a text is cut at two unit boundaries and written as prefix, suffix, middle (psm) or suffix, prefix, middle (spm).

A byte automaton reads each text once. Its classes are line feed, UTF-8 continuation byte, `<`, each letter of a
sentinel, `>` and the rest; its states say whether a unit has begun and how much of a sentinel has been met. Every
transition is counted: the counts give characters (transitions on bytes that begin a character), units (transitions on a
line feed, and the unit left open in the last state) and sentinels (transitions that end one). The automaton
forgets all but its last few bytes (checked when the table is made), so the states of a whole chunk are looked up in one
table at once; chunks bound the memory for a text of any length. The second pass goes only to the chunks in which
the two cuts lie, as the first pass has counted each chunk's units.

Units are lines, `[^\\n]*\\n|[^\\n]+`. Draws come from the SHA-256 of `seed:doc_id`, so reruns agree and no state is needed.

Defined results: a null text is empty; an empty text, and one that holds a sentinel, stays plain; a null doc_id draws
as the empty string; rows equal in doc_id are cut at the same draws; other columns are ignored. A scan without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
CHUNK = 1 << 20
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Automaton:
    """Finds line ends, character starts and sentinels in bytes. Sentinels: `<`, one letter, `>`; no two of one letter."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        letters = [s[1:-1] for s in sentinels]
        if any(s != f"<{x}>" or len(x) != 1 or x in "<>\n" or not x.isascii() for s, x in zip(sentinels, letters, strict=True)) or len(set(letters)) < len(letters):
            raise ValueError("a sentinel is <, one ASCII letter of its own, and >")
        self.sentinels = sentinels
        line, more, opens, closes, rest = range(5)
        k = len(letters)
        self.classes = 5 + k
        self.of_byte = np.full(256, rest, np.uint8)
        self.of_byte[0x80:0xC0] = more
        for c, b in ((line, "\n"), (opens, "<"), (closes, ">"), *((5 + i, x) for i, x in enumerate(letters))):
            self.of_byte[ord(b)] = c
        # states: 0 no unit has begun, 1 within a unit, 2 after <, 3 + i after < and the i-th letter, 3 + k + i after that sentinel
        states = 3 + 2 * k
        self.step = np.ones((states, self.classes), np.uint8)
        self.step[:, line], self.step[:, opens] = 0, 2
        for i in range(k):
            self.step[2, 5 + i] = 3 + i
            self.step[3 + i, closes] = 3 + k + i
        self.line, self.found = line, 3 + k
        # what each transition (state, class) adds to the characters, the units and the sentinels
        at = np.arange(states)[:, None], np.arange(self.classes)[None, :]
        self.weights = np.stack([np.broadcast_to(at[1] != more, self.step.shape), np.broadcast_to(at[1] == line, self.step.shape), self.step >= self.found]).reshape(3, -1).astype(np.int64)
        # any three classes in a row lead to one state, whatever came before: that is the table for whole chunks
        c = self.classes
        run = self.step[self.step[self.step[:, :, None], np.arange(c)[None, None, :]][:, :, :, None], np.arange(c)[None, None, None, :]]
        if (run != run[:1]).any():
            raise AssertionError("the automaton doesn't forget")
        self.after_three = run[0].reshape(-1)

    def states(self, chunk: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the chunk's bytes and the state after each; state: the one before the chunk."""
        cls = self.of_byte[chunk]
        made = np.empty(len(cls), np.uint8)
        head = min(len(cls), 2)
        for i in range(head):
            state = int(self.step[state, cls[i]])
            made[i] = state
        if len(cls) > 2:
            wide = cls.astype(np.int32)
            made[2:] = self.after_three[(wide[:-2] * self.classes + wide[1:-1]) * self.classes + wide[2:]]
        return cls, made

    def scan(self, text: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, int]:
        """Per chunk its characters, units ended and sentinels, and the last state."""
        state, rows = 0, []
        for at in range(0, len(text), chunk):
            cls, made = self.states(text[at : at + chunk], state)
            came = np.empty_like(made)
            came[0], came[1:] = state, made[:-1]
            counted = np.bincount(came.astype(np.int64) * self.classes + cls, minlength=self.weights.shape[1])
            rows.append(self.weights @ counted)
            state = int(made[-1])
        return np.array(rows, np.int64).reshape(-1, 3), state

    def unit_end(self, text: np.ndarray, rows: np.ndarray, unit: int, chunk: int = CHUNK) -> int:
        """Where the first `unit` units end: only the chunk that holds the place is read again."""
        if unit == 0:
            return 0
        upto = np.cumsum(rows[:, 1])
        k = int(np.searchsorted(upto, unit))
        if k == len(rows):
            return len(text)  # the last unit has no line feed
        mine = text[k * chunk : (k + 1) * chunk]
        ends = np.flatnonzero(self.of_byte[mine] == self.line)
        return k * chunk + int(ends[unit - (int(upto[k - 1]) if k else 0) - 1]) + 1

    def marks(self, text: np.ndarray, chunk: int = CHUNK) -> list[tuple[int, int]]:
        """(which sentinel, where it begins), left to right."""
        state, out = 0, []
        for at in range(0, len(text), chunk):
            _, made = self.states(text[at : at + chunk], state)
            hit = np.flatnonzero(made >= self.found)
            out += [(int(made[i]) - self.found, at + int(i) - 2) for i in hit]
            state = int(made[-1])
        return out


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four groups of eight digits of the hex SHA-256 of seed:doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def _chars(text: np.ndarray) -> int:
    """Bytes that begin a character."""
    return int(np.count_nonzero((text & 0xC0) != 0x80))


def infill(text: bytes, doc_id: int | None, automaton: Automaton, seed: int = SEED, rate: int = RATE, spm: int = SPM, chunk: int = CHUNK) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    data = np.frombuffer(text, np.uint8)
    rows, last = automaton.scan(data, chunk)
    _, ended, found = rows.sum(axis=0).tolist() if len(rows) else (0, 0, 0)
    n = ended + (1 if last != 0 else 0)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or found or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = automaton.unit_end(data, rows, a, chunk), automaton.unit_end(data, rows, b, chunk)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    p, s, m = (x.encode() for x in automaton.sentinels)
    form = "spm" if h4 % 100 < spm else "psm"
    output = b"".join((s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle))
    return n, form, _chars(data[:i]), _chars(data[i:j]), output


def restored(output: bytes, form: str, automaton: Automaton, chunk: int = CHUNK) -> bytes:
    """The text that infill was given."""
    if form == "plain":
        return output
    found = automaton.marks(np.frombuffer(output, np.uint8), chunk)
    ends = [at for _, at in found[1:]] + [len(output)]
    parts = {which: output[at + 3 : end] for (which, at), end in zip(found, ends, strict=True)}
    return parts[0] + parts[2] + parts[1]


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, ...] = SENTINELS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of docs. rate, spm: per cent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sentinels)
        for b in batches:
            ids = b.column(0).to_pylist()
            made = [infill(t.as_py() or b"", i, automaton, seed, rate, spm, chunk) for i, t in zip(ids, b.column(1), strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True) if made else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text"), "UTF-8").alias("t")).mapInArrow(run, MADE)


def restore(made: DataFrame, sentinels: tuple[str, ...] = SENTINELS, chunk: int = CHUNK) -> DataFrame:
    """The rows of transform with restored, the text rebuilt from output and form alone."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(sentinels)
        for b in batches:
            texts = [restored(t.as_py(), f.as_py(), automaton, chunk) for t, f in zip(b.column(5).cast(pa.binary()), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, "restored"])

    return made.select(*names).mapInArrow(run, MADE + ", restored string")


def digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
