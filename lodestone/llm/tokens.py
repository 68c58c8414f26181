"""Token counts with a public tokenizer; huge documents are encoded in overlapping chunks and spliced.

The tokenizer drops white space before it merges, so nothing merges across it: the start of a word is a boundary
of every encoding. A huge document is cut into chunks that overlap. Both encodings of an overlap, with offsets,
must agree on every token between its first and last word start; then that place is a proven boundary and the
chunks are spliced at the word start nearest the overlap's middle. Where they don't agree, or the overlap has no
two word starts, the left chunk is encoded again with the overlap doubled, up to the whole rest of the text.

Other documents are encoded word by word with a bounded memory of words already encoded.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted each; other columns
are ignored. A scan without a shuffle.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
CHUNK, OVERLAP = 1 << 16, 1 << 10
MEMORY_WORDS = 1_200_000
LIMIT = 2048

_WS = "\x09-\x0d\x20\x85\xa0  -     　"
_WORD = re.compile(f"[^{_WS}]+")
_START = re.compile(f"(?<=[{_WS}])[^{_WS}]")
#: White space to str.split() but not to the tokenizer.
_OTHER = re.compile("[\x1c-\x1f]")


def vocabulary_path(name: str) -> str:
    """A path stays; a bare name is looked up among the public tokenizers, on whichever machine asks."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, memory_words: int = MEMORY_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.chunk, self.overlap, self.memory_words = chunk, overlap, memory_words
        self.memory: dict[str, bytes] = {}

    def _spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids and start offsets."""
        out = []
        for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            out.append((np.array(e.ids, np.uint32), np.array([a for a, _ in e.offsets], np.int64)))
        return out

    def huge(self, text: str) -> bytes:
        step = self.chunk - self.overlap
        starts = list(range(0, max(1, len(text) - self.overlap), step))
        made = self._spans([text[s : s + self.chunk] for s in starts])
        parts: list[np.ndarray] = []
        begin, i = 0, 0
        while i < len(starts):
            s, end = starts[i], min(starts[i] + self.chunk, len(text))
            ids, at = made[i][0], made[i][1] + s
            j, wide = i + 1, self.overlap
            cut = None
            while end < len(text):
                while j + 1 < len(starts) and starts[j] + self.chunk <= end:
                    j += 1  # a chunk that the widened one has swallowed can't follow it
                cut = self._boundary(text, (ids, at), (made[j][0], made[j][1] + starts[j]), starts[j], min(end, starts[j] + self.chunk))
                if cut is not None:
                    break
                end, wide = min(len(text), end + wide), wide * 2
                (ids, at), = self._spans([text[s:end]])
                at = at + s
            stop = len(text) if cut is None else cut
            parts.append(ids[(at >= begin) & (at < stop)])
            if cut is None:
                break
            begin, i = cut, j
        return np.concatenate(parts).astype("<u4").tobytes()

    @staticmethod
    def _boundary(text, left, right, low, high) -> int | None:
        """A word start between low and high where both encodings agree, or None."""
        found = [m.start() for m in _START.finditer(text, low + 1, high)]
        if len(found) < 2:
            return None
        a, b = found[0], found[-1]
        cut_l, cut_r = ((x[1] >= a) & (x[1] < b) for x in (left, right))
        same = np.array_equal(left[0][cut_l], right[0][cut_r]) and np.array_equal(left[1][cut_l], right[1][cut_r])
        return min(found, key=lambda x: abs(2 * x - low - high)) if same else None

    def encode(self, texts: list[str]) -> list[bytes]:
        memory = self.memory
        split = [None if len(t) > self.chunk else t.split() if not _OTHER.search(t) else _WORD.findall(t) for t in texts]
        known = [None if ws is None else list(map(memory.get, ws)) for ws in split]
        new = list({w for ws, got in zip(split, known, strict=True) if got and None in got for w, x in zip(ws, got, strict=True) if x is None})
        more: dict[str, bytes] = {}
        for k in range(0, len(new), 400):
            part = new[k : k + 400]  # words apart by a space are encoded as they are alone
            (ids, at), = self._spans([" ".join(part)])
            begin = np.cumsum([0, *(len(w) + 1 for w in part)])
            data, cut = ids.astype("<u4").tobytes(), (4 * np.searchsorted(at, begin)).tolist()
            more.update((w, data[a:b]) for w, a, b in zip(part, cut, cut[1:], strict=False))
        memory.update(itertools.islice(more.items(), max(0, self.memory_words - len(memory))))
        out = []
        for t, ws, got in zip(texts, split, known, strict=True):
            if ws is None:
                out.append(self.huge(t))
            elif None in got:
                out.append(b"".join([more[w] if x is None else x for w, x in zip(ws, got, strict=True)]))
            else:
                out.append(b"".join(got))
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(*key) -> Encoder:
    """One encoder a worker process and setting: its memory outlives the task."""
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def encoded(batches: Iterator[pa.RecordBatch], key: tuple, group: int = 256) -> Iterator[tuple[list, list[str], list[bytes]]]:
    """doc_ids, texts and id bytes, some documents at a time; batches: doc_id, text."""
    enc = encoder(*key)
    for b in batches:
        for k in range(0, b.num_rows, group):
            part = b.slice(k, group)
            texts = [t or "" for t in part.column(1).to_pylist()]
            yield part.column(0).to_pylist(), texts, enc.encode(texts)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, memory_words: int = MEMORY_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs."""
    key = (vocabulary, chunk, overlap, memory_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, found in encoded(batches, key):
            n = [len(x) // 4 for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
