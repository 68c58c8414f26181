"""Retrieval with the full scores: a stated set of queries meets all rows in one scan, without a join on words.

Queries are dealt by hash into blocks of about QUERIES; a block becomes an index from words to queries, and a task scores each row it reads against the block, passing on k rows a
query. So a word that every row has costs a row one look-up, and nothing is emitted for pairs that don't reach the top. Rows are not shuffled by `grounded`; `concepts` shuffles
their words once, for the weights.

Defined results: rows with a null id take no part, null texts are empty; ties go to the smaller id; scores are rounded half up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CHUNK_VOCABULARY
from ..sources.shared import discard, staged

QUERIES = 4096
#: Weights of overlap, vocabulary and length; hits for a full vocabulary score; words of a chunk of full length score.
WEIGHTS, FULL_HITS, SHORT, LONG, LEAST_LENGTH = (0.50, 0.30, 0.20), 8, 80, 400, 0.5
DENSE, LEXICAL, SAME_MODULE, OTHER_MODULE = 0.60, 0.40, 0.15, 0.60
COSINE, CONFIDENCE, NAMED, LONGER_THAN = 0.70, 0.30, 0.15, 3
_TERM, _WORD = re.compile(r"\b[a-zA-Z]{3,}\b"), re.compile(r"\w+")
FOUND = "q_id long, id long, score double"


def half_up(x: np.ndarray, places: int) -> np.ndarray:
    return np.floor(x * 10**places + 0.5 + 1e-6) / 10**places


class Best:
    """The k best rows of each query so far: larger scores first, then smaller ids."""

    def __init__(self, q_ids: np.ndarray, k: int):
        self.q_ids, self.k, self.kept = q_ids, k, [np.zeros(0)] * len(q_ids)
        self.scores, self.ids = [np.zeros(0)] * len(q_ids), [np.zeros(0, np.int64)] * len(q_ids)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: rows by queries; -inf doesn't count."""
        for j in range(len(self.q_ids)):
            mine = scores[:, j]
            use = mine > (self.scores[j][-1] if len(self.scores[j]) == self.k else -np.inf)
            use |= (mine == self.scores[j][-1]) if len(self.scores[j]) == self.k else False
            if use.any():
                s, i = np.concatenate([self.scores[j], mine[use]]), np.concatenate([self.ids[j], ids[use]])
                order = np.lexsort((i, -s))[: self.k]
                self.scores[j], self.ids[j] = s[order], i[order]

    def rows(self) -> pa.RecordBatch:
        n = [len(s) for s in self.scores]
        parts = (np.repeat(self.q_ids, n), np.concatenate([*self.ids, np.zeros(0, np.int64)]), np.concatenate([*self.scores, np.zeros(0)]))
        return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.float64())], names=["q_id", "id", "score"])


def _blocks(queries: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """The queries, some at a time: the driver holds one block."""
    kept = staged(queries, "queries")
    n = -(-kept.count() // size)
    for b in range(n):
        some = kept.where(F.pmod(F.xxhash64("q_id"), F.lit(n)) == b).toPandas()
        if len(some):
            yield some
    discard(kept)


def _top(queries: DataFrame, rows: DataFrame, k: int, scorer: Callable[[pd.DataFrame], Callable[[pa.RecordBatch], np.ndarray]], size: int) -> DataFrame:
    """q_id, id, score, rank. scorer(block of queries) gives what scores a batch of rows (the first column: id): rows by queries."""
    made = None
    for block in _blocks(queries, size):
        score, q_ids = scorer(block), block["q_id"].to_numpy(np.int64)

        def scan(batches: Iterator[pa.RecordBatch], score=score, q_ids=q_ids) -> Iterator[pa.RecordBatch]:
            best = Best(q_ids, k)
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    some = b.slice(at, 256)
                    best.add(score(some), some.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield best.rows()

        found = rows.mapInArrow(scan, FOUND)
        made = found if made is None else made.union(found)
    if made is None:
        return rows.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "id"))
    return made.withColumn("rank", rank).where(F.col("rank") <= k)


def _postings(terms: list[set[str]]) -> dict[str, np.ndarray]:
    index: dict[str, list[int]] = {}
    for j, some in enumerate(terms):
        for t in some:
            index.setdefault(t, []).append(j)
    return {t: np.array(js) for t, js in index.items()}


def _vocabulary():
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, w in enumerate(dict.fromkeys(CHUNK_VOCABULARY)):
        made.add_word(w, i)
    made.make_automaton()
    return made


def static_score(low: str, automaton) -> float:
    """What a chunk's vocabulary and length are worth, whatever the query."""
    hits, n = len({i for _, i in automaton.iter(low)}), len(low.split())
    length = 1.0 if SHORT <= n <= LONG else n / SHORT if n < SHORT else max(LEAST_LENGTH, LONG / n)
    return WEIGHTS[1] * min(1.0, hits / FULL_HITS) + WEIGHTS[2] * length


def grounded(queries: DataFrame, chunks: DataFrame, k: int = 3, size: int = QUERIES) -> DataFrame:
    """q_id, id, score, rank of each query's k best chunks.

    queries: q_id, text, module, and vector if there is one; chunks: id, text, module, and vector. With vectors on both sides the score is the cosine and the lexical score in
    fixed parts; without, a chunk of the query's module gains and one of another loses (a null or empty module does neither).
    """
    dense = "vector" in queries.columns and "vector" in chunks.columns
    rows = chunks.where("id is not null").select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("module").cast("string"), F.lit("")).alias("module"), *([F.col("vector").cast("array<double>").alias("vector")] if dense else []))
    asked = queries.where("q_id is not null").select(F.col("q_id").cast("long").alias("q_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("module").cast("string"), F.lit("")).alias("module"), *([F.col("vector").cast("array<double>").alias("vector")] if dense else [])).dropDuplicates(["q_id"])

    def scorer(block: pd.DataFrame) -> Callable[[pa.RecordBatch], np.ndarray]:
        terms = [set(_TERM.findall(t.lower())) for t in block["text"]]
        index, sizes = _postings(terms), np.array([max(1, len(t)) for t in terms], np.float64)
        modules = block["module"].to_numpy()
        vectors = np.array(block["vector"].tolist(), np.float64) if dense else None
        kept: list = []

        def score(b: pa.RecordBatch) -> np.ndarray:
            if not kept:
                kept.append(_vocabulary())
            made = np.zeros((b.num_rows, len(sizes)))
            for i, (text, module) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                low = text.lower()
                met = [index[t] for t in set(_TERM.findall(low)) & index.keys()]
                overlap = np.bincount(np.concatenate(met), minlength=len(sizes)) / sizes if met else np.zeros(len(sizes))
                base = half_up(WEIGHTS[0] * overlap + static_score(low, kept[0]), 4)
                if vectors is None:
                    same = (modules != "") & (modules == module)
                    other = (modules != "") & (module != "") & ~same
                    base = np.where(same, np.minimum(1.0, base + SAME_MODULE), np.where(other, base * OTHER_MODULE, base))
                made[i] = base
            if vectors is not None:
                x = np.array(b.column(3).to_pylist(), np.float64)
                made = DENSE * (x @ vectors.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :] + 1e-9) + LEXICAL * made
            return half_up(made, 9)

        return score

    return _top(asked, rows, k, scorer, size)


def concepts(queries: DataFrame, known: DataFrame, k: int = 5, kind: str | None = None, size: int = QUERIES) -> DataFrame:
    """q_id, id, score, rank of each query's k best concepts, by the cosine of TF-IDF vectors, the concept's confidence, and whether a word of the query is in its name.

    queries: q_id, text. known: id, name, text, confidence, kind. Weights come from all of known, whatever kind is asked for. A query of white space alone gets the concepts
    of the highest confidence.
    """
    spark = known.sparkSession
    each = known.where("id is not null").select(F.col("id").cast("long").alias("id"), F.lower(F.coalesce("name", F.lit(""))).alias("name"), F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("ws"), F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"), "kind")
    each = staged(each, "concepts")
    n = each.count()
    counts = staged(each.select("id", F.size("ws").alias("len"), F.explode("ws").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("n")), "counts")
    idf = staged(counts.groupBy("term").agg((F.log((F.lit(n) + 1.0) / (F.count("*") + 1)) + 1).alias("idf")), "idf")
    weighed = counts.join(idf, "term").select("id", "term", (F.col("n") / F.col("len") * F.col("idf")).alias("w"))
    vectors = weighed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("v"))  # a concept's own words
    rows = each.where(F.lit(True) if kind is None else F.col("kind") == kind).join(vectors, "id", "left").select("id", "name", "confidence", F.coalesce(F.transform("v", lambda x: x["term"]), F.array().cast("array<string>")).alias("terms"), F.coalesce(F.transform("v", lambda x: x["w"]), F.array().cast("array<double>")).alias("ws"))
    asked = queries.where("q_id is not null").select(F.col("q_id").cast("long").alias("q_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["q_id"])

    def scorer(block: pd.DataFrame) -> Callable[[pa.RecordBatch], np.ndarray]:
        tokens = [_WORD.findall(t.lower()) for t in block["text"]]
        blank = np.array([not t.strip() for t in block["text"]])
        vocabulary = sorted({t for ts in tokens for t in ts})
        listed = spark.createDataFrame([(t,) for t in vocabulary], "term string") if vocabulary else None
        have = {r["term"]: r["idf"] for r in idf.join(listed, "term").collect()} if vocabulary else {}  # words of one block
        place = {t: i for i, t in enumerate(vocabulary)}
        weights = np.zeros((len(tokens), len(vocabulary)))
        for j, ts in enumerate(tokens):
            for t, c in Counter(ts).items():
                weights[j, place[t]] = c / len(ts) * have.get(t, np.log(n + 1))
        norms = np.sqrt((weights * weights).sum(axis=1))
        long = [[t for t in ts if len(t) > LONGER_THAN] for ts in tokens]

        def score(b: pa.RecordBatch) -> np.ndarray:
            made = np.zeros((b.num_rows, len(tokens)))
            confidence = np.asarray(b.column(2).to_pylist(), np.float64)
            for i, (name, terms, ws) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                at = [(place[t], w) for t, w in zip(terms, ws, strict=True) if t in place]
                norm = np.sqrt(np.square(np.array(ws, np.float64)).sum())
                if at and norm > 0:
                    cols, values = (np.array(x) for x in zip(*at, strict=True))
                    made[i] = weights[:, cols] @ values / np.maximum(norms * norm, 1e-300)
                made[i] = COSINE * made[i] + CONFIDENCE * confidence[i]
                named = np.array([any(t in name for t in ts) for ts in long])
                made[i] = np.where(named, np.minimum(1.0, made[i] + NAMED), made[i])
            return half_up(np.where(blank[None, :], confidence[:, None], made), 9)

        return score

    return _top(asked, rows, k, scorer, size)
