"""Lexical and TF-IDF retrieval as joins on tokens, vector retrieval by a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import vectors
from ..sources.shared import work_path


def token_table(df: DataFrame, key: str, text: str, longer_than: int = 2) -> DataFrame:
    """key, token, n: how often each token occurs."""
    return df.select(key, F.explode(T.tokens(F.col(text), longer_than)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def top_k(scored: DataFrame, query: str, order: list, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


def lexical(queries: DataFrame, docs: DataFrame, q: str, d: str, k: int = 3) -> DataFrame:
    """q, d, score: the share of a query's distinct tokens that a document has. An inner join on tokens."""
    qt = queries.select(q, "token").distinct()
    sizes = qt.groupBy(q).agg(F.count("*").alias("size"))
    met = qt.join(docs.select(d, "token").distinct(), "token").groupBy(q, d).agg(F.count("*").alias("met"))
    scored = met.join(sizes, q).select(q, d, F.round(F.col("met") / F.col("size"), 4).alias("score"))
    return top_k(scored, q, [F.desc("score"), F.asc(d)], k)


def tfidf(queries: DataFrame, docs: DataFrame, q: str, d: str, k: int = 3) -> DataFrame:
    """q, d, score: cosine of TF-IDF vectors; idf = ln((N + 1) / (df + 1)) + 1 from the documents."""
    n = docs.agg(F.count_distinct(d).alias("n_docs"))
    idf = docs.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("token", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))

    def weigh(t: DataFrame, key: str, name: str) -> DataFrame:
        w = t.join(idf, "token").withColumn("w", F.col("n") * F.col("idf"))
        norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norms, key).select(key, "token", (F.col("w") / F.col("norm")).alias(name))

    met = weigh(queries, q, "a").join(weigh(docs, d, "b"), "token").groupBy(q, d).agg(F.round(F.sum(F.col("a") * F.col("b")), 4).alias("score"))
    return top_k(met, q, [F.desc("score"), F.asc(d)], k)


def vector_top(queries: DataFrame, base: DataFrame, k: int, keep=None) -> DataFrame:
    """q_id, q_label, vec_id, label, sim (cosine, 5 places), rank of each query's k nearest rows other than itself: exact, by a fresh index of base."""
    path = work_path(base.sparkSession, "index")
    vectors.build(base, path)
    return vectors.search(queries, path, k, keep=keep)


def hard_negatives(pairs: DataFrame, base: DataFrame, above: float = 0.5, below: float = 0.9) -> DataFrame:
    """anchor, positive, negative, sim, pair_type of every pair (anchor, positive: ids of base): the row most similar to the anchor with a similarity between the bounds that
    isn't the positive. A pair for which there is none is kept as easy, without a negative. Pairs whose anchor isn't in base are easy too."""
    asked = base.join(pairs.select(F.col("anchor").alias("vec_id")).distinct(), "vec_id", "left_semi")
    path = work_path(base.sparkSession, "index")
    vectors.build(base, path)
    # of the two best, one is not the positive
    found = vectors.search(asked, path, 2, keep=lambda sim, label, own: (sim > above) & (sim < below))
    near = pairs.join(found.select(F.col("q_id").alias("anchor"), "vec_id", "sim", "rank"), "anchor").where("vec_id <> positive or positive is null")
    best = near.groupBy("anchor", "positive").agg(F.min(F.struct("rank", "vec_id", "sim")).alias("b"))
    made = pairs.join(best.withColumnRenamed("anchor", "_a").withColumnRenamed("positive", "_p"), (F.col("anchor") == F.col("_a")) & F.col("positive").eqNullSafe(F.col("_p")), "left")
    return made.select("anchor", "positive", F.col("b.vec_id").alias("negative"), F.col("b.sim").alias("sim"), F.when(F.col("b").isNull(), "easy").otherwise("hard").alias("pair_type"))
