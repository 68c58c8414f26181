"""Queries over edge tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import graph

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: A tree (each customer needs the one with a third of its number), and the same with ways back that close cycles.
TREE = "SELECT c_custkey AS src, CAST(floor(c_custkey / 3) AS BIGINT) AS dst FROM {customer} WHERE c_custkey >= 3"
LOOPS = TREE + " UNION ALL SELECT CAST(floor(c_custkey / 3) AS BIGINT) AS src, c_custkey AS dst FROM {customer} WHERE c_custkey >= 3 AND c_custkey % 50 = 0"
#: Chains: each part needs the next one of its brand and type.
CHAIN = "SELECT src, dst FROM (SELECT p_partkey AS src, lead(p_partkey) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS dst FROM {part}) x WHERE dst IS NOT NULL"


def _edges(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    table = "part" if "{part}" in text else "customer"
    return spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def _duck(text: str) -> str:
    return text.replace("{customer}", "customer").replace("{part}", "part")


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


_WALK = "walk(src, dst, depth) AS (SELECT src, dst, CAST(1 AS BIGINT) FROM edges UNION ALL SELECT w.src, e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.dst = e.src)"
_REACH = "reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"


@_query(f"WITH RECURSIVE edges AS ({_duck(TREE)}), {_WALK} SELECT src, dst, min(depth) AS depth FROM walk GROUP BY src, dst")
def prerequisite_closure(spark, sf_dir):
    return graph.closure(_edges(spark, sf_dir, TREE))


@_query(f"WITH RECURSIVE edges AS ({_duck(CHAIN)}), {_WALK} SELECT src, dst, min(depth) AS depth FROM walk GROUP BY src, dst")
def chain_closure(spark, sf_dir):
    return graph.closure(_edges(spark, sf_dir, CHAIN))


@_query(f"WITH RECURSIVE edges AS ({_duck(LOOPS)}), {_REACH} SELECT src, dst FROM reach")
def cyclic_closure(spark, sf_dir):
    return graph.closure(_edges(spark, sf_dir, LOOPS)).select("src", "dst")


@_query(f"WITH RECURSIVE edges AS ({_duck(LOOPS)}), {_REACH} SELECT a.src AS node, min(a.dst) AS cycle FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src")
def graph_cycles(spark, sf_dir):
    return graph.cycles(_edges(spark, sf_dir, LOOPS)).select("node", "cycle")


@_query(f"WITH RECURSIVE edges AS ({_duck(TREE)}), {_WALK}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT node, coalesce(max(depth), 0) AS depth FROM n LEFT JOIN walk ON node = src GROUP BY node")
def topological_depth(spark, sf_dir):
    return graph.layers(_edges(spark, sf_dir, TREE))


@_query(f"WITH RECURSIVE edges AS ({_duck(TREE)}), {_WALK} SELECT src AS node, arg_max(dst, depth) AS root, max(depth) AS depth FROM walk GROUP BY src")
def parent_chain(spark, sf_dir):
    return graph.subsumed(_edges(spark, sf_dir, TREE))
