"""Operators as SQL over a caller's tables, and the few spellings in which DuckDB differs.

An operator's text names its input tables in braces; `apply` binds them to DataFrames. Patterns are written r'...'.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Spark's name, DuckDB's name. regexp_sub(x, pattern, by, 'g') replaces every match.
_DUCK = {
    "regexp_like(": "regexp_matches(", "regexp_sub(": "regexp_replace(", "size(": "len(", "filter(": "list_filter(", "transform(": "list_transform(",
    "array_distinct(": "list_distinct(", "array_contains(": "list_contains(", "array_intersect(": "list_intersect(", "array_join(": "array_to_string(",
    "try_element_at(": "list_extract(", "startswith(": "starts_with(", "endswith(": "ends_with(", "collect_list(": "list(", "collect_set(": "list(DISTINCT ", "sort_array(": "list_sort(", "bround(": "round_even(",
    "array(": "list_value(", "<<nl>>": "chr(10)", "explode(": "unnest(", "sequence(": "generate_series(",
}
_NAME = re.compile("|".join(rf"(?<![\w]){re.escape(k)}" for k in sorted(_DUCK, key=len, reverse=True)))
_LAMBDA = re.compile(r"\b(\w+) -> ")
#: <<joined x 'between' place>>: the group's values of x in order of place, joined.
_JOINED = re.compile(r"<<joined (\w+) ('[^']*'|<<nl>>) (\w+)>>")
#: <<numbered xs x place>>: a row for each element of xs, with its place. <<shingles ws n>>: runs of n of the elements, joined by a blank; fewer: one run.
_NUMBERED = re.compile(r"<<numbered (\w+) (\w+) (\w+)>>")
_SHINGLES = re.compile(r"<<shingles (\w+) (\d+)>>")
#: A word begins or ends here, in any script.
_EDGES = {"<<b>>": r"(?:^|[^\p{L}\p{N}_])", "<<e>>": r"(?:$|[^\p{L}\p{N}_])"}
_LINES = re.compile(r"<<lines (\{\w+\}) (\w+)>>")


def spark_text(text: str) -> str:
    text = _LINES.sub(r"(SELECT \2, pos AS line_no, regexp_replace(col, r'^\\s+|\\s+$', '') AS line FROM \1 LATERAL VIEW posexplode(split(coalesce(text, ''), r'\\n')) l)", text)
    text = _NUMBERED.sub(r"posexplode(\1) AS (\3, \2)", text)
    text = _SHINGLES.sub(r"transform(sequence(1, greatest(1, size(\1) - \2 + 1)), i -> array_join(slice(\1, i, \2), ' '))", text)
    text = _JOINED.sub(r"array_join(transform(sort_array(collect_list(struct(\3, \1))), x -> x.\1), \2)", text)
    for mark, by in (*_EDGES.items(), ("<<g1>>", "$1"), ("<<g2>>", "$2")):
        text = text.replace(mark, by)
    return text.replace("regexp_sub(", "regexp_replace(").replace(", 'g')", ")").replace("<<nl>>", "'\\n'")


def duck_text(text: str) -> str:
    text = _LINES.sub(r"(SELECT \2, CAST(i - 1 AS INT) AS line_no, regexp_replace(string_split(coalesce(text, ''), chr(10))[i], '^\\s+|\\s+$', '', 'g') AS line FROM \1, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS r(i))", text)
    text = _NUMBERED.sub(r"unnest(\1) AS \2, unnest(range(0, len(\1))) AS \3", text)
    text = _SHINGLES.sub(r"list_transform(generate_series(1, greatest(1, len(\1) - \2 + 1)), lambda i: array_to_string(\1[i:i + \2 - 1], ' '))", text)
    text = _JOINED.sub(r"string_agg(\1, \2 ORDER BY \3)", text)
    for mark, by in (*_EDGES.items(), ("<<g1>>", r"\1"), ("<<g2>>", r"\2")):
        text = text.replace(mark, by)
    text = re.sub(r"\br'", "'", _NAME.sub(lambda m: _DUCK[m.group()], text))
    return re.sub(r"\{(\w+)\}", r"\1", _LAMBDA.sub(r"lambda \1: ", text))


def apply(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """The operator's rows. Braces that name no table, as in patterns, are Spark's own doubled ones."""
    parts = re.split("({(?:" + "|".join(tables) + ")})", spark_text(text))
    return spark.sql("".join(p if k % 2 else p.replace("{", "{{").replace("}", "}}") for k, p in enumerate(parts)), **tables)


def register(operators: dict[str, str], uses: dict[str, tuple[str, dict[str, str]]]) -> tuple[dict, dict[str, str]]:
    """Queries and oracles. uses: query name to (operator, its inputs as selects over the base tables, which stand in braces)."""

    def query(text: str, inputs: dict[str, str]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for s in inputs.values() for t in re.findall(r"\{(\w+)\}", s)}
            made = {n: apply(spark, s, **{t: base[t] for t in re.findall(r"\{(\w+)\}", s)}) for n, s in inputs.items()}
            return apply(spark, text, **made)

        return run

    def oracle(text: str, inputs: dict[str, str]) -> str:
        head = "WITH RECURSIVE " if "RECURSIVE" in text else "WITH "
        body = re.sub(r"^\s*WITH (RECURSIVE )?", ", ", text) if re.match(r"\s*WITH ", text) else " " + text
        return duck_text(head + ", ".join(f"{n} AS ({s})" for n, s in inputs.items()) + body)

    return {q: query(operators[o], i) for q, (o, i) in uses.items()}, {q: oracle(operators[o], i) for q, (o, i) in uses.items()}
