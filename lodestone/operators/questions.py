"""Question papers as text to questions: parsers from the most to the least reliable, of which the first that finds any counts for a text.

numbered by Q and a number (with answers), numbered lines, lines that look like questions, paragraphs that do. All inside the JVM; a text is parsed where it lies.

Defined results: a null or empty text has no questions; questions of fewer than LEAST characters go, before and after a parser is chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gates
from ..functions import text as T

#: Patterns, signs of a question, and lengths.
LEAST, RAW, KEY = 10, 200, 100
BY_Q = r"(?is)(?:Q(?:uestion)?[\s.:]*(\d+)[\s.:]*)(.*?)(?=Q(?:uestion)?[\s.:]*\d+|$)"
ANSWER = r"(?i)\n\s*(?:A(?:ns(?:wer)?)?[\s.:]*)"
NEW = r"(?i)^\s*(?:\d+[\.\)]\s+|\(\d+\)\s+|[ivxlc]+[\.\)]\s+|[a-e][\.\)]\s+|(?:Q|Que|Question)\s*\.?\s*\d+)"
NUMBER = r"(?i)^\s*(?:\d+[\.\)]|\(\d+\)|[ivxlc]+[\.\)]|[a-e][\.\)]|(?:Q|Que|Question)\s*\.?\s*\d+[\.\):]?)\s*"
IN_LINES = ("?", "explain", "define", "describe", "list", "what", "how", "why", "compare", "discuss", "write", "state", "derive", "prove", "solve", "calculate", "differentiate", "illustrate", "evaluate", "design", "construct", "analyze")
IN_BLOCKS = ("?", "explain", "define", "describe", "discuss", "write")


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _question(text: Column, answer: Column, raw: Column) -> Column:
    return F.struct(text.alias("question"), answer.cast("string").alias("answer"), raw.alias("raw"))


def _long(found: Column) -> Column:
    return F.filter(found, lambda q: F.length(q["question"]) >= LEAST)


def _any(low: Column, signs: tuple[str, ...]) -> Column:
    made = F.lit(False)
    for s in signs:
        made = made | F.contains(low, F.lit(s))
    return made


def by_q(text: Column) -> Column:
    """Q1 ... Q2 ..., an answer split off at a line that begins with A, Ans or Answer."""
    bodies = F.filter(F.transform(F.regexp_extract_all(text, F.lit(BY_Q), F.lit(2)), _bare), lambda b: F.length(b) >= LEAST)

    def one(b: Column) -> Column:
        parts = F.split(b, ANSWER, 2)
        has = F.size(parts) > 1
        q = F.when(has, _bare(parts[0])).otherwise(b)
        return _question(q, F.when(has, _bare(F.get(parts, 1))), F.substring(q, 1, RAW))

    return F.transform(bodies, one)


def by_number(text: Column) -> Column:
    """Lines that begin with a number or letter open a question; the lines after them belong to it, and those before the first too."""

    def closed(s: Column) -> Column:
        q = _bare(F.regexp_replace(_bare(F.array_join(s["cur"], " ")), NUMBER, ""))
        return F.when(F.size(s["cur"]) > 0, F.concat(s["out"], F.array(_question(q, F.lit(None), s["raw"])))).otherwise(s["out"])

    def state(out: Column, cur: Column, raw: Column) -> Column:
        return F.struct(out.alias("out"), cur.alias("cur"), raw.alias("raw"))

    def step(s: Column, line: Column) -> Column:
        more = state(s["out"], F.concat(s["cur"], F.array(line)), s["raw"])
        opened = state(closed(s), F.array(line), line)
        return F.when((line == "") & (F.size(s["cur"]) == 0), s).when((line != "") & line.rlike(NEW), opened).otherwise(more)

    none = F.array().cast("array<struct<question:string,answer:string,raw:string>>")
    lines = F.transform(F.split(text, r"\n"), _bare)
    return F.aggregate(lines, state(none, F.array().cast("array<string>"), F.lit("")), step, lambda s: _long(closed(s)))


def by_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\n"), _bare), lambda x: (F.length(x) >= LEAST) & _any(F.lower(x), IN_LINES))
    return F.transform(lines, lambda x: _question(_bare(F.regexp_replace(x, r"^\s*[\d]+[\.\)]\s*", "")), F.lit(None), x))


def by_block(text: Column) -> Column:
    blocks = F.filter(F.transform(F.split(text, r"\n\s*\n"), _bare), lambda x: (F.length(x) >= LEAST) & _any(F.lower(x), IN_BLOCKS))
    return F.transform(blocks, lambda x: _question(x, F.lit(None), F.substring(x, 1, RAW)))


def parse(texts: DataFrame, key: str, text: str, subject: str) -> DataFrame:
    """key, place, question_id, question, answer, parser, marks, level, kind, difficulty of every question."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = texts.select(key, F.col(subject).alias("_s"), by_q(t).alias("p1"), by_number(t).alias("p2"), by_line(t).alias("p3"), by_block(t).alias("p4"))
    which = F.when(F.size("p1") > 0, 1).when(F.size("p2") > 0, 2).when(F.size("p3") > 0, 3).otherwise(4)
    chosen = found.select(key, "_s", which.alias("parser"), F.when(which == 1, F.col("p1")).when(which == 2, F.col("p2")).when(which == 3, F.col("p3")).otherwise(F.col("p4")).alias("qs"))
    each = chosen.select(key, "_s", "parser", F.posexplode(_long(F.col("qs"))).alias("place", "q")).select(key, "_s", "parser", "place", "q.*")
    made = each.withColumns({"marks": T.marks(F.col("raw")), "level": T.bloom_descending(F.col("question")), "kind": gates.question_kind(F.col("question"))})
    name = F.md5(F.concat_ws("_", F.coalesce(F.col("_s").cast("string"), F.lit("general")), F.substring("question", 1, KEY)))
    return made.select(key, "place", name.alias("question_id"), "question", "answer", F.element_at(F.array(*[F.lit(x) for x in ("by_q", "by_number", "by_line", "by_block")]), F.col("parser")).alias("parser"), "marks", "level", "kind", T.difficulty(F.col("level"), F.col("marks")).alias("difficulty"))
