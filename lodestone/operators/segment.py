"""Row generators: chunks, segments, pairs of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_chunks(df: DataFrame, key: str, text: str, size: int | Column = 300, overlap: int | Column = 30, min_chars: int = 50) -> DataFrame:
    """key, chunk_no, chunk: windows of words, `size` long, that advance by size - overlap; short ones go."""
    size, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (size, overlap))
    ws = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    made = df.select(key, ws.alias("_w"), size.alias("_s"), (size - overlap).alias("_step")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.col("_step"))
    out = made.select(key, F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice(F.col("_w"), i + 1, F.col("_s")), " "))).alias("chunk_no", "chunk"))
    return out.where(F.length("chunk") >= min_chars)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, line (trimmed), blank lines left out."""
    out = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    return out.withColumn("line", F.trim("line")).where("line <> ''")


def segments(rows: DataFrame, key: str, order: str, is_head: Column) -> DataFrame:
    """Rows numbered by the head row they follow; what precedes the first head goes."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("segment", F.sum(is_head.cast("int")).over(w)).where("segment > 0")


def carry_forward(rows: DataFrame, key: str, order: str, value: Column, default: str, name: str = "topic") -> DataFrame:
    """The last non-null value so far in each key's order."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def repeated_lines(rows: DataFrame, key: str, line: str, times: int) -> DataFrame:
    """key, line (lower case), n of the lines that a document has `times` or more often."""
    return rows.groupBy(key, F.lower(line).alias("line")).agg(F.count("*").alias("n")).where(F.col("n") >= times)


def paragraph_groups(df: DataFrame, key: str, text: str, groups: int, between: str = r"\n\s*\n") -> DataFrame:
    """key, segment, paragraphs: paragraphs over 30 characters in `groups` runs of equal number, the rest in the last.

    Blank lines part paragraphs unless told otherwise. A text with fewer paragraphs than groups gives no row.
    """
    parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), between), lambda p: F.regexp_replace(p, r"^[\s\x0b]+|[\s\x0b]+$", ""))
    made = df.select(key, F.filter(parts, lambda p: F.length(p) > 30).alias("_p")).where(F.size("_p") >= groups)
    run = F.floor(F.size("_p") / groups).cast("int")
    cut = lambda i: F.slice(F.col("_p"), i * run + 1, F.when(i < groups - 1, run).otherwise(F.size("_p")))
    return made.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), cut)).alias("segment", "paragraphs"))


def sentence_packs(df: DataFrame, key: str, text: str, size: int = 300, modules: int | None = None) -> DataFrame:
    """key, pack_no, words, pack: whole sentences in order, gathered greedily, joined by a space.

    A pack ends before the sentence that would take it past `size` words (a longer sentence stands alone). With
    modules, a pack ends once it has the text's words divided by modules, until modules - 1 packs have ended.
    A null or blank text gives no row. One pass over each text: the greedy rule looks back, so it runs in Python.
    """
    import re

    import pandas as pd

    def run(batches):
        end = re.compile(r"(?<=[.!?])\s+")
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"], strict=True):
                if not t.strip():
                    continue
                target = max(1, len(t.split()) // modules) if modules else 0
                packs, now, n = [], [], 0
                for s in end.split(t):
                    w = len(s.split())
                    if not modules and now and n + w > size:
                        packs.append((n, " ".join(now)))
                        now, n = [], 0
                    now.append(s)
                    n += w
                    if modules and n >= target and len(packs) < modules - 1:
                        packs.append((n, " ".join(now)))
                        now, n = [], 0
                if now:
                    packs.append((n, " ".join(now)))
                rows += [(k, i, n, p) for i, (n, p) in enumerate(packs)]
            yield pd.DataFrame(rows, columns=[key, "pack_no", "words", "pack"])

    kind = df.schema[key].dataType.simpleString()
    used = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("k is not null")
    return used.mapInPandas(run, f"`{key}` {kind}, pack_no int, words int, pack string")


def sentence_groups(df: DataFrame, key: str, text: str, groups: int) -> DataFrame:
    """key, segment, sentences: sentences in `groups` runs of equal number, the rest in the last; empty runs go."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+")
    run = F.greatest(F.lit(1), F.floor(F.size("_s") / groups).cast("int"))
    cut = lambda i: F.slice(F.col("_s"), i * run + 1, F.when(i < groups - 1, run).otherwise(F.size("_s")))
    made = df.select(key, parts.alias("_s")).select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), cut)).alias("segment", "sentences"))
    return made.where(r"array_join(sentences, ' ') rlike '[^\\s\\x0b]'")


def page_range(chunk_no: Column, chunks: Column, pages: int, module: int = 1, modules: int = 1) -> tuple[Column, Column]:
    """First and last page that chunk chunk_no (from 1) of `chunks` falls on, in proportion to its place in its module."""
    span = max(1, pages // modules)
    start = F.floor((chunk_no - 1) / F.greatest(chunks - 1, F.lit(1)) * span).cast("long") + (module - 1) * span + 1
    end = start + F.greatest(F.lit(1), F.floor(span / F.greatest(chunks, F.lit(1))).cast("long"))
    return F.greatest(F.lit(1), start), F.least(F.lit(pages), end)
