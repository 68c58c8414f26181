"""Paragraphs packed into chunks by rules that look back: folds over a document's own paragraphs, inside the JVM.

Each rule walks over the paragraphs with the chunks made so far, the paragraphs that wait, and how many words they have. Blank paragraphs go.

Defined results: a null or empty text gives no chunk; what is left at the end counts only from the rule's least words on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Paragraphs that begin like this open a chunk.
HEADING = r"(?m)^(\d+[\.\d]*\s+[A-Z]|[A-Z][A-Z\s]{4,}$|(?:Definition|Theorem|Algorithm|Lemma)\s)"
BLANK_LINES, SENTENCE_END = r"\n\s*\n", r"(?<=[.!?])\s+"


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _pieces(text: Column, at: str) -> Column:
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), at), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.transform(F.filter(bare, lambda p: p != ""), lambda p: F.struct(p.alias("t"), words(p).alias("n")))


def _sentences(p: Column) -> Column:
    return F.transform(F.split(p, SENTENCE_END), lambda s: F.struct(s.alias("t"), words(s).alias("n")))


def _none() -> Column:
    return F.array().cast("array<string>")


def _state(out: Column, cur: Column, n: Column) -> Column:
    return F.struct(out.alias("out"), cur.alias("cur"), n.cast("int").alias("n"))


def _zero() -> Column:
    return _state(_none(), _none(), F.lit(0))


def _closed(s: Column, glue: str, least: int) -> Column:
    """The chunks with what waits, if it has enough words."""
    return F.when((F.size(s["cur"]) > 0) & (s["n"] >= least), F.concat(s["out"], F.array(F.array_join(s["cur"], glue)))).otherwise(s["out"])


def paragraph_packs(text: Column, least: int = 80, most: int = 400, at: str = r"\n\n") -> Column:
    """Chunks: a paragraph of `least` words stands alone; smaller ones are packed until they have `most`. A pack that is still too small waits on."""

    def step(s: Column, p: Column) -> Column:
        enough = (F.size(s["cur"]) > 0) & (s["n"] >= least)
        alone = _state(F.concat(F.when(enough, _closed(s, "\n", least)).otherwise(s["out"]), F.array(p["t"])), F.when(enough, _none()).otherwise(s["cur"]), F.when(enough, 0).otherwise(s["n"]))
        cur, n = F.concat(s["cur"], F.array(p["t"])), s["n"] + p["n"]
        packed = F.when(n >= most, _state(F.concat(s["out"], F.array(F.array_join(cur, "\n"))), _none(), F.lit(0))).otherwise(_state(s["out"], cur, n))
        return F.when(p["n"] >= least, alone).otherwise(packed)

    return F.aggregate(_pieces(text, at), _zero(), step, lambda s: _closed(s, "\n", least))


def concept_packs(text: Column, least: int = 60, most: int = 400, rest: int = 30, at: str = r"\n\n+") -> Column:
    """As paragraph_packs, but a paragraph of more than `most` words is cut at sentences, into parts of `least` to `most` words; a last part needs `rest`."""

    def cut(p: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            cur, n = F.concat(s["cur"], F.array(x["t"])), s["n"] + x["n"]
            return F.when(n.between(least, most), _state(F.concat(s["out"], F.array(F.array_join(cur, " "))), _none(), F.lit(0))).otherwise(_state(s["out"], cur, n))

        return F.aggregate(_sentences(p["t"]), _zero(), step, lambda s: _closed(s, " ", rest))

    def step(s: Column, p: Column) -> Column:
        enough = (F.size(s["cur"]) > 0) & (s["n"] >= least)
        made = F.when(p["n"] > most, cut(p)).otherwise(F.array(p["t"]))
        alone = _state(F.concat(F.when(enough, _closed(s, "\n", least)).otherwise(s["out"]), made), F.when(enough, _none()).otherwise(s["cur"]), F.when(enough, 0).otherwise(s["n"]))
        cur, n = F.concat(s["cur"], F.array(p["t"])), s["n"] + p["n"]
        packed = F.when(n >= most, _state(F.concat(s["out"], F.array(F.array_join(cur, "\n"))), _none(), F.lit(0))).otherwise(_state(s["out"], cur, n))
        return F.when(p["n"] >= least, alone).otherwise(packed)

    return F.aggregate(_pieces(text, at), _zero(), step, lambda s: _closed(s, "\n", least))


def module_packs(text: Column, target: int = 500, least: int = 40, most: int = 900, at: str = BLANK_LINES) -> Column:
    """Chunks of about `target` words: a heading opens a new one, a paragraph of more than `most` words is cut at sentences; chunks below `least` go."""

    def flushed(s: Column) -> Column:
        return _state(_closed(s, "\n\n", least), _none(), F.lit(0))

    def cut(s: Column, p: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            full = (a["n"] + x["n"] > target) & (F.size(a["cur"]) > 0)
            return F.when(full, _state(_closed(a, " ", least), F.array(x["t"]), x["n"])).otherwise(_state(a["out"], F.concat(a["cur"], F.array(x["t"])), a["n"] + x["n"]))

        return F.aggregate(_sentences(p["t"]), flushed(s), step)

    def step(s: Column, p: Column) -> Column:
        opens = (s["n"] > least) & (F.regexp_like(F.split(p["t"], r"\n")[0], F.lit(HEADING)) | (s["n"] + p["n"] > target))
        add = lambda a: _state(a["out"], F.concat(a["cur"], F.array(p["t"])), a["n"] + p["n"])
        return F.when(p["n"] > most, cut(s, p)).otherwise(F.when(opens, add(flushed(s))).otherwise(add(s)))

    return F.aggregate(_pieces(text, at), _zero(), step, lambda s: _closed(s, "\n\n", least))


def module_chunks(modules: DataFrame, module: str, text: str, **kw) -> DataFrame:
    """module, chunk_id, place (from 1), total, n_words, text of every chunk of module_packs."""
    made = modules.select(module, module_packs(F.col(text), **kw).alias("_c"))
    each = made.select(module, F.size("_c").alias("total"), F.posexplode("_c").alias("_p", "text"))
    name = F.format_string("%s_chunk_%02d", F.col(module).cast("string"), F.col("_p") + 1)
    return each.select(module, name.alias("chunk_id"), (F.col("_p") + 1).alias("place"), "total", words(F.col("text")).alias("n_words"), "text")
