"""A document's text made ready for concepts: headers and footers, contents lines and bare numbers go, titles lose their numbers, sections come out with their texts.

Everything happens on the array of a document's lines inside the JVM; a text is cleaned where it lies.

Defined results: a null text is empty; an empty text has one section, Document, without content; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits and patterns of the rules.
REPEATED, SECTION, LAST_SECTION, CONTENT = 3, 30, 20, 30
LEAST_SURE, MOST_SURE = 0.5, 0.98
FOOTER = r"^page\s+\d+(\s+of\s+\d+)?$|^(isbn|copyright|all rights reserved|published by|doi:)|^https?://\S+$|^[-=_]{4,}$|^\d+$"
DOTTED, NUMBERED = r"^.{10,}\.{3,}\s*\d+\s*$", r"^\d+(\.\d+)*\s+[A-Z].*\s+\d+$"
BARE_NUMBER, NUMBER = r"^\d+(\.\d+)*$", r"(?i)^(?:MODULE|UNIT|CHAPTER|SECTION)?\s*\d+(\.\d+)*\s*[:.\-–]?\s*"
TITLE = r"^[A-Z][A-Za-z0-9\-/()& ]{8,80}$"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines as an array; a break at the end opens no further one."""
    return _let(F.split(F.coalesce(text, F.lit("")), _BREAK), lambda cut: F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut))


def repeated_lines(ls: Column, times: int = REPEATED) -> Column:
    """Lines (bare, lower case, 4 to 120 characters, no number) that stand there so many times."""
    named = F.filter(F.transform(ls, lambda x: F.lower(bare(x))), lambda x: F.length(x).between(4, 120) & ~x.rlike(r"^\d+$"))

    def often(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s) - times + 1)), lambda i: F.get(s, i - 1) == F.get(s, i + times - 2))
        return F.array_distinct(F.transform(at, lambda i: F.get(s, i - 1)))

    return _let(F.array_sort(named), often)


def is_header(line: Column, often: Column) -> Column:
    low = F.lower(bare(line))
    return (low != "") & (low.rlike(FOOTER) | F.array_contains(often, low))


def is_contents(line: Column) -> Column:
    s = bare(line)
    dots = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    return s.rlike(DOTTED) | (s.rlike(NUMBERED) & (dots >= 2))


def titled(ls: Column) -> Column:
    """Lines without bare numbers; numbered titles keep their words if these have eight characters, and go otherwise."""

    def one(line: Column) -> Column:
        s = bare(line)
        words = F.regexp_replace(F.regexp_replace(s, NUMBER, ""), r"^[ :.\-–]+|[ :.\-–]+$", "")
        short = (F.length(s) < 100) & s.rlike(NUMBER)
        return F.when(s == "", "").when(s.rlike(BARE_NUMBER), None).when(short, F.when(F.length(words) >= 8, words)).otherwise(line)

    return F.array_compact(F.transform(ls, one))


def is_title(line: Column) -> Column:
    """A short line of capitalised words without a full stop, or of capitals alone."""
    s = bare(line)
    cased = F.length(s).between(10, 80) & s.rlike(TITLE) & (F.size(F.split(s, r"\s+")) <= 8)
    return (s != "") & (cased | ((s == F.upper(s)) & (s != F.lower(s)) & F.length(s).between(8, 80)))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def sections(text: Column) -> Column:
    """Array of title and content. A title closes the section before it, if that has any line; short ones are dropped."""

    def state(out: Column, title: Column, cur: Column) -> Column:
        return F.struct(out.alias("out"), title.alias("title"), cur.alias("cur"))

    def closed(s: Column, least: int) -> Column:
        content = bare(F.array_join(s["cur"], "\n"))
        return F.when(n_words(content) >= least, F.concat(s["out"], F.array(F.struct(s["title"].alias("title"), content.alias("content"))))).otherwise(s["out"])

    def step(s: Column, line: Column) -> Column:
        kept = F.when(bare(line) == "", "").otherwise(line)
        opens = is_title(line) & (F.size(s["cur"]) > 0)
        return F.when(opens, state(closed(s, SECTION), bare(line), F.array().cast("array<string>"))).otherwise(state(s["out"], s["title"], F.concat(s["cur"], F.array(kept))))

    none = F.array().cast("array<struct<title:string,content:string>>")
    return _let(F.coalesce(text, F.lit("")), lambda whole: _sections(whole, none, state, step, closed))


def _sections(text: Column, none: Column, state: Callable, step: Callable, closed: Callable) -> Column:
    made = F.aggregate(lines(text), state(none, F.lit("Introduction"), F.array().cast("array<string>")), step, lambda s: F.when(F.size(s["cur"]) > 0, closed(s, LAST_SECTION)).otherwise(s["out"]))
    return _let(made, lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(F.struct(F.lit("Document").alias("title"), text.alias("content")))))


def preprocess(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text (the sections' contents, or all that is left where they are short), sections, headers, contents (what went), confidence."""
    # each step is worked out once, whatever names it: as columns they would be put into the functions over lines, and worked out for each line

    def headers(ls: Column) -> Column:
        return _let(repeated_lines(ls), lambda often: F.struct(F.size(ls).alias("n"), F.filter(ls, lambda x: ~is_header(x, often)).alias("body"), F.transform(F.filter(ls, lambda x: is_header(x, often)), bare).alias("headers")))

    def contents(m: Column) -> Column:
        return F.struct(m["n"].alias("n"), m["headers"].alias("headers"), F.filter(m["body"], lambda x: ~is_contents(x)).alias("left"), F.transform(F.filter(m["body"], is_contents), bare).alias("contents"))

    def cleaned(m: Column) -> Column:
        joined = F.regexp_replace(F.regexp_replace(F.array_join(titled(m["left"]), "\n"), r"\n{3,}", "\n\n"), r"[ \t]{3,}", " ")
        return _let(bare(joined), lambda c: F.struct(m["n"].alias("n"), m["headers"].alias("headers"), m["contents"].alias("contents"), c.alias("cleaned"), sections(c).alias("sections")))

    def finished(m: Column) -> Column:
        only = F.array_join(F.transform(m["sections"], lambda s: s["content"]), "\n\n")
        gone = (F.size(m["headers"]) + F.size(m["contents"])) / F.greatest(m["n"], F.lit(1))
        sure = F.least(F.lit(MOST_SURE), F.greatest(F.lit(LEAST_SURE), 1.0 - gone * 0.5))
        text = _let(only, lambda o: F.when(n_words(o) < CONTENT, m["cleaned"]).otherwise(o))
        return F.struct(text.alias("text"), m["sections"].alias("sections"), m["headers"].alias("headers"), m["contents"].alias("contents"), F.round(sure, 2).alias("confidence"))

    made = _let(_let(_let(_let(lines(F.col(text)), headers), contents), cleaned), finished)
    return docs.select(key, F.explode(F.array(made)).alias("r")).select(key, "r.*")
