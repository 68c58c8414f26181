"""Column functions for cleaning, tokenising and scoring text. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies and patterns that the scores are defined by.
CHUNK_VOCABULARY = (
    "define explain describe analyze apply evaluate design implement derive prove state list compare illustrate calculate solve "
    "determine find compute theorem principle concept algorithm system method process function equation formula proof module "
    "chapter unit example solution problem given note remark definition property lemma circuit signal network frequency voltage "
    "current resistance capacitance inductance impedance power efficiency temperature pressure velocity force stress strain matrix "
    "vector integral derivative probability distribution entropy complexity traversal node edge graph tree stack queue array sort "
    "search heuristic optimization convergence stability transfer transform modulation bandwidth gain satellite orbit antenna "
    "transponder link propagation"
).split()
ACADEMIC_TERMS = (
    "definition theorem equation formula proof derive calculate algorithm system architecture analysis module component principle "
    "property function variable parameter output input frequency signal voltage current matrix vector state diagram"
).split()
CLUTTER = (
    r"(?i)isbn[:\s]*[0-9\-]{10,17}", r"(?i)copyright\s+©?\s*\d{4}", r"(?i)all\s+rights\s+reserved", r"(?i)page\s+\d+\s+of\s+\d+",
    r"(?i)downloaded\s+from", r"(?i)watermark", r"(?i)www\.[a-z0-9\-]+\.[a-z]{2,}", r"(?i)table\s+of\s+contents", r"(?i)\[\s*ad\s*\]|advertisement",
)
CORRUPTION = (
    r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]",
    r"(?:[^\x00-\x7f]{3,}\s*){3,}",
    r"\$[A-Za-z0-9+/]{8,}={0,2}",
    r"(?:obj\s+[0-9]+\s+[0-9]+|stream|endstream|xref)",
    r"\\u[0-9a-fA-F]{4}(?:\\u[0-9a-fA-F]{4}){3,}",
)
VERBS = {
    "L1": ("define", "list", "name", "state"),
    "L2": ("explain", "describe", "discuss", "summarize"),
    "L3": ("apply", "solve", "calculate", "demonstrate"),
    "L4": ("analyze", "examine", "break down", "differentiate"),
    "L5": ("evaluate", "judge", "critique", "argue"),
    "L6": ("design", "create", "propose", "derive"),
}
#: Levels by name, the highest first, with what each shows in a question, and what each counts for its difficulty.
NAMED_LEVELS = {
    "create": "design, create, develop, propose, formulate, construct, plan, devise, invent, compose, write a program, build, derive",
    "evaluate": "evaluate, justify, assess, argue, critique, judge, defend, support, validate, recommend, which is better, pros and cons",
    "analyze": "analyze, examine, investigate, break down, categorize, compare and contrast, differentiate, distinguish between, relate, why, how does, what causes",
    "apply": "apply, solve, calculate, compute, determine, demonstrate, use, implement, execute, find, show that, construct, draw, sketch, plot",
    "understand": "explain, describe, discuss, summarize, interpret, classify, compare, contrast, distinguish, illustrate, paraphrase, differentiate, elaborate",
    "remember": "define, list, state, name, identify, recall, recognize, label, match, select, what is, who, when, where, enumerate, mention, write",
}
NAMED_LEVELS = {k: tuple(v.split(", ")) for k, v in NAMED_LEVELS.items()}
LEVEL_COST = {"remember": 1, "understand": 2, "apply": 3, "analyze": 4, "evaluate": 5, "create": 5}
#: Marks of a question, tried in this order; numbers from 1 to 20 count.
MARKS = (
    r"(?i)\[([0-9]+)\]",
    r"(?i)\(([0-9]+)\s*(?:marks?|pts?|points?)\)",
    r"(?i)([0-9]+)\s*(?:marks?|pts?|points?)",
    r"(?i)\[([0-9]+)\s*m\]",
    r"(?i)([0-9]+)\s*m\b",
)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def tokens(text: Column, longer_than: int = 0) -> Column:
    """Lower-case letter and digit runs."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > longer_than)


def strip_tags(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return squeeze(bare)


def substring_hits(text: Column, vocabulary: list[str]) -> Column:
    """How many words of a vocabulary occur anywhere in a text."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in dict.fromkeys(vocabulary)])


def printable_ratio(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}\p{P}\p{Z}]")) / F.greatest(F.length(text), F.lit(1))


def language_score(text: Column) -> Column:
    ws = F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]{2,}\b"), F.lit(0))
    hits = F.size(F.filter(ws, lambda w: w.isin(ACADEMIC_TERMS)))
    return F.when(F.size(ws) == 0, 0.0).otherwise(F.least(F.lit(1.0), hits / F.size(ws) * 15.0))


def formula_score(text: Column) -> Column:
    symbols = F.regexp_count(text, F.lit(r"[=+\-*/^√∫∑∏α-ωΑ-Ω∈∉⊂⊃⊆⊇]"))
    latex = F.regexp_count(text, F.lit(r"\\(frac|sum|int|sqrt|alpha|beta|theta|partial)"))
    numbers = F.regexp_count(text, F.lit(r"\b[0-9]+(\.[0-9]+)?\b"))
    return F.least(F.lit(1.0), (symbols * 2 + latex * 4 + numbers * F.lit(0.5)) / (F.length(text) / 100.0 + 1))


def table_score(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    tabular = F.filter(lines, lambda x: x.rlike(r"\||\t|\s{3,}"))
    return F.when(F.size(lines) == 0, 0.0).otherwise(F.size(tabular) / F.size(lines))


def diagram_score(text: Column) -> Column:
    return F.least(F.lit(1.0), F.regexp_count(text, F.lit(r"(?i)\b(fig|figure|block diagram|circuit|schematic|architecture)\b")) * F.lit(0.33))


def noise_score(text: Column) -> Column:
    hits = reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in CLUTTER])
    control = F.regexp_count(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))
    return F.when(text == "", 1.0).otherwise(F.least(F.lit(1.0), hits * F.lit(0.2) + control / F.greatest(F.length(text), F.lit(1))))


def bloom_ascending(text: Column) -> Column:
    """The first level, from L1 up, of which a verb occurs anywhere; L2 if none does."""
    return _bloom(text, VERBS, "L2")


def bloom_descending(text: Column) -> Column:
    """The first level by name, from create down, of which a sign occurs anywhere; understand if none does."""
    return _bloom(text, NAMED_LEVELS, "understand")


def _bloom(text: Column, levels: dict[str, tuple[str, ...]], default: str) -> Column:
    low, chain = F.lower(F.coalesce(text, F.lit(""))), None
    for level, signs in levels.items():
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(v)) for v in signs])
        chain = F.when(hit, level) if chain is None else chain.when(hit, level)
    return chain.otherwise(default)


def marks(text: Column) -> Column:
    """The first number from 1 to 20 that a text names as marks, by patterns in order; each pattern's first match counts."""
    found = []
    for p in MARKS:
        n = F.regexp_extract(text, p, 1)
        value = F.when((n != "") & (F.length(n) <= 9), n.cast("int"))
        found.append(F.when((value >= 1) & (value <= 20), value))
    return F.coalesce(*found)


def difficulty(level: Column, value: Column) -> Column:
    """easy, medium or hard by a level's name and the marks (null: none)."""
    cost = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVEL_COST.items() for x in kv]), level), F.lit(2))
    score = cost + (F.coalesce(value, F.lit(0)) > 8).cast("int") + (F.coalesce(value, F.lit(0)) > 12).cast("int")
    return F.when(score <= 2, "easy").when(score <= 4, "medium").otherwise("hard")
