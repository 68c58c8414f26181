"""Gates over questions and concepts: grammar, completeness, kind, marks and grounding. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, weights and patterns that the gates are defined by.
INFORMAL = ("wanna", "gonna", "gotta", "like", "okay", "hey", "hello", "please")
INTRO = (r"^here is", r"^sure", r"^i have generated", r"^the question is", r"^draft", r"^question [0-9]+:", r"^q[0-9]+:")
DANGLING = (
    r"(?i)(?:^|[^\p{L}\p{N}_])(the|a|an|of|in|to|for|with|on|at|by|from|and|or|is|are|was|were)\s*$",
    r"[,;:]\s*$",
    r"\(\s*$",
    r"\.\.\.\s*$",
)
COMMANDS = (
    "explain describe analyze analyse evaluate apply demonstrate list identify design state define compute calculate discuss "
    "illustrate compare contrast with using given for show what why how when where which who"
).split()
PREAMBLES = ("with", "using", "given", "for", "consider", "in", "suppose", "assuming")
KINDS = {
    "mcq": r"(?i)\([a-d]\)|\\\([a-d]\\\)|(^|[^\p{L}\p{N}_])[a-d]\)|\\b[a-d]\\\)|[a-d]\.|choose the correct|select the|which of the following|pick the correct",
    "numerical": r"(?i)calculate|compute|find the value|solve|determine the|evaluate the expression|how many|how much",
    "short": r"(?i)short note|brief|in one line|define|state|list|name|write short|mention",
    "long": r"(?i)explain in detail|discuss at length|elaborate|describe with|write in detail|detailed explanation|explain with examples|discuss various",
}
CONCEPTS = {
    "numerical": r"[=<>≤≥±∑∫√^]|\\frac|\\sum|equation\s*[0-9]|formula",
    "diagram": r"figure|diagram|graph|block diagram|circuit|flowchart|table",
    "derivation": r"derive|proof|theorem|lemma|derivation|obtain|deduce",
    "algorithmic": r"algorithm|steps|procedure|pseudocode|complexity|o\(|theta\(",
}
WEIGHTS = {"L1": 1.0, "L2": 1.5, "L3": 2.0, "L4": 2.5, "L5": 3.0, "L6": 3.5}
MARK_RANGES = {"L1": (1, 3), "L2": (4, 6), "L3": (5, 8), "L4": (6, 10), "L5": (7, 12), "L6": (8, 12)}
FACTORS = (
    (0.35, ("prove", "proof", "derivation", "derive")),
    (0.25, ("draw", "diagram", "illustrate", "sketch", "figure")),
    (0.20, ("compare", "contrast", "differentiate", "distinguish")),
)
UNGROUNDED = (
    "with from that this have been will marks discuss explain describe state illustrate analyse evaluate design given figure reference "
    "vehicle technician student scenario case study diagnostic sequence justify identify probable cause suggest"
).split()
LENIENT = ("compiler", "circular queue", "hospital", "bst", "stack", "queue")
WORKED = r"calculate|solve|compute|apply|demonstrate|illustrate|using fresh"


def bare(text: Column) -> Column:
    """The text without white space at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\x0b]+|[\s\x0b]+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\s\x0b]+"), F.lit(0))


def any_of(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def grammar_gate(text: Column) -> Column:
    """A score from 1 down: length, end mark, markdown, preamble and capital cost fixed shares; 0.70 passes."""
    t, n = F.coalesce(text, F.lit("")), F.size(words(text))
    costs = [
        (n < 6, 0.40),
        (n > 120, 0.20),
        (~bare(text).rlike(r"[?.]$"), 0.15),
        (F.contains(t, F.lit("**")) | F.contains(t, F.lit("__")), 0.20),
        (t.rlike(r"(?i)^(here is|question:|answer:)"), 0.30),
        ((t != "") & ~t.rlike(r"^\p{Lu}"), 0.10),
    ]
    return reduce(lambda s, c: s - F.when(c[0], F.lit(c[1])).otherwise(F.lit(0.0)), costs, F.lit(1.0))


def grammar_issues(text: Column) -> Column:
    """Names of the rules that a question breaks, one entry each time; only empty_text where there is no text."""
    t, n = bare(text), F.size(words(text))
    slang = F.filter(F.transform(words(text), lambda w: F.regexp_replace(F.lower(w), r"[,.?:!\"']+$", "")), lambda w: w.isin(*INFORMAL))
    named = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    found = F.concat(
        named(~t.rlike(r"^\p{Lu}"), "capitalization"),
        named(~t.rlike(r"[.?!]$"), "punctuation"),
        F.transform(slang, lambda w: F.lit("slang_detected")),
        *[named(F.lower(t).rlike(p), "conversational_intro") for p in INTRO],
        named(n < 4, "too_short"),
        named(n > 60, "too_long"),
    )
    return F.when(t == "", F.array(F.lit("empty_text"))).otherwise(found)


def question_kind(text: Column) -> Column:
    """mcq, numerical, short or long by the first kind with a mark; else short under 10 words, long over 30, or descriptive."""
    t, n, chain = F.coalesce(text, F.lit("")), F.size(words(text)), None
    for kind, pattern in KINDS.items():
        chain = F.when(t.rlike(pattern), kind) if chain is None else chain.when(t.rlike(pattern), kind)
    return chain.when(n < 10, "short").when(n > 30, "long").otherwise("descriptive")


def concept_kind(text: Column) -> Column:
    low, chain = F.lower(F.coalesce(text, F.lit(""))), None
    for kind, pattern in CONCEPTS.items():
        chain = F.when(low.rlike(pattern), kind) if chain is None else chain.when(low.rlike(pattern), kind)
    return chain.otherwise("theoretical")


def suggested_levels(text: Column, kind: Column) -> Column:
    low, some = F.lower(F.coalesce(text, F.lit(""))), lambda *x: F.array(*[F.lit(v) for v in x])
    return (
        F.when(kind == "numerical", some("L3", "L4"))
        .when(kind == "diagram", some("L2", "L3"))
        .when(kind == "derivation", some("L4", "L5"))
        .when(any_of(low, ("define", "definition")), some("L1", "L2"))
        .when(any_of(low, ("compare", "difference")), some("L4"))
        .when(any_of(low, ("design", "propose")), some("L6"))
        .otherwise(some("L2", "L3"))
    )


def optimal_marks(text: Column, level: Column) -> Column:
    """Marks by level, length and what is asked for; halves go to the even number, then the level's range holds."""
    low, n = F.lower(F.coalesce(text, F.lit(""))), F.size(words(text))
    factor = F.when(n < 15, F.lit(0.85)).when(n < 30, F.lit(1.0)).otherwise(F.lit(1.2))
    asks = reduce(lambda s, f: s + F.when(any_of(low, f[1]), F.lit(f[0])).otherwise(F.lit(0.0)), FACTORS, F.lit(1.0))
    pick = lambda of, default: reduce(lambda c, k: F.when(level == k, F.lit(of[k])).otherwise(c), WEIGHTS, F.lit(default))
    made = F.bround(pick(WEIGHTS, 2.0) * factor * asks * F.lit(2.2))
    low_end, high_end = pick({k: a for k, (a, _) in MARK_RANGES.items()}, 2), pick({k: b for k, (_, b) in MARK_RANGES.items()}, 10)
    return F.greatest(low_end, F.least(high_end, made.cast("int")))


def balanced(text: Column) -> Column:
    """Brackets close in order and double quotes are even. Folds over the brackets alone, with the open ones as state."""
    t = F.coalesce(text, F.lit(""))
    marks = F.filter(F.split(F.regexp_replace(t, r"[^()\[\]{}]", ""), ""), lambda c: c != "")

    def step(state: Column, c: Column) -> Column:
        opener = F.translate(c, ")]}", "([{")
        return (
            F.when(state == "!", state)
            .when(c.isin("(", "[", "{"), F.concat(state, c))
            .when((state != "") & (F.right(state, F.lit(1)) == opener), F.left(state, F.length(state) - 1))
            .otherwise(F.lit("!"))
        )

    return (F.aggregate(marks, F.lit(""), step) == "") & (F.length(F.regexp_replace(t, r'[^"]', "")) % 2 == 0)


def completeness(text: Column) -> Column:
    """complete, or the first thing that is wrong: empty, short, dangling, unbalanced, punctuation, structure."""
    t, ws = bare(text), words(text)
    first = F.regexp_replace(F.lower(F.get(ws, F.lit(0))), r"^[.,;:()]+|[.,;:()]+$", "")
    opens = first.isin(*COMMANDS) | reduce(lambda a, b: a | b, [F.startswith(F.lower(t), F.lit(p)) for p in PREAMBLES])
    return (
        F.when(t == "", "empty")
        .when(F.size(ws) < 5, "short")
        .when(reduce(lambda a, b: a | b, [t.rlike(p) for p in DANGLING]), "dangling")
        .when(~balanced(t), "unbalanced")
        .when(~t.rlike(r"[.?!]$"), "punctuation")
        .when(~opens, "structure")
        .otherwise("complete")
    )


def grounding(question: Column, evidence: Column) -> Column:
    """struct(coverage, passed): the share of a question's terms that the evidence holds, less for numbers it lacks.

    Without evidence the gate passes at 0.70, without terms at 0.75.
    """
    q, low = F.coalesce(question, F.lit("")), F.lower(F.coalesce(question, F.lit("")))
    known = F.lower(F.concat(F.coalesce(evidence, F.lit("")), F.lit(" ")))
    terms = F.filter(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike(r"^[a-z]{4,}$") & ~w.isin(*UNGROUNDED))
    share = F.size(F.filter(terms, lambda w: F.contains(known, w))) / F.greatest(F.size(terms), F.lit(1))
    number = F.lit(r"\b[0-9]+(?:\.[0-9]+)?\b")
    invented = F.size(F.array_except(F.array_except(F.regexp_extract_all(q, number, F.lit(0)), F.regexp_extract_all(q, F.lit(r"(?i)([0-9]+)\s*marks?"), F.lit(1))), F.regexp_extract_all(known, number, F.lit(0))))
    coverage = (
        F.when((invented == 0) | low.rlike(WORKED), share)
        .when(invented >= 2, F.least(share, F.lit(0.45)))
        .otherwise(F.least(share, F.greatest(F.lit(0.40), share - 0.15)))
    )
    bar = F.when(any_of(low, LENIENT), F.lit(0.25)).when(F.size(words(known)) < 80, F.lit(0.30)).otherwise(F.lit(0.35))
    gate = lambda score, passed: F.struct(score.alias("coverage"), passed.alias("passed"))
    return (
        F.when(F.coalesce(evidence, F.lit("")) == "", gate(F.lit(0.70), F.lit(True)))
        .when(F.size(terms) == 0, gate(F.lit(0.75), F.lit(True)))
        .otherwise(gate(coverage, coverage >= bar))
    )


# The parts of an answer and the words that show them.
COMPONENTS = {
    "definition": ("is defined", "is a", "refers to"),
    "explanation": ("explanation", "works by", "operates"),
    "algorithm": ("algorithm", "steps", "procedure"),
    "diagram": ("diagram", "figure", "draw"),
    "applications": ("application", "used in", "example"),
}


def answer_components(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.when(any_of(low, v), k) for k, v in COMPONENTS.items()]), lambda c: c.isNotNull())


def position_difficulty(index: Column, total: Column, easy: float = 0.25, medium: float = 0.50) -> Column:
    """easy, medium or hard by a part's place (from 0) among all parts."""
    ratio = index / F.greatest(total - 1, F.lit(1))
    return F.when(ratio <= easy, "easy").when(ratio <= easy + medium, "medium").otherwise("hard")
