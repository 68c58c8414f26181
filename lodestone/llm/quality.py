"""Quality rules: structural rules, and the Jensen-Shannon divergence from language references.

Only DataFrame functions are used. The texts are read once: a scan without a shuffle stages each document's counts
(and, for a caller who wants them, its row). What follows reads these counts. The references are a character-class and
a common-word histogram of each known language, summed over its documents that pass the structural rules. The limits
come from the same documents, by language: a distance is too large beyond the upper quartile plus FENCE times the
distance between the quartiles, within fixed bounds. The words' distance is taken times the square root of the number
of words for this, as that of a sample from its own source falls so.

Defined results: a null or empty text has no words and fails `n_words < 20`; a null or unlisted language is
compared with the pooled reference of all documents, in the words by the share of all languages' common words (its
language alone sets it apart from their pooled histogram); a document shorter than the length guards is not judged by
the histogram that its length can't support, nor is any where no document passes the structural rules; very long texts
are read whole; repeated rows and ties are judged alike, each row by itself; an empty table gives no rows; columns
beside doc_id, text and lang are ignored, or kept as they are with keep_rows, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, staged, words

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of each language that has a reference.
COMMON_WORDS = {
    "en": tuple("the of and to in a is that for it on with as was be by this are from at or an have not which but they his had we their has".split()),
    "fr": tuple("de la le et les des en un une du que pour est dans par qui sur au il plus ne pas avec ce son se sont aux ou elle mais comme".split()),
    "de": tuple("der die und in den von zu das mit ist des auf sich dem im nicht ein eine als auch es an werden aus er hat dass sie nach bei um noch".split()),
    "es": tuple("de la que el en y a los del las por con un una se para no es al lo como su o pero sus le ha me si sin sobre este".split()),
}
POOLED = "*"
ALL_COMMON = sorted({w for ws in COMMON_WORDS.values() for w in ws})
CLASSES = ("space", "upper", "lower", "digit", "symbol", "punct")

#: Length guards: a histogram of fewer characters or words says too little to reject a document.
GUARD_CHARS, GUARD_WORDS = 300, 64
#: The limit of a distance: upper quartile plus this many distances between the quartiles.
FENCE = 4.0
#: Bounds of the classes' limit (Jensen-Shannon distance, base 2, from 0 to 1).
CLASS_BOUNDS = (0.26, 0.34)
#: Bounds of the words' limit, in parts of the reference's distance from a text without any common word.
WORD_BOUNDS = (0.4, 0.92)


def _repeat_words(ws: Column) -> Column:
    """Words inside 8-word windows that the text has twice or more. Hashes find the few texts worth an exact look."""
    n = F.size(ws)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))

    def exact() -> Column:
        ordered = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(ws, i, WINDOW), " ").alias("w"), i.alias("p"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, i: F.get(s, i - 1)["w"].eqNullSafe(x["w"]) | F.get(s, i + 1)["w"].eqNullSafe(x["w"])))
        at = F.sort_array(F.transform(twice, lambda x: x["p"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    of_words = F.transform(ws, lambda w: F.xxhash64(w))
    of_windows = let(of_words, lambda h: F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(WINDOW)])))
    any_twice = let(of_windows, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(F.when(any_twice, exact()).otherwise(F.lit(0))).cast("long")


def _removed(text: Column, pattern: str) -> Column:
    """Characters of the runs that pattern matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _class_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """Characters by class. Letters go first, so the other patterns run over the little that is left."""
    text = F.col("text")
    left = docs.withColumn("_rest", F.regexp_replace(text, r"\p{L}+", "")).withColumn("_marks", F.regexp_replace("_rest", SPACE, ""))
    counts = left.select(
        *keep,
        F.length(text).cast("long").alias("n_all"),
        _removed(text, r"\p{Lu}+").alias("upper"),
        (F.length(text) - F.length("_rest")).cast("long").alias("_letters"),
        (F.length("_rest") - F.length("_marks")).cast("long").alias("space"),
        F.length("_marks").cast("long").alias("_n_marks"),
        _removed(F.col("_marks"), r"\p{N}+").alias("digit"),
        _removed(F.col("_marks"), f"{SYMBOLS}+").alias("symbol"),
    )
    return counts.withColumns({
        "lower": F.col("_letters") - F.col("upper"),
        "punct": F.col("_n_marks") - F.col("digit") - F.col("symbol"),
    })


def _common(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w.isin(ALL_COMMON))


def _ref() -> Column:
    return F.when(F.col("lang").isin(list(COMMON_WORDS)), F.col("lang")).otherwise(F.lit(POOLED)).alias("_ref")


def _hits(common: Column, ref: Column) -> Column:
    """How often each of the reference's words occurs, in its list's order."""
    ordered = F.sort_array(common)

    def counted(sorted_words: Column) -> Column:
        found = F.array_distinct(sorted_words)
        places = F.concat(F.transform(found, lambda w: F.array_position(sorted_words, w)), F.array(F.size(sorted_words).cast("long") + 1))
        return let(places, lambda p: F.map_from_arrays(found, F.transform(found, lambda w, i: (F.get(p, i + 1) - F.get(p, i)).cast("int"))))

    usual = reduce(lambda c, r: F.when(ref == r, F.array(*map(F.lit, COMMON_WORDS[r]))).otherwise(c), COMMON_WORDS, F.array(*map(F.lit, ALL_COMMON)))
    return let(let(ordered, counted), lambda m: F.transform(usual, lambda w: F.coalesce(F.try_element_at(m, w), F.lit(0))))


def profile(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """doc_id (or the whole row as _row), and the counts on which rules and histograms rest. One scan, no shuffle."""
    text = F.col("text")
    row = F.struct("*").alias("_row") if keep_rows else F.struct("doc_id").alias("_row")
    base = docs.select(row, _ref(), F.coalesce(text, F.lit("")).alias("text")).withColumn("_words", words(text))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    counted = base.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "_hits": _hits(_common(text), F.col("_ref")),
    })
    kept = ("_row", "_ref", "n_words", "n_dup_lines", "n_repeat_words", "_hits")
    counted = _class_counts(counted, *kept)
    return counted.select(
        *kept, "n_all", *CLASSES,
        (F.col("n_all") - F.col("space")).alias("word_chars"),
        F.col("symbol").alias("n_symbols"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def references(made: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Class and common-word shares of each listed language, and of all documents, from those that pass the rules.

    made: what profile gives. The driver gets one row a reference: their number is fixed by COMMON_WORDS.
    """
    longest = max(map(len, (ALL_COMMON, *COMMON_WORDS.values())))
    hits = [F.sum(F.get("_hits", F.lit(i))).alias(f"_h{i}") for i in range(longest)]
    rows = made.where("not base_failed").groupBy("_ref").agg(*[F.sum(n).alias(n) for n in (*CLASSES, "n_words")], *hits).collect()
    chars = {r["_ref"]: [r[c] or 0 for c in CLASSES] for r in rows}
    n_words = {r["_ref"]: r["n_words"] or 0 for r in rows}
    said = {r["_ref"]: dict(zip(COMMON_WORDS.get(r["_ref"], ALL_COMMON), (r[f"_h{i}"] or 0 for i in range(longest)), strict=False)) for r in rows}
    if not rows:
        return {}
    chars[POOLED] = [sum(v) for v in zip(*chars.values(), strict=True)]
    n_words[POOLED] = sum(n_words.values())
    said[POOLED] = {w: sum(s.get(w, 0) for s in said.values()) for w in ALL_COMMON}
    found = {}
    for ref, c in chars.items():
        mine = [said[ref].get(w, 0) for w in COMMON_WORDS.get(ref, ALL_COMMON)]
        n = max(n_words[ref], 1)
        shares = [sum(mine) / n] if ref == POOLED else [x / n for x in mine]
        found[ref] = ([x / max(sum(c), 1) for x in c], [*shares, max(1 - sum(shares), 0.0)])
    return found


def _js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, between two arrays of shares."""

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0)) + F.when(y > 0, y * F.log2(y / m)).otherwise(F.lit(0.0))

    total = F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def _without_common(q: list[float]) -> float:
    """Jensen-Shannon distance of a text without any common word from a reference of the word shares q."""
    c = 1 - q[-1]
    return math.sqrt(max(0.0, (math.log2(2 / (2 - c)) + c + ((1 - c) * math.log2(2 * (1 - c) / (2 - c)) if c < 1 else 0)) / 2))


def _distances(made: DataFrame, refs: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """made with class_distance, word_distance, _without (the distance of a text without a common word) and _root."""
    known = [r for r in refs if r != POOLED]
    share = lambda n, of: n / F.greatest(of, F.lit(1)).cast("double")
    by_ref = lambda make: reduce(lambda c, r: F.when(F.col("_ref") == r, make(r)).otherwise(c), known, make(POOLED))
    lits = lambda x: F.array(*map(F.lit, x))
    common = F.aggregate("_hits", F.lit(0), lambda a, x: a + x)
    # a language without a reference of its own is compared with the pooled one
    single = F.col("_ref").isin(known) & (F.col("_ref") != POOLED)
    hits = F.when(single, F.transform("_hits", lambda x: x)).otherwise(F.array(common))
    said = let(hits, lambda h: F.transform(F.concat(h, F.array((F.col("n_words") - common).cast("int"))), lambda x: share(x, F.col("n_words"))))
    return made.withColumns({
        "class_distance": _js_distance(F.array(*[share(F.col(c), F.col("n_all")) for c in CLASSES]), by_ref(lambda r: lits(refs[r][0]))),
        "word_distance": _js_distance(said, by_ref(lambda r: lits(refs[r][1]))),
        "_without": by_ref(lambda r: F.lit(_without_common(refs[r][1]))),
        "_root": F.sqrt(F.greatest(F.col("n_words"), F.lit(1))),
    })


def limits(far: DataFrame, fence: float = FENCE) -> DataFrame:
    """_ref, class_fence, word_fence (times the root of the words) from the documents that pass the rules: a row a reference."""
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.75], 10_000)
    q = far.where("not base_failed").groupBy("_ref").agg(quartiles("class_distance").alias("c"), quartiles(F.col("word_distance") * F.col("_root")).alias("w"))
    return q.select("_ref", *[(F.get(x, 1) + fence * (F.get(x, 1) - F.get(x, 0))).alias(n) for x, n in ((F.col("c"), "class_fence"), (F.col("w"), "word_fence"))])


def judge(docs: DataFrame, fence: float = FENCE, class_bounds: tuple[float, float] = CLASS_BOUNDS, word_bounds: tuple[float, float] = WORD_BOUNDS, guard_chars: int = GUARD_CHARS, guard_words: int = GUARD_WORDS, keep_rows: bool = False) -> DataFrame:
    """Rule counts, both distances to the document's language reference, and the verdict `kept`; doc_id, or the whole row as _row."""
    made = staged(profile(docs, keep_rows), "profile")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    first = F.col("_row") if keep_rows else F.col("_row.doc_id").alias("doc_id")
    refs = references(made)
    if not refs:
        none = F.lit(0.0)
        return made.select(first, *counts, (~F.col("base_failed")).alias("kept"), none.alias("class_distance"), none.alias("word_distance"))
    far = _distances(made, refs)
    # a row a reference: 5 at most
    judged = far.join(F.broadcast(limits(far, fence)), "_ref", "left")
    inside = lambda x, low, high: F.greatest(low, F.least(high, F.coalesce(x, high)))
    max_class = inside(F.col("class_fence"), F.lit(class_bounds[0]), F.lit(class_bounds[1]))
    max_words = inside(F.col("word_fence") / F.col("_root"), F.col("_without") * word_bounds[0], F.col("_without") * word_bounds[1])
    too_far = ((F.col("n_all") >= guard_chars) & (F.col("class_distance") > max_class)) | ((F.col("n_words") >= guard_words) & (F.col("word_distance") > max_words))
    return judged.select(first, *counts, (~F.col("base_failed") & ~too_far).alias("kept"), "class_distance", "word_distance")
