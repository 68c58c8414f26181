"""Quality gates over chunks and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

MIN_PRINTABLE, MIN_WORDS, MIN_DENSITY, MIN_QUALITY, MIN_ACADEMIC = 0.85, 25, 0.60, 0.70, 2


def chunk_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds word_count, printable, density, academic, quality (4 places) and reason ('' where the chunk passes)."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    ws = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    out = df.withColumn("_t", t).withColumn("_w", ws)
    out = out.withColumns({
        "word_count": F.size("_w"),
        "printable": T.printable_ratio(F.col("_t")),
        "density": F.size(F.filter("_w", lambda w: w.rlike(r"^[\p{L}][\p{L}'-]*[\p{P}]?$"))) / F.greatest(F.size("_w"), F.lit(1)),
        "academic": T.substring_hits(F.col("_t"), T.CHUNK_VOCABULARY),
    })
    raw = F.lit(0.40) * F.col("printable") + F.lit(0.35) * F.col("density") + F.lit(0.25) * F.least(F.lit(1.0), F.col("academic") / 10)
    bonus = F.when(F.col("word_count").between(50, 400), F.lit(0.05)).otherwise(F.lit(0.0))
    out = out.withColumn("quality", F.round(F.least(F.lit(1.0), raw + bonus), 4))
    reason = (
        F.when(F.col("_t") == "", "EMPTY")
        .when(reduce(lambda a, b: a | b, [F.col("_t").rlike(p) for p in T.CORRUPTION]), "CORRUPTION")
        .when(F.col("printable") < MIN_PRINTABLE, "LOW_PRINTABLE")
        .when(F.col("word_count") < MIN_WORDS, "TOO_SHORT")
        .when(F.col("density") < MIN_DENSITY, "LOW_WORD_DENSITY")
        .when(F.col("academic") < MIN_ACADEMIC, "LOW_ACADEMIC")
        .when(F.col("quality") < MIN_QUALITY, "LOW_QUALITY")
        .otherwise("")
    )
    return out.withColumn("reason", reason).drop("_t", "_w")


def academic_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the sub-scores and the overall academic score, each to 4 places."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({
        "language": T.language_score(t), "formula": T.formula_score(t), "tabular": T.table_score(t), "diagram": T.diagram_score(t), "noise": T.noise_score(t), "ocr": T.printable_ratio(t),
    })
    # a text of under 20 characters is noise and nothing else
    enough = F.length(F.regexp_replace(t, r"^[\s\x0b]+|[\s\x0b]+$", "")) >= 20
    out = out.withColumns({c: F.when(enough, F.col(c)).otherwise(F.lit(1.0 if c == "noise" else 0.0)) for c in ("language", "formula", "tabular", "diagram", "noise", "ocr")})
    overall = F.least(F.lit(1.0), F.col("language") * 0.4 + F.col("ocr") * 0.3 + F.col("formula") * 0.2 + F.col("diagram") * 0.1)
    out = out.withColumn("overall", overall).withColumn("valid", (F.col("ocr") >= 0.70) & (F.col("noise") <= 0.40) & enough)
    return out.withColumns({c: F.round(c, 4) for c in ("language", "formula", "tabular", "diagram", "noise", "ocr", "overall")})

#: Thresholds tried in turn, and the reasons that no threshold lifts.
STEPS = (0.70, 0.55, 0.40)
HARD = ("EMPTY", "CORRUPTION", "LOW_PRINTABLE", "TOO_SHORT", "LOW_WORD_DENSITY")


def adaptive_threshold(scored: DataFrame, key: str) -> DataFrame:
    """key, threshold, accepted, chunks, pass_rate: the first threshold that any chunk of a document passes holds for all.

    scored is what chunk_quality gives; a document of which no chunk passes has the last threshold and 0 accepted.
    """
    fit = ~F.col("reason").isin(*HARD) & (F.col("academic") >= 1)
    made = scored.groupBy(key).agg(*[F.count_if(fit & (F.col("quality") >= s)).alias(f"_{i}") for i, s in enumerate(STEPS)], F.count("*").alias("chunks"))
    threshold = F.when(F.col("_0") > 0, STEPS[0]).when(F.col("_1") > 0, STEPS[1]).otherwise(STEPS[2])
    accepted = F.when(F.col("_0") > 0, F.col("_0")).when(F.col("_1") > 0, F.col("_1")).otherwise(F.col("_2"))
    return made.select(key, threshold.alias("threshold"), accepted.alias("accepted"), "chunks", F.round(accepted / F.col("chunks"), 4).alias("pass_rate"))
