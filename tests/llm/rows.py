"""Small tables with the awkward rows: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WIDE = SCHEMA + ", _row string, size long, h string, n_words string, kept string, _fp string, _id string, base string"


def rows(n=60, seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7))) for _ in range(120)] + ["Éa", "ñu", "the", "of"]
    made = []
    for i in range(n):
        lines = [" ".join(r.choice(vocab) for _ in range(r.randint(3, 14))) for _ in range(r.randint(1, 9))]
        made.append([i, "\n".join(lines), r.choice(["en", "fr", None]), r.choice(["s1", "s2", None]), 1])
    for i in range(n // 4):  # exact and near copies
        j = r.randrange(n)
        text = made[j][1]
        if i % 2:
            ws = text.split(" ")
            ws[r.randrange(len(ws))] = "changed"
            text = " ".join(ws)
        made.append([n + i, text, "en", "s1", 1])
    made += [[1000, None, None, None, None], [1001, "", "en", "s2", 0], [1002, " \n\t ", "en", "s2", 4], [None, "alone without id", "en", "s1", 1]]
    made.append([1003, "\n".join(["same old line here"] * 7), "en", "s1", 1])
    made.append([1004, "x" * 70_000, "en", "s1", 1])
    made.append([1005, " ".join(r.choice(vocab) for _ in range(9000)), "en", "s2", 1])
    made.append(list(made[3]))  # a repeated row
    return [tuple(m) for m in made]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def wide(spark):
    return spark.createDataFrame([(*m, "r", 1, "h", "w", "k", "f", "i", "b") for m in rows()], WIDE)
