"""The common-word histogram: junk made of letters and texts in a wrong language go, prose stays."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from lodestone.llm import quality

from .rows import frame

WORDS = {k: [("".join(random.Random(f"{k}{i}").choice("abcdefghilmnoprstu") for _ in range(5))) for i in range(400)] for k in quality.COMMON_WORDS}


def prose(r, lang, n, common=0.18):
    """n words, some of them the language's common words by falling frequency, in lines of 12."""
    usual = quality.COMMON_WORDS[lang]
    ws = [r.choices(usual, [1 / (k + 1) for k in range(len(usual))])[0] if r.random() < common else r.choice(WORDS[lang]) for _ in range(n)]
    return "\n".join(" ".join(ws[i : i + 12]) for i in range(0, n, 12))


@pytest.fixture(scope="module")
def kept(spark):
    r = random.Random(4)
    clean, junk = {}, {}
    for lang in quality.COMMON_WORDS:
        for n in (100, 130, 200, 400, 1500):
            for _ in range(20):
                clean[len(clean)] = (prose(r, lang, n), lang)
    for n in (100, 150, 400, 2000):
        for lang in (*quality.COMMON_WORDS, None, "xx"):
            junk[10_000 + len(junk)] = (prose(r, "en", n, 0.0), lang)  # words without any common one
        for lang, other in (("en", "de"), ("de", "en"), ("en", "fr"), ("fr", "de"), ("es", "de"), ("de", "es"), ("en", "es"), ("fr", "en")):
            junk[10_000 + len(junk)] = (prose(r, other, n), lang)
    for lang, other in (("fr", "es"), ("es", "fr")):
        junk[10_000 + len(junk)] = (prose(r, other, 600), lang)
    for k in range(20):
        clean[5000 + k] = (prose(r, ("en", "fr", "de", "es")[k % 4], 150), (None, "xx")[k % 2])
    data = [(i, t, lang, "s", 1) for i, (t, lang) in (clean | junk).items()]
    return {x.doc_id: x for x in quality.judge(frame(spark, data)).collect()}


def test_junk_of_letters_and_wrong_languages_go(kept):
    assert [i for i, x in kept.items() if i >= 10_000 and (x.kept or x.base_failed)] == []


def test_clean_rows_stay(kept):
    clean = [x for i, x in kept.items() if i < 10_000]
    assert sum(x.kept for x in clean) >= 0.99 * len(clean)


def test_limit_is_the_distance_without_common_words(spark):
    q = [0.1, 0.08, 0.82]
    lits = lambda x: quality.F.array(*map(quality.F.lit, x))
    got = spark.range(1).select(quality._js_distance(lits([0.0, 0.0, 1.0]), lits(q))).first()[0]
    assert abs(got - quality._without_common(q)) < 1e-9


def brute_judge(data):
    """kept and both distances of every row, from the definition."""
    space, word = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+")
    rows = []
    for i, t, lang, *_ in data:
        t = t or ""
        ws = word.findall(t)
        at = defaultdict(list)
        for k in range(len(ws) - 7):
            at[tuple(ws[k : k + 8])].append(k)
        again = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(8)}
        letters = sum(c.isalpha() for c in t)
        upper = sum(unicodedata.category(c) == "Lu" for c in t)
        blank, digit, symbol = len("".join(space.findall(t))), sum(unicodedata.category(c)[0] == "N" for c in t), sum(c in "#*$%&|<>" for c in t)
        classes = [blank, upper, letters - upper, digit, symbol, len(t) - blank - letters - digit - symbol]
        low = Counter(word.findall(t.lower()))
        rows.append((i, lang if lang in quality.COMMON_WORDS else "*", len(t), len(ws), classes, low, len(ws) < 20 or 100 * len(again) > 30 * len(ws)))
    fit = [r for r in rows if not r[6]]
    refs = {}
    for ref in {r[1] for r in fit} | {"*"}:
        of = [r for r in fit if ref in (r[1], "*")]
        usual = quality.COMMON_WORDS.get(ref, quality.ALL_COMMON)
        n = sum(r[3] for r in of)
        # a listed language's share of pooled words is that of its own list
        said = [sum(r[5][w] for r in of if ref != "*" or w in quality.COMMON_WORDS.get(r[1], quality.ALL_COMMON)) / n for w in usual]
        chars = [sum(r[4][k] for r in of) for k in range(6)]
        said = [sum(said)] if ref == "*" else said
        refs[ref] = ([c / sum(chars) for c in chars], [*said, 1 - sum(said)])

    def js(p, q):
        kl = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x > 0)
        return math.sqrt(max(0.0, (kl(p, q) + kl(q, p)) / 2))

    made = {}
    for i, ref, chars, n, classes, low, failed in rows:
        ref = ref if ref in refs else "*"
        said = [low[w] / max(n, 1) for w in quality.COMMON_WORDS.get(ref, quality.ALL_COMMON)]
        said = [sum(said)] if ref == "*" else said
        made[i] = (ref, chars, n, js([c / max(chars, 1) for c in classes], refs[ref][0]), js([*said, min(n, 1) - sum(said)], refs[ref][1]), failed)
    kept = {}
    for i, (ref, chars, n, c, w, failed) in made.items():
        like = [x for x in made.values() if x[0] == ref and not x[5]]

        def limit(k, low, high, like=like, root=1.0):
            v = sorted(x[k] * (math.sqrt(max(x[2], 1)) if k == 4 else 1) for x in like)
            if not v:
                return high
            q1, q3 = (v[math.ceil(p * len(v)) - 1] for p in (0.25, 0.75))
            return max(low, min(high, (q3 + quality.FENCE * (q3 - q1)) / root))

        none = quality._without_common(refs[ref][1])
        far = (chars >= quality.GUARD_CHARS and c > limit(3, *quality.CLASS_BOUNDS)) or (n >= quality.GUARD_WORDS and w > limit(4, *(none * b for b in quality.WORD_BOUNDS), root=math.sqrt(n)))
        kept[i] = (not failed and not far, c, w)
    return kept


def test_verdicts_against_brute_force(spark):
    r = random.Random(11)
    data = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate((prose(r, k, r.randint(5, 700)), k) for k in quality.COMMON_WORDS for _ in range(25))]
    data += [(200 + i, prose(r, "en", 120 + i, 0.0), "en", "s", 1) for i in range(6)]
    data += [(300 + i, " ".join(r.choice("#$%|<>") * 3 + "ab" for _ in range(150)), "en", "s", 1) for i in range(4)]
    data += [(400 + i, prose(r, "fr", 200), (None, "xx")[i % 2], "s", 1) for i in range(12)]
    data += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, "the same words again and again here now " * 9, "en", "s", 1), (503, "x" * 70_000, "de", "s", 1)]
    got, want = {x.doc_id: x for x in quality.judge(frame(spark, data)).collect()}, brute_judge(data)
    assert got.keys() == want.keys()
    for i, (kept, c, w) in want.items():
        assert (got[i].kept, round(got[i].class_distance, 9), round(got[i].word_distance, 9)) == (kept, round(c, 9), round(w, 9)), i
    assert not any(got[i].kept for i in [*range(200, 206), *range(300, 304), 500, 501, 502, 503])


def test_no_document_passes_the_rules(spark):
    data = [(1, "too short", "en", "s", 1), (2, None, None, None, None)]
    assert [(x.kept, x.class_distance) for x in quality.judge(frame(spark, data)).collect()] == [(False, 0.0)] * 2
