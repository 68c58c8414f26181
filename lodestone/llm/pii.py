"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

The base patterns' matches are the seeds; long hexadecimal strings are seeds of a kind of their own, secret. The word
before a seed, and the two words before it, are lexical patterns. Runs of the loose shape of an identifier (with inner
spaces, after a label such as `tel:`) that no base pattern takes are candidates under the same patterns.

Spark scores the graph of patterns and instances in rounds. A pattern's confidence is the summed score of what it
precedes (seeds 1, candidates what they have so far) over the number of times that the corpus has the pattern at all,
plus one: everyday words score nothing, however many identifiers happen to follow them. A candidate's score is that
of its best pattern. Candidates past `min_confidence` count as seeds in the next round, so that a pattern which only
they show may qualify too. Patterns of enough distinct seeds and confidence add the spans that they precede; secrets
are told in this way only.

The texts are read twice: for seeds and candidates, and for the frequencies of the patterns that enough distinct
instances share. A bitmap of fixed size picks these out; a join takes out its false hits. What lies between are
(pattern, instance) pairs, summed before any join.

Defined results: a null or empty text has no spans; the start of a text is the word `<s>`; an identifier that follows
another with nothing but punctuation between is under the other's patterns; texts and words of any length are read
whole, in linear time (a word of over 64 characters stands in a pattern by its hash); nothing is ranked, so ties need
no order; rows equal in doc_id and text get equal results, each a row; an empty table gives none; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, staged

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE = 5, 3, 0.7
#: Bits of the map of patterns to be counted (2 MB), and of a row of it.
BITS, ROW_BITS = 1 << 24, 1 << 15

# The base patterns. Quantifiers that can't give back are possessive, so digits cost linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Loose shapes of candidates.
_MAIL_SIGN = re.compile(r"@|\[at\]|\(at\)", re.I)
_LOOSE_MAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]++\x20?(?:@|\[at\]|\(at\))\x20?[\w-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[\w-]++)*+", re.I)
_LOOSE_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+=*+")
_LOOSE_IP = re.compile(r"(?<![0-9A-Za-z.:])[0-9A-Fa-f]++(?:[.:][0-9A-Fa-f]++){3,7}+(?![0-9A-Za-z])")
_LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?+\+?+[0-9]++(?:[\x20().+/-]{1,3}+[0-9]++)*+(?![0-9A-Za-z])")
_DIGIT = re.compile(r"[0-9]")
_HEX = re.compile(r"[0-9A-Fa-f]{32,64}")

_SPACE = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
_EDGE = ".,;:!?\"'()[]{}<>|"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BETWEEN = re.compile(r"[\x20\x09-\x0D.,;:!?\"'()\[\]{}<>|/-]*")
START, MET = "<s>", "<id>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.group().split(".") if len(p) < 4300) and all(len(p) < 4300 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return found


def _digits(x: str) -> int:
    return sum("0" <= c <= "9" for c in x)


def _plain(word: str) -> str:
    """A word as patterns have it: lower case, without punctuation at its ends unless it is nothing else."""
    w = word.lower()
    w = w.strip(_EDGE) or w
    return w if len(w) <= 64 else f"#{xxhash.xxh3_128_hexdigest(w.encode())}"


def _label(word: str) -> str:
    """The beginning of a word up to its first inner : or =, a label; empty if it has none."""
    cut = min((x for x in (word.find(":", 0, -1), word.find("=", 0, -1)) if x >= 0), default=-1)
    return word[: cut + 1].lower().lstrip(_EDGE) if 0 <= cut < 64 else ""


def _candidates(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, seed) of the loose shapes; they may overlap each other and base spans."""
    if _MAIL_SIGN.search(text):
        yield from (("email", m.start(), m.end(), False) for m in _LOOSE_MAIL.finditer(text))
    if not _DIGIT.search(text):
        return
    for m in _LOOSE_SECRET.finditer(text):
        if _digits(m.group()) >= 3 and sum(map(str.isalpha, m.group())) >= 3:
            yield SECRET, m.start(), m.end(), _HEX.fullmatch(m.group()) is not None
    for m in _LOOSE_IP.finditer(text):
        if _digits(m.group()) >= 4:
            yield "ip", m.start(), m.end(), False
    for m in _LOOSE_NUMBER.finditer(text):
        if 7 <= (n := _digits(m.group())) <= 19:
            yield "phone" if n <= 15 else "card", m.start(), m.end(), False


def _context(text: str, done: int, start: int) -> list[str]:
    """At most two words before start, nearest first, none from before done. What is glued to start counts if it is a label."""
    ws, at = [], start
    while len(ws) < 2 and at > done:
        stop = at
        while at > done and text[at - 1] not in _SPACE:
            at -= 1
        if at < stop:
            w = text[at:stop]
            if stop < start:
                ws.append(_plain(w))
            elif (label := _label(w + " ")) and w.rstrip("\"'([{<")[-1:] in (":", "="):
                ws.append(label)
        while at > done and text[at - 1] in _SPACE:
            at -= 1
    return ws


def scan(text: str) -> tuple[list, list]:
    """Base spans, and the occurrences of identifiers: (kind, start, end, one, two, instance, seed).

    one and two are the patterns of one and of two words. Base spans are told first where spans overlap.
    """
    base = base_spans(text)
    spans = [(s, e, k, True) for k, s, e in base]
    taken = sorted((s, e) for s, e, _, _ in spans)
    starts = [s for s, _ in taken]
    furthest = list(accumulate((e for _, e in taken), max))
    end = -1
    for s, e, k, seed in sorted((s, e, k, seed) for k, s, e, seed in _candidates(text)):
        n = bisect_left(starts, e)
        if s >= end and (n == 0 or furthest[n - 1] <= s):
            spans.append((s, e, k, seed))
            end = e
    made, done, one, two = [], 0, START, f"{START} {START}"
    for s, e, k, seed in sorted(spans):
        if s > done or not made:
            if not made or _BETWEEN.fullmatch(text, done, s) is None:
                ws = _context(text, done, s)
                edge = MET if made else START
                one = ws[0] if ws else edge
                two = f"{ws[1] if len(ws) > 1 else edge} {one}"
        instance = xxhash.xxh64_intdigest(text[s:e].lower().encode("utf-8", "replace"), 3) - (1 << 63)
        made.append((k, s, e, one, two, instance, seed))
        done = max(done, e)
    return base, made


class Wanted:
    """Which patterns the bitmap picks, with a memory of words met."""

    def __init__(self, bits: bytes):
        self.bits, self.words = bits, {}

    def __call__(self, pattern: str) -> bool:
        x = xxhash.xxh64_intdigest(pattern.encode("utf-8", "replace"), 42) % BITS
        return bool(self.bits[x >> 3] >> (x & 7) & 1)

    def word(self, raw: str) -> tuple[str, ...]:
        """The patterns of one word that a word shows and the bitmap picks: itself, and its label."""
        if raw not in self.words:
            if len(self.words) > 1 << 18:  # begun anew, so it stays bounded
                self.words.clear()
            shown = (_plain(raw), *((_label(raw),) if ":" in raw or "=" in raw else ()))
            self.words[raw] = tuple(w for w in shown if w and self(w))
        return self.words[raw]


def patterns_of(text: str, wanted: Wanted) -> Counter:
    """How often a text has each pattern that the bitmap picks. A pair can only be wanted where its second word is."""
    found, before, word = Counter(), START, wanted.word
    for raw in _WORD.findall(text):
        if ones := word(raw):
            for w in ones:
                found[w] += 1
                found[f"{before if before is START else _plain(before)} {w}"] += 1
        before = raw
    picked = Counter({p: n for p, n in found.items() if " " not in p or wanted(p)})
    picked.update(p for p in (START, f"{START} {START}") if wanted(p))
    return picked


def frequencies(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, freq: how often the texts of docs have each of patterns. One scan; a task passes on the patterns that the bitmap picks."""
    place = F.pmod(F.xxhash64("pattern"), F.lit(BITS)) + 1
    rows = patterns.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = bytearray(BITS // 8)
    for r in rows.collect():  # BITS / ROW_BITS rows at most
        at = (r["k"] - 1) * (ROW_BITS // 8)
        bits[at : at + ROW_BITS // 8] = r["bits"]
    bits = bytes(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = Wanted(bits)
        for b in batches:
            n: Counter = Counter()
            for t in b["text"]:
                n.update(patterns_of(t, wanted))
            yield pd.DataFrame({"pattern": pd.Series(list(n), dtype=str), "n": pd.Series(list(n.values()), dtype="int64")})

    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("freq"))
    return counted.join(patterns, "pattern", "left_semi")


def bootstrap(graph: DataFrame, freq: DataFrame, rounds: int, min_seeds: int, min_confidence: float) -> DataFrame:
    """kind, pattern, confidence of the patterns that qualify. graph: kind, pattern, instance, n (occurrences), seed, distinct."""
    edges = staged(graph.join(freq, "pattern"), "edges")
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    sure, known = None, -1
    for _ in range(rounds):
        confidence = F.least(F.lit(1.0), F.sum(F.col("n") * F.col("score")) / (F.max("freq") + 1))
        pattern = scored.groupBy("kind", "pattern").agg(confidence.alias("confidence"), F.count_if(F.col("score") >= min_confidence).alias("seeds"))
        sure = staged(pattern.where((F.col("seeds") >= min_seeds) & (F.col("confidence") > 0)), "patterns")
        best = edges.where("not seed").join(sure.select("kind", "pattern", "confidence"), ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max("confidence").alias("best"))
        scored = edges.join(best, ["kind", "instance"], "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0)))).drop("best")
        now = sure.where(F.col("confidence") >= min_confidence).count()
        if now == known:
            break
        known = now
    return sure.where(F.col("confidence") >= min_confidence).select("kind", "pattern", "confidence")


def find(docs: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id, base (array of kind, start, end) and added (the same, of spans that the patterns discover)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [scan(t or "") for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "_id": b["_id"], "_th": b["_th"],
                "base": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x, _ in made],
                "met": [[dict(zip(("kind", "start", "end", "one", "two", "instance", "seed"), e, strict=True)) for e in x] for _, x in made],
            })

    span = "array<struct<kind:string,start:long,end:long>>"
    met = "array<struct<kind:string,start:long,end:long,one:string,two:string,instance:long,seed:boolean>>"
    rows = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_id", "_th")
    rows = staged(rows.mapInPandas(run, f"doc_id long, _id long, _th long, base {span}, met {met}"), "spans")
    told = rows.select("_id", "_th", F.explode("met").alias("e")).select("_id", "_th", "e.*")
    # rows equal in doc_id and text count each: so do their words
    either = told.select("*", F.explode(F.array_distinct(F.array("one", "two"))).alias("pattern"))
    graph = staged(either.groupBy("kind", "pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "graph")
    shared = graph.groupBy("kind", "pattern").agg(F.count("*").alias("distinct")).where(F.col("distinct") >= min_seeds)
    wanted = staged(shared.select("pattern").distinct(), "wanted")
    sure = bootstrap(graph.join(wanted, "pattern", "left_semi"), frequencies(docs, wanted), rounds, min_seeds, min_confidence)
    unseen = either.where(~F.col("seed") | (F.col("kind") == SECRET))
    added = unseen.join(sure, ["kind", "pattern"]).groupBy("_id", "_th").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    return rows.join(added, ["_id", "_th"], "left").select("doc_id", "base", F.coalesce("added", F.array().cast(span)).alias("added"))


def joined(spans):
    """kind:start:end, comma-joined, by kind as listed in KINDS (secrets last), then start."""
    ranked = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(ranked), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
