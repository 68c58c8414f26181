"""Conversations as training windows of a token budget, cut between turns, and their way back.

A turn is written `<|im_start|>role`, a line feed, its text, `<|im_end|>` and a line feed. Control strings inside a role or a text get
a backslash after their `<`, one more if they have some already, so they can be told from the template's own and taken back.

Prefix sums of the turns' tokens choose the windows: from a turn on, a binary search finds the last turn that fits the
budget. Every window retains the conversation's system turn and repeats the turns before it, as far as the history's
budget goes and leaves room for the first new turn. Only new assistant turns are targets: the loss mask is a list of
code point ranges, and repeated turns have none, so each target is met once. A turn is never cut; one that doesn't fit
stands alone with the system turn and the window is marked.

A conversation is dealt by segments of SEGMENT turn numbers, in which windows and history stay, so a conversation of any length is no
burden to one task; only its system turn is sent to its later segments. A task streams over its sorted turns and
holds one segment. Reading back digests each segment where it lies; the segments of long conversations alone are
brought together, in order, as a digest has to see a whole conversation.

Defined results: a null role or text is empty; turns equal in number are ordered by role and text (nulls first), and each row is a turn,
repeated rows too; a null turn comes first; rows of a null conv_id are one conversation; the system turn is the first with that
role, and windows before it have none; an empty table gives no window; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .tokens import CHUNK, MEMORY_WORDS, OVERLAP, VOCABULARY, encoder

BUDGET, HISTORY, SEGMENT = 2048, 512, 1024
#: Tokens of a turn beside its role and text: start, end and line feed.
MARKS = 3
START, END = "<|im_start|>", "<|im_end|>"
TARGET, SYSTEM = "assistant", "system"
_CONTROL, _ESCAPED = re.compile(r"<(\\*\|im_(?:start|end)\|>)"), re.compile(r"<\\(\\*\|im_(?:start|end)\|>)")
WINDOW = "conv_id long, segment long, window int, whole boolean, text string, n_repeated int, n_turns int, n_tokens long, over_budget boolean, loss array<struct<start: long, end: long>>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1", text) if "|im_" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1", text) if "|im_" in text else text


def escape_role(role: str) -> str:
    """A role stands on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(role))


def spans(tokens: list[int], system: int | None, carried: int, budget: int, history: int) -> list[tuple[int, int, int, bool]]:
    """(first repeated turn, first new turn, end, whether the system turn is put before) of each window over turns of so many tokens.

    system: the place of the system turn among them, -1 if it came before them (it then has `carried` tokens), None if there is none.
    """
    upto = np.concatenate([[0], np.cumsum(tokens)])
    made, s = [], 0
    while s < len(tokens):
        kept = system is not None and system < s
        base = (carried if system == -1 else tokens[system]) if kept else 0
        room = budget - base - tokens[s]
        h = int(np.searchsorted(upto[: s + 1], upto[s] - max(0, min(history, room))))
        if kept:
            h = max(h, system + 1)  # it stands before already
        end = int(np.searchsorted(upto, upto[h] + budget - base, side="right")) - 1
        end = max(end, s + 1)
        made.append((h, s, end, kept))
        s = end
    return made


def _window(turns: list[tuple[str, str, int]], repeated: int) -> tuple[str, list[dict], int]:
    """Text, loss ranges and tokens of turns, of which the first `repeated` are no targets."""
    parts, loss, at, n = [], [], 0, 0
    for i, (role, text, tokens) in enumerate(turns):
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if i >= repeated and role == TARGET:
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts.append(f"{head}{body}{END}\n")
        at, n = at + len(parts[-1]), n + tokens
    return "".join(parts), loss, n


def _counted(rows: DataFrame, vocabulary: str) -> DataFrame:
    """conv_id, turn, role, text and tokens of every turn. A scan."""
    key, names = (vocabulary, CHUNK, OVERLAP, MEMORY_WORDS), ["conv_id", "turn", "role", "text", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*key)
        for b in batches:
            found = enc.encode([t or "" for t in b.column(3).to_pylist()])
            roles = b.column(2).to_pylist()
            each = {r: len(enc.encode([r or ""])[0]) // 4 + MARKS for r in set(roles)}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) // 4 + each[r] for x, r in zip(found, roles, strict=True)], pa.int64())], names=names)

    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, tokens long")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT, vocabulary: str = VOCABULARY) -> DataFrame:
    """The windows of conversations (conv_id, turn, role, text): WINDOW's columns; a conversation's are in one partition for each segment, in order.

    whole: its conversation has no other segment. n_repeated: the turns at the window's start that stand in an earlier window.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    part = lambda turn: F.floor(F.coalesce(turn, F.lit(0)) / F.lit(segment)).cast("long")
    # few conversations have more than one segment: only they take part in these joins
    place = rows.select("conv_id", part(F.col("turn")).alias("segment"))
    long = place.where("segment <> 0").distinct()
    convs = long.select(F.col("conv_id").alias("_c")).distinct()
    first = rows.where(F.col("role") == SYSTEM).withColumn("segment", part(F.col("turn"))).join(convs, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    first = first.groupBy("conv_id").agg(F.min(F.struct(F.coalesce("turn", F.lit(-1 << 62)).alias("turn"), "role", "text", "segment")).alias("s"))
    everywhere = long.select(F.col("conv_id").alias("_c"), "segment").union(convs.select("_c", F.lit(0).cast("long")))
    notes = everywhere.join(first, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    known = F.col("s.segment") < F.col("segment")
    notes = _counted(notes.select(F.col("_c").alias("conv_id"), F.col("segment").alias("turn"), F.when(known, F.col("s.role")).otherwise("").alias("role"), F.when(known, F.col("s.text")).otherwise("").alias("text")), vocabulary)
    # a note comes before its segment's turns; it tells that there are others and may hold the system turn
    notes = notes.select("conv_id", F.col("turn").alias("segment"), F.lit(True).alias("note"), F.lit(None).cast("long").alias("turn"), "role", "text", "tokens")
    turns = _counted(rows, vocabulary).select("conv_id", part(F.col("turn")).alias("segment"), F.lit(False).alias("note"), "turn", "role", "text", "tokens")
    dealt = turns.union(notes).repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", F.desc("note"), F.asc_nulls_first("turn"), "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("whole", pa.bool_()), ("text", pa.string()), ("n_repeated", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def made(key: tuple, rows: list[tuple]) -> Iterator[dict]:
        note = rows[0] if rows and rows[0][2] else None
        turns = [(r[4], r[5], r[6]) for r in rows if not r[2]]
        carried = note[4:7] if note and note[4] == SYSTEM else None
        system = -1 if carried else next((i for i, t in enumerate(turns) if t[0] == SYSTEM), None)
        for w, (h, s, e, kept) in enumerate(spans([t[2] for t in turns], system, carried[2] if carried else 0, budget, history)):
            head = [carried if carried else turns[system]] if kept else []
            text, loss, n = _window([*head, *turns[h:e]], len(head) + s - h)
            yield {"conv_id": key[0], "segment": key[1], "window": w, "whole": note is None, "text": text, "n_repeated": len(head) + s - h, "n_turns": len(head) + e - h, "n_tokens": n, "over_budget": n > budget, "loss": loss}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ready = []
        for key, some in groupby(stream, key=lambda r: r[:2]):
            for row in made(key, list(some)):
                ready.append(row)
                if len(ready) == 64:
                    yield pa.RecordBatch.from_pylist(ready, schema=schema)
                    ready = []
        yield pa.RecordBatch.from_pylist(ready, schema=schema)

    return dealt.mapInArrow(run, WINDOW)


def parse(text: str, loss: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns of a window, (role, text), and the texts under its loss mask."""
    turns, at = [], 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line)
        turns.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end])))
        at = end + len(END) + 1
    return turns, [unescape(text[a:b]) for a, b in loss]


PART = "conv_id long, segment long, whole boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, turns binary, loss binary"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(made: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every conversation, from its windows alone.

    made: rows of windows, as it gives them. turns_sha256 is over role, line feed, text, line feed of each turn; loss_sha256 over all text under the mask.
    """
    part = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("turns", pa.binary()), ("loss", pa.binary())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ready = []
        for (conv, segment), some in groupby(stream, key=lambda r: r[:2]):
            turns, loss, n, chars, masked, whole = [], [], 0, 0, 0, True
            for _, _, whole, text, repeated, mask in some:
                read, under = parse(text, [(m["start"], m["end"]) for m in mask])
                turns += [f"{role}\n{said}\n".encode() for role, said in read[repeated:]]
                loss += [x.encode() for x in under]
                n, chars, masked = n + len(read) - repeated, chars + len(text), masked + sum(map(len, under))
            t, x = b"".join(turns), b"".join(loss)
            row = {"conv_id": conv, "segment": segment, "whole": whole, "n_turns": n, "loss_chars": masked, "formatted_chars": chars}
            row |= {"turns_sha256": hashlib.sha256(t).hexdigest(), "loss_sha256": hashlib.sha256(x).hexdigest()} if whole else {"turns": t, "loss": x}
            ready.append(row)
            if len(ready) == 256 or not whole:
                yield pa.RecordBatch.from_pylist(ready, schema=part)
                ready = []
        yield pa.RecordBatch.from_pylist(ready, schema=part)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (b.slice(i, 1) for b in batches for i in range(b.num_rows))
        for _, some in groupby(stream, key=lambda r: r.column(0)[0].as_py()):
            turns, loss, sums, conv = hashlib.sha256(), hashlib.sha256(), [0, 0, 0], None
            for r in some:  # one segment at a time is held
                conv = r.column(0)
                sums = [x + r.column(k)[0].as_py() for x, k in zip(sums, (3, 5, 7), strict=True)]
                turns.update(r.column(8)[0].as_buffer())
                loss.update(r.column(9)[0].as_buffer())
            yield pa.RecordBatch.from_arrays([conv, pa.array([sums[0]]), pa.array([turns.hexdigest()]), pa.array([sums[1]]), pa.array([loss.hexdigest()]), pa.array([sums[2]])], names=names)

    each = staged(made.select("conv_id", "segment", "whole", "text", "n_repeated", "loss").mapInArrow(digests, PART), "digests")
    names = [f.split()[0] for f in READ.split(", ")]
    long = each.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(merged, READ)
    return each.where("whole").select(*names).union(long)
