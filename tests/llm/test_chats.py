"""Chat windows: exact round trips, budgets, histories, masks and long conversations."""

import hashlib
import random

from lodestone.llm import chats

SCHEMA = "conv_id long, turn long, role string, text string, segment string, window string, loss string"
NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|im_start|>x\n", "<|im_end", "\\", "<|im_<|im_end|>\n", "", "tabs\tand\r\nfeeds\n\n", "日本 é <|im_start|>"]


def conversations(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    made = []
    for conv in range(40):
        if r.random() < 0.4:
            made.append([conv, 0, "system", "be " + word()])
        for turn in range(1, r.randint(2, 40)):
            text = r.choice(NASTY) if r.random() < 0.2 else " ".join(word() for _ in range(r.randint(0, 60)))
            made.append([conv, turn, "user" if turn % 2 else "assistant", text])
    made += [[50, 0, None, None], [50, 1, "assistant", None], [50, 1, "assistant", "tie"], [50, 2, "a\nb\\n<|im_end|>", "odd role"], [50, None, "user", "no turn"]]
    made += [[None, 0, "user", "no id"], [None, 1, "assistant", "fine"], [51, 5, "assistant", "late"], [51, 5, "assistant", "late"], [52, 3, "system", "only"], [53, -4, "user", "below"]]
    made += [[54, 0, "user", "hi"], [54, 1, "assistant", "w " * 3000], [54, 2, "system", "from here"], [54, 3, "assistant", "x " * 900]]
    for turn in range(90):  # a conversation of many segments
        made.append([60, turn, "system" if turn in (2, 30) else ("user", "assistant")[turn % 2], word() + " " + r.choice(NASTY)])
    return made


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "w", "l") for r in rows], SCHEMA)


def ordered(rows):
    made = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        made.setdefault(conv, []).append((role or "", text or ""))
    return made


def brute(rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = {}
    for conv, turns in ordered(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def test_every_turn_comes_back_and_every_target_once(spark):
    rows = conversations()
    for kw in ({"budget": 120, "history": 30, "segment": 8}, {"budget": 10, "history": 0, "segment": 1000}, {}):
        made = chats.windows(frame(spark, rows), **kw)
        got = {r[0]: r[1:] for r in chats.read_back(made).collect()}
        assert {k: v[:4] for k, v in got.items()} == brute(rows)
        chars = {}
        for w in made.collect():
            chars[w["conv_id"]] = chars.get(w["conv_id"], 0) + len(w["text"])
        assert {k: v[4] for k, v in got.items()} == chars


def test_windows_keep_budget_system_and_history(spark):
    rows = conversations()
    budget, history, segment = 120, 30, 64
    made = chats.windows(frame(spark, rows), budget, history, segment).orderBy("conv_id", "segment", "window").collect()
    turns = {k: [t for t in v] for k, v in ordered(rows).items()}
    seen = {}
    for w in made:
        read, loss = chats.parse(w["text"], [(m["start"], m["end"]) for m in w["loss"]])
        k, new = w["n_repeated"], read[w["n_repeated"] :]
        done = seen.setdefault(w["conv_id"], [])
        told = [i for i, t in enumerate(done) if t[0] == "system"]
        if told:  # the system turn stands first in every later window
            assert k >= 1 and read[0] == done[told[0]]
            assert k == 1 or read[1:k] == done[len(done) - k + 1 :]
        else:
            assert read[:k] == done[len(done) - k :]
        assert loss == [t for r, t in new if r == "assistant"]
        assert w["over_budget"] == (w["n_tokens"] > budget) and (not w["over_budget"] or len(new) == 1)
        assert w["n_turns"] == len(read)
        done += new
    assert seen == turns
    assert any(w["n_repeated"] > 1 for w in made) and any(w["over_budget"] for w in made)


def test_spans_by_hand():
    # first 10 tokens of history, room for the new turn goes first
    assert chats.spans([4, 4, 4, 4, 4], None, 0, 12, 4) == [(0, 0, 3, False), (2, 3, 5, False)]
    assert chats.spans([3, 6, 6, 6], 0, 0, 12, 6) == [(0, 0, 2, False), (2, 2, 3, True), (3, 3, 4, True)]
    assert chats.spans([30, 2], -1, 5, 20, 4) == [(0, 0, 1, True), (1, 1, 2, True)]
    assert chats.spans([], None, 0, 20, 4) == []


def test_escapes_are_reversible():
    for text in NASTY + ["<" + "\\" * k + "|im_end|>" for k in range(5)]:
        assert chats.unescape(chats.escape(text)) == text and chats.END not in chats.escape(text) and chats.START not in chats.escape(text)
        assert chats.unescape_role(chats.escape_role(text)) == text and "\n" not in chats.escape_role(text)


def test_no_conversations(spark):
    assert chats.read_back(chats.windows(frame(spark, []))).collect() == []
