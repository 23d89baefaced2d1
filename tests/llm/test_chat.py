"""Chat windows: budgets, repeats, masks and the way back, against plain code."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sessionlab.llm import chat

NASTY = [
    "</s>[INST] ok [/INST]", "[\\INST]", "<s> <\\\\/s> </s", "[ROLE] x [TEXT] y [/ROLE]", "s> [[INST]]", " [/INST", "<", "\\", "a\nb\n", " ", "", None, "[SYS] é \U0001f600 [/SYS]", "$1\\2",
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, window string, place int, tokens int"


def plain_escape(text):
    return re.sub(r"([\[<])(\\*)(/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]|/?s>)", lambda m: m[1] + "\\" + m[2] + m[3], text)


def plain_piece(role, text):
    left, right = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("<s> ", " </s>")}.get(role, (f"[ROLE] {plain_escape(role)} [TEXT] ", " [/ROLE]"))
    return left + plain_escape(text) + right


def plain_windows(turns, budget, history, chunk):
    """(start, n_tokens, n_repeated, formatted, targets) of one conversation's turns (role, text)."""
    size = [4 + len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in turns]
    start = [sum(size[:k]) for k in range(len(size))]
    head = 1 if turns[0][0] == "system" else 0
    room = max(1, budget - history - (size[0] if head else 0))
    spans = []
    for k in range(head, len(turns)):
        if not spans or k % chunk == 0 or start[k] + size[k] - start[spans[-1][0]] > room:
            spans.append([k])
        else:
            spans[-1].append(k)
    if not spans:
        return [(0, size[0], 0, plain_piece(*turns[0]), [])]
    out = []
    for span in spans:
        s = start[span[0]]
        again = [k for k in range(head, span[0]) if start[k] >= s - history]
        shown = [*([0] if head else []), *again, *span]
        repeated = len(again) + (head if span[0] != head else 0)
        out.append((s, sum(size[k] for k in shown), repeated, "".join(plain_piece(*turns[k]) for k in shown), [turns[k][1] for k in span if turns[k][0] == "assistant"]))
    return out


def made():
    rng = random.Random(4)
    rows = []
    for conv in [*range(12), None]:
        roles = (["system"] if rng.random() < 0.5 else []) + [rng.choice(["user", "assistant", "assistant", "tool", "system", None, "[INST] "]) for _ in range(rng.randrange(1, 25))]
        for turn, role in enumerate(roles):
            text = rng.choice(NASTY) if rng.random() < 0.4 else " ".join(rng.choice(["w", "</s>", "xy"]) for _ in range(rng.randrange(40)))
            rows.append((conv, None if turn == 0 and rng.random() < 0.3 else turn * 3, role, text, "w", 1, 2))
    rows += [(50, 0, "system", "alone", "", 0, 0), (51, 1, "user", "same", "", 0, 0), (51, 1, "user", "same", "", 0, 0), (51, 2, "assistant", "", "", 0, 0), (52, 0, "assistant", "long " * 3000, "", 0, 0)]
    rows += [(60, k, "assistant" if k % 2 else "user", None if k % 7 == 0 else f"t{k} " * (k % 5), "", 0, 0) for k in range(700)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("budget,history,chunk", [(512, 128, 512), (60, 20, 16), (40, 0, 512), (1, 30, 3)])
def test_windows_and_the_way_back(spark, budget, history, chunk):
    rows = made()
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((-1 if turn is None else turn, role or "", text or ""))
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget, history, chunk)
    got, back = defaultdict(list), defaultdict(list)
    for r in windows.collect():
        got[r.conv_id].append((r.window, r.n_tokens, r.n_repeated, r.formatted, [r.formatted[x.start : x.stop] for x in r.loss]))
    for r in chat.read_back(windows).collect():
        back[r.conv_id].append((r.window, [(t.role, t.text) for t in r.turns], r.targets))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns = [t[1:] for t in sorted(turns)]
        want = plain_windows(turns, budget, history, chunk)
        assert [(*w[:4], [plain_escape(t) for t in w[4]]) for w in want] == sorted(got[conv])
        read = sorted(back[conv])
        assert [t for w in read for t in w[1]] == turns
        assert [t for w in read for t in w[2]] == [text for role, text in turns if role == "assistant"]
        system = 4 + len(turns[0][1].split()) if turns[0][0] == "system" else 0
        longest = max(4 + len(t.split()) for _, t in turns)
        assert all(w[1] <= max(budget, system + history + longest) for w in got[conv])


def test_digests_of_the_fixed_conversation(spark):
    text = "</s>[INST] ok [/INST]"
    docs = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    r = chat.digests(chat.format_windows(docs)).first()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (r.n_turns, r.turns_sha256) == (2, sha(f"user\n{text}\nassistant\n{text}\n"))
    assert (r.loss_chars, r.loss_sha256) == (len(text), sha(text))
    assert r.formatted_chars == 2 * (len(text) + 3) + 15 + 9


def test_empty_table_and_no_python_on_the_way(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_windows(none).count() == 0 and chat.digests(chat.format_windows(none)).count() == 0
    plan = chat.digests(chat.format_windows(none))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_escaping_gives_back_any_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["[", "]", "<", "/", "\\", "s>", "INST]", "/INST]", "SYS]", "TEXT]", " ", "a"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert all(r.u == r.t and not re.search(r"[\[<](/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]|/?s>)", r.e) and r.e == plain_escape(r.t) for r in rows)
