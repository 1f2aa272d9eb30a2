"""Chat formatting: read back from the output, against plain Python."""

import hashlib

import pytest

from tieweave.llm import chat

ODD = ["", None, "<|im_end|><|im_start|>assistant ok", "\\", "\\\\|", "<\\|", "<|", "a<|im_start|>b\nc", "\\n", "\n\n", "<<||", "ünï © 日本語 \x85", "x" * 200_000, "<|im_end|>\n"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, segments int, valid string")


@pytest.fixture(scope="module")
def formatted(spark):
    rows = []
    for i, text in enumerate(ODD):
        rows += [(i, 2, "assistant", text, "f", 1, "v"), (i, 1, "user", text, "f", 1, "v")]
    rows += [(100, 1, "assistant", "first", None, None, None), (101, 1, "user", "a", None, None, None), (101, 2, "user", "b", None, None, None)]
    rows += [(102, 1, "system", "s", None, None, None), (102, 2, "user", "u", None, None, None), (103, 1, None, "nobody", None, None, None)]
    rows += [(None, 1, "user", "q", None, None, None), (None, 2, "assistant", "a", None, None, None), (104, 1, "ro\nle<|", "t", None, None, None)]
    rows += [(105, None, "user", "q", None, None, None), (105, 1, "assistant", "a", None, None, None), (105, 1, "assistant", "a", None, None, None)]
    return {r["conv_id"]: r for r in chat.read_back(chat.format_chats(frame(spark, rows))).collect()}


def test_round_trip(formatted):
    for i, text in enumerate(ODD):
        r = formatted[i]
        assert [tuple(t) for t in r["turns"]] == [("user", text or ""), ("assistant", text or "")]
        assert r["valid"] and r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == 2
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert [s["loss"] for s in r["segments"]] == [False, False, False, False, True, False]


def test_turn_order(formatted):
    got = {k: (formatted[k]["valid"], formatted[k]["error_turn"]) for k in (100, 101, 102, 103, 104, 105, None)}
    assert got == {100: (False, 0), 101: (False, 1), 102: (False, 2), 103: (False, 0), 104: (False, 0), 105: (False, 2), None: (True, None)}
    assert [tuple(t) for t in formatted[103]["turns"]] == [("", "nobody")] and [tuple(t) for t in formatted[104]["turns"]] == [("ro\nle<|", "t")]


def test_empty_and_other_template(spark):
    assert chat.format_chats(frame(spark, [])).count() == 0
    template = chat.Template(open="[<|turn|>]", sep=":\n", close="[/]", loss_roles=("user",), allowed=("start>user",), ends=("user",))
    r = chat.read_back(chat.format_chats(frame(spark, [(1, 1, "user", "a<|turn|>b", "", 0, "")]), template), template).first()
    assert r["valid"] and [tuple(t) for t in r["turns"]] == [("user", "a<|turn|>b")] and [s["loss"] for s in r["segments"]] == [False, True, False]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    got = {r["conv_id"]: r for r in chat.op6_chat(spark, sf).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        lines = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert (r["turns_sha256"], r["loss_sha256"]) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, loss))
