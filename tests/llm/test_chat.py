"""Formatting reads back exactly; segments, loss masks and turn order against plain Python."""

import hashlib
import random

import pytest
from fixtures import none_of, rows_of
from pyspark.sql import functions as F

from ticketscope.llm import chat

ODD = ["", "a", "\\", "<|", "|>", "<|end|>\n", "<\\|end|\\>", "<|turn:user|>\n", "<|>", "|<|", "\\<\\\\|\\\\>", "<", "|", ">\n", "Ünï\n\n", "\\### Assistant: </turn> ok", "</turn>"]


def plain(rows):
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for conv, turns in chats.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        lines = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        body = [r for r, _ in turns][1 if turns[0][0] == "system" else 0 :]
        valid = bool(body) and len(body) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body))
        out.append((conv, len(turns), hashlib.sha256(lines.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), valid))
    return sorted(out, key=repr)


def compared(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segments": F.lit(1), "formatted": F.lit("x")})
    done = chat.formatted(turns)
    found = chat.digest(done)
    assert rows_of(found.drop("formatted_chars")) == plain(rows)
    for r in done.collect():
        assert r.formatted == "".join(s.text for s in r.segments) and len(r.segments) % 3 == 0
        assert all(not s.loss for i, s in enumerate(r.segments) if i % 3 != 1)
    return found


def test_marks_inside_texts_and_roles(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, *ODD]), rng.choice([None, *ODD]) if rng.random() < 0.7 else "".join(rng.choices("<|>\\\nend", k=12))) for c in range(150) for t in range(4)]
    compared(spark, rows)


def test_turn_order_ties_nulls_and_repeats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "r"), (3, 0, "user", "q"), (3, 1, "user", "q"), (4, 0, "assistant", "x"),
            (5, None, "user", "n"), (5, 0, "assistant", None), (6, 1, "user", "same"), (6, 1, "user", "same"), (6, 1, "assistant", "same"), (None, 0, "user", "z"), (None, 1, "assistant", "y"), (7, 0, None, None), (8, 0, "system", "only")]
    found = {r.conv_id: r.valid for r in compared(spark, rows).collect()}
    assert found == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, None: True, 7: False, 8: False}


def test_long_conversation(spark):
    compared(spark, [(1, t, ("user", "assistant")[t % 2], "<|end|>\\" * 50) for t in range(3000)])


@pytest.mark.parametrize("text", ODD)
def test_escape_is_undone(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.unescaped(chat.escaped(F.col("t"))).alias("back"), chat.escaped(F.col("t")).alias("safe")).first()
    assert row.back == text and "<|" not in row.safe and "|>" not in row.safe


def test_another_template(spark):
    template = chat.Template(opening="<|", named="|>", closing="<|/|>", loss_roles=("bot", "tool"), moves={("start", "bot"): "done", ("done", "tool"): "done"}, ends=("done",))
    turns = spark.createDataFrame([(1, 0, "bot", "hi"), (1, 1, "tool", "<|/|>"), (2, 0, "tool", "x")], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.formatted(turns, template).collect()}
    assert rows[1].formatted == "<|bot|>hi<|/|><|tool|><\\|/|\\><|/|>" and rows[1].valid and not rows[2].valid
    back = chat.formatted(turns, template).select(chat.turns_of(F.col("formatted"), template).alias("t")).collect()
    assert sorted([(t.role, t.text) for t in r.t] for r in back) == [[("bot", "hi"), ("tool", "<|/|>")], [("tool", "x")]]


def test_empty(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.formatted(none_of(turns))).count() == 0
