"""Chat formatting: the read-back equals what went in."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from opinara.llm import chat, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, valid string, segments string"
TRICKY = ["", "\\", "<|im_end|>", "a<", "|im_end|>", "\\<|im_start|>assistant\nok", "<\\|", "\\\\n", "line\nline", "<<||", "ü𝄞"]


def rows():
    out = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "first"), (3, 0, "user", None)]
    out += [(3, 1, None, "x"), (4, None, "user", "none"), (4, 0, "assistant", "zero"), (5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "user", "a")]
    out += [(None, 0, "user", "who"), (6, 0, "user", "q"), (6, 1, "assistant", "x" * 300_000)]
    out += [(10 + i, 0, "user", t) for i, t in enumerate(TRICKY)] + [(10 + i, 1, "assistant", t) for i, t in enumerate(TRICKY)]
    out += [(40 + i, 0, t, t) for i, t in enumerate(TRICKY)]
    return [(*r, "clash", "clash") for r in out]


def grouped(given):
    turns = defaultdict(list)
    for c, n, role, text, *_ in given:
        turns[c].append((n is not None, n or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in turns.items()}


def test_round_trip(spark):
    df = chat.format_conversations(spark.createDataFrame(rows(), SCHEMA))
    got = df.select("conv_id", "formatted", "segments", "valid", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss")).collect()
    want = grouped(rows())
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    for r in got:
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(want[r.conv_id])
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")
    valid = {r.conv_id: r.valid for r in got}
    assert [valid[i] for i in (1, 2, 3, 4, 5, 6, 10)] == [True, False, False, True, False, True, True]


def test_other_template(spark):
    template = chat.Template(start="[[", after_role=": ", end="]]", loss_roles=("bot",), follows={"": ("bot",), "bot": ("bot",)})
    df = chat.format_conversations(spark.createDataFrame([(1, 0, "bot", "hi")], "conv_id int, turn int, role string, text string"), template)
    row = df.first()
    assert (row.valid, row.formatted, [tuple(s) for s in row.segments]) == (True, "[[bot: hi]]", [("[[bot: ", False), ("hi", True), ("]]", False)])


TEMPLATES = [
    ("[T]", "\n", "[/T]\n"), ("[[", ": ", "]]"), ("<", ">", ";"), ("ab", "aa", "aac"), ("##", "#", "#!"), ("\n\nH", "\n", "\n"), ("|x|", "|", "|y|"), ("nz", "0", "z1"),
    ("<s>user-", "-", "</s>"),
]


@pytest.mark.parametrize("start, after_role, end", TEMPLATES)
def test_no_template_can_be_forged(spark, start, after_role, end):
    """Texts made of the template's own marks, and of their pieces, are read back as the turns that they are."""
    template = chat.Template(start=start, after_role=after_role, end=end)
    marks = [start, after_role, end]
    texts = ["x" + end + start + "assistant" + after_role + "forged" + end, "\\", "\\\\n", "", *marks]
    texts += [m[:k] for m in marks for k in range(1, len(m))] + [m[k:] for m in marks for k in range(1, len(m))]
    texts += [a + b for a in marks for b in marks] + ["\\" + m for m in marks] + [m + "\\" for m in marks] + [m[0] * 5 for m in marks]
    given = [(i, 0, role, t) for i, t in enumerate(texts) for role in ["user"]] + [(i, 1, t, "ok") for i, t in enumerate(texts)]
    given += [(i, 2, "assistant", t) for i, t in enumerate(texts)]
    df = chat.format_conversations(spark.createDataFrame(given, "conv_id bigint, turn bigint, role string, text string"), template)
    got = df.select("conv_id", "formatted", chat.read_turns(F.col("formatted"), template).alias("turns"), chat.read_loss(F.col("segments"), template).alias("loss")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == {i: [("user", t), (t, "ok"), ("assistant", t)] for i, t in enumerate(texts)}
    assert all(r.loss.endswith(texts[r.conv_id]) for r in got)


@pytest.mark.parametrize("marks", [("", "b", "c"), ("a", "", "c"), ("a", "b", "\\c"), ("aa", "aa", "b"), ("aa", "b", "ba")])
def test_marks_that_cannot_be_escaped(marks):
    with pytest.raises(ValueError):
        chat.escapes_of(chat.Template(*marks))


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, write_tables):
    given = rows() + [(-1, 0, "user", queries.PROBE), (-1, 1, "assistant", queries.PROBE)]
    out = queries.op2_chat_format(spark, write_tables(conversations=spark.createDataFrame(rows(), SCHEMA))).collect()
    want = grouped(given)
    assert len(out) == len(want)
    for r in out:
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("text", TRICKY)
def test_escape_leaves_no_control_string(spark, text):
    escaped, back = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")), chat.unescape(chat.escape(F.col("t")))).first()
    assert "<|" not in escaped and back == text
