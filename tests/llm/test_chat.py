import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstage.llm import chat
from tests.conftest import SF, same_rows

HOSTILE = st.lists(
    st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[AS]", "\\", "<", "[", "/", "s>", "<|image:0|>", "é", "\n", "<\\/s>"]),
    max_size=12
).map("".join)


def read(turns, moved=0):
    """What the reader finds in the pieces of turns, with the loss mask moved by so many characters."""
    reader, spans, whole = chat.Reader(), [], chat.START
    reader.feed(chat.START)
    for role, text in turns:
        piece, lo, hi, _ = chat.format_turn(role, text)
        mask = (lo + moved, hi + moved) if role == "assistant" else None
        if mask:
            spans.append((len(whole) + lo, len(whole) + hi))
        whole += piece
        reader.feed(piece, mask)
    return reader.row(0), whole, spans


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "to[AS]ol"]), HOSTILE), max_size=6))
def test_round_trip(turns):
    row, whole, spans = read(turns)
    said = "".join(t for r, t in turns if r == "assistant")
    assert "".join(chat.unescape(whole[a:b]) for a, b in spans) == said
    assert row[1] == len(turns) and row[2] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert row[3:5] == (len(said), hashlib.sha256(said.encode()).hexdigest()) and row[5] == len(whole)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), HOSTILE), max_size=6), st.integers(1, 300))
def test_pieces_may_end_anywhere_between_turns(turns, step):
    pieces = [chat.START, *(chat.format_turn(r, t)[0] for r, t in turns)]
    reader = chat.Reader()
    for i in range(0, len(pieces), step):
        reader.feed("".join(pieces[i : i + step]))
    assert reader.row(0)[1:3] == read(turns)[0][1:3]


def test_a_shifted_mask_is_found_out(spark):
    turns = [("user", "a question"), ("assistant", "an answer </s>")]
    right, shifted = read(turns)[0], read(turns, moved=1)[0]
    assert right[2] == shifted[2] and right[4] != shifted[4]
    with pytest.raises(ValueError, match="outside a piece"):
        read([("assistant", "x")], moved=9)
    said = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    pieces = chat.format_conversations(said)
    whole = chat.read_back(pieces).first()
    moved = chat.read_back(pieces.withColumns({"loss_start": F.col("loss_start") + 1, "loss_end": F.col("loss_end") + 1})).first()
    unmasked = chat.read_back(pieces.withColumns({"loss_start": F.lit(None).cast("long"), "loss_end": F.lit(None).cast("long")})).first()
    assert whole.loss_chars == len("an answer </s>") and whole.turns_sha256 == moved.turns_sha256 == unmasked.turns_sha256
    assert whole.loss_sha256 != moved.loss_sha256 and unmasked.loss_chars == 0


def test_typed_parts(spark):
    parts = [
        {"type": "text", "text": "see </s> "}, {"type": "image", "ref": "i.png", "width": 28, "height": 15},
        {"type": "audio", "ref": "a.wav", "seconds": 1.5}, {"type": "document", "ref": "d.pdf", "pages": 3}, {"type": "text", "text": None}
    ]
    rows = spark.createDataFrame(
        [(1, 0, "user", [{k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in parts])],
        f"conv_id long, turn long, role string, text array<{chat.PART.simpleString()}>"
    )
    r = chat.format_conversations(rows).first()
    assert r.formatted == "<s>[INST]see <\\/s> <|image:0|><|audio:1|><|document:2|>[/INST]"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 4), ("audio", "a.wav", 38), ("document", "d.pdf", 1536)]
    assert r.expanded_tokens == 1578 and all(r.formatted[a.position :].startswith(f"<|{a.kind}") for a in r.attachments)
    with pytest.raises(ValueError, match="no such content part"):
        chat.flatten([{"type": "smell"}])


def expected(rows):
    turns = {}
    for c, t, r, x in rows:
        turns.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x or ""))
    out = {}
    for c, ts in turns.items():
        ts = [(r, x) for _, _, _, r, x in sorted(ts)]
        said = "".join(x for r, x in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_query_equals_oracle(spark, duck):
    same_rows(chat.QUERIES["op9_chat_formatting"](spark, SF), duck, chat.SQL["op9_chat_formatting"])


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.QUERIES["op9_chat_formatting"](spark, SF).collect()}
    assert got == expected(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", "y"), (2, None, "assistant", "z" * 300_000),
        *[(3, i, "user", f"t{i}") for i in range(12000)]
    ]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'own' AS c", "1 AS start", "'f' AS formatted")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_conversations(said)).collect()}
    assert got == expected(rows)
    assert chat.read_back(chat.format_conversations(said.limit(0))).count() == 0


@given(HOSTILE, HOSTILE)
def test_strings_and_parts_are_visited_alike(a, b):
    whole, none = chat.flatten(a + b + "\n" + a)
    assert none == [] and whole == chat.escape(a + b + "\n" + a)
    lines = [{"type": "text", "text": a + b + "\n"}, {"text": a}]
    assert chat.flatten(lines)[0] == whole
    visited = []

    class Counting(chat.Flattener):
        def visit_text(self, part):
            visited.append(part["text"])
            super().visit_text(part)

    before, chat.Flattener = chat.Flattener, Counting
    try:
        chat.flatten(a)
    finally:
        chat.Flattener = before
    assert visited == [a]


def test_texts_become_parts_by_lines(spark):
    rows = spark.createDataFrame([("a\n\nb </s>",), ("",), (None,), ("x\n",)], "text string").select(chat.as_parts(F.col("text")).alias("p")).collect()
    assert [[p.text for p in r.p] for r in rows] == [["a\n", "\n", "b </s>"], [""], [""], ["x\n", ""]]
    assert all(p.type == "text" and p.ref is None for r in rows for p in r.p)
