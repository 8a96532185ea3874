"""Chat formatting: exact round trips, typed parts, chunks, edges."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lumiquarry.llm import chat_format as m

SAYINGS = st.lists(st.sampled_from([*"\\<>/ tunrpa#\n\x00\u00e9\U0001f642", "<turn ", "</turn>", "<part ", "<part image 0>"]), max_size=12).map("".join)


@given(st.lists(st.tuples(SAYINGS, SAYINGS), max_size=5))
def test_turns_come_back(turns):
    text = "".join(m.formatted_turn(role, [{"type": "text", "text": said}], m.Cost())[0] for role, said in turns)
    assert [(role, said, held) for role, said, held in m.parsed(text)] == [(role, said, []) for role, said in turns]


def test_parts_leave_placeholders_in_order():
    parts = [
        {"type": "text", "text": "See <part image 0> "}, {"type": "image", "ref": "a.png", "width": 56, "height": 29},
        {"type": "audio", "ref": "b.wav", "length": 100}, {"type": "text", "text": None}, {"type": "document", "ref": None, "length": 3}, {"type": "image"},
    ]
    text, begin, end, attached = m.formatted_turn("user", parts, m.Cost(), 4)
    assert [(k, n, r, t) for k, n, r, _, t in attached] == [("image", 4, "a.png", 4), ("audio", 5, "b.wav", 3), ("document", 6, None, 1536), ("image", 7, None, 256)]
    assert all(text[at:].startswith(f"<part {k} {n}>") for k, n, _, at, _ in attached)
    assert text[:begin] == "<turn user>" and text[end:] == "</turn>"
    ((role, said, held),) = m.parsed(text)
    assert (role, said) == ("user", "See <part image 0> ") and held == [("image", 4, 19), ("audio", 5, 19), ("document", 6, 19), ("image", 7, 19)]
    with pytest.raises(ValueError):
        m.formatted_turn("user", [{"type": "film"}], m.Cost())


@pytest.mark.parametrize("text", ["x", "<turn a>", "</turn>", "<turn a><turn b></turn>", "<turn a></turn>x", "\\x", "<turn a></turn>\\"])
def test_other_texts_are_errors(text):
    with pytest.raises(ValueError):
        list(m.parsed(text))


SCHEMA = "conv_id long, turn long, role string, text string, chunk int, last boolean, conv string, loss string"


def held(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)


def wanted(rows):
    convs: dict = {}
    for c, *rest in rows:
        convs.setdefault(c, []).append(rest)
    out = {}
    for c, mine in convs.items():
        mine = [(r or "", x or "") for _, r, x in sorted(mine, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))]
        learned = "".join(x for r, x in mine if r == "assistant")
        out[c] = (len(mine), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


ROWS = [
    (1, 0, "user", m.PROBE), (1, 1, "assistant", m.PROBE), (2, None, None, None), (2, 0, "assistant", None), (2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"),
    (None, 3, "assistant", "\\<turn user>\u0130\x00\U0001f642"), (None, None, "a>b\\", "  "), (3, 0, "system", "long </turn> " * 50_000), (3, 1, "assistant", "long <part " * 50_000), (4, 0, "user", ""),
]


@pytest.mark.parametrize("size", [1, 40, m.CHUNK_CHARS])
def test_conversations_come_back_from_chunks_of_any_size(spark, tmp_path, size):
    m.format_conversations(held(spark, ROWS), chunk_chars=size).write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    got = {r.conv_id: tuple(r)[1:5] for r in m.read_back(chunks).collect()}
    assert got == wanted(ROWS)
    assert chunks.count() > len(got) if size == 1 else chunks.count() >= len(got)


def test_typed_parts_in_a_table(spark):
    image = {"type": "image", "text": None, "ref": "i", "width": 28, "height": 28, "length": None}
    said = {"type": "text", "text": "hello", "ref": None, "width": None, "height": None, "length": None}
    df = spark.createDataFrame([(1, 0, "user", "unused", [image, said, image]), (1, 1, "assistant", "from text", None), (1, 2, "user", "unused", [])], f"conv_id long, turn long, role string, text string, parts {m.PARTS}")
    (row,) = m.format_conversations(df, parts_col="parts").collect()
    assert row.text == "<turn user><part image 0>hello<part image 1></turn><turn assistant>from text</turn><turn user></turn>"
    assert [(a.kind, a.number, a.ref, a.tokens) for a in row.attachments] == [("image", 0, "i", 1), ("image", 1, "i", 1)] and [row.text[s.start : s.end] for s in row.loss] == ["from text"]
    (back,) = m.read_back(m.format_conversations(df, parts_col="parts")).collect()
    assert (back.n_turns, back.n_attachments, back.attachment_tokens, back.loss_chars, back.formatted_chars) == (3, 2, 2, 9, len(row.text))


def test_a_mask_off_its_turns_is_an_error(spark):
    from pyspark.sql import functions as F

    chunks = m.format_conversations(held(spark, ROWS[:2]))
    bad = chunks.withColumn("loss", F.transform("loss", lambda x: F.struct((x["start"] + 1).alias("start"), x["end"].alias("end"))))
    with pytest.raises(Exception, match="off its turns"):
        m.read_back(bad).collect()


def test_no_rows_and_query(spark, tmp_path):
    assert m.read_back(m.format_conversations(held(spark, []))).count() == 0
    held(spark, ROWS).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:5] for r in m.op13_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == wanted([*ROWS, (-7, 0, "user", m.PROBE), (-7, 1, "assistant", m.PROBE)])
