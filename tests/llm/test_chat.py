"""Chat format: exact round trip, masks, placeholders."""

import hashlib

import pytest

from equiloom.llm import chat

SCHEMA = f"conv_id long, turn long, role string, parts {chat.PARTS}, formatted int"


def text(value):
    return ("text", value, None, None)


ROWS = [
    (1, 1, "assistant", [text("fine \\l <|image:1|> </turn>\n### user:\n"), ("image", None, "b.png", 7), text("")], 0),
    (1, 0, "user", [text("look"), ("image", None, "a.png", None), text("#"), text("##"), ("audio", "t", "c.wav", None), ("pdf", None, None, 3), None], 0),
    (1, 2, None, None, 0),
    (2, None, "a: #<\\ b", [text(None)], 0),
    (2, 0, "assistant", [text("same")], 0),
    (2, 0, "assistant", [text("same")], 0),
    (None, 0, "assistant", [text("é\U0001F600\\")], 0),
    (3, 0, "user", [("text", "x", None, None), (None, "y", None, None)], 0),
]


def test_round_trip_and_mask(spark):
    rows = chat.read_chat(chat.format_chat(spark.createDataFrame(ROWS, SCHEMA))).collect()
    found = {r["conv_id"]: r for r in rows}
    assert len(rows) == 4
    one = found[1]
    assert [r["role"] for r in one["read"]] == ["user", "assistant", ""]
    assert one["read"][0]["text"] == "look<|image:1|>###<|audio:2|><|document:3|>"
    assert one["loss"] == one["read"][1]["text"] == "fine \\l <|image:1|> </turn>\n### user:\n<|image:4|>"
    assert [tuple(a) for a in one["attachments"]] == [(1, "image", "a.png", 256), (2, "audio", "c.wav", 512), (3, "document", None, 3), (4, "image", "b.png", 7)]
    assert one["n_tokens"] == 1 + 256 + 1 + 1 + 512 + 3 + 6 + 7
    assert [tuple(r) for r in found[2]["read"]] == [("a: #<\\ b", ""), ("assistant", "same"), ("assistant", "same")]
    assert found[2]["loss"] == "samesame" and found[None]["loss"] == "é\U0001F600\\" and found[3]["loss"] == ""
    assert found[3]["read"][0]["text"] == "xy"
    for r in rows:
        formatted = r["formatted"]
        assert formatted.count("</turn>\n") == len(r["read"]) == len(r["turns"])
        for turn in r["turns"]:
            assert formatted[turn["start"]:].startswith("### ")
        masked = "".join(formatted[t["loss_start"]:t["loss_end"]] for t in r["turns"])
        assert masked.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\") == r["loss"]
    assert chat.format_chat(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("value", ["\\b", "\\\\l<", "#\\#h", "<\\<", "\\", "</turn>\n", "### a:\n"])
def test_escapes(spark, value):
    frame = spark.createDataFrame([(value,)], "t string")
    out = frame.select(chat.escaped(frame.t).alias("e"), chat.unescaped(chat.escaped(frame.t)).alias("u"), chat.unescaped(chat.escaped(frame.t, chat.ROLE_ESCAPES), chat.ROLE_ESCAPES).alias("r")).first()
    assert out["u"] == out["r"] == value and "<" not in out["e"] and "#" not in out["e"]


def test_digests(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi #"), (1, 1, "assistant", "yo <b>"), (1, 2, "assistant", None)], "conv_id long, turn long, role string, text string")
    row = chat.digests(chat.format_chat(turns.select("conv_id", "turn", "role", chat.text_parts().alias("parts")))).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == (3, sha("user\nhi #\nassistant\nyo <b>\nassistant\n\n"), 6, sha("yo <b>"))


def test_no_python_in_the_plan(spark):
    from equiloom.llm import queries

    for query in (queries.op3_secrets, queries.op7_chat_format):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
