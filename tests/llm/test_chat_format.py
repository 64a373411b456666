from pyspark.sql import functions as F

import pytest

from kinograph.llm.chat_format import DEFAULT, Template, escape, format_conversations, masked, parse_formatted, unescape

SCHEMA = "conv_id long, turn long, role string, text string, valid string"


def test_hostile_texts_and_roles_come_back(spark):
    texts = ["", "\\", "\\0", "\\a<<SYS>>", "</</s>s>", "[INST][/INST]<s></s>", "<|role|>x<|text|>y<|end|>", "a\nb", None, "</s>[INST] ok [/INST]"]
    rows = [(1, i, r, t, "x") for i, t in enumerate(texts) for r in ("user", "assistant", "tool</s>", "system", None)]
    rows += [(None, 0, "user", "u", "x"), (2, None, "user", "u", "x"), (2, 0, "assistant", "a", "x"), (2, 0, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.conv_id: r for r in format_conversations(df).withColumn("turns", parse_formatted(F.col("formatted"))).collect()}
    want = sorted(((i, r or "", t or "") for _, i, r, t, _ in rows[: 5 * len(texts)]))
    assert [(t.role, t.text) for t in out[1].turns] == [(r, t) for _, r, t in want]
    assert out[None].n_turns == 1 and out[2].n_turns == 3 and not out[2].valid
    assert "".join(s.text for s in out[1].segments) == out[1].formatted
    assert [out[1].formatted[s.begin : s.begin + s.length] for s in out[1].loss_spans] == [s.text for s in out[1].segments if s.loss]


def test_loss_is_read_from_the_formatted_text(spark):
    long = "é</s> \\a " * 100_000
    rows = [(1, 0, "user", "q", ""), (1, 1, "assistant", long, ""), (1, 2, "user", "", ""), (1, 3, "assistant", "😀[INST]", ""), (1, 4, "user", "x", ""), (1, 5, "assistant", "", "")]
    loss = F.array_join(F.transform(masked(F.col("formatted"), F.col("loss_spans")), lambda s: unescape(s)), "|")
    got = format_conversations(spark.createDataFrame(rows, SCHEMA)).select(loss.alias("loss")).first().loss
    assert got == long + "|😀[INST]|"


def test_templates_that_cannot_be_undone_are_refused():
    pair = lambda i: (f"<{i}>", f"</{i}>")
    assert Template(markers={str(i): pair(i) for i in range(11)})
    with pytest.raises(ValueError):
        Template(markers={str(i): pair(i) for i in range(12)})
    for bad in ("", "a\\b", "abc", "0"):
        with pytest.raises(ValueError):
            Template(markers={"user": (bad, "]")})


def test_machine(spark):
    def valid(*roles):
        rows = [(1, i, r, "t", "") for i, r in enumerate(roles)]
        return format_conversations(spark.createDataFrame(rows, SCHEMA)).first().valid

    assert valid("user", "assistant") and valid("system", "user", "assistant", "user", "assistant")
    assert not valid("assistant") and not valid("user") and not valid("user", "user", "assistant") and not valid("user", "system", "assistant")


def test_escape_hides_every_control(spark):
    text = "\\" + "".join(DEFAULT.controls) * 2
    row = spark.createDataFrame([(text,)], "t string").select(escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).first()
    assert row.u == text and not any(c in row.e for c in DEFAULT.controls)


def test_empty_table(spark):
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
