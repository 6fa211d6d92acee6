import pytest
from pyspark.sql import functions as F

from seamline.llm.chat import Template, format_chats, read_chats

SCHEMA = "conv_id long, turn long, role string, text string, segments int, n_turns string"


def read(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = format_chats(df).withColumn("turns", read_chats(F.col("formatted")))
    return {r.conv_id: r for r in out.collect()}


def test_round_trip_of_control_strings(spark):
    odd = ["\\", "\\\\", "\\0", "###", "\\###", "</turn>", "</turn>\n### User: x</turn>\n", ": ", "\\\\0###\\1", "", "é\x00\n"]
    rows = [(i, k, role, text) for i, text in enumerate(odd) for k, role in enumerate(["user", "assistant", "User", "od: d###\\"])]
    for i, r in read(spark, rows).items():
        assert [(t.role, t.text) for t in r.turns] == [("user", odd[i]), ("assistant", odd[i]), ("User", odd[i]), ("od: d###\\", odd[i])]
        assert r.formatted == "".join(s.text for s in r.segments)
        assert not r.valid and r.n_turns == 4


def test_machine_nulls_ties_and_loss(spark):
    got = read(spark, [
        (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"),
        (2, 0, "user", "u"),
        (3, 0, "assistant", "a"), (3, 1, "user", "u"),
        (4, None, None, None), (4, None, None, None),
        (None, 0, "user", "u"), (None, 1, "assistant", "b"),
    ])
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True}
    assert [s.text for s in got[1].segments if s.loss] == ["a"]
    assert [(t.role, t.text) for t in got[4].turns] == [("", "")] * 2


def test_empty_table_and_own_template(spark):
    assert read(spark, []) == {}
    df = spark.createDataFrame([(1, 0, "q", "x<|e|>")], "conv_id long, turn long, role string, text string")
    own = Template(head="<|b|>", after_role="|", end="<|e|>", roles={"q": "Q"}, loss_roles=("q",), controls=("<|b|>", "<|e|>", "|"), moves={"start": {"q": "q"}}, final=("q",))
    r = format_chats(df, own).withColumn("turns", read_chats(F.col("formatted"), own)).first()
    assert r.valid and r.formatted == "<|b|>Q|x\\1<|e|>" and [(x.role, x.text) for x in r.turns] == [("q", "x<|e|>")]


def test_many_controls_and_marks_with_pattern_signs(spark):
    controls = ("(+)", "[.*]", "$", *(f"<{k}>" for k in range(12)))
    own = Template(head="(+)", after_role="$", end="[.*]", controls=controls, escape="^")
    odd = "".join(controls) + "^0^^a^b<11><1>" + "x" * 300_000
    df = spark.createDataFrame([(1, 0, "user", odd), (1, 1, "^r$", odd[::-1])], "conv_id long, turn long, role string, text string")
    r = format_chats(df, own).withColumn("turns", read_chats(F.col("formatted"), own)).first()
    assert [(x.role, x.text) for x in r.turns] == [("user", odd), ("^r$", odd[::-1])]
    with pytest.raises(ValueError):
        Template(end="|")
