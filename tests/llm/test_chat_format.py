from pyspark.sql import functions as F

from geotables.llm.chat_format import format_chat, read_back

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string"


def rows_of(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {r.conv_id: r for r in read_back(format_chat(df)).collect()}


def test_round_trip_merging_and_mask(spark):
    odd = "\\0 \\1<s>[INST] </s>[/INST][INST]\\"
    out = rows_of(spark, [(1, 2, "assistant", "b" + odd), (1, 0, "user", odd), (1, 3, "assistant", "c\nd"),
                          (1, 1, "assistant", ""), (2, 0, "user", "hé")])
    assert [tuple(t) for t in out[1].turns] == [("user", odd), ("assistant", ""), ("assistant", "b" + odd),
                                                ("assistant", "c\nd")]
    assert out[1].loss_text == "b" + odd + "c\nd"
    assert out[1].n_blocks == 2 and out[1].formatted.count("</s>") == 2
    assert out[2].loss_text == "" and out[2].formatted == "<s>user[INST]hé[/INST]</s>"


def test_nulls_ties_and_empty(spark):
    out = rows_of(spark, [(None, 1, None, None), (None, None, "assistant", "x"), (3, 1, "user", "b"),
                          (3, 1, "user", "a"), (3, 1, "user", "a")])
    assert [tuple(t) for t in out[None].turns] == [("assistant", "x"), ("", "")]
    assert [t.text for t in out[3].turns] == ["a", "a", "b"]
    assert rows_of(spark, []) == {}


def test_long_conversation(spark):
    out = rows_of(spark, [(1, i, "assistant" if i % 3 else "user", f"t{i}" * 50) for i in range(500)])
    assert len(out[1].turns) == 500
    assert out[1].loss_text == "".join(f"t{i}" * 50 for i in range(500) if i % 3)


def test_no_python_in_plan(spark):
    df = format_chat(spark.createDataFrame([(1, 0, "user", "x", "y")], SCHEMA))
    assert "Python" not in df._jdf.queryExecution().toString().replace("PythonSQL", "")
    assert df.select(F.col("formatted")).first()[0] == "<s>user[INST]x[/INST]</s>"
