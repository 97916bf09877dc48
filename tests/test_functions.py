"""Column functions against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from sheafline.functions import arrays, naming, numbers, text

REPLIES = [
    ("1", 1, 1), ("10", 1, 1), ("2010", 0, 0), ("answer: 1", 1, 1), ("0 Error", 0, 0),
    ("unsure", 0, None), ("", 0, None), (None, 0, None),
]


def column(spark, values, expr, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}").select("i", expr.alias("x"))
    return [r["x"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def test_label_parsing(spark):
    values = [r for r, _, _ in REPLIES]
    assert column(spark, values, text.parse_label("v")) == [a for _, a, _ in REPLIES]
    assert column(spark, values, text.parse_label_or_null("v")) == [b for _, _, b in REPLIES]


def test_spans(spark):
    values = ["a <b> c", "<<x> y", "a <b\nc> d", "a <b\rc> d", "a <b c> d", "<>", "<> <b>", "none", None]

    def first(v):
        m = v and re.search(r"<(.+?)>", v)
        return m.group(1) if m else None

    assert column(spark, values, text.first_span("v")) == [first(v) for v in values]
    assert column(spark, values, text.strip_marks("v")) == [v and re.sub("[<>]", "", v) for v in values]
    groups = [None if v is None else re.findall(r"<([^<>]+)>", v) for v in values]
    assert column(spark, values, text.marked_groups("v")) == groups


def test_whitespace(spark):
    values = ["\n\n a \n", "\r\na\r\n", " \t a  b　\x1c", "", None]
    assert column(spark, values, text.strip_newlines("v")) == [str("nan" if v is None else v).strip("\n") for v in values]
    assert column(spark, values, text.strip_space("v")) == [v and v.strip() if v is not None else None for v in values]
    assert column(spark, values[:-1], text.word_count("v")) == [len(v.split()) for v in values[:-1]]


def test_prompts(spark):
    one = lambda e: column(spark, ["t"], e)[0]
    assert one(text.render_prompt("v", "sys")) == "sys\n\nUser: Text: t\nAssistant:"
    assert one(text.render_prompt("v", "sys", F.lit(1))) == "sys\n\nUser: Text: t\nAssistant: 1"
    assert one(text.render_prompt("v")) == "\n\nUser: Text: t\nAssistant:"
    assert one(text.render_prompt("v", "sys", style="plain")) == "sys\n\nUser: t"
    assert one(text.render_prompt("v", style="raw")) == "t"
    assert [tuple(m) for m in one(text.chat_messages("v", "sys"))] == [("system", "sys"), ("user", "t")]
    nested = one(text.chat_messages("v", "sys", nested=True))
    assert nested[1]["content"][0]["type"] == "text" and nested[1]["content"][0]["text"] == "t"
    with pytest.raises(ValueError):
        text.render_prompt("v", style="odd")


def test_replies(spark):
    payloads = [
        '{"output":[{"type":"reasoning"},{"type":"message","content":[{"type":"refusal","text":"no"},{"type":"output_text","text":" 1 \\n"}]}]}',
        '{"output":[{"type":"message","content":[]},{"type":"message","content":[{"type":"output_text","text":"0"}]}]}',
        '{"output":[]}', "{}", "not json", None,
    ]
    assert column(spark, payloads, text.reply_from_json("v")) == ["1", "0", "0 Error", "0 Error", "0 Error", "0 Error"]
    schema = "v array<struct<generated_text:array<struct<role:string,content:string>>>>"
    outputs = [[([("user", "q"), ("assistant", " 1 ")],)], [([],)], []]
    assert column(spark, outputs, text.unwrap_generated("v"), schema) == ["1", "", ""]
    assert column(spark, ["prompt 1\n"], text.completion_suffix("v", F.lit("prompt"))) == ["1"]


def test_round_exact_equals_python(spark):
    values = [k / n for n in range(1, 401) for k in range(n + 1)] + [0.5, 2.5, 1e9 + 0.0005]
    for digits in (2, 3, 4):
        got = column(spark, values, numbers.round_exact(F.col("v"), digits), "v double")
        assert got == [round(v, digits) for v in values]
    assert column(spark, [None], numbers.round_exact(F.col("v"), 3), "v double") == [None]
    large = [float("inf"), float("-inf"), 1e16, -1e300, 2.0**52 / 1000, 2.0**60 + 1]
    assert column(spark, large, numbers.round_exact(F.col("v"), 3), "v double") == [round(v, 3) for v in large]


def test_arrays(spark):
    df = spark.createDataFrame([([5, 1, 2, 3], [-100, 5, 1, 9])], "p array<int>, l array<int>")
    assert tuple(df.select(arrays.shifted_hits(F.col("p"), F.col("l")).alias("h")).first()["h"]) == (2, 3)
    empty = spark.createDataFrame([([], [])], "p array<int>, l array<int>")
    assert tuple(empty.select(arrays.shifted_hits(F.col("p"), F.col("l")).alias("h")).first()["h"]) == (0, 0)


def test_names(spark):
    names = ["finetune-03", "a-3x", "plain", "12", "a-007", "a-", None]
    assert column(spark, names[:-1], naming.trailing_iteration(F.col("v"))) == [3, 0, 0, 12, 7, 0]
    assert column(spark, [7], naming.iteration_name(F.col("v")), "v int") == ["finetune-07"]
    run = naming.run_id(F.lit("p"), F.lit("a/b.c"), F.lit(2), naming.method_name(5, 50), F.col("v"))
    assert column(spark, ["x", "", None], run) == ["Result-x-p-a-b-c-prompt2-m5-n50"] + ["Result-p-a-b-c-prompt2-m5-n50"] * 2
    name = naming.result_name(F.col("v"), F.lit(3))
    assert column(spark, ["r"], name) == ["r-experiment3.xlsx"]
    assert column(spark, ["r.a.xlsx", "r"], naming.metrics_name(F.col("v"))) == ["r.a.csv", "r.csv"]


def test_row_local_functions_on_a_stream(spark, tmp_path):
    """The same expressions work on a streaming DataFrame."""
    spark.createDataFrame([("a <b> c", "1 yes")], "text string, reply string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, reply string").parquet(str(tmp_path / "in"))
    out = stream.select(text.first_span("text").alias("span"), text.parse_label("reply").alias("label"))
    query = out.writeStream.format("memory").queryName("rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM rows").collect()] == [("b", 1)]
