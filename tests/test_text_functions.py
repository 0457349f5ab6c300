"""Edge cases for extraction, float parsing, checking and labels (FIXTURES §4).

Expected values follow Python semantics, written out by hand."""
import math

import pytest
from pyspark.sql import functions as F

from qamill.functions import text as T

NBSP, IDEO, LSEP = " ", "　", " "

EXTRACT_CASES = [
    ("a #### 1,234 ", "1234"),
    ("#### 5\r\nfoo", "5"),
    ("####\n\n7", "7"),
    ("#### \n", ""),
    ("####", None),
    ("x 3.5.2 y", "2"),
    ("costs $1,200.", "1200."),
    ("5-3", "-3"),
    ("end -3,", "-3"),
    ("#### 1\n#### 2", "1"),
    (f"#### nbsp{NBSP}9{NBSP}", f"nbsp{NBSP}9"),
    (f"#### 4{LSEP}x", f"4{LSEP}x"),
    (f"#### {IDEO} 8", "8"),
    ("answer ٣ apples", "٣"),
    ("no idea", None),
    ("", None),
]


def test_extract_answer(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXTRACT_CASES)], "i int, t string")
    got = dict(df.select("i", T.extract_answer(F.col("t")).alias("e")).collect())
    for i, (text, expected) in enumerate(EXTRACT_CASES):
        assert got[i] == expected, repr(text)


def test_strip_is_python_strip(spark):
    ws = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    samples = [ws + "a b" + ws, " x ", "\x1c y\x1f", "z"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in df.select(T.py_strip("t")).collect()]
    assert got == [s.strip() for s in samples]


PARSES = ["1e5", "1_000", " 12 ", "72.", ".5", "1.e3", "1e1_0", "-0", "inf", "Infinity", "1e400",
          "-inf", "NaN", "+1.5E-3", "\u0663", "\u0661\u0662.\uff15"]
FAILS = ["", "1d", "1f", "0x10", "1__0", "_1", "1_", "1._5", ".", "e5", "+-1", "--3", "$5", "18%", "3/4"]


def test_py_float(spark):
    cases = PARSES + FAILS
    df = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i int, s string")
    got = dict(df.select("i", T.py_float(F.col("s")).alias("v")).collect())
    for i, s in enumerate(cases):
        try:
            expected = float(s)
        except ValueError:
            expected = None
        if expected is None:
            assert got[i] is None, s
        elif math.isnan(expected):
            assert math.isnan(got[i]), s
        else:
            assert got[i] == expected, s


CHECK_CASES = [
    (None, "5", False),
    ("72.", "72", True),
    ("1e2", "100", True),
    ("nan", "nan", False),
    ("1000", "1,000", False),
    ("5", "text #### 5", True),
    ("$5", "$5 ", True),
    ("", "#### ", True),
    ("-0", "0", True),
]


def test_check_answer(spark):
    df = spark.createDataFrame([(i, e, g) for i, (e, g, _) in enumerate(CHECK_CASES)],
                               "i int, e string, g string")
    got = dict(df.select("i", T.check_answer(F.col("e"), F.col("g")).alias("c")).collect())
    for i, (e, g, expected) in enumerate(CHECK_CASES):
        assert got[i] is expected, (e, g)


def test_gold_select(spark):
    df = spark.createDataFrame([(None, "full"), ("", "full"), ("7", "full")], "v string, a string")
    got = [r[0] for r in df.select(T.gold_select(F.col("v"), F.col("a"))).collect()]
    assert got == ["full", "full", "7"]


def test_gold_value_keeps_commas_without_marker(spark):
    df = spark.createDataFrame([(" 1,000 ",), ("x #### 1,000",)], "a string")
    assert [r[0] for r in df.select(T.gold_value(F.col("a"))).collect()] == ["1,000", "1000"]


def test_labels(spark):
    df = spark.createDataFrame(
        [("sft", True, True, True), (None, None, None, False), ("", False, False, None)],
        "m string, c boolean, k boolean, e boolean")
    got = [tuple(r) for r in df.select(T.train_label("m", "c", "k"),
                                       T.full_label("m", "c", "k", "e")).collect()]
    assert got == [("SFT | train:chat | mask_q", "SFT | train:chat | mask_q | eval:chat"),
                   ("? | train:raw", "? | train:raw | eval:raw"),
                   (" | train:raw", " | train:raw | eval:raw")]


def test_prompts(spark):
    df = spark.createDataFrame([("Q?", "A.")], "q string, a string")
    r = df.select(T.raw_prompt("q"), T.raw_text("q", "a"), T.raw_text("q", "a", eos=""),
                  T.chat_text("q"), T.chat_text("q", "a")).first()
    assert r[0] == "Question: Q?\nAnswer: "
    assert r[1] == "Question: Q?\nAnswer: A.<|im_end|>"
    assert r[2] == "Question: Q?\nAnswer: A."
    assert r[3] == "<|im_start|>user\nQ?<|im_end|>\n<|im_start|>assistant\n"
    assert r[4] == "<|im_start|>user\nQ?<|im_end|>\n<|im_start|>assistant\nA.<|im_end|>\n"


@pytest.mark.parametrize("path,expected", [("configs/grpo_sft.yaml", "grpo"),
                                           ("x/sft.yaml", "sft"), ("custom.yaml", None)])
def test_infer_method(spark, path, expected):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(T.infer_method("p")).first()[0] == expected


def test_percent_text_rounds_like_python(spark):
    from qamill.functions import fmt
    values = [0.05125, 0.0525, 1 / 3, 2 / 3, 0.5, 0.0, 1.0, 0.123456, 7 / 4000]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: (r.p2, r.p1) for r in df.select("i", fmt.percent("v", 2).alias("p2"),
                                                 fmt.percent("v", 1).alias("p1")).collect()}
    for i, v in enumerate(values):
        assert got[i] == (f"{v:.2%}", f"{v:.1%}"), v
    # Java's half-up formatting of the same value differs here, which is why
    # this column is formatted in Python
    java = df.select(F.format_string("%.2f%%", F.col("v") * 100).alias("j")).collect()
    assert any(r.j != f"{v:.2%}" for r, v in zip(java, values))
