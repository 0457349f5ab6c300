"""Properties of extraction, checking and array functions on generated text, stated
without restating how they work: what must not change when a text is changed."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qamill.functions import text as T
from qamill.operators import scoring

LETTERS = st.text(alphabet="abc xyz.,!\n\t\u00a0", max_size=12)
NUMBER = st.integers(min_value=-10**9, max_value=10**9)
GAP = st.text(alphabet=" ,\t\u3000", max_size=3)


def verdicts(spark, rows):
    """(output, gold answer) pairs through the scoring join."""
    outs = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)],
                                 "sample_id long, model_output string")
    samples = spark.createDataFrame([(i, g, None) for i, (_, g) in enumerate(rows)],
                                    "sample_id long, answer string, answer_value string")
    got = {r.sample_id: r.correct for r in scoring.score(outs, samples).collect()}
    return [got[i] for i in range(len(rows))]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(LETTERS, NUMBER, GAP, GAP), min_size=250, max_size=250))
def test_a_marked_number_is_right_however_it_is_dressed(spark, cases):
    rows = []
    for words, n, before, after in cases:
        gold = f"{words}\n#### {n}"
        rows += [(f"{words}\n#### {before}{n}{after}", gold),          # spaces and commas around it
                 (f"#### {n:,}", gold),                                 # thousands commas inside it
                 (f"#### {n}\n{words} 77 #### 3", gold),                # what follows the line
                 (f"{words} {n}.0" if n >= 0 else f"#### {n}.0", gold)]  # another spelling
    assert all(verdicts(spark, rows))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(LETTERS, NUMBER, st.integers(1, 10**6)), min_size=250, max_size=250))
def test_another_number_is_wrong(spark, cases):
    rows = [(f"{words}\n#### {n + d}", f"#### {n}") for words, n, d in cases]
    rows += [(words, f"#### {n}") for words, n, _ in cases]  # no number at all
    assert not any(verdicts(spark, rows))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text(alphabet="0123456789,.- ab", max_size=15), LETTERS),
                min_size=300, max_size=300))
def test_text_without_digits_leaves_the_last_number(spark, cases):
    df = spark.createDataFrame([(i, a, a + " " + b) for i, (a, b) in enumerate(cases)],
                               "i int, a string, b string")
    same = df.select(T.last_number("a").eqNullSafe(T.last_number("b")).alias("same"))
    assert same.where(~F.col("same")).count() == 0


ints = st.lists(st.integers(min_value=0, max_value=5), max_size=12)


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(ints, ints, ints, st.integers(min_value=0, max_value=14)),
                min_size=300, max_size=300))
def test_array_functions(spark, cases):
    from qamill.functions import arrays as A
    rows = [(i, shared + [8] + p, shared + [9] + f, len(shared), w)
            for i, (shared, p, f, w) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, p array<int>, f array<int>, n int, w int")
    out = df.select(
        "i", A.common_prefix_len("p", "f").alias("lcp"),
        A.masked_labels("f", A.common_prefix_len("p", "f")).alias("lab"),
        A.pad_right("f", F.col("w"), 0).alias("right"),
        A.pad_left("f", F.greatest(F.col("w"), F.size("f")), 0).alias("left"),
        A.truncate("f", F.col("w")).alias("cut"),
        A.completion_slice(F.concat("p", "f"), F.lit(0), F.size("p")).alias("comp"))
    got = {r.i: r for r in out.collect()}
    for i, p, f, n, w in rows:
        r = got[i]
        assert r.lcp == n and r.lab == [-100] * n + f[n:]
        assert r.right == (f + [0] * w)[:w] and r.cut == f[:w]
        assert r.left == [0] * (max(w, len(f)) - len(f)) + f and r.comp == f
