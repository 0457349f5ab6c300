import pytest
from pyspark.sql import functions as F

from qamill.functions import text as T
from qamill.operators import scoring
from qamill.operators.tasks import GSM8K, TaskSpec, get_task, register_task


def test_unknown_task_lists_available():
    with pytest.raises(KeyError, match="nope.*gsm8k"):
        get_task("nope")


def test_second_task_plugs_into_scoring(spark):
    """A task with its own extraction rule (last word, compared as text)."""
    def raw(spark_, _d):
        return spark_.createDataFrame([(1, "test", "q", "Paris"), (2, "test", "q2", "Rome")],
                                      "sample_id long, split string, question string, answer string")

    spec = TaskSpec(name="capitals", raw_samples=raw,
                    extract=lambda c: F.try_element_at(F.split(T.py_strip(c), " "), F.lit(-1)),
                    gold_value=T.py_strip, check_parsed=T.check_parsed,
                    to_number=lambda c: F.lit(None).cast("double"))
    register_task(spec)
    task = get_task("capitals")
    outs = spark.createDataFrame([(1, 1, "it is Paris"), (2, 1, "it is Milan"), (3, 1, "x")],
                                 "sample_id long, gen_no long, model_output string")
    scored = scoring.score(outs, task.samples(spark, ""), task)
    got = {r.sample_id: r.correct for r in scored.collect()}
    assert got == {1: True, 2: False}


def test_reward_without_gold(spark):
    outs = spark.createDataFrame([(10**9, 1, "#### 5", "r")],
                                 "sample_id long, gen_no long, model_output string, run_id string")
    samples = spark.createDataFrame([], "sample_id long, answer string, answer_value string")
    r = scoring.reward(outs, samples, GSM8K).first()
    assert r.reward == 0.0 and r.gold is None


def test_experiment_selection(spark):
    from qamill.operators import experiments
    from qamill.sources import fixtures
    exps = fixtures.experiments(spark)
    picked = experiments.select_experiments(exps, ["grpo_no_chat", "nope"])
    assert [r.name for r in picked.collect()] == ["grpo_no_chat"]
    with pytest.raises(ValueError, match="grpo_no_chat"):
        experiments.select_experiments(exps, ["nope"])


def test_right_answers_with_outer_commas_score(spark):
    outs = spark.createDataFrame(
        [(1, "#### 5 ,"), (2, "#### , 5"), (3, "#### 1,234 ,"), (4, "#### 6 ,")],
        "sample_id long, model_output string")
    samples = spark.createDataFrame([(1, "#### 5", "5"), (2, "#### 5", "5"), (3, "#### 1,234", "1234"),
                                     (4, "#### 5", "5")],
                                    "sample_id long, answer string, answer_value string")
    got = {r.sample_id: (r.extracted_answer, r.correct) for r in scoring.score(outs, samples).collect()}
    # the extracted value keeps the space that the removed comma leaves
    assert got == {1: ("5 ", True), 2: (" 5", True), 3: ("1234 ", True), 4: ("6 ", False)}


def test_missing_outputs_count_as_wrong(spark):
    from qamill.operators import summary
    cols = ", ".join(f"{c} string" for c in scoring.RUN_COLS)
    run = tuple("x" for _ in scoring.RUN_COLS)
    scored = spark.createDataFrame([(*run, 1, True)], cols + ", sample_id long, correct boolean")
    asked = spark.range(1, 3)
    r = summary.run_summary(scored, asked).first()
    assert (r.total_samples, r.correct, r.accuracy) == (2, 1, 0.5)


def test_advantage_of_a_single_generation(spark):
    one = spark.createDataFrame([(1, 1, 1.0)], "sample_id long, gen_no long, reward double")
    r = scoring.group_advantage(one).first()
    assert (r.group_std, r.advantage) == (0.0, 0.0)


def test_grid_is_keyed_by_experiment(spark):
    from qamill.operators import experiments
    exps = spark.createDataFrame([("a", "sft", True, False, 0), ("b", "sft", True, False, 1)],
                                 "name string, method string, use_chat_template boolean, "
                                 "mask_question boolean, ordinal int")
    runs = spark.createDataFrame([("a", True, "r1", 0.5)],
                                 "experiment_name string, eval_chat_template boolean, run_id string, "
                                 "accuracy double")
    cells = experiments.grid(exps)
    assert [r.name for r in experiments.with_results(cells, runs).where("run_id = 'r1'").collect()] == ["a"]
    assert sorted((r.name, r.eval_chat_template) for r in experiments.missing(cells, runs).collect()) \
        == [("a", False), ("b", False), ("b", True)]


def test_one_metadata_row_a_model(spark):
    from qamill.operators import summary
    runs = spark.createDataFrame([("m", "", False, False)],
                                 "model_path string, train_method string, train_chat_template boolean, "
                                 "train_mask_question boolean")
    info = spark.createDataFrame([("m", "configs/sft.yaml", None, True), ("m", "configs/sft.yaml", None, True)],
                                 "model_path string, original_config_path string, "
                                 "use_chat_template boolean, mask_question boolean")
    got = summary.enrich_runs(runs, info).collect()
    assert [tuple(r) for r in got] == [("m", "sft", None, True)]  # a stored null stays null


def test_fractions_by_value(spark):
    """The Python task: equal values in any form, texts otherwise; one Python pass a side."""
    task = get_task("fractions")
    outs = [(1, "#### 6/16"), (2, "#### 0.375"), (3, "#### 0.37"), (4, "#### 3/0"), (5, "3"), (6, "no"),
            (7, "#### 1e9"), (8, "#### " + "9" * 6000), (9, None), (10, "#### -.5"), (11, "#### abc")]
    gold = {1: "3/8", 2: "3/8", 3: "3/8", 4: "3/0", 5: "3.0", 6: "3", 7: "1000000000", 8: "9" * 6000, 9: "1",
            10: "-1/2", 11: "abc"}
    o = spark.createDataFrame(outs, "sample_id long, model_output string")
    s = spark.createDataFrame([(k, f"#### {v}", v) for k, v in gold.items()],
                              "sample_id long, answer string, answer_value string")
    scored = scoring.score(o, s, task)
    got = {r.sample_id: r.correct for r in scored.collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: False, 8: True, 9: False,
                   10: True, 11: True}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
