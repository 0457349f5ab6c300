"""Tables bucketed by sample: no shuffle on either side, one gold row a sample."""
from qamill.operators import scoring
from qamill.sources import bucketed


def _tables(spark, scratch, name, outputs, samples, buckets=4):
    bucketed.write_outputs(outputs, f"{name}_o", f"{scratch}/o", buckets)
    bucketed.write_gold(samples, f"{name}_g", f"{scratch}/g", buckets=buckets)
    return bucketed.reward_tables(spark, f"{name}_o", f"{name}_g")


def test_join_and_aggregate_read_the_buckets_as_they_lie(spark, scratch):
    outputs = spark.createDataFrame([(i % 50, "r", f"#### {i % 7}") for i in range(400)],
                                    "sample_id long, run_id string, model_output string")
    samples = spark.createDataFrame([(i, f"#### {i % 7}", str(i % 7)) for i in range(50)],
                                    "sample_id long, answer string, answer_value string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        means = scoring.reward_by_prompt(_tables(spark, scratch, "buckets_plan", outputs, samples))
        plan = means._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        got = {(r.sample_id, r.n_completions, r.mean_reward) for r in means.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plain = scoring.reward_by_prompt(scoring.reward(outputs, samples))
    assert got == {tuple(r) for r in plain.collect()} and len(got) == 50


def test_one_gold_row_a_sample(spark, scratch):
    """A repeated sample id does not double rewards; null ids and samples without outputs or gold."""
    outputs = spark.createDataFrame([(1, "#### 5", "x"), (2, "#### 6", "y"), (3, "#### 7", "z"), (None, "#### 5", "n")],
                                    "sample_id long, model_output string, run_id string")
    samples = spark.createDataFrame(
        [(1, "#### 5", "5"), (1, "#### 5", "5"), (1, "#### 9", "9"), (2, "#### 5", "5"), (4, "a", "a"), (None, "#### 5", "5")],
        "sample_id long, answer string, answer_value string")
    got = sorted((str(r.sample_id), r.reward) for r in
                 _tables(spark, scratch, "buckets_dup", outputs, samples).collect())
    assert got == [("1", 1.0), ("2", 0.0), ("3", 0.0), ("None", 0.0)]
    again = _tables(spark, scratch, "buckets_dup", outputs.limit(0), samples.limit(0))
    assert again.count() == 0
