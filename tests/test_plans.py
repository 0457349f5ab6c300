"""Plan-shape checks: the physical properties the scale design relies on."""
import re

from qamill.plans import catalog as C
from tests.conftest import SF_SMALL


def _plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df = C.QUERIES[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()   # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_run_summary_pre_aggregates_and_prunes(spark):
    plan = _plan(spark, "run_summary")
    assert "partial_count" in plan and "Window" not in plan
    schema = re.search(r"lineitem.parquet.*ReadSchema: struct<(.*?)>", plan).group(1)
    assert schema.count(":") < 11     # not every lineitem column is decoded


def test_hot_samples_can_be_split(spark):
    """Without broadcasts the sample join feeds no window on the same key, and the
    numbering joins back on keys that identify a row."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for name in ("check_answer", "reward", "extract_answer"):
            plan = _plan(spark, name)
            assert "SortMergeJoin" in plan
            assert not re.search(r"Window \[row_number\(\) windowspecdefinition\(sample_id", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_extraction_comes_before_numbering(spark):
    plan = _plan(spark, "extract_marker")
    top = plan.split("regexp_substr")[0]
    assert "SortMergeJoin" in top or "BroadcastHashJoin" in top
    assert "l_orderkey" in top  # the join back on the line item's keys is above the extraction


def test_batches_come_from_keys(spark):
    df = C.QUERIES["batch_assign"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "Generate" not in plan


def test_no_scan_or_definition_is_kept(spark):
    from qamill.sources import tables
    assert not [n for n, v in vars(tables).items() if isinstance(v, dict) and not n.startswith("__")]


def test_detail_index_has_no_run_window(spark):
    plan = _plan(spark, "score_details")
    assert not re.search(r"Window \[row_number\(\).*partitionBy.*run_id", plan)
    assert "ExistingRDD" in plan      # positions come from the checkpointed range slices


def test_eval_prompts_use_no_cross_join(spark):
    plan = _plan(spark, "eval_prompts")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_number_texts_are_cleaned_once(spark):
    """The digit table stands in the plan once a side, not once for every branch of the parser."""
    plan = C.QUERIES["check_answer"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("٠") == 2


def test_requested_splits_prune_at_run_time(spark):
    plan = _plan(spark, "split_requested")
    assert re.search(r"PartitionFilters: \[[^\]]*dynamicpruning", plan)
