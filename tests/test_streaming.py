"""Scoring a stream of outputs gives the batch answer."""
import os
import uuid

from qamill.operators import scoring
from qamill.operators.tasks import GSM8K
from qamill.sources import fixtures
from qamill.streaming.scoring import start_scoring
from tests.conftest import SF_SMALL


def test_stream_scoring_matches_batch(spark, scratch):
    outs = fixtures.outs(spark, SF_SMALL).drop(*fixtures.GEN_ORDER).select(
        "sample_id", "run_id", "model_output")
    src = os.path.join(scratch, "incoming")
    outs.write.parquet(src)
    samples = GSM8K.samples(spark, SF_SMALL)
    q = start_scoring(spark, src, outs.schema, samples, os.path.join(scratch, "scored"),
                      name=f"test_{uuid.uuid4().hex}")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    streamed = spark.read.parquet(os.path.join(scratch, "scored")).select(
        "sample_id", "run_id", "model_output", "extracted_answer", "correct")
    batch = scoring.score(outs, samples).select(
        "sample_id", "run_id", "model_output", "extracted_answer", "correct")
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_stream_run_totals_match_batch(spark, scratch):
    """Running per-run totals over a stream of output files (state = one row
    per run) end equal to the batch summary."""
    from qamill.operators import summary
    from qamill.streaming.scoring import score_stream, summary_stream
    outs = fixtures.outs(spark, SF_SMALL).drop(*fixtures.GEN_ORDER).drop("model_path")
    src = os.path.join(scratch, "incoming2")
    # two arrivals
    outs.where("eval_chat_template").write.parquet(os.path.join(src, "a"))
    outs.where("not eval_chat_template").write.parquet(os.path.join(src, "b"))
    samples = GSM8K.samples(spark, SF_SMALL)
    stream = (spark.readStream.schema(outs.schema).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", 1).parquet(src))
    scored = score_stream(stream, samples)
    totals = summary_stream(scored.withColumn("model_path", scored["run_id"]))
    name = f"totals_{uuid.uuid4().hex}"
    q = (totals.writeStream.format("memory").queryName(name).outputMode("complete")
         .option("checkpointLocation", os.path.join(scratch, "ckpt_totals")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.run_id: (r.total_samples, r.correct) for r in spark.table(name).collect()}
    batch = summary.run_summary(scoring.score(outs.withColumn("model_path", outs["run_id"]),
                                              samples))
    expected = {r.run_id: (r.total_samples, r.correct) for r in batch.collect()}
    assert got == expected


def test_python_task_scores_a_stream(spark, scratch):
    from qamill.operators.tasks import get_task
    task = get_task("fractions")
    outs = fixtures.fraction_outs(spark, SF_SMALL).select("sample_id", "model_output")
    src = os.path.join(scratch, "fractions")
    outs.write.parquet(src)
    samples = task.samples(spark, SF_SMALL)
    q = start_scoring(spark, src, outs.schema, samples, os.path.join(scratch, "scored_fractions"),
                      name=f"test_{uuid.uuid4().hex}", task=task)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    streamed = spark.read.parquet(os.path.join(scratch, "scored_fractions")).groupBy("correct").count().collect()
    batch = scoring.score(outs, samples, task).groupBy("correct").count().collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch)) and len(batch) == 2
