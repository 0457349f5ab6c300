"""File round trips: results tables, summaries scattered over run folders,
nested result documents, comparison CSV, run metadata."""
import json
import os

import pytest
from pyspark.sql import functions as F

from qamill.operators import report
from qamill.plans import catalog as C
from qamill.sources import documents, files
from tests.conftest import SF_SMALL


def _write_summary_dirs(base, runs):
    for r in runs:
        d = os.path.join(base, r["name"])
        os.makedirs(d, exist_ok=True)
        with open(os.path.join(d, "summary.json"), "w") as f:
            json.dump(r["summary"], f, indent=2)
    os.makedirs(os.path.join(base, "no_summary_here"), exist_ok=True)


def test_results_tables_roundtrip(spark, scratch):
    summ = C.run_summary(spark, SF_SMALL)
    det = C.score_details(spark, SF_SMALL)
    files.write_results(summ, det, scratch)
    s, d = files.read_results(spark, scratch)
    assert s.count() == summ.count() and d.count() == det.count()
    one = summ.first().run_id
    s1, d1 = files.read_results(spark, scratch, run_id=one)
    assert {r.run_id for r in d1.select("run_id").distinct().collect()} == {one}
    assert d1.count() == det.where(F.col("run_id") == one).count()


def test_summary_discovery(spark, scratch):
    runs = [{"name": "b_run", "summary": {"experiment_name": "b", "train_method": "sft",
                                           "eval_chat_template": True, "total_samples": 4,
                                           "correct": 1, "accuracy": 0.25}},
            {"name": "a_run", "summary": {"experiment_name": "a", "train_method": "grpo",
                                           "train_chat_template": True,
                                           "eval_chat_template": False, "total_samples": 2,
                                           "correct": 2, "accuracy": 1.0}}]
    _write_summary_dirs(scratch, runs)
    # deeper directories and files of the folder itself are no runs
    _write_summary_dirs(os.path.join(scratch, "a_run"), runs[:1])
    with open(os.path.join(scratch, "summary.json"), "w") as f:
        json.dump(runs[0]["summary"], f)
    df = files.read_summary_files(spark, scratch)
    got = sorted((os.path.basename(r.eval_dir), r.experiment_name, r.train_chat_template)
                 for r in df.collect())
    assert got == [("a_run", "a", True), ("b_run", "b", None)]
    dirs = [os.path.basename(r.eval_dir) for r in files.discover_runs(spark, scratch).collect()]
    assert dirs == ["a_run", "b_run"]
    labelled = report.with_labels(df).orderBy("eval_dir").collect()
    assert [r.label for r in labelled] == ["GRPO | train:chat | eval:raw", "SFT | train:raw | eval:chat"]


def test_discovery_of_nothing_is_empty(spark, scratch):
    os.makedirs(os.path.join(scratch, "empty_run"))
    with open(os.path.join(scratch, "empty_run", "other.json"), "w") as f:
        f.write("{}")
    df = files.read_summary_files(spark, scratch)
    assert df.count() == 0 and "accuracy" in df.columns


def test_result_documents(spark, scratch):
    doc = {"summary": {"experiment_name": "e1", "total_samples": 2, "correct": 1, "accuracy": 0.5},
           "details": [{"index": 0, "question": "q0", "gold_answer": "#### 1", "gold_value": "1",
                        "model_output": "#### 1", "extracted_answer": "1", "correct": True},
                       {"index": 1, "question": "q1", "gold_answer": "#### 2", "gold_value": "2",
                        "model_output": "no", "extracted_answer": None, "correct": False}]}
    d = os.path.join(scratch, "e1_eval_raw")
    os.makedirs(d)
    with open(os.path.join(d, "results.json"), "w") as f:
        json.dump(doc, f, indent=2)
    rows = files.read_result_documents(spark, scratch).orderBy("index").collect()
    assert [(r["index"], r.extracted_answer, r.correct) for r in rows] == [(0, "1", True), (1, None, False)]


def test_summary_json_and_csv(spark, scratch):
    runs = C._runs(spark, SF_SMALL)
    files.write_summaries_json(runs, os.path.join(scratch, "summaries"))
    back = files.read_summary_files(spark, os.path.join(scratch, "summaries"))
    assert back.count() == runs.count() == files.discover_runs(spark, scratch + "/summaries").count()
    comp = report.comparison(runs)
    files.write_comparison_csv(comp, os.path.join(scratch, "csv"), single_file=True)
    parts = [p for p in os.listdir(os.path.join(scratch, "csv")) if p.endswith(".csv")]
    assert len(parts) == 1
    with open(os.path.join(scratch, "csv", parts[0])) as f:
        header = f.readline().strip().split(",")
        body = f.read()
    assert header[:2] == ["run_id", "experiment_name"] and "label" in header
    assert "true" in body or "false" in body


def test_run_info_roundtrip(spark, scratch):
    info = spark.createDataFrame(
        [("models/N_O_0", "configs/grpo.yaml", ("gsm8k", True, None, "out"), None)],
        files.RUN_INFO_FILE_SCHEMA)
    files.write_run_info(info, os.path.join(scratch, "info"))
    back = files.read_run_info(spark, os.path.join(scratch, "info")).first()
    assert back.model_path == "models/N_O_0" and back.use_chat_template is True
    assert back.mask_question is None


def test_split_partitioned_samples(spark, scratch):
    qa = C.qa_scan(spark, SF_SMALL)
    path = os.path.join(scratch, "samples")
    files.write_samples(qa, path)
    test = files.read_split(spark, path, "test")
    assert test.count() == qa.where(F.col("split") == "test").count()
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "(split#" in plan


# --- sinks keep other runs ------------------------------------------------------------------

SUMMARY = "run_id string, experiment_name string, train_method string, train_chat_template boolean, " \
          "train_mask_question boolean, eval_chat_template boolean, model_path string, task string, " \
          "total_samples bigint, correct bigint, accuracy double"
DETAIL = "run_id string, index bigint, question string, gold_answer string, gold_value string, " \
         "model_output string, extracted_answer string, correct boolean"


def _summary(spark, *runs, correct=1):
    return spark.createDataFrame([(r, r.lower(), "sft", True, None, False, f"m/{r}", "t", 2, correct, correct / 2)
                                  for r in runs], SUMMARY)


def _details(spark, run, n, output="é \"x\"\n"):
    return spark.createDataFrame([(run, k, f"q{k}", "a", "", output, None, k % 2 == 0) for k in range(n)], DETAIL)


def test_second_run_keeps_the_first_and_replaces_itself(spark, scratch):
    for run, n in (("A", 3), ("B", 4), ("B", 5)):
        files.write_results(_summary(spark, run, correct=n), _details(spark, run, n), f"{scratch}/r")
        files.write_summaries_json(_summary(spark, run, correct=n), f"{scratch}/s")
        files.write_details_json(_details(spark, run, n), f"{scratch}/d")
        info = spark.createDataFrame([(f"m/{run}", f"{n}", None, None)],
                                     "model_path string, original_config_path string, cli_args struct<task:string>, "
                                     "timestamp timestamp")
        files.write_run_info(info, f"{scratch}/i")
    s, d = files.read_results(spark, f"{scratch}/r")
    assert sorted((r.run_id, r.correct) for r in s.collect()) == [("A", 3), ("B", 5)]
    assert {r.run_id: r["count"] for r in d.groupBy("run_id").count().collect()} == {"A": 3, "B": 5}
    assert sorted((r.experiment_name, r.correct) for r in files.read_summary_files(spark, f"{scratch}/s").collect()) \
        == [("a", 3), ("b", 5)]
    assert files.read_detail_files(spark, f"{scratch}/d").count() == 8
    assert sorted((r.model_path, r.original_config_path) for r in files.read_run_info(spark, f"{scratch}/i").collect()) \
        == [("m/A", "3"), ("m/B", "5")]


def test_run_info_tells_absent_flags_from_nulls(spark, scratch):
    os.makedirs(f"{scratch}/x")
    with open(f"{scratch}/x/part-0.json", "w") as f:
        for doc in ({"model_path": "a", "cli_args": {"use_chat_template": None}, "timestamp": "2024-01-02T03:04:05"},
                    {"model_path": "b", "cli_args": {"mask_question": True}}, {"model_path": "c"}):
            f.write(json.dumps(doc) + "\n")
    got = {r.model_path: (r.use_chat_template, r.mask_question, r.timestamp is not None)
           for r in files.read_run_info(spark, scratch).collect()}
    assert got == {"a": (None, False, True), "b": (False, True, False), "c": (False, False, False)}


# --- summaries of any keys --------------------------------------------------------------------

def test_summary_union_keeps_unknown_keys(spark, scratch):
    _write_summary_dirs(scratch, [
        {"name": "a", "summary": {"accuracy": 0.5, "total_samples": 4, "temperature": 0.7, "Seed": 1}},
        {"name": "b", "summary": {"accuracy": 1, "task": "t", "nested": {"x": [1, None]}, "mixed": 1, "seed": 2}},
        {"name": "c", "summary": {"mixed": "one", "a.b 'c\"": True, "accuracy": None, "Accuracy": 0.25}}])
    got = files.read_summary_union(spark, scratch)
    assert got.columns == files.SUMMARY_SCHEMA.fieldNames() + \
        ["Accuracy_2", "Seed", "a.b 'c\"", "mixed", "nested", "seed_2", "temperature", "eval_dir"]
    assert dict(got.dtypes)["temperature"] == "double" and dict(got.dtypes)["Seed"] == "bigint"
    rows = {r.eval_dir[-1]: r for r in got.collect()}
    assert [rows[k].accuracy for k in "abc"] == [0.5, 1.0, None] and rows["c"].Accuracy_2 == 0.25
    assert [rows[k].temperature for k in "abc"] == [0.7, None, None]
    assert [rows[k].mixed for k in "abc"] == [None, "1", "one"]
    assert rows["b"].nested == '{"x":[1,null]}' and rows["c"]["a.b 'c\""] is True
    assert (rows["a"].Seed, rows["b"].seed_2, rows["a"].total_samples) == (1, 2, 4)


def test_summary_union_without_files_or_objects(spark, scratch):
    got = files.read_summary_union(spark, scratch)
    assert got.columns == [*files.SUMMARY_SCHEMA.fieldNames(), "eval_dir"] and got.count() == 0
    assert [f.dataType for f in got.schema.fields[:-1]] == [f.dataType for f in files.SUMMARY_SCHEMA.fields]
    os.makedirs(f"{scratch}/x")
    with open(f"{scratch}/x/summary.json", "w") as f:
        f.write("[1, 2]")
    assert files.read_summary_union(spark, scratch).drop("eval_dir").collect()[0] == (None,) * 10


# --- nested documents ---------------------------------------------------------------------------

def _document(folder):
    with open(f"{folder}/results.json") as f:
        return json.load(f)


def test_documents_hold_all_details_in_order(spark, scratch):
    both = _details(spark, "A", 500).unionByName(_details(spark, "B/1 ü", 3)).unionByName(_details(spark, "gone", 2))
    documents.write_result_documents(_summary(spark, "A", "B/1 ü", "empty"), both.repartition(7), scratch)
    doc = _document(documents.document_folder(scratch, "A"))
    assert [x["index"] for x in doc["details"]] == list(range(500))
    assert doc["summary"]["experiment_name"] == "a" and doc["summary"]["train_mask_question"] is None
    assert doc["details"][1] == {"index": 1, "question": "q1", "gold_answer": "a", "gold_value": "",
                                 "model_output": "é \"x\"\n", "extracted_answer": None, "correct": False}
    assert _document(documents.document_folder(scratch, "empty"))["details"] == []
    assert sorted(os.listdir(scratch)) == ["A", "B%2F1%20%C3%BC", "empty"]
    back = files.read_result_documents(spark, scratch)
    assert sorted(map(tuple, back.select(*files.DETAIL_SCHEMA.fieldNames()).collect()), key=str) == \
        sorted(map(tuple, both.where("run_id != 'gone'").select(*files.DETAIL_SCHEMA.fieldNames()).collect()), key=str)
    # one run again: its document is replaced, the others stay
    documents.write_result_documents(_summary(spark, "A"), _details(spark, "A", 2), scratch)
    assert len(_document(documents.document_folder(scratch, "A"))["details"]) == 2
    assert len(_document(documents.document_folder(scratch, "B/1 ü"))["details"]) == 3


def test_own_documents_are_read_by_lines_and_others_whole(spark, scratch):
    documents.write_result_documents(_summary(spark, "A", "B"), _details(spark, "A", 40), scratch)
    odd = {"two": '{"summary": {"experiment_name": "o"}, "details": [\n{"index": 1, "x": [{"y": 1},\n{"z": 1}]}\n]}\n',
           "one": '{"summary": {"experiment_name": "o"}, "details": [{"index": 2}, {"index": 3}]}',
           "both": '{"summary": {"experiment_name": "o"}, "details": [\n{"index": 4}, {"index": 5},\n{"index": 6}\n]}\n'}
    for name, text in odd.items():
        os.makedirs(f"{scratch}/{name}")
        with open(f"{scratch}/{name}/results.json", "w") as f:
            f.write(text)
    back = files.read_result_documents(spark, scratch)
    assert sorted((r.eval_dir.rsplit("/", 1)[1], r.experiment_name, r["index"]) for r in back.collect()) == \
        [("A", "a", k) for k in range(40)] + [("both", "o", k) for k in (4, 5, 6)] + [("one", "o", 2), ("one", "o", 3), ("two", "o", 1)]
    only = files.read_result_documents(spark, f"{scratch}/A")
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "FileScan json" not in plan and only.count() == 40


def test_results_are_scored_once(spark, monkeypatch):
    calls, score = [], C.scoring.score
    monkeypatch.setattr(C.scoring, "score", lambda *a, **k: calls.append(1) or score(*a, **k))
    assert C.results_roundtrip(spark, SF_SMALL).count() == C.score_details(spark, SF_SMALL).count()
    assert len(calls) == 2  # the second for the count


def test_a_failed_document_write_leaves_nothing(spark, scratch):
    bad = _details(spark, "A", 50).withColumn(
        "question", F.when(F.col("index") == 40, F.raise_error(F.lit("broken"))).otherwise(F.col("question")))
    with pytest.raises(Exception, match="broken"):
        documents.write_result_documents(_summary(spark, "A"), bad, scratch)
    assert os.listdir(scratch) == []
