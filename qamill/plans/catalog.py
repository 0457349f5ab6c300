"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the provided tables (through the derived inputs in
``qamill.sources.fixtures``) and returns a DataFrame; nothing is collected and
nothing is kept between calls. Column names match the oracle SQL in
``qamill.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qamill.functions import arrays as A
from qamill.functions import fmt
from qamill.functions import options as O
from qamill.functions import text as T
from qamill.functions import times as TM
from qamill.operators import conversations, experiments, report, scoring, sft, summary, tokens
from qamill.operators.tasks import GSM8K, get_task
from qamill.sources import bucketed, documents, files, fixtures
from qamill.session import checkpoint_dir, materialize
from qamill.sources.tables import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}

# Query parameters (fixed so the oracle can use the same values).
MAX_SAMPLES = 100
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def query(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__] = fn
    return fn


def _qa(spark, d):
    return GSM8K.samples(spark, d)


def _numbered(df, d, *cols, split=None):
    """Row-local results (narrow) with ``gen_no`` joined on last."""
    return fixtures.number_generations(df.select("sample_id", *fixtures.GEN_ORDER, *cols), d, split)


def _test(spark, d):
    return GSM8K.load_split(spark, d, "test")


def _evaluated(spark, d, samples=None, carry=()):
    """The first output of every run and test sample, scored."""
    outputs = scoring.first_outputs(fixtures.outs(spark, d, "test"), fixtures.GEN_ORDER)
    return scoring.score(outputs, _test(spark, d) if samples is None else samples, carry=carry)


def _rewarded(spark, d):
    """Rewards of all outputs for training samples."""
    return scoring.reward(fixtures.outs(spark, d, "train"), GSM8K.load_split(spark, d, "train"))


# --- P1/P2 inputs: question/answer samples -------------------------------------------

@query
def qa_scan(spark, d):
    return _qa(spark, d).select("sample_id", "split", "question", "answer", "answer_value")


@query
def split_filter(spark, d):
    return GSM8K.load_split(spark, d, "test").select("sample_id", "question", "answer",
                                                     "answer_value")


@query
def split_requested(spark, d):
    """Samples written by split, and the splits that the SFT runs ask for read back (pruned at run time)."""
    path = _folder(spark, "samples")
    files.write_samples(_qa(spark, d), path)
    asked = fixtures.requested_splits(spark, d).where(F.col("train_method") == "sft")
    return files.read_requested(spark, path, asked) \
        .select("sample_id", "split", "question", "answer", "answer_value")


@query
def gold_extract(spark, d):
    raw = GSM8K.raw_samples(spark, d)
    return raw.select("sample_id", T.gold_value(F.col("answer")).alias("gold_value"))


@query
def gold_select(spark, d):
    return _qa(spark, d).select("sample_id", T.gold_select(F.col("answer_value"),
                                                           F.col("answer")).alias("gold"))


@query
def raw_prompt(spark, d):
    return _qa(spark, d).select("sample_id", T.raw_prompt("question").alias("prompt"))


@query
def eval_prompts(spark, d):
    """Prompts for both evaluation formats (a generator, not a join)."""
    test = GSM8K.load_split(spark, d, "test")
    both = test.select("sample_id", "question",
                       F.explode(F.array(F.lit(True), F.lit(False))).alias("eval_chat_template"))
    return both.select("sample_id", "eval_chat_template",
                       T.prompt_text("question", "eval_chat_template").alias("prompt"))


@query
def rl_prompt_set(spark, d):
    train = GSM8K.load_split(spark, d, "train")
    return train.select("sample_id", T.raw_prompt("question").alias("prompt"),
                        T.gold_select(F.col("answer_value"), F.col("answer")).alias("answer"))


@query
def max_samples(spark, d):
    """Head limit in sample order: a top-k (TakeOrderedAndProject), not a bare limit."""
    test = GSM8K.load_split(spark, d, "test")
    return test.orderBy("sample_id").limit(MAX_SAMPLES).select("sample_id", "question")


# --- P2 scoring ---------------------------------------------------------------------

@query
def extract_marker(spark, d):
    found = fixtures.outs(spark, d).withColumn("marker_value", T.extract_marker("model_output"))
    return _numbered(found, d, "marker_value").select("sample_id", "gen_no", "marker_value")


@query
def extract_answer(spark, d):
    found = scoring.with_extracted(fixtures.outs(spark, d))
    return _numbered(found, d, "extracted_answer").select("sample_id", "gen_no", "extracted_answer")


@query
def extract_last_number(spark, d):
    docs = read_table(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", T.last_number("text").alias("last_number"))


@query
def check_answer(spark, d):
    """Every output for a test sample, checked."""
    scored = scoring.score(fixtures.outs(spark, d, "test"), _test(spark, d))
    cols = ["run_id", "extracted_answer", "gold", "correct"]
    return _numbered(scored, d, *cols, split="test").select("sample_id", "gen_no", *cols)


@query
def check_fractions(spark, d):
    """A task whose check is Python: exact fractions."""
    task = get_task("fractions")
    scored = scoring.score(fixtures.fraction_outs(spark, d), task.load_split(spark, d, "test"), task)
    return _numbered(scored, d, "extracted_answer", "gold", "correct", split="test") \
        .select("sample_id", "gen_no", "extracted_answer", "gold", "correct")


@query
def score_details(spark, d):
    scored = _evaluated(spark, d, scoring.detail_samples(_test(spark, d)), scoring.DETAIL_CARRY)
    keys = fixtures.outs(spark, d, "test").select("run_id", "sample_id").distinct()
    return scoring.details_from_scored(scored, keys)


@query
def run_summary(spark, d):
    return summary.run_summary(_evaluated(spark, d), _test(spark, d)) \
        .select("run_id", *summary.SUMMARY_COLS)


@query
def run_summary_limited(spark, d):
    """The evaluation of the first ``MAX_SAMPLES`` test samples."""
    asked = _test(spark, d).orderBy("sample_id").limit(MAX_SAMPLES)
    return summary.run_summary(_evaluated(spark, d, asked), asked) \
        .select("run_id", *summary.SUMMARY_COLS)


@query
def reward(spark, d):
    return _numbered(_rewarded(spark, d), d, "run_id", "reward", split="train") \
        .select("sample_id", "gen_no", "run_id", "reward")


@query
def reward_by_prompt(spark, d):
    return scoring.reward_by_prompt(_rewarded(spark, d))


@query
def reward_by_prompt_bucketed(spark, d):
    """Mean rewards from tables bucketed by sample: neither the join nor the aggregate shuffles."""
    name = f"qamill_{uuid.uuid4().hex}"
    outputs = fixtures.outs(spark, d, "train").select("sample_id", "run_id", "model_output")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucketed.write_outputs(outputs, f"{name}_outputs", _folder(spark, "outputs"), buckets)
    bucketed.write_gold(GSM8K.load_split(spark, d, "train"), f"{name}_gold", _folder(spark, "gold"),
                        buckets=buckets)
    return scoring.reward_by_prompt(bucketed.reward_tables(spark, f"{name}_outputs", f"{name}_gold"))


@query
def reward_by_run(spark, d):
    return scoring.reward_by_run(_rewarded(spark, d))


@query
def group_advantage(spark, d):
    adv = scoring.group_advantage(_numbered(_rewarded(spark, d), d, "reward", split="train"))
    return adv.select("sample_id", "gen_no", "group_id", "reward", "group_mean", "advantage")


@query
def output_union(spark, d):
    """Generated outputs and assistant messages, two tables concatenated by name."""
    cols = ["run_id", "sample_id", "gen_no", "model_output"]
    generated = _numbered(fixtures.outs(spark, d), d, "run_id", "model_output").select(*cols)
    return generated.unionByName(fixtures.message_outputs(spark, d).select(*cols))


# --- P1 conversations and training text -----------------------------------------------

SFT_MAX_LEN = sft.MAX_LEN
BATCH_CAP = 48
BATCH_SIZE = 16
BATCH_SLICE = 3
THINK_SUFFIX = "<think>\n\n</think>\n\n"   # a chat template option: an empty thinking block
KEYS = list(conversations.KEYS)


def _pairs(spark, d):
    return fixtures.pairs(spark, d)


@query
def conv_pairs(spark, d):
    return _pairs(spark, d).select(*KEYS, "question", "answer")


@query
def chat_render(spark, d):
    conv = read_table(spark, d, "conversations", ["conv_id", "turn", "role", "text"])
    return conversations.render(conv)


@query
def chat_prompt(spark, d):
    return conversations.with_prompts(_pairs(spark, d), use_chat=True).select(*KEYS, "prompt")


@query
def sft_text(spark, d):
    both = _pairs(spark, d).withColumn(
        "use_chat_template", F.explode(F.array(F.lit(True), F.lit(False))))
    return both.select(*KEYS, "use_chat_template",
                       T.full_text(F.col("question"), F.col("answer"),
                                   F.col("use_chat_template")).alias("text"))


@query
def vocab(spark, d):
    docs = read_table(spark, d, "documents", ["doc_id", "text"])
    return tokens.build_vocab(docs, ["text"]).select("token", "n", "token_id")


def _tok(spark, d):
    return sft.tokenized(_pairs(spark, d), use_chat=False)


def _examples(spark, d, use_chat=False, mask_question=True, suffix=""):
    tok = sft.tokenized(_pairs(spark, d), use_chat=use_chat, generation_suffix=suffix)
    return sft.examples(tok, mask_question=mask_question, max_len=SFT_MAX_LEN)


def _batch_keys(spark, d):
    """(conv_id, turn, batch_id): batches depend on the sample keys alone."""
    return sft.assign_batches(_pairs(spark, d).select(*KEYS), KEYS, BATCH_SIZE)


def _batched(spark, d):
    return _examples(spark, d).join(_batch_keys(spark, d), KEYS, "inner")


@query
def token_ids(spark, d):
    t = _tok(spark, d)
    return t.select(*KEYS, F.size("full_ids").cast("bigint").alias("n_tokens"),
                    A.as_text("full_ids").alias("input_ids"),
                    A.as_text(A.ones_like("full_ids")).alias("attention_mask"))


@query
def truncate_tokens(spark, d):
    t = _tok(spark, d).withColumn("ids", A.truncate("full_ids", BATCH_CAP))
    return t.select(*KEYS, F.size("ids").cast("bigint").alias("n_tokens"),
                    A.as_text("ids").alias("input_ids"))


@query
def prompt_lcp(spark, d):
    return _examples(spark, d).select(*KEYS, F.col("prompt_len").cast("bigint").alias("prompt_len"))


@query
def mask_labels(spark, d):
    return _examples(spark, d).select(*KEYS, A.as_text("labels").alias("labels"))


def _example_text(ex):
    return ex.select(*KEYS, A.as_text("input_ids").alias("input_ids"),
                     A.as_text("attention_mask").alias("attention_mask"),
                     A.as_text("labels").alias("labels"))


@query
def sft_examples(spark, d):
    """Raw layout, loss on the answer only."""
    return _example_text(_examples(spark, d))


@query
def sft_examples_full_loss(spark, d):
    """Raw layout, loss on question and answer."""
    return _example_text(_examples(spark, d, mask_question=False))


@query
def sft_examples_chat(spark, d):
    """Chat layout, loss on all of it."""
    return _example_text(_examples(spark, d, use_chat=True, mask_question=False))


@query
def sft_examples_chat_mask(spark, d):
    """Chat layout with a template option in the prompt, loss after the common prefix: the
    prompt leaves the full text at the thinking block, so masking stops there."""
    return _example_text(_examples(spark, d, use_chat=True, suffix=THINK_SUFFIX))


@query
def sft_examples_model(spark, d):
    """Raw layout, loss on the answer only, with a model's token ids: the texts that the ids of an example and its
    supervised labels stand for."""
    tok = sft.tokenized(_pairs(spark, d), tokenizer=TOKENIZER)
    ex = sft.examples(tok, max_len=None)
    learnt = F.filter("labels", lambda i: i != A.IGNORE_INDEX)
    return ex.select(*KEYS, tokens.model_text(ex, "input_ids", TOKENIZER).alias("input_text"),
                     tokens.model_text(ex, learnt, TOKENIZER).alias("supervised_text"))


@query
def loss_token_stats(spark, d):
    return sft.loss_token_stats(_examples(spark, d), SFT_MAX_LEN)


@query
def batch_assign(spark, d):
    return _batch_keys(spark, d).select(*KEYS, "batch_id")


@query
def batch_counts(spark, d):
    return sft.batch_count(_pairs(spark, d), BATCH_SIZE)


@query
def batch_slice(spark, d):
    """One batch: its keys are chosen first, and only its texts are tokenized."""
    pairs = _pairs(spark, d)
    keys = _batch_keys(spark, d).where(F.col("batch_id") == BATCH_SLICE)
    vocabulary = sft.vocabulary(conversations.training_texts(pairs, False))
    tok = sft.tokenized(pairs.join(keys.select(*KEYS), KEYS, "left_semi"), vocab=vocabulary)
    ex = sft.examples(tok, mask_question=True, max_len=SFT_MAX_LEN)
    return ex.select(*KEYS, F.lit(BATCH_SLICE).cast("bigint").alias("batch_id"),
                     A.as_text("input_ids").alias("input_ids"))


def _padded(spark, d, cap=None):
    p = sft.pad_batches(_batched(spark, d), max_length=cap)
    return p.select(*KEYS, "batch_id", "width", A.as_text("input_ids").alias("input_ids"),
                    A.as_text("labels").alias("labels"),
                    A.as_text("attention_mask").alias("attention_mask"))


@query
def batch_pad(spark, d):
    return _padded(spark, d)


@query
def batch_pad_capped(spark, d):
    return _padded(spark, d, BATCH_CAP)


def _left(spark, d):
    return sft.left_pad_prompts(_batched(spark, d))


@query
def left_pad(spark, d):
    return _left(spark, d).select(*KEYS, "batch_id", "width",
                                  A.as_text("gen_input_ids").alias("input_ids"),
                                  A.as_text("gen_attention_mask").alias("attention_mask"))


@query
def mask_counts(spark, d):
    lp = _left(spark, d)
    return lp.select(*KEYS, A.array_sum("gen_attention_mask").alias("real_tokens"),
                     A.count_value("gen_attention_mask", 0).cast("bigint").alias("pad_tokens"))


@query
def completion_slice(spark, d):
    """A generated sequence = left-padded prompt ids + answer ids; slicing off
    padding and prompt must give the answer ids back."""
    lp = _left(spark, d)
    full_lcp = A.common_prefix_len("prompt_ids", "full_ids")
    answer_ids = F.slice("full_ids", full_lcp + 1, F.greatest(F.size("full_ids"), F.lit(1)))
    gen = F.concat("gen_input_ids", answer_ids)
    comp = A.completion_slice(gen, A.count_value("gen_attention_mask", 0),
                              A.array_sum("gen_attention_mask"))
    return lp.select(*KEYS, A.as_text(comp).alias("completion_ids"))


# --- P3/P4 run summaries and the comparison report --------------------------------------

DUPLICATED_RUN = "N_O_0"       # evaluated twice; the later directory must be ignored
EXPERIMENT_PICK = ["sft_no_chat_mask_q", "grpo_no_chat", "sft_chat"]


def _runs(spark, d):
    s = summary.run_summary(_evaluated(spark, d), _test(spark, d))
    return s.withColumn("eval_dir", F.concat(F.lit("eval/"), F.col("run_id")))


REPORT_COLS = ["run_id", "eval_dir", *summary.SUMMARY_COLS]


@query
def report_comparison(spark, d):
    return report.comparison(_runs(spark, d)).select(*REPORT_COLS, "label", "train_label")


@query
def report_first(spark, d):
    """The duplicated run appears a second time under a later directory with a
    different accuracy (made with a generator, so the runs are scored once)."""
    runs = _runs(spark, d)
    copies = F.when(F.col("run_id") == DUPLICATED_RUN, F.array(F.lit(0), F.lit(1))) \
        .otherwise(F.array(F.lit(0)))
    both = runs.withColumn("_copy", F.explode(copies))
    again = F.col("_copy") == 1
    both = (both.withColumn("eval_dir", F.when(again, F.concat(F.col("eval_dir"), F.lit("_rerun")))
                            .otherwise(F.col("eval_dir")))
            .withColumn("accuracy", F.when(again, F.lit(1.0) - F.col("accuracy"))
                        .otherwise(F.col("accuracy")))
            .drop("_copy"))
    return report.first_per_format(report.with_labels(both))


@query
def report_grouped(spark, d):
    return report.grouped(report.with_labels(_runs(spark, d)))


@query
def report_pairs(spark, d):
    """Labels with both formats; a label whose raw evaluation never ran is left out."""
    return report.chat_raw_pairs(report.with_labels(_runs(spark, d)))


@query
def report_labels(spark, d):
    return report.label_order(report.with_labels(_runs(spark, d)))


@query
def report_max(spark, d):
    return report.best_accuracy(_runs(spark, d))


@query
def accuracy_pct(spark, d):
    return _runs(spark, d).select("run_id", "accuracy", fmt.percent("accuracy", 2).alias("accuracy_pct"),
                                  fmt.percent("accuracy", 1).alias("accuracy_pct1"))


@query
def summary_union(spark, d):
    """Summaries written by two tool versions: the raw-format half lacks
    ``train_method`` and ``train_mask_question``; absent keys become null."""
    runs = _runs(spark, d)
    full = runs.where(F.col("eval_chat_template"))
    ragged = runs.where(~F.col("eval_chat_template")).drop("train_method", "train_mask_question")
    both = full.unionByName(ragged, allowMissingColumns=True)
    return report.with_labels(both).select(*REPORT_COLS, "train_label", "label")


@query
def runs_with_summary(spark, d):
    """Run directories that hold a summary: every run of the grid's models and formats,
    semi-joined to the summaries there are."""
    li = read_table(spark, d, "lineitem", ["l_returnflag", "l_linestatus"]).distinct()
    listed = li.select(F.explode(F.array(*[
        F.concat_ws("_", F.concat(F.lit("eval/"), F.col("l_returnflag")),
                    "l_linestatus", F.lit(v)) for v in ("0", "1")])).alias("eval_dir"))
    return listed.join(_runs(spark, d).select("eval_dir"), "eval_dir", "left_semi")


@query
def run_enrich(spark, d):
    enriched = summary.enrich_runs(_runs(spark, d), fixtures.run_info(spark))
    return enriched.select("run_id", "model_path", "train_method", "train_chat_template",
                           "train_mask_question")


# --- files: what the sinks write, the scans read ------------------------------------------

def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}/{name}"


def _results(spark, d):
    """Summaries and detail rows of one evaluation: the outputs are scored once for both. Every output's sample
    is asked for, so the scored rows hold all keys that details are numbered by."""
    test = _test(spark, d)
    scored = materialize(_evaluated(spark, d, scoring.detail_samples(test), scoring.DETAIL_CARRY))
    runs = summary.run_summary(scored, test).select("run_id", *summary.SUMMARY_COLS)
    details = scoring.details_from_scored(scored, scored.select("run_id", "sample_id").distinct())
    return materialize(runs), materialize(details)


def _in_turn(key):
    """Filters for three writes into one folder: some runs, the others, and the first ones again."""
    first = F.pmod(F.xxhash64(key), F.lit(2)) == 0
    return [first, ~first, first]


@query
def results_roundtrip(spark, d):
    """Result tables written by run, in several writes, and read back: detail rows with their
    run's accuracy."""
    base = _folder(spark, "results")
    runs, details = _results(spark, d)
    for part in _in_turn("run_id"):
        files.write_results(runs.where(part), details.where(part), base)
    runs, details = files.read_results(spark, base)
    return details.join(runs.select("run_id", "accuracy"), "run_id") \
        .select("run_id", "index", "sample_id", "extracted_answer", "correct", "accuracy")


@query
def summary_files(spark, d):
    """Summaries written as one JSON document a run, in several writes, and found again by the scan."""
    base = _folder(spark, "eval")
    runs = materialize(_runs(spark, d).drop("eval_dir"))
    for part in _in_turn("run_id"):
        files.write_summaries_json(runs.where(part), base)
    return files.read_summary_files(spark, base).select(
        F.regexp_extract("eval_dir", "[^/]+$", 0).alias("run_dir"), *summary.SUMMARY_COLS)


@query
def summary_key_union(spark, d):
    """Summaries of two tool versions in one folder: chat runs have a seed, a temperature and a nested object
    that no schema names; raw runs have another key and lack two of the schema's."""
    base = _folder(spark, "eval")
    runs = materialize(_runs(spark, d).drop("eval_dir"))
    chat = runs.where("eval_chat_template").withColumn("seed", F.length("run_id").cast("bigint")) \
        .withColumn("temperature", F.when(F.col("train_mask_question"), F.lit(0.7))) \
        .withColumn("sampling", F.struct(F.col("correct").alias("top_k"), F.lit(True).alias("on")))
    raw = runs.where("not eval_chat_template").drop("train_method", "train_mask_question") \
        .withColumn("note", F.concat(F.lit("raw "), "run_id"))
    files.write_summaries_json(chat, base)
    files.write_summaries_json(raw, base)
    return files.read_summary_union(spark, base).withColumn(
        "eval_dir", F.regexp_extract("eval_dir", "[^/]+$", 0))


@query
def discovered_runs(spark, d):
    base = _folder(spark, "eval")
    files.write_summaries_json(_runs(spark, d).drop("eval_dir"), base)
    return files.discover_runs(spark, base).select(
        F.regexp_extract("eval_dir", "[^/]+$", 0).alias("run_dir"))


@query
def comparison_csv(spark, d):
    """The comparison table written as CSV and read back with its schema."""
    path = _folder(spark, "comparison")
    table = report_comparison(spark, d)
    files.write_comparison_csv(table, path)
    return files.read_comparison_csv(spark, path, table.schema)


@query
def detail_documents(spark, d):
    """Detail rows written as JSON lines, a folder a run, and read back."""
    base = _folder(spark, "details")
    files.write_details_json(score_details(spark, d), base)
    return files.read_detail_files(spark, base).select(
        F.regexp_extract("eval_dir", "[^/]+$", 0).alias("run_dir"), "index", "question",
        "gold_value", "model_output", "extracted_answer", "correct")


@query
def result_documents(spark, d):
    """One nested document a run, in two writes, and its details opened again."""
    base = _folder(spark, "documents")
    runs, details = _results(spark, d)
    for part in _in_turn("run_id")[:2]:
        documents.write_result_documents(runs.where(part), details.where(part), base)
    return files.read_result_documents(spark, base).select(
        F.regexp_extract("eval_dir", "[^/]+$", 0).alias("run_dir"), "experiment_name", "index", "question",
        "gold_value", "model_output", "extracted_answer", "correct")


@query
def run_info_files(spark, d):
    """Run metadata of every model in the outputs, written as JSON and read back flat."""
    path = _folder(spark, "run_info")
    models = fixtures.outs(spark, d).select("model_path", "train_chat_template",
                                            "train_mask_question").distinct()
    info = models.select(
        "model_path", F.lit("configs/sft.yaml").alias("original_config_path"),
        F.struct(F.lit(fixtures.TASK_NAME).alias("task"),
                 F.col("train_chat_template").alias("use_chat_template"),
                 F.when(F.col("train_mask_question"), F.lit(True)).alias("mask_question"),
                 F.lit("out").alias("output_dir")).alias("cli_args"),
        F.lit("2024-01-02T03:04:05").cast("timestamp").alias("timestamp"))
    info = materialize(info)
    for part in _in_turn("model_path"):
        files.write_run_info(info.where(part), path)
    return files.read_run_info(spark, path).select(
        "model_path", "original_config_path", "use_chat_template", "mask_question",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"))


# --- experiment grid -------------------------------------------------------------------

def _cells(spark, names=None):
    exps = fixtures.experiments(spark)
    if names is not None:
        exps = experiments.select_experiments(exps, names)
    return experiments.grid(exps)


GRID_COLS = ["name", "method", "use_chat_template", "mask_question", "eval_chat_template",
             "eval_order", "eval_name"]


@query
def experiment_matrix(spark, d):
    return experiments.with_results(_cells(spark), _runs(spark, d)) \
        .select(*GRID_COLS, "run_id", "accuracy")


@query
def experiment_filter(spark, d):
    return experiments.with_results(_cells(spark, EXPERIMENT_PICK), _runs(spark, d)) \
        .select(*GRID_COLS, "run_id", "accuracy")


@query
def missing_evals(spark, d):
    return experiments.missing(_cells(spark), _runs(spark, d)).select(*GRID_COLS)


# --- run options and run names (events) ----------------------------------------------

CONFIG_OPTIONS = {"k": "0", "src": "cfg"}


def _merged(spark, d):
    ev = read_table(spark, d, "events", ["event_id", "ts", "event_type", "props"])
    return ev.withColumn("opts", O.merge_override(O.literal_options(CONFIG_OPTIONS),
                                                  O.parse_options("props")))


@query
def option_merge(spark, d):
    m = _merged(spark, d)
    return m.select("event_id", F.element_at("opts", F.lit("k")).alias("opt_k"),
                    F.element_at("opts", F.lit("src")).alias("opt_src"),
                    F.size("opts").cast("bigint").alias("n_opts"),
                    O.malformed("props").alias("malformed"))


@query
def option_default(spark, d):
    m = _merged(spark, d)
    return m.select("event_id", O.get_option("opts", "k", "none").alias("opt_k"),
                    O.get_option("opts", "temperature", "0.0").alias("opt_temperature"),
                    O.get_option("opts", "do_sample", "false").alias("opt_do_sample"))


TYPED_CONFIG = {"k": 0, "temperature": 0.7, "do_sample": None, "chat": {"thinking": False, "turns": 3},
                "stop": ["a", "b"]}


@query
def option_typed(spark, d):
    """Options of a config, overridden by each event's, with their JSON types: an event's nested object
    replaces the config's, and the config's null stays a null."""
    ev = read_table(spark, d, "events", ["event_id", "event_type", "props"])
    chat = F.when(F.col("event_type") == "click",
                  F.concat(F.lit('{"chat": {"thinking": true}, "k": '), F.col("event_id").cast("string"), F.lit(', "x": null}')))
    merged = O.merge_typed(O.merge_typed(O.literal_typed(TYPED_CONFIG), O.parse_typed("props")), O.parse_typed(chat))
    m = ev.select("event_id", merged.alias("opts"), O.malformed_typed("props").alias("malformed"))
    return m.select(
        "event_id", "malformed", O.get_typed("opts", "k", "bigint", -1).alias("opt_k"),
        O.get_typed("opts", "temperature", "double", 0.0).alias("opt_temperature"),
        O.get_typed("opts", "do_sample", "boolean", True).alias("opt_do_sample"),
        O.get_typed("opts", "max_tokens", "bigint", 512).alias("opt_max_tokens"),
        O.get_typed("opts", "chat", "boolean", path="$.thinking").alias("opt_thinking"),
        O.get_typed("opts", "chat", "bigint", path="$.turns").alias("opt_turns"),
        O.get_typed("opts", "stop", "string", path="$[1]").alias("opt_stop"),
        O.has_option("opts", "x").alias("has_x"), F.size("opts").cast("bigint").alias("n_opts"))


@query
def run_names(spark, d):
    ev = read_table(spark, d, "events", ["event_id", "ts", "event_type"])
    stamp = TM.local_stamp("ts")
    method = F.when(F.col("event_type").isin("purchase", "signup"), F.lit("grpo")).otherwise(F.lit("sft"))
    name = T.model_dir_name(F.col("event_id") % 2 == 0, method, F.col("event_id") % 3 == 0,
                            F.lit(fixtures.TASK_NAME), stamp)
    return ev.select("event_id", stamp.alias("stamp"), name.alias("run_name"))
