"""Derived input tables built from the provided parquet tables.

The engine's inputs are question/answer samples, generated outputs keyed by
run and sample, and conversations. The test data carries none of these
directly, so they are derived here, by Spark, from the TPC-H-like tables; the
work therefore grows with the tables. Definitions are listed in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from qamill.functions import text as T
from qamill.operators.indexing import dense_index, number_keys
from qamill.sources.tables import read_table

# Fixed values of the derived tables.
TASK_NAME = "gsm8k"
TRAIN_EVERY = 5            # every 5th part is a training sample
OUTPUT_CASES = 10          # model-output shapes, chosen by (orderkey + linenumber) % OUTPUT_CASES
RUN_INFO_ROWS = [
    # model_path, original_config_path, use_chat_template, mask_question
    ("models/N_O_0", "configs/grpo.yaml", True, False),
    ("models/N_O_1", "configs/sft.yaml", False, True),
    ("models/N_F_0", "configs/custom.yaml", None, None),
    ("models/A_F_0", "configs/grpo.yaml", True, False),
]
EXPERIMENT_ROWS = [
    # name, method, use_chat_template, mask_question
    ("sft_chat_template", "sft", True, False),
    ("grpo_chat_template", "grpo", True, False),
    ("sft_no_chat_full_loss", "sft", False, False),
    ("grpo_no_chat", "grpo", False, False),
    ("sft_no_chat_mask_q", "sft", False, True),
]


def _price_cents(price: Column) -> Column:
    return F.floor(price * F.lit(100)).cast("bigint")


def qa_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unstripped QA sample per part; the answer ends in ``#### value``."""
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_retailprice"])
    v = _price_cents(F.col("p_retailprice"))
    return part.select(
        F.col("p_partkey").alias("sample_id"),
        F.when(F.col("p_partkey") % TRAIN_EVERY == 0, F.lit("train"))
        .otherwise(F.lit("test")).alias("split"),
        F.concat(F.lit("  Price of "), F.col("p_name"), F.lit("? ")).alias("question"),
        F.concat(F.lit("It sells.\n#### "), F.format_number(v, 0), F.lit(" ")).alias("answer"),
    )


def fraction_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unstripped QA sample per part whose answer is its size in eighths."""
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size"])
    return part.select(
        F.col("p_partkey").alias("sample_id"),
        F.when(F.col("p_partkey") % TRAIN_EVERY == 0, F.lit("train"))
        .otherwise(F.lit("test")).alias("split"),
        F.concat(F.lit(" Size of "), F.col("p_name"), F.lit("? ")).alias("question"),
        F.concat(F.lit("In eighths.\n#### "), F.col("p_size").cast("string"), F.lit("/8 ")).alias("answer"),
    )


def fraction_outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output per line item for the fraction task: the answer over a multiple of eight, as a
    decimal, a wrong fraction, or none."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", *GEN_ORDER[1:]])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    size, times = F.col("p_size").cast("bigint"), F.col("l_linenumber").cast("bigint")
    case = F.col("l_orderkey") % 4
    mills = size * 125
    text = (F.when(case == 0, F.concat_ws("/", size * times, times * 8))
            .when(case == 1, F.concat(F.floor(mills / 1000).cast("string"), F.lit("."),
                                      F.lpad((mills % 1000).cast("string"), 3, "0")))
            .when(case == 2, F.concat_ws("/", size + 1, F.lit(8)))
            .otherwise(F.lit("unknown")))
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_partkey").alias("sample_id"), *GEN_ORDER, F.concat(F.lit("#### "), text).alias("model_output"))


def requested_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, train_method, split): the split that each run in the line items asks for."""
    runs = outs(spark, sf_dir).select("run_id", "train_method").distinct()
    return runs.withColumn("split", F.when(F.col("train_method") == "grpo", F.lit("train"))
                           .otherwise(F.lit("test")))


def _model_output(case: Column, v: Column) -> Column:
    vs = v.cast("string")
    vf = F.format_number(v, 0)
    return (F.when(case == 0, F.concat(F.lit("#### "), vf))
            .when(case == 1, F.concat(F.lit("so 3 and "), vf, F.lit(".")))
            .when(case == 2, F.concat(F.lit("#### "), (v + 1).cast("string")))
            .when(case == 3, F.lit("no idea"))
            .when(case == 4, F.concat(F.lit("#### 5\n#### "), vs))
            .when(case == 5, F.concat(F.lit("#### $"), vs))
            .when(case == 6, F.concat(F.lit("it is "), vs, F.lit(".0")))
            .when(case == 8, F.concat(F.lit("#### "), vs, F.lit(" ,")))
            .when(case == 9, F.concat(F.lit("#### , "), vs))
            .otherwise(F.lit("#### \n")))


GEN_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]


def _in_split(key: str, split: str | None) -> Column:
    """The split of a sample, as a filter on its key that reaches the scan."""
    if split is None:
        return F.lit(True)
    train = F.col(key) % TRAIN_EVERY == 0
    return train if split == "train" else ~train


def outs(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """Generated outputs, one per line item of the split's samples, tagged with the run
    that produced them; ``GEN_ORDER`` orders the outputs of a sample.

    Run A_F_1 has no line items: raw-format evaluations of that model are missing."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                     "l_returnflag", "l_linestatus", "l_extendedprice"]) \
        .where(_in_split("l_partkey", split))
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_retailprice"])
    joined = li.join(part, li.l_partkey == part.p_partkey, "inner")
    v = _price_cents(F.col("p_retailprice"))
    case = (F.col("l_orderkey") + F.col("l_linenumber")) % OUTPUT_CASES
    sft, grpo = F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"
    variant = F.when(sft & (F.col("l_linestatus") == "F"), F.lit(0)).otherwise(F.col("l_suppkey") % 2)
    run_id = F.concat_ws("_", "l_returnflag", "l_linestatus", variant.cast("string"))
    method = F.when(sft, F.lit("sft")).when(grpo, F.lit("grpo")).otherwise(F.lit(""))
    experiment = (F.when(sft & (variant == 0), F.lit("sft_no_chat_mask_q"))
                  .when(sft, F.lit("sft_no_chat_full_loss"))
                  .when(grpo & (variant == 1), F.lit("grpo_chat_template")).otherwise(run_id))
    return joined.select(
        F.col("l_partkey").alias("sample_id"),
        *GEN_ORDER,
        run_id.alias("run_id"),
        experiment.alias("experiment_name"),
        F.concat(F.lit("models/"), run_id).alias("model_path"),
        F.lit(TASK_NAME).alias("task"),
        method.alias("train_method"),
        grpo.alias("train_chat_template"),
        (variant == 0).alias("train_mask_question"),
        (F.col("l_linestatus") == "O").alias("eval_chat_template"),
        _model_output(case, v).alias("model_output"),
    )


def number_generations(df: DataFrame, sf_dir: str, split: str | None = None) -> DataFrame:
    """``gen_no`` (from 1) of each output among its sample's line items. Only the line
    items' key columns, of the split's samples where ``df`` has one split alone, are ranged and
    checkpointed; the number joins back on all of them."""
    keys = read_table(df.sparkSession, sf_dir, "lineitem", ["l_partkey", *GEN_ORDER]) \
        .where(_in_split("l_partkey", split)) \
        .withColumnRenamed("l_partkey", "sample_id")
    df = number_keys(df, keys, ["sample_id"], GEN_ORDER, "gen_no")
    return df.withColumn("gen_no", F.col("gen_no") + 1).drop(*GEN_ORDER)


def message_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant messages in the layout of generated outputs."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return conv.where(F.col("role") == "assistant").select(
        F.lit("conversations").alias("run_id"), F.col("conv_id").alias("sample_id"),
        F.col("turn").cast("bigint").alias("gen_no"), F.col("text").alias("model_output"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))


def paired(conv: DataFrame) -> DataFrame:
    """A user message with the assistant message that follows it in the conversation,
    keyed by (conv_id, turn) of the question; turn numbers may have gaps.

    Positions are numbered on the key columns (``dense_index``: a conversation of any
    length is spread over tasks); every join is on a key that is unique."""
    at = dense_index(conv.select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "_i")
    users = at.where(F.col("role") == "user").select("conv_id", "turn", "_i")
    replies = at.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("_rc"), F.col("turn").alias("_rt"), (F.col("_i") - 1).alias("_ri"))
    keys = users.join(replies, (F.col("conv_id") == F.col("_rc")) & (F.col("_i") == F.col("_ri"))) \
        .select("conv_id", "turn", "_rt")
    question = conv.select(F.col("conv_id").alias("_qc"), F.col("turn").alias("_qt"),
                           T.py_strip("text").alias("question"))
    answer = conv.select(F.col("conv_id").alias("_ac"), F.col("turn").alias("_at"),
                         T.py_strip("text").alias("answer"))
    return (keys.join(question, (F.col("conv_id") == F.col("_qc")) & (F.col("turn") == F.col("_qt")))
            .join(answer, (F.col("conv_id") == F.col("_ac")) & (F.col("_rt") == F.col("_at")))
            .select("conv_id", "turn", "question", "answer"))


RUN_INFO_SCHEMA = Ty.StructType([
    Ty.StructField("model_path", Ty.StringType(), False),
    Ty.StructField("original_config_path", Ty.StringType(), True),
    Ty.StructField("use_chat_template", Ty.BooleanType(), True),
    Ty.StructField("mask_question", Ty.BooleanType(), True),
])

EXPERIMENT_SCHEMA = Ty.StructType([
    Ty.StructField("name", Ty.StringType(), False),
    Ty.StructField("method", Ty.StringType(), False),
    Ty.StructField("use_chat_template", Ty.BooleanType(), False),
    Ty.StructField("mask_question", Ty.BooleanType(), False),
])


def run_info(spark: SparkSession) -> DataFrame:
    """Training-run metadata dimension (one row per trained model)."""
    return spark.createDataFrame(RUN_INFO_ROWS, RUN_INFO_SCHEMA)


def experiments(spark: SparkSession) -> DataFrame:
    """The experiment definitions, in declaration order (``ordinal``)."""
    rows = [(*r, i) for i, r in enumerate(EXPERIMENT_ROWS)]
    schema = Ty.StructType([*EXPERIMENT_SCHEMA.fields,
                            Ty.StructField("ordinal", Ty.IntegerType(), False)])
    return spark.createDataFrame(rows, schema)
