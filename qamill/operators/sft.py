"""Supervised fine-tuning examples: format, tokenize, truncate, mask; then
fixed-size batches padded to the batch's longest row.

Every step is a column expression over one row except the id lookup (a join)
and the batch width (a window over one batch of ``batch_size`` rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qamill.functions import arrays as A
from qamill.functions.text import DEFAULT_EOS
from qamill.operators import conversations, tokens
from qamill.operators.indexing import dense_index


#: Tokens of an example at most, as in the training configuration.
MAX_LEN = 1024


def tokenized(pairs: DataFrame, use_chat: bool = False, eos: str | None = DEFAULT_EOS,
              generation_suffix: str = "", vocab: DataFrame | None = None,
              tokenizer: str | None = None) -> DataFrame:
    """conv_id, turn, prompt_ids, full_ids (untruncated) for each sample: ids of the model whose
    ``tokenizer`` file is named, else of ``vocab``, which is built over the texts when not given."""
    texts = conversations.training_texts(pairs, use_chat, eos, generation_suffix)
    if tokenizer is not None:
        return tokens.model_token_ids(texts, conversations.KEYS,
                                      {"prompt_text": "prompt_ids", "full_text": "full_ids"}, tokenizer)
    if vocab is None:
        vocab = vocabulary(texts, generation_suffix)
    return tokens.token_ids(texts, conversations.KEYS,
                            {"prompt_text": "prompt_ids", "full_text": "full_ids"}, vocab)


def vocabulary(texts: DataFrame, generation_suffix: str = "") -> DataFrame:
    """Vocabulary of training texts; prompts add words only through a template suffix."""
    return tokens.build_vocab(texts, ["full_text", "prompt_text"] if generation_suffix
                              else ["full_text"])


def examples(tok: DataFrame, mask_question: bool = True, max_len: int | None = MAX_LEN) -> DataFrame:
    """input_ids, attention_mask and labels, each truncated to ``max_len``.

    With ``mask_question`` the first ``prompt_len`` labels are -100, where
    ``prompt_len`` is the longest common prefix of the truncated prompt ids and
    the truncated input ids; otherwise labels copy the ids."""
    input_ids = A.truncate("full_ids", max_len)
    prompt_ids = A.truncate("prompt_ids", max_len)
    df = tok.select(*conversations.KEYS, "full_ids", "prompt_ids", input_ids.alias("input_ids"),
                    prompt_ids.alias("prompt_ids_trunc"))
    df = df.withColumn("attention_mask", A.ones_like("input_ids"))
    df = df.withColumn("prompt_len", A.common_prefix_len("prompt_ids_trunc", "input_ids"))
    labels = A.masked_labels("input_ids", "prompt_len") if mask_question else F.col("input_ids")
    return df.withColumn("labels", labels)


def loss_token_stats(ex: DataFrame, max_len: int | None = MAX_LEN) -> DataFrame:
    """Totals of masked and supervised label positions, rows with nothing to
    learn from, rows cut by truncation (one global row, partial aggregates)."""
    masked = A.count_value("labels", A.IGNORE_INDEX)
    total = F.size("labels")
    cut = F.size("full_ids") > F.lit(max_len) if max_len is not None else F.lit(False)
    return ex.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(masked.cast("bigint")).alias("masked_tokens"),
                  F.sum((total - masked).cast("bigint")).alias("supervised_tokens"),
                  F.count_if(total - masked == 0).alias("rows_no_supervised"),
                  F.count_if(cut).alias("rows_truncated"))


def assign_batches(keys: DataFrame, key_cols: list[str], batch_size: int,
                   group_cols: list[str] | None = None) -> DataFrame:
    """batch_id = position (in ``key_cols`` order, within ``group_cols``) // size;
    the last batch may be short. Pass the key columns only: they are ranged and
    checkpointed (``dense_index``), and no window holds a whole group."""
    idx = dense_index(keys, group_cols or [], key_cols, "_pos")
    return idx.withColumn("batch_id", F.floor(F.col("_pos") / F.lit(batch_size)).cast("bigint")) \
        .drop("_pos")


def batch_count(df: DataFrame, batch_size: int) -> DataFrame:
    """Number of batches, ``ceil(rows / batch_size)`` (0 for no rows)."""
    return df.agg(F.ceil(F.count(F.lit(1)) / F.lit(batch_size)).cast("bigint").alias("n_batches"))


def pad_batches(batched: DataFrame, pad_id: int = tokens.PAD_ID, max_length: int | None = None,
                batch_cols: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Right-pad ids (pad id), labels (-100) and mask (0) to the batch's
    longest row, capped at ``max_length``; longer rows are cut."""
    w = Window.partitionBy(*batch_cols)
    width = F.max(F.size("input_ids")).over(w)
    if max_length is not None:
        width = F.least(width, F.lit(max_length))
    df = batched.withColumn("width", width.cast("bigint"))
    return (df.withColumn("input_ids", A.pad_right("input_ids", F.col("width"), pad_id))
            .withColumn("labels", A.pad_right("labels", F.col("width"), A.IGNORE_INDEX))
            .withColumn("attention_mask", A.pad_right("attention_mask", F.col("width"), A.MASK_PAD)))


def left_pad_prompts(batched: DataFrame, pad_id: int = tokens.PAD_ID,
                     batch_cols: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Generation-side batch: prompts left-padded to the batch's longest."""
    w = Window.partitionBy(*batch_cols)
    df = batched.withColumn("width", F.max(F.size("prompt_ids")).over(w).cast("bigint"))
    return (df.withColumn("gen_input_ids", A.pad_left("prompt_ids", F.col("width"), pad_id))
            .withColumn("gen_attention_mask",
                        A.pad_left(A.ones_like("prompt_ids"), F.col("width"), A.MASK_PAD)))
