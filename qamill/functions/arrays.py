"""Array Column expressions for token sequences: truncation, longest common
prefix, label masking, right/left padding and completion slicing.

All are Spark higher-order / collection functions evaluated on the JVM; a row's
arrays never leave the executor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label id the loss ignores, and the attention-mask pad value.
IGNORE_INDEX = -100
MASK_PAD = 0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    """Column as is, a name as a column, anything else as a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def truncate(ids, max_len) -> Column:
    """Keep the head: at most ``max_len`` elements (None keeps all)."""
    if max_len is None:
        return _c(ids)
    return F.slice(_c(ids), F.lit(1), _lit(max_len))


def ones_like(ids) -> Column:
    """Attention mask of ones for real tokens."""
    return F.transform(_c(ids), lambda _: F.lit(1))


def common_prefix_len(prompt_ids, input_ids) -> Column:
    """Length of the longest common prefix of two arrays.

    ``zip_with`` pads the shorter side with nulls, which compare as not-equal;
    the fold stops counting at the first mismatch."""
    eq = F.zip_with(_c(prompt_ids), _c(input_ids),
                    lambda a, b: F.coalesce(a == b, F.lit(False)))
    folded = F.aggregate(eq, F.struct(F.lit(0).alias("n"), F.lit(True).alias("run")),
                         lambda acc, x: F.struct(
                             F.when(acc["run"] & x, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
                             (acc["run"] & x).alias("run")))
    return folded["n"]


def masked_labels(input_ids, prompt_len) -> Column:
    """``[-100] * n + ids[n:]``: no loss on the first ``prompt_len`` tokens."""
    ids = _c(input_ids)
    n = F.least(_lit(prompt_len), F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), n), F.slice(ids, n + 1, F.size(ids)))


def _fill(value, count) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(_lit(count), F.lit(0)).cast("int"))


def pad_right(ids, width, pad_value) -> Column:
    """Right-pad to ``width``; an array longer than ``width`` is cut to it."""
    arr = _c(ids)
    w = _lit(width)
    return F.when(F.size(arr) < w, F.concat(arr, _fill(pad_value, w - F.size(arr)))) \
        .otherwise(F.slice(arr, F.lit(1), w))


def pad_left(ids, width, pad_value) -> Column:
    """Left-pad to ``width`` (generation side)."""
    arr = _c(ids)
    return F.concat(_fill(pad_value, _lit(width) - F.size(arr)), arr)


def count_value(arr, value) -> Column:
    return F.size(F.filter(_c(arr), lambda x: x == F.lit(value)))


def array_sum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def completion_slice(generated, pad_len, prompt_len) -> Column:
    """``output[pad_len + prompt_len:]``: drop the left padding and the prompt."""
    seq = _c(generated)
    start = _lit(pad_len) + _lit(prompt_len) + 1
    return F.when(start <= F.size(seq), F.slice(seq, start, F.size(seq))) \
        .otherwise(F.array().cast("array<int>"))


def as_text(arr) -> Column:
    """Space-separated text form of an int array (used for report/oracle output)."""
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), " ")
