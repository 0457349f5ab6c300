"""String Column expressions: answer extraction, answer checking, prompt and
label formatting.

Every function maps Column -> Column and is built from JVM-side Spark
expressions, so it stays inside whole-stage codegen; nothing here runs Python
per row.

Python ``re``/``str`` semantics are kept exactly where the answer depends on
them: Python's ``\\s`` and ``str.strip()`` use Unicode whitespace, ``\\d`` is any
Unicode decimal digit, and ``.`` stops only at ``\\n``. The Java regex engine
differs on all three, so the patterns below spell the classes out.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the semantics being matched)
# ---------------------------------------------------------------------------
# Characters Python's str.isspace() accepts, i.e. what str.strip() and re's \s
# remove/match: \t \n \v \f \r, U+001C..U+001F, space, U+0085, U+00A0, U+1680,
# U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")
# The same set as a regex character class (valid for Java and RE2).
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The answer marker, then optional whitespace, then the rest of the line.
MARKER = "####"
# Java flag (?d): '.' excludes only '\n', as in Python.
MARKER_MATCH = r"(?d)####" + WS_CLASS + r"*.+"
# A number: optional minus, a digit, digits or commas, optional dot, digits.
NUMBER_PATTERN = r"-?\p{Nd}[\p{Nd},]*\.?\p{Nd}*"
# What Python's float() accepts once stripped (ASCII digits, '_' between digits).
PYFLOAT_PATTERN = (r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)"
                   r"([eE][+-]?\d+(_\d+)*)?$")
PYFLOAT_SPECIAL_NAN = r"^[+-]?nan$"
PLAIN_NUMBER_CHARS = "0123456789.eE+-"
PYFLOAT_SPECIAL_INF = r"^[+-]?(inf|infinity)$"
# Prompt layout without a chat template; the trailing space is part of it.
RAW_QUESTION_PREFIX = "Question: "
RAW_ANSWER_PREFIX = "\nAnswer: "
# Default chat layout (ChatML): one segment per message, then the generation
# prompt when no answer is given.
CHAT_OPEN = "<|im_start|>"
CHAT_CLOSE = "<|im_end|>\n"
CHAT_GENERATION_PROMPT = "<|im_start|>assistant\n"
DEFAULT_EOS = "<|im_end|>"
# Report labels.
LABEL_SEP = " | "
UNKNOWN_METHOD = "?"
# Method inference from a training-config path: first match wins.
METHOD_HINTS = ("grpo", "sft")
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(col) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends."""
    return F.trim(_c(col), F.lit(PY_WHITESPACE))


def marker_capture(col) -> Column:
    """Stripped text after the first ``####`` (null when there is no marker).

    ``re.search(r"####\\s*(.+)")`` then ``.strip()``: the whitespace the ``\\s*``
    would consume is removed by the strip anyway, so the whole match minus the
    marker, stripped, is the same value. An empty capture stays ``''``.
    """
    match = F.regexp_substr(_c(col), F.lit(MARKER_MATCH))
    return py_strip(F.substr(match, F.lit(len(MARKER) + 1)))


def has_marker(col) -> Column:
    return F.regexp_substr(_c(col), F.lit(MARKER_MATCH)).isNotNull()


def extract_marker(col) -> Column:
    """Marker path of extraction: capture, strip, drop thousands commas."""
    return F.replace(marker_capture(col), F.lit(","), F.lit(""))


def last_number(col) -> Column:
    """The last number in the text, commas removed; null when there is none."""
    found = F.regexp_extract_all(_c(col), F.lit(NUMBER_PATTERN), 0)
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit(""))


def gold_value(col) -> Column:
    """Gold extraction: marker value, else the stripped text (commas kept)."""
    marker = extract_marker(col)
    return F.when(marker.isNotNull(), marker).otherwise(py_strip(col))


def extract_answer(col) -> Column:
    """Answer extraction from model output: marker value, else last number,
    else null. An empty marker capture is ``''`` and does not fall through."""
    return F.coalesce(extract_marker(col), last_number(col))


def _script_digits() -> tuple[str, str]:
    """Decimal digits outside ASCII and their values, from the Unicode database."""
    found = [(chr(c), str(unicodedata.decimal(chr(c)))) for c in range(128, sys.maxunicode + 1)
             if unicodedata.decimal(chr(c), None) is not None and c <= 0xFFFF]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


_DIGITS = _script_digits()


def ascii_digits(col) -> Column:
    """Decimal digits of any script (basic plane) as 0-9; other text is unchanged."""
    s = _c(col)
    return F.when(s.rlike(r"[^\x00-\x7F]"), F.translate(s, *_DIGITS)).otherwise(s)


def number_text(col) -> Column:
    """The text that ``parsed_number`` reads: stripped, digits of any script as 0-9."""
    return ascii_digits(py_strip(col))


def py_float(col) -> Column:
    """``float(x)`` as a nullable double: null where Python raises ValueError."""
    return parsed_number(number_text(col))


def parsed_number(text) -> Column:
    """``py_float`` of a text that ``number_text`` has made. It reads the text several times, so callers
    that parse many rows give it a column of a projection of its own.

    Surrounding white space goes and decimal digits of any script are read as
    0-9. The plain-number case is tried first and needs no regex: over the
    characters 0-9 . e E + - the grammars of Python's float() and Java's
    Double.parseDouble (Spark's cast) accept exactly the same strings. The
    underscore form and the special words are looked at only otherwise."""
    s = _c(text)
    low = F.lower(s)
    short = F.length(s) <= F.lit(len("+infinity"))
    plain = F.translate(s, PLAIN_NUMBER_CHARS, "") == F.lit("")
    return (F.when(plain, s.try_cast("double"))
            .when(s.rlike(PYFLOAT_PATTERN),
                  F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
            .when(short & low.rlike(PYFLOAT_SPECIAL_NAN), F.lit(float("nan")))
            .when(short & low.rlike(PYFLOAT_SPECIAL_INF),
                  F.when(F.startswith(low, F.lit("-")), F.lit(float("-inf")))
                  .otherwise(F.lit(float("inf")))))


def check_parsed(extracted, extracted_num, gold_val, gold_num) -> Column:
    """Answer check on already parsed sides (each number parsed once):
    null extraction is wrong; both numeric -> float equality (NaN never
    equal); otherwise the stripped strings must match."""
    ext, ef, gf, gv = _c(extracted), _c(extracted_num), _c(gold_num), _c(gold_val)
    same_text = py_strip(ext) == py_strip(gv)
    verdict = (F.when(ext.isNull(), F.lit(False))
               .when(ef.isNotNull() & gf.isNotNull(), (ef == gf) & ~F.isnan(ef))
               .otherwise(same_text))
    return F.coalesce(verdict, F.lit(False))


def check_answer(extracted, gold) -> Column:
    """Answer check: null extraction is wrong; the gold is re-extracted; both
    sides numeric -> float equality (NaN never equal), else stripped strings.
    (Column form for one-off use; ``qamill.operators.scoring`` parses each
    side once in its own projection.)"""
    ext = _c(extracted)
    gv = gold_value(gold)
    return check_parsed(ext, py_float(ext), gv, py_float(gv))


def gold_select(answer_value, answer) -> Column:
    """Gold used for checking: the extracted value when truthy, else the answer."""
    return F.coalesce(F.nullif(_c(answer_value), F.lit("")), _c(answer))


def raw_prompt(question) -> Column:
    return F.concat(F.lit(RAW_QUESTION_PREFIX), _c(question), F.lit(RAW_ANSWER_PREFIX))


def raw_text(question, answer, eos: str | None = DEFAULT_EOS) -> Column:
    """Prompt + answer + end-of-sequence token (when the token is non-empty)."""
    return F.concat(raw_prompt(question), _c(answer), F.lit(eos or ""))


def chat_segment(role, content) -> Column:
    return F.concat(F.lit(CHAT_OPEN), _c(role), F.lit("\n"), _c(content), F.lit(CHAT_CLOSE))


def chat_text(question, answer=None, generation_suffix: str = "") -> Column:
    """Chat layout of one user turn and, when given, one assistant turn.

    Without an answer the generation prompt is appended (plus an optional
    literal such as an empty thinking block)."""
    user = chat_segment(F.lit("user"), question)
    if answer is None:
        return F.concat(user, F.lit(CHAT_GENERATION_PROMPT + generation_suffix))
    return F.concat(user, chat_segment(F.lit("assistant"), answer))


def prompt_text(question, use_chat, generation_suffix: str = "") -> Column:
    """Prompt for generation, chat or raw by a boolean column."""
    return (F.when(_c(use_chat), chat_text(question, None, generation_suffix))
            .otherwise(raw_prompt(question)))


def full_text(question, answer, use_chat, eos: str | None = DEFAULT_EOS) -> Column:
    """Training text, chat or raw by a boolean column."""
    return (F.when(_c(use_chat), chat_text(question, answer))
            .otherwise(raw_text(question, answer, eos)))


def fmt_word(flag) -> Column:
    """``chat`` when the flag is true, ``raw`` for false or null."""
    return F.when(_c(flag), F.lit("chat")).otherwise(F.lit("raw"))


def method_label(train_method) -> Column:
    return F.upper(F.coalesce(_c(train_method), F.lit(UNKNOWN_METHOD)))


def train_label(train_method, train_chat, train_mask) -> Column:
    """``METHOD | train:chat/raw`` plus `` | mask_q`` when masking was on."""
    return F.concat_ws(LABEL_SEP, method_label(train_method),
                       F.concat(F.lit("train:"), fmt_word(train_chat)),
                       F.when(_c(train_mask), F.lit("mask_q")))


def full_label(train_method, train_chat, train_mask, eval_chat) -> Column:
    return F.concat(train_label(train_method, train_chat, train_mask),
                    F.lit(LABEL_SEP + "eval:"), fmt_word(eval_chat))


def infer_method(config_path) -> Column:
    """Training method named in a config path (first hint wins), else null."""
    path = _c(config_path)
    expr = F.lit(None).cast("string")
    for hint in reversed(METHOD_HINTS):
        expr = F.when(F.contains(path, F.lit(hint)), F.lit(hint)).otherwise(expr)
    return expr


def eval_run_name(experiment, eval_chat) -> Column:
    return F.concat(_c(experiment), F.lit("_"),
                    F.when(_c(eval_chat), F.lit("eval_chat")).otherwise(F.lit("eval_raw")))


def model_dir_name(use_chat, method, mask_question, task, stamp) -> Column:
    """``{chat|nochat}_{method}_{maskq|fullloss|default}_{task}_{stamp}``;
    the RL method has no masking option and always says ``default``."""
    masking = (F.when(_c(method) == F.lit("grpo"), F.lit("default"))
               .when(_c(mask_question), F.lit("maskq")).otherwise(F.lit("fullloss")))
    return F.concat_ws("_", F.when(_c(use_chat), F.lit("chat")).otherwise(F.lit("nochat")),
                       _c(method), masking, _c(task), _c(stamp))
