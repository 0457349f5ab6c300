"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Written independently of the Spark code: plain SQL over the same parquet
tables (views ``part``, ``lineitem``, ``conversations``, ...), with patterns of its
own. Python only assembles repeated SQL fragments.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# The code points that Python's str.strip() removes.
SPACES = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239,
          8287, 12288]
WS = "(" + " || ".join(f"chr({c})" for c in SPACES) + ")"
WS_SET = "[" + "".join(f"\\x{{{c:X}}}" for c in SPACES) + "]"
NL = "chr(10)"
MARK_RE = "####" + WS_SET + "*([^\\n]+)"
NUMBER_RE = "-?[\\p{Nd}][\\p{Nd},]*[.]?[\\p{Nd}]*"
FLOAT_RE = "[+-]?([0-9]+(_[0-9]+)*[.]?([0-9]+(_[0-9]+)*)?|[.][0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?"
TOKEN_RE = "[\\pL\\pM\\pN_]+|[^\\pL\\pM\\pN_" + WS_SET[1:-1] + "]"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def marker(x: str) -> str:
    """Marker value (null when no marker)."""
    return (f"(CASE WHEN regexp_matches({x}, '{MARK_RE}') THEN "
            f"replace({strip(f'regexp_extract({x}, {chr(39)}{MARK_RE}{chr(39)}, 1)')}, ',', '') END)")


def gold(x: str) -> str:
    return f"coalesce({marker(x)}, {strip(x)})"


def last_num(x: str) -> str:
    return f"replace((regexp_extract_all({x}, '{NUMBER_RE}'))[-1], ',', '')"


def extract(x: str) -> str:
    return f"coalesce({marker(x)}, {last_num(x)})"


def pyfloat(x: str) -> str:
    s = strip(x)
    return (f"(CASE WHEN regexp_full_match(lower({s}), '[+-]?nan') THEN CAST('nan' AS DOUBLE) "
            f"WHEN regexp_full_match(lower({s}), '[+-]?(inf|infinity)') THEN "
            f"(CASE WHEN starts_with({s}, '-') THEN CAST('-inf' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END) "
            f"WHEN regexp_full_match({s}, '{FLOAT_RE}') THEN TRY_CAST(replace({s}, '_', '') AS DOUBLE) END)")


def check(e: str, g: str) -> str:
    gv = gold(g)
    ef, gf = pyfloat(e), pyfloat(gv)
    return (f"coalesce(CASE WHEN {e} IS NULL THEN false "
            f"WHEN {ef} IS NOT NULL AND {gf} IS NOT NULL THEN ({ef} = {gf} AND NOT isnan({ef})) "
            f"ELSE {strip(e)} = {strip(gv)} END, false)")


def raw_prompt(q: str) -> str:
    return f"('Question: ' || {q} || {NL} || 'Answer: ')"


def chat_seg(role: str, content: str) -> str:
    return f"('<|im_start|>' || {role} || {NL} || {content} || '<|im_end|>' || {NL})"


def chat_prompt(q: str) -> str:
    return f"({chat_seg(chr(39) + 'user' + chr(39), q)} || '<|im_start|>assistant' || {NL})"


def chat_full(q: str, a: str) -> str:
    return f"({chat_seg(chr(39) + 'user' + chr(39), q)} || {chat_seg(chr(39) + 'assistant' + chr(39), a)})"


V = "CAST(floor(p_retailprice * 100) AS BIGINT)"

QA_RAW = f"""qa_raw AS (
  SELECT p_partkey AS sample_id,
         CASE WHEN p_partkey % 5 = 0 THEN 'train' ELSE 'test' END AS split,
         '  Price of ' || p_name || '? ' AS question,
         'It sells.' || {NL} || '#### ' || format('{{:,}}', {V}) || ' ' AS answer
  FROM part)"""

QA = f"""{QA_RAW},
qa AS (
  SELECT sample_id, split, {strip('question')} AS question, {strip('answer')} AS answer,
         {gold(strip('answer'))} AS answer_value
  FROM qa_raw)"""

MODEL_OUTPUT = (f"CASE (l_orderkey + l_linenumber) % 10 "
                f"WHEN 0 THEN '#### ' || format('{{:,}}', {V}) "
                f"WHEN 1 THEN 'so 3 and ' || format('{{:,}}', {V}) || '.' "
                f"WHEN 2 THEN '#### ' || CAST({V} + 1 AS VARCHAR) "
                f"WHEN 3 THEN 'no idea' "
                f"WHEN 4 THEN '#### 5' || {NL} || '#### ' || CAST({V} AS VARCHAR) "
                f"WHEN 5 THEN '#### $' || CAST({V} AS VARCHAR) "
                f"WHEN 6 THEN 'it is ' || CAST({V} AS VARCHAR) || '.0' "
                f"WHEN 8 THEN '#### ' || CAST({V} AS VARCHAR) || ' ,' "
                f"WHEN 9 THEN '#### , ' || CAST({V} AS VARCHAR) "
                f"ELSE '#### ' || {NL} END")

VARIANT = "(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 0 ELSE l_suppkey % 2 END)"
RUN_ID = f"(l_returnflag || '_' || l_linestatus || '_' || CAST({VARIANT} AS VARCHAR))"
METHOD = "(CASE l_returnflag WHEN 'A' THEN 'sft' WHEN 'R' THEN 'grpo' ELSE '' END)"
EXPERIMENT = f"""(CASE WHEN l_returnflag = 'A' AND {VARIANT} = 0 THEN 'sft_no_chat_mask_q'
  WHEN l_returnflag = 'A' THEN 'sft_no_chat_full_loss'
  WHEN l_returnflag = 'R' AND {VARIANT} = 1 THEN 'grpo_chat_template' ELSE {RUN_ID} END)"""

OUTS = f"""outs AS (
  SELECT l_partkey AS sample_id,
         row_number() OVER (PARTITION BY l_partkey
                            ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS gen_no,
         {RUN_ID} AS run_id, {EXPERIMENT} AS experiment_name, 'models/' || {RUN_ID} AS model_path,
         'gsm8k' AS task, {METHOD} AS train_method, {METHOD} = 'grpo' AS train_chat_template,
         {VARIANT} = 0 AS train_mask_question, l_linestatus = 'O' AS eval_chat_template,
         {MODEL_OUTPUT} AS model_output
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

GOLD = """gold AS (
  SELECT sample_id, split, coalesce(nullif(answer_value, ''), answer) AS gold FROM qa)"""

SCORED = f"""{QA},
{OUTS},
{GOLD},
ext AS (SELECT *, {extract('model_output')} AS extracted_answer FROM outs),
scored AS (
  SELECT ext.*, gold.gold, {check('extracted_answer', 'gold.gold')} AS correct
  FROM ext JOIN gold USING (sample_id) WHERE split = 'test')"""

# the first output of each run and sample is the one that an evaluation counts
EVALUATED = f"""{SCORED},
evaluated AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY run_id, sample_id ORDER BY gen_no) = 1)"""

REWARD = f"""{QA},
{OUTS},
{GOLD},
ext AS (SELECT *, {extract('model_output')} AS extracted_answer FROM outs),
rw AS (
  SELECT ext.*, CASE WHEN gold.gold IS NOT NULL AND {check('extracted_answer', 'gold.gold')}
                     THEN 1.0 ELSE 0.0 END::DOUBLE AS reward
  FROM ext JOIN gold USING (sample_id) WHERE split = 'train')"""

RUN_KEYS = ("run_id, experiment_name, train_method, train_chat_template, train_mask_question, "
            "eval_chat_template, model_path, task")


def summary_select(asked: str) -> str:
    """Per-run totals over the samples that the subquery ``asked`` lists."""
    n = f"(SELECT count(*) FROM ({asked}) a)"
    hit = f"count(*) FILTER (WHERE correct AND sample_id IN ({asked}))"
    return (f"{RUN_KEYS}, {n} AS total_samples, {hit} AS correct, "
            f"coalesce(CAST({hit} AS DOUBLE) / nullif({n}, 0), 0.0) AS accuracy")


ASKED = "SELECT sample_id FROM qa WHERE split = 'test'"
FEWER = ASKED + " ORDER BY sample_id LIMIT 100"

RUNS = f"""{EVALUATED},
runs AS (
  SELECT {summary_select(ASKED)}, 'eval/' || run_id AS eval_dir
  FROM evaluated GROUP BY {RUN_KEYS})"""


def q(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


# --- QA samples ---------------------------------------------------------------------
q("qa_scan", f"WITH {QA} SELECT sample_id, split, question, answer, answer_value FROM qa")
q("split_filter", f"WITH {QA} SELECT sample_id, question, answer, answer_value FROM qa "
                  f"WHERE split = 'test'")
q("split_requested", f"""WITH {QA}, {OUTS},
asked AS (SELECT DISTINCT CASE WHEN train_method = 'grpo' THEN 'train' ELSE 'test' END AS split
          FROM outs WHERE train_method = 'sft')
SELECT sample_id, split, question, answer, answer_value FROM qa WHERE split IN (SELECT split FROM asked)""")
q("gold_extract", f"WITH {QA_RAW} SELECT sample_id, {gold('answer')} AS gold_value FROM qa_raw")
q("gold_select", f"WITH {QA} SELECT sample_id, coalesce(nullif(answer_value, ''), answer) AS gold FROM qa")
q("raw_prompt", f"WITH {QA} SELECT sample_id, {raw_prompt('question')} AS prompt FROM qa")
q("eval_prompts", f"""WITH {QA}
SELECT sample_id, f.eval_chat_template,
       CASE WHEN f.eval_chat_template THEN {chat_prompt('question')} ELSE {raw_prompt('question')} END AS prompt
FROM qa, (VALUES (true), (false)) AS f(eval_chat_template) WHERE split = 'test'""")
q("rl_prompt_set", f"""WITH {QA}
SELECT sample_id, {raw_prompt('question')} AS prompt, coalesce(nullif(answer_value, ''), answer) AS answer
FROM qa WHERE split = 'train'""")
q("max_samples", f"WITH {QA} SELECT sample_id, question FROM qa WHERE split = 'test' "
                 f"ORDER BY sample_id LIMIT 100")

# --- scoring ------------------------------------------------------------------------
q("extract_marker", f"WITH {OUTS} SELECT sample_id, gen_no, {marker('model_output')} AS marker_value FROM outs")
q("extract_answer", f"WITH {OUTS} SELECT sample_id, gen_no, {extract('model_output')} AS extracted_answer FROM outs")
q("extract_last_number", f"SELECT doc_id, {last_num('text')} AS last_number FROM documents")
q("check_answer", f"WITH {SCORED} SELECT sample_id, gen_no, run_id, extracted_answer, gold, correct FROM scored")
q("check_fractions", """WITH fr AS (
  SELECT l_partkey AS sample_id, p_size,
         row_number() OVER (PARTITION BY l_partkey
                            ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS gen_no,
         CASE l_orderkey % 4
           WHEN 0 THEN CAST(p_size * l_linenumber AS VARCHAR) || '/' || CAST(8 * l_linenumber AS VARCHAR)
           WHEN 1 THEN CAST(CAST(p_size AS DECIMAL(18, 3)) / 8 AS DECIMAL(18, 3))::VARCHAR
           WHEN 2 THEN CAST(p_size + 1 AS VARCHAR) || '/8' ELSE 'unknown' END AS extracted_answer
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 5 <> 0)
SELECT sample_id, gen_no, extracted_answer, CAST(p_size AS VARCHAR) || '/8' AS gold,
       CASE WHEN contains(extracted_answer, '/')
              THEN CAST(split_part(extracted_answer, '/', 1) AS BIGINT) * 8
                   = p_size * CAST(split_part(extracted_answer, '/', 2) AS BIGINT)
            WHEN contains(extracted_answer, '.') THEN CAST(extracted_answer AS DECIMAL(18, 3)) * 8 = p_size
            ELSE false END AS correct
FROM fr""")
DETAILS = f"""{EVALUATED},
details AS (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY sample_id) - 1 AS index,
         sample_id, qa.question, qa.answer AS gold_answer, qa.answer_value AS gold_value,
         model_output, extracted_answer, correct
  FROM evaluated JOIN qa USING (sample_id))"""
q("score_details", f"WITH {DETAILS} SELECT * FROM details")
q("run_summary", f"WITH {EVALUATED} SELECT {summary_select(ASKED)} FROM evaluated GROUP BY {RUN_KEYS}")
q("run_summary_limited", f"""WITH {EVALUATED}
SELECT {summary_select(FEWER)} FROM evaluated WHERE sample_id IN ({FEWER}) GROUP BY {RUN_KEYS}""")
q("reward", f"WITH {REWARD} SELECT sample_id, gen_no, run_id, reward FROM rw")
q("reward_by_prompt", f"""WITH {REWARD}
SELECT sample_id, count(*) AS n_completions, avg(reward) AS mean_reward FROM rw GROUP BY sample_id""")
q("reward_by_prompt_bucketed", ORACLE["reward_by_prompt"])
q("reward_by_run", f"""WITH {REWARD}
SELECT run_id, count(*) AS n_completions, avg(reward) AS mean_reward FROM rw GROUP BY run_id""")
q("group_advantage", f"""WITH {REWARD},
g AS (SELECT *, CAST(floor((gen_no - 1) / 4) AS BIGINT) AS group_id FROM rw)
SELECT sample_id, gen_no, group_id, reward,
       avg(reward) OVER w AS group_mean,
       round((reward - avg(reward) OVER w) / (coalesce(stddev_samp(reward) OVER w, 0) + 0.0001), 9)
         AS advantage
FROM g WINDOW w AS (PARTITION BY sample_id, group_id)""")
q("output_union", f"""WITH {OUTS}
SELECT run_id, sample_id, gen_no, model_output FROM outs
UNION ALL
SELECT 'conversations', conv_id, CAST(turn AS BIGINT), text FROM conversations WHERE role = 'assistant'""")


# --- conversations, tokens, SFT examples, batches ------------------------------------
PAIRS = f"""pairs AS (
  SELECT (conv_id, turn) AS sid, conv_id, turn, {strip('text')} AS question,
         {strip('next_text')} AS answer
  FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) c
  WHERE role = 'user' AND next_role = 'assistant')"""


def lcp(p: str, f: str) -> str:
    m = f"least(len({p}), len({f}))"
    return (f"coalesce(list_position(list_transform(range(1, {m} + 1), lambda i: {p}[i] = {f}[i]), false) - 1, "
            f"{m})")


def fill(value: str, n: str) -> str:
    return f"list_transform(range(greatest({n}, 0)), lambda x: {value})"


def txt(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def tok(ptext: str, ftext: str, vocab_of: str = "ftok") -> str:
    """Tokens, ids, examples and batches of the given prompt and full texts."""
    return f"""{PAIRS},
texts AS (SELECT sid, {ptext} AS ptext, {ftext} AS ftext FROM pairs),
tl AS (SELECT sid, regexp_extract_all(ptext, '{TOKEN_RE}') AS ptoks,
              regexp_extract_all(ftext, '{TOKEN_RE}') AS ftoks FROM texts),
ftok AS (SELECT sid, pos, ftoks[pos] AS token
         FROM (SELECT sid, ftoks, unnest(range(1, len(ftoks) + 1)) AS pos FROM tl)),
ptok AS (SELECT sid, pos, ptoks[pos] AS token
         FROM (SELECT sid, ptoks, unnest(range(1, len(ptoks) + 1)) AS pos FROM tl)),
vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS token_id
          FROM {vocab_of} GROUP BY token),
fids AS (SELECT sid, list(token_id ORDER BY pos) AS full_ids FROM ftok JOIN vocab USING (token) GROUP BY sid),
pids AS (SELECT sid, list(token_id ORDER BY pos) AS prompt_ids FROM ptok JOIN vocab USING (token) GROUP BY sid),
tok AS (SELECT tl.sid, coalesce(fids.full_ids, []::BIGINT[]) AS full_ids,
               coalesce(pids.prompt_ids, []::BIGINT[]) AS prompt_ids
        FROM tl LEFT JOIN fids USING (sid) LEFT JOIN pids USING (sid)),
ex1 AS (SELECT sid, full_ids, prompt_ids, list_slice(full_ids, 1, 1024) AS input_ids,
               list_slice(prompt_ids, 1, 1024) AS pt FROM tok),
ex2 AS (SELECT *, {lcp('pt', 'input_ids')} AS prompt_len FROM ex1),
ex AS (SELECT *, list_transform(input_ids, lambda x: 1) AS attention_mask,
              list_concat({fill('-100', 'least(prompt_len, len(input_ids))')},
                          list_slice(input_ids, prompt_len + 1, len(input_ids))) AS labels
       FROM ex2),
b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY sid) - 1) / 16) AS BIGINT) AS batch_id FROM ex),
lp AS (SELECT *, CAST(max(len(prompt_ids)) OVER (PARTITION BY batch_id) AS BIGINT) AS width FROM b),
lp2 AS (SELECT *, list_concat({fill('0', 'width - len(prompt_ids)')}, prompt_ids) AS gen_ids,
               list_concat({fill('0', 'width - len(prompt_ids)')}, list_transform(prompt_ids, lambda x: 1)) AS gen_mask
        FROM lp)"""


RAW_PROMPT = raw_prompt("question")
RAW_FULL = f"{RAW_PROMPT} || answer || '<|im_end|>'"
TOK = tok(RAW_PROMPT, RAW_FULL)
CHAT = tok(chat_prompt("question"), chat_full("question", "answer"))
THINK = "'<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)"
CHAT_THINK = tok(f"{chat_prompt('question')} || {THINK}", chat_full("question", "answer"),
                 "(SELECT token FROM ftok UNION ALL SELECT token FROM ptok) bt")
KEY = "sid[1] AS conv_id, sid[2] AS turn"

q("conv_pairs", f"WITH {PAIRS} SELECT conv_id, turn, question, answer FROM pairs")
q("chat_render", f"""
SELECT conv_id, count(*) AS n_turns,
       string_agg({chat_seg('role', chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}, '' ORDER BY turn) ||
       CASE WHEN arg_max(role, turn) <> 'assistant' THEN '<|im_start|>assistant' || {NL} ELSE '' END AS text
FROM conversations GROUP BY conv_id""")
q("chat_prompt", f"WITH {PAIRS} SELECT conv_id, turn, {chat_prompt('question')} AS prompt FROM pairs")
q("sft_text", f"""WITH {PAIRS}
SELECT conv_id, turn, f.use_chat_template,
       CASE WHEN f.use_chat_template THEN {chat_full('question', 'answer')}
            ELSE {raw_prompt('question')} || answer || '<|im_end|>' END AS text
FROM pairs, (VALUES (true), (false)) AS f(use_chat_template)""")
q("vocab", f"""
WITH toks AS (SELECT unnest(regexp_extract_all(text, '{TOKEN_RE}')) AS token FROM documents)
SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) AS token_id
FROM toks GROUP BY token""")
q("token_ids", f"""WITH {TOK}
SELECT {KEY}, CAST(len(full_ids) AS BIGINT) AS n_tokens, {txt('full_ids')} AS input_ids,
       {txt('list_transform(full_ids, lambda x: 1)')} AS attention_mask FROM tok""")
q("truncate_tokens", f"""WITH {TOK}
SELECT {KEY}, CAST(least(len(full_ids), 48) AS BIGINT) AS n_tokens,
       {txt('list_slice(full_ids, 1, 48)')} AS input_ids FROM ex""")
q("prompt_lcp", f"WITH {TOK} SELECT {KEY}, CAST(prompt_len AS BIGINT) AS prompt_len FROM ex")
q("mask_labels", f"WITH {TOK} SELECT {KEY}, {txt('labels')} AS labels FROM ex")

EXAMPLE = f"{KEY}, {txt('input_ids')} AS input_ids, {txt('attention_mask')} AS attention_mask"
q("sft_examples", f"WITH {TOK} SELECT {EXAMPLE}, {txt('labels')} AS labels FROM ex")
# byte-level ids stand for the text itself; the space before an answer is part of its first word's token
q("sft_examples_model", f"""WITH {PAIRS}
SELECT conv_id, turn, {RAW_FULL} AS input_text, ' ' || answer || '<|im_end|>' AS supervised_text FROM pairs""")
q("sft_examples_full_loss", f"WITH {TOK} SELECT {EXAMPLE}, {txt('input_ids')} AS labels FROM ex")
q("sft_examples_chat", f"WITH {CHAT} SELECT {EXAMPLE}, {txt('input_ids')} AS labels FROM ex")
q("sft_examples_chat_mask", f"WITH {CHAT_THINK} SELECT {EXAMPLE}, {txt('labels')} AS labels FROM ex")
q("loss_token_stats", f"""WITH {TOK},
s AS (SELECT len(labels) AS total, len(list_filter(labels, lambda x: x = -100)) AS masked,
             len(full_ids) AS n_full FROM ex)
SELECT count(*) AS n_rows, CAST(sum(masked) AS BIGINT) AS masked_tokens,
       CAST(sum(total - masked) AS BIGINT) AS supervised_tokens,
       count(*) FILTER (WHERE total - masked = 0) AS rows_no_supervised,
       count(*) FILTER (WHERE n_full > 1024) AS rows_truncated
FROM s""")
q("batch_assign", f"WITH {TOK} SELECT {KEY}, batch_id FROM b")
q("batch_slice", f"WITH {TOK} SELECT {KEY}, batch_id, {txt('input_ids')} AS input_ids FROM b WHERE batch_id = 3")
q("batch_counts", f"WITH {PAIRS} SELECT CAST(ceil(count(*) / 16.0) AS BIGINT) AS n_batches FROM pairs")


def padded(name: str, cap: int) -> None:
    """Right-padded batches at most ``cap`` wide."""
    def part(x: str, fill_with: str) -> str:
        return txt(f"list_concat(list_slice({x}, 1, width), {fill(fill_with, f'width - len({x})')})")
    q(name, f"""WITH {TOK},
w AS (SELECT *, CAST(least(max(len(input_ids)) OVER (PARTITION BY batch_id), {cap}) AS BIGINT) AS width FROM b)
SELECT {KEY}, batch_id, width, {part('input_ids', '0')} AS input_ids, {part('labels', '-100')} AS labels,
       {part('attention_mask', '0')} AS attention_mask
FROM w""")


padded("batch_pad", 1024)
padded("batch_pad_capped", 48)
q("left_pad", f"""WITH {TOK}
SELECT {KEY}, batch_id, width, {txt('gen_ids')} AS input_ids, {txt('gen_mask')} AS attention_mask FROM lp2""")
q("mask_counts", f"""WITH {TOK}
SELECT {KEY}, CAST(list_sum(gen_mask) AS BIGINT) AS real_tokens,
       CAST(len(list_filter(gen_mask, lambda x: x = 0)) AS BIGINT) AS pad_tokens FROM lp2""")
q("completion_slice", f"""WITH {TOK},
g AS (SELECT sid, list_concat(gen_ids, list_slice(full_ids, {lcp('prompt_ids', 'full_ids')} + 1, len(full_ids))) AS gen,
             width FROM lp2)
SELECT {KEY}, {txt('list_slice(gen, width + 1, len(gen))')} AS completion_ids FROM g""")


# --- run summaries, report, experiment grid, options ---------------------------------
def train_label(m: str, c: str, k: str) -> str:
    return (f"concat_ws(' | ', upper(coalesce({m}, '?')), "
            f"'train:' || CASE WHEN {c} THEN 'chat' ELSE 'raw' END, CASE WHEN {k} THEN 'mask_q' END)")


def full_label(m: str, c: str, k: str, e: str) -> str:
    return f"({train_label(m, c, k)} || ' | eval:' || CASE WHEN {e} THEN 'chat' ELSE 'raw' END)"


LABELLED = f"""{RUNS},
lab AS (SELECT *, {train_label('train_method', 'train_chat_template', 'train_mask_question')} AS train_label,
               {full_label('train_method', 'train_chat_template', 'train_mask_question', 'eval_chat_template')} AS label
        FROM runs)"""

REPORT_COLS = ("run_id, eval_dir, experiment_name, train_method, train_chat_template, train_mask_question, "
               "eval_chat_template, model_path, task, total_samples, correct, accuracy")


def first_sql(src: str) -> str:
    return (f"SELECT train_label, eval_chat_template, min(eval_dir) AS eval_dir, "
            f"arg_min(accuracy, eval_dir) AS accuracy FROM {src} "
            f"WHERE eval_chat_template IS NOT NULL GROUP BY train_label, eval_chat_template")


def sides_sql(src: str) -> str:
    return (f"SELECT train_label, max(CASE WHEN eval_chat_template THEN accuracy END) AS chat_accuracy, "
            f"max(CASE WHEN NOT eval_chat_template THEN accuracy END) AS raw_accuracy "
            f"FROM ({first_sql(src)}) f GROUP BY train_label")


ORDER_SQL = ("SELECT train_label, min(eval_dir) AS first_dir, "
             "row_number() OVER (ORDER BY min(eval_dir), train_label) AS label_order FROM lab GROUP BY train_label")

q("report_comparison", f"WITH {LABELLED} SELECT {REPORT_COLS}, label, train_label FROM lab")
q("report_first", f"""WITH {RUNS},
both_runs AS (SELECT * FROM runs UNION ALL
              SELECT * REPLACE (eval_dir || '_rerun' AS eval_dir, 1.0 - accuracy AS accuracy)
              FROM runs WHERE run_id = 'N_O_0'),
lab AS (SELECT *, {train_label('train_method', 'train_chat_template', 'train_mask_question')} AS train_label FROM both_runs)
{first_sql('lab')}""")
q("report_grouped", f"""WITH {LABELLED}
SELECT s.train_label, coalesce(chat_accuracy, 0.0) AS chat_accuracy, coalesce(raw_accuracy, 0.0) AS raw_accuracy,
       o.label_order
FROM ({sides_sql('lab')}) s JOIN ({ORDER_SQL}) o USING (train_label)""")
q("report_pairs", f"""WITH {RUNS},
lab AS (SELECT *, {train_label('train_method', 'train_chat_template', 'train_mask_question')} AS train_label
        FROM runs)
SELECT train_label, chat_accuracy AS chat, raw_accuracy AS raw FROM ({sides_sql('lab')}) s
WHERE chat_accuracy IS NOT NULL AND raw_accuracy IS NOT NULL""")
q("report_labels", f"WITH {LABELLED} {ORDER_SQL}")
q("report_max", f"WITH {RUNS} SELECT max(accuracy) AS max_accuracy FROM runs")
q("accuracy_pct", f"""WITH {RUNS}
SELECT run_id, accuracy, printf('%.2f%%', accuracy * 100) AS accuracy_pct,
       printf('%.1f%%', accuracy * 100) AS accuracy_pct1 FROM runs""")
q("summary_union", f"""WITH {RUNS},
u AS (SELECT * FROM runs WHERE eval_chat_template
      UNION ALL BY NAME
      SELECT * EXCLUDE (train_method, train_mask_question) FROM runs WHERE NOT eval_chat_template)
SELECT {REPORT_COLS},
       {train_label('train_method', 'train_chat_template', 'train_mask_question')} AS train_label,
       {full_label('train_method', 'train_chat_template', 'train_mask_question', 'eval_chat_template')} AS label
FROM u""")
q("runs_with_summary", f"WITH {RUNS} SELECT DISTINCT eval_dir FROM runs")

RUN_INFO_VALUES = """(VALUES ('models/N_O_0', 'configs/grpo.yaml', true, false),
        ('models/N_O_1', 'configs/sft.yaml', false, true),
        ('models/N_F_0', 'configs/custom.yaml', NULL, NULL),
        ('models/A_F_0', 'configs/grpo.yaml', true, false))
        AS ri(ri_path, ri_cfg, ri_chat, ri_mask)"""

q("run_enrich", f"""WITH {RUNS}
SELECT run_id, model_path,
       CASE WHEN ri_path IS NOT NULL AND coalesce(train_method, '') = ''
            THEN coalesce(CASE WHEN contains(ri_cfg, 'grpo') THEN 'grpo' WHEN contains(ri_cfg, 'sft') THEN 'sft' END,
                          train_method)
            ELSE train_method END AS train_method,
       CASE WHEN ri_path IS NOT NULL AND NOT coalesce(train_chat_template, false)
            THEN ri_chat ELSE train_chat_template END AS train_chat_template,
       CASE WHEN ri_path IS NOT NULL AND NOT coalesce(train_mask_question, false)
            THEN ri_mask ELSE train_mask_question END AS train_mask_question
FROM runs LEFT JOIN {RUN_INFO_VALUES} ON runs.model_path = ri.ri_path""")

EXPERIMENTS_VALUES = """(VALUES ('sft_chat_template', 'sft', true, false),
        ('grpo_chat_template', 'grpo', true, false),
        ('sft_no_chat_full_loss', 'sft', false, false),
        ('grpo_no_chat', 'grpo', false, false),
        ('sft_no_chat_mask_q', 'sft', false, true)) AS e(name, method, use_chat_template, mask_question)"""

CELLS = f"""cells AS (
  SELECT e.*, CAST(f.eval_order AS BIGINT) AS eval_order, f.eval_chat_template,
         name || '_' || CASE WHEN f.eval_chat_template THEN 'eval_chat' ELSE 'eval_raw' END AS eval_name
  FROM {EXPERIMENTS_VALUES}, (VALUES (0, true), (1, false)) AS f(eval_order, eval_chat_template))"""

GRID_COLS = "name, method, use_chat_template, mask_question, eval_chat_template, eval_order, eval_name"
CELL_JOIN = "cells.name = runs.experiment_name AND cells.eval_chat_template = runs.eval_chat_template"

# --- files: the same rows come back ----------------------------------------------------
q("results_roundtrip", f"""WITH {DETAILS},
runs AS (SELECT {summary_select(ASKED)} FROM evaluated GROUP BY {RUN_KEYS})
SELECT run_id, index, sample_id, extracted_answer, details.correct, accuracy
FROM details JOIN runs USING (run_id)""")
q("summary_files", f"WITH {RUNS} SELECT 'run_id=' || run_id AS run_dir, * EXCLUDE (run_id, eval_dir) FROM runs")
q("summary_key_union", f"""WITH {RUNS}
SELECT experiment_name, CASE WHEN eval_chat_template THEN train_method END AS train_method, train_chat_template,
       CASE WHEN eval_chat_template THEN train_mask_question END AS train_mask_question, eval_chat_template,
       model_path, task, total_samples, correct, accuracy,
       CASE WHEN NOT eval_chat_template THEN 'raw ' || run_id END AS note,
       CASE WHEN eval_chat_template THEN '{{"on":true,"top_k":' || correct || '}}' END AS sampling,
       CASE WHEN eval_chat_template THEN CAST(length(run_id) AS BIGINT) END AS seed,
       CASE WHEN eval_chat_template AND train_mask_question THEN CAST(0.7 AS DOUBLE) END AS temperature,
       'run_id=' || run_id AS eval_dir FROM runs""")
q("discovered_runs", f"WITH {RUNS} SELECT 'run_id=' || run_id AS run_dir FROM runs")
q("comparison_csv", ORACLE["report_comparison"])
q("detail_documents", f"""WITH {DETAILS}
SELECT 'run_id=' || run_id AS run_dir, index, question, gold_value, model_output, extracted_answer, correct
FROM details""")
q("result_documents", f"""WITH {DETAILS}
SELECT run_id AS run_dir, experiment_name, index, question, gold_value, model_output, extracted_answer, correct
FROM details JOIN (SELECT DISTINCT run_id, experiment_name FROM outs) USING (run_id)""")
q("run_info_files", f"""WITH {OUTS}
SELECT DISTINCT model_path, 'configs/sft.yaml' AS original_config_path,
       train_chat_template AS use_chat_template, nullif(train_mask_question, false) AS mask_question,
       '2024-01-02T03:04:05' AS stamp FROM outs""")

q("experiment_matrix", f"""WITH {RUNS}, {CELLS}
SELECT {', '.join('cells.' + c for c in GRID_COLS.split(', '))}, runs.run_id, runs.accuracy
FROM cells LEFT JOIN runs ON {CELL_JOIN}""")
q("experiment_filter", f"""WITH {RUNS}, {CELLS}
SELECT {', '.join('cells.' + c for c in GRID_COLS.split(', '))}, runs.run_id, runs.accuracy
FROM cells LEFT JOIN runs ON {CELL_JOIN}
WHERE cells.name IN ('sft_no_chat_mask_q', 'grpo_no_chat', 'sft_chat')""")
q("missing_evals", f"""WITH {RUNS}, {CELLS}
SELECT {GRID_COLS} FROM cells WHERE NOT EXISTS (SELECT 1 FROM runs WHERE {CELL_JOIN})""")

MERGED = """m AS (SELECT event_id, props, map_concat(MAP {'k': '0', 'src': 'cfg'},
                                         json_transform(props, '"MAP(VARCHAR, VARCHAR)"')) AS opts
              FROM events)"""


def opt_get(key: str, default: str) -> str:
    return f"CASE WHEN map_contains(opts, '{key}') THEN opts['{key}'] ELSE '{default}' END"


q("option_merge", f"""WITH {MERGED}
SELECT event_id, opts['k'] AS opt_k, opts['src'] AS opt_src, CAST(cardinality(opts) AS BIGINT) AS n_opts,
       props IS NOT NULL AND NOT json_valid(props) AS malformed FROM m""")
q("option_default", f"""WITH {MERGED}
SELECT event_id, {opt_get('k', 'none')} AS opt_k, {opt_get('temperature', '0.0')} AS opt_temperature,
       {opt_get('do_sample', 'false')} AS opt_do_sample FROM m""")
q("option_typed", """WITH e AS (
  SELECT event_id, event_type = 'click' AS click, CASE WHEN json_valid(props) THEN props END AS good, props FROM events)
SELECT event_id, coalesce(props IS NOT NULL AND json_type(good) IS DISTINCT FROM 'OBJECT', false) AS malformed,
       CASE WHEN click THEN event_id ELSE coalesce(CAST(json_extract(good, '$.k') AS BIGINT), 0) END AS opt_k,
       CAST(0.7 AS DOUBLE) AS opt_temperature, CAST(NULL AS BOOLEAN) AS opt_do_sample,
       CAST(512 AS BIGINT) AS opt_max_tokens, coalesce(click, false) AS opt_thinking,
       CASE WHEN click THEN NULL ELSE CAST(3 AS BIGINT) END AS opt_turns, 'b' AS opt_stop, coalesce(click, false) AS has_x,
       CAST(CASE WHEN click THEN 6 ELSE 5 END + len(list_filter(coalesce(json_keys(good), []),
            lambda x: x NOT IN ('k', 'temperature', 'do_sample', 'chat', 'stop'))) AS BIGINT) AS n_opts
FROM e""")
q("run_names", """WITH e AS (
  SELECT event_id, strftime(timezone('America/Los_Angeles', timezone('UTC', ts)), '%Y%m%d_%H%M%S') AS stamp,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'grpo' ELSE 'sft' END AS method
  FROM events)
SELECT event_id, stamp,
       concat_ws('_', CASE WHEN event_id % 2 = 0 THEN 'chat' ELSE 'nochat' END, method,
                 CASE WHEN method = 'grpo' THEN 'default' WHEN event_id % 3 = 0 THEN 'maskq' ELSE 'fullloss' END,
                 'gsm8k', stamp) AS run_name
FROM e""")
