"""File sources and sinks for evaluation results and run metadata.

* results: a summary table and a detail table, each partitioned by ``run_id``, or one nested
  ``{"summary", "details"}`` document a run (``qamill.sources.documents``);
* every sink replaces the runs (models) it is given and leaves all others as they are;
* summaries as one JSON document a run, details as JSON lines, comparison tables as
  CSV with a header;
* reading summaries scattered over run directories: a run directory is a direct child of
  the evaluation folder and holds ``summary.json`` or the part file that the summary sink
  writes; each row is tagged with its directory, directories without one are skipped and
  no match at all gives an empty table with the full schema;
* summaries with keys of any name (``read_summary_union``), found in the files as VARIANT;
* reading details back from JSON lines (any size), or from nested result documents: those in the writer's
  layout by lines (any size), others as a whole (one document is one row, so one task reads it).

Every other read names its schema, so no scan infers types.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from qamill.session import materialize

SUMMARY_SCHEMA = Ty.StructType([
    Ty.StructField("experiment_name", Ty.StringType()),
    Ty.StructField("train_method", Ty.StringType()),
    Ty.StructField("train_chat_template", Ty.BooleanType()),
    Ty.StructField("train_mask_question", Ty.BooleanType()),
    Ty.StructField("eval_chat_template", Ty.BooleanType()),
    Ty.StructField("model_path", Ty.StringType()),
    Ty.StructField("task", Ty.StringType()),
    Ty.StructField("total_samples", Ty.LongType()),
    Ty.StructField("correct", Ty.LongType()),
    Ty.StructField("accuracy", Ty.DoubleType()),
])

DETAIL_SCHEMA = Ty.StructType([
    Ty.StructField("index", Ty.LongType()),
    Ty.StructField("question", Ty.StringType()),
    Ty.StructField("gold_answer", Ty.StringType()),
    Ty.StructField("gold_value", Ty.StringType()),
    Ty.StructField("model_output", Ty.StringType()),
    Ty.StructField("extracted_answer", Ty.StringType()),
    Ty.StructField("correct", Ty.BooleanType()),
])

RESULTS_DOC_SCHEMA = Ty.StructType([
    Ty.StructField("summary", SUMMARY_SCHEMA),
    Ty.StructField("details", Ty.ArrayType(DETAIL_SCHEMA)),
])

RUN_INFO_FILE_SCHEMA = Ty.StructType([
    Ty.StructField("model_path", Ty.StringType()),
    Ty.StructField("original_config_path", Ty.StringType()),
    Ty.StructField("cli_args", Ty.StructType([
        Ty.StructField("task", Ty.StringType()),
        Ty.StructField("use_chat_template", Ty.BooleanType()),
        Ty.StructField("mask_question", Ty.BooleanType()),
        Ty.StructField("output_dir", Ty.StringType()),
    ])),
    Ty.StructField("timestamp", Ty.TimestampType()),
])

#: Column types of JSON values under keys that no schema names; all others are read as JSON text.
VALUE_TYPES = {"BIGINT": "bigint", "BOOLEAN": "boolean", "DOUBLE": "double", "FLOAT": "double", "STRING": "string",
               "VOID": "string"}

#: Distinct splits that a run list is broadcast with at most.
MAX_SPLITS = 10_000
FILE_PATH = Ty.StructType([Ty.StructField("file_path", Ty.StringType())])
#: Documents whose summaries are broadcast to their lines at most.
MAX_DOCUMENTS = 10_000
#: First line of a document as ``documents.write_result_documents`` writes it; a detail is a line, then comes the last.
HEAD = r'^\{"summary": (\{.*\}), "details": \[$'
TAIL = "]}"
SUMMARY_FILES = "{summary,part-*}.json"
DETAIL_FILES = "part-*.json"


def _dir_of_file() -> F.Column:
    return F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", "")


def _in_children(reader: DataFrameReader, base: str, names: str, empty: DataFrame) -> DataFrame:
    """JSON documents called ``names`` in direct children of ``base``: one level is listed, so neither deeper
    folders nor files of other names (details) are. ``empty`` where there is none."""
    escaped = re.sub(r"([][{}*?\\])", r"\\\1", base.rstrip("/"))
    try:
        return reader.option("multiLine", True).json(f"{escaped}/*/{names}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty


def write_samples(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """QA samples partitioned by split on disk, so loading one split lists and
    reads only that split's folder."""
    samples.write.mode(mode).partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a split-partitioned sample table (partition pruning)."""
    return spark.read.parquet(path).where(F.col("split") == F.lit(split))


def read_requested(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """The splits that some of ``requests`` (a ``split`` column) ask for. The samples' partitions are
    pruned while the query runs, by the splits found in the requests: their distinct splits are counted, and
    broadcast up to ``MAX_SPLITS``; beyond it the join is a plain one and prunes nothing. An empty split is
    on disk as the null one, which equals none."""
    asked = materialize(requests.select("split").distinct()).where(F.col("split") > "")
    if asked.limit(MAX_SPLITS + 1).count() <= MAX_SPLITS:
        asked = F.broadcast(asked)
    return spark.read.parquet(path).join(asked, "split", "left_semi")


def _by_folder(df: DataFrame, column: str, mode: str):
    """A writer that keeps a folder for each value of ``column``. Overwriting replaces the folders of
    the values that ``df`` has and no others."""
    return df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(column)


def write_results(summaries: DataFrame, details: DataFrame, base: str,
                  fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Summary and detail tables under ``base/summary`` and ``base/details``, both partitioned by
    ``run_id`` so a reader of one run prunes the rest. Other runs in the folder stay."""
    _by_folder(summaries, "run_id", mode).format(fmt).save(f"{base}/summary")
    _by_folder(details, "run_id", mode).format(fmt).save(f"{base}/details")


def write_summaries_json(summaries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document in a folder for each run; ``read_summary_files`` finds it. Null fields are
    written, so a present null stays apart from an absent key. Other runs in the folder stay."""
    _by_folder(summaries, "run_id", mode).option("ignoreNullFields", False).json(path)


def write_details_json(details: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Detail rows as JSON lines in a folder for each run. Other runs in the folder stay."""
    _by_folder(details, "run_id", mode).option("ignoreNullFields", False).json(path)


def read_detail_files(spark: SparkSession, eval_base: str) -> DataFrame:
    """Detail rows of all runs below ``eval_base``, tagged with the run directory. JSON
    lines split over tasks, whatever the size of a run."""
    return (spark.read.schema(DETAIL_SCHEMA)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", DETAIL_FILES)
            .json(eval_base)
            .withColumn("eval_dir", _dir_of_file()))


def read_results(spark: SparkSession, base: str, fmt: str = "parquet",
                 run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    s = spark.read.format(fmt).load(f"{base}/summary")
    d = spark.read.format(fmt).load(f"{base}/details")
    if run_id is not None:   # partition pruning: only that run's directory is listed
        s, d = s.where(F.col("run_id") == run_id), d.where(F.col("run_id") == run_id)
    return s, d


def read_summary_files(spark: SparkSession, eval_base: str) -> DataFrame:
    """The summary of every run directory in ``eval_base`` (one JSON document in a file),
    with ``eval_dir`` = the directory holding it. Deeper directories, files of the
    folder itself and directories without a summary are skipped; none at all -> an
    empty table with the schema."""
    none = spark.createDataFrame([], Ty.StructType([*SUMMARY_SCHEMA.fields,
                                                    Ty.StructField("_metadata", FILE_PATH)]))
    df = _in_children(spark.read.schema(SUMMARY_SCHEMA), eval_base, SUMMARY_FILES, none)
    return df.select(*SUMMARY_SCHEMA.names, _dir_of_file().alias("eval_dir"))


def _scalar(value: F.Column, kind: str) -> F.Column:
    """A JSON value as a column of ``kind``, null for a JSON null or where it has no such value."""
    return F.when(~F.is_variant_null(value), F.try_variant_get(value, "$", kind))


def _json_text(value: F.Column) -> F.Column:
    """Texts as they are, any other JSON value as JSON text."""
    plain = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.when(~F.is_variant_null(value), F.coalesce(plain, F.to_json(value)))


def read_summary_union(spark: SparkSession, eval_base: str) -> DataFrame:
    """``read_summary_files`` with every key that any summary has: the schema's columns first, then
    the others by name. A key that a summary lacks is null in its row.

    The files are read as VARIANT. One pass aggregates the keys and their types (as many rows as there are
    keys come to the driver), one projection makes the columns. Whole numbers are bigint, other numbers
    double; objects, arrays and keys of mixed types are JSON text. Of keys that differ in case alone from an
    earlier one, the column gets a number: ``Seed`` after ``seed`` is ``Seed_2``. No summary at all gives an
    empty table with the schema's columns; a file that holds no object is a row of nulls."""
    none = spark.createDataFrame([], Ty.StructType([Ty.StructField("_doc", Ty.VariantType()),
                                                    Ty.StructField("_metadata", FILE_PATH)]))
    files = _in_children(spark.read.option("singleVariantColumn", "_doc"), eval_base, SUMMARY_FILES, none)
    found = files.select(F.expr("try_cast(_doc as map<string,variant>)").alias("_keys"),
                         _dir_of_file().alias("eval_dir"))
    known = {f.name: f.dataType.simpleString() for f in SUMMARY_SCHEMA.fields}
    others = found.select(F.explode("_keys").alias("key", "value")).where(~F.col("key").isin(*known)) \
        .groupBy("key").agg(F.schema_of_variant_agg("value").alias("kind")).orderBy("key").collect()
    columns = [_scalar(F.element_at("_keys", F.lit(k)), kind).alias(k) for k, kind in known.items()]
    taken = {k.lower() for k in known} | {"eval_dir"}
    for key, kind in others:
        name, n = key, 1
        while name.lower() in taken:
            n += 1
            name = f"{key}_{n}"
        taken.add(name.lower())
        value = F.element_at("_keys", F.lit(key))
        kind = "double" if kind.startswith("DECIMAL") else VALUE_TYPES.get(kind)
        columns.append((_scalar(value, kind) if kind else _json_text(value)).alias(name))
    return found.select(*columns, "eval_dir")


def discover_runs(spark: SparkSession, eval_base: str) -> DataFrame:
    """Run directories that hold a summary, in ascending order."""
    return read_summary_files(spark, eval_base).select("eval_dir").distinct().orderBy("eval_dir")


def read_result_documents(spark: SparkSession, eval_base: str,
                          file_name: str = "results.json") -> DataFrame:
    """Nested ``{"summary", "details"}`` documents opened into detail rows,
    tagged with the run directory.

    One pass over the lines finds the documents that are in the writer's layout: a first line with the summary,
    whole details on every other line, a last line. Their lines are read over tasks, whatever the size of
    a document. Each of the others is read as one row."""
    def found(reader):
        return reader.option("recursiveFileLookup", True).option("pathGlobFilter", file_name)

    lines = found(spark.read).text(eval_base).select(F.col("_metadata.file_path").alias("_file"), "value")
    head = F.regexp_extract("value", HEAD, 1)
    summary = F.when(F.col("value").startswith('{"summary": {') & (head != "") & F.try_parse_json(head).isNotNull(),
                     F.from_json(head, SUMMARY_SCHEMA))
    more = F.col("value").endswith("},")
    line = F.expr("if(endswith(value, ','), left(value, length(value) - 1), value)")
    whole_line = F.col("value").startswith("{") & (more | F.col("value").endswith("}"))
    part = F.when(whole_line, F.from_json(F.concat(F.lit("["), line, F.lit("]")), Ty.ArrayType(DETAIL_SCHEMA)))
    last = F.col("value") == TAIL
    kinds = lines.select("_file", summary.alias("_summary"), part.alias("_part"), more.alias("_more"), last.alias("_last"))
    parts, heads = F.count("_part"), F.count("_summary")
    ours = (heads == 1) & (F.count_if("_last") == 1) & (heads + parts + 1 == F.count(F.lit(1))) \
        & (F.count_if(F.col("_part").isNotNull() & ~F.col("_more")) == F.least(parts, F.lit(1)))
    seen = materialize(kinds.groupBy("_file").agg(
        ours.alias("_ours"), F.max("_summary.experiment_name").alias("experiment_name")))
    whole = [r[0] for r in seen.where(~F.col("_ours")).select("_file").collect()]
    split = seen.where("_ours").select("_file", "experiment_name")
    if seen.limit(MAX_DOCUMENTS + 1).count() <= MAX_DOCUMENTS:
        split = F.broadcast(split)
    folder = F.regexp_replace("_file", "/[^/]+$", "").alias("eval_dir")
    # a line has details, so the outer form adds none; it parses a line once, the plain one also in a filter
    rows = lines.where(whole_line).select("_file", part.alias("_part")).join(split, "_file") \
        .select(folder, "experiment_name", F.inline_outer("_part"))
    if not whole:
        return rows
    docs = found(spark.read.schema(RESULTS_DOC_SCHEMA).option("multiLine", True)).json(eval_base) \
        .where(F.col("_metadata.file_path").isin(whole)).withColumn("eval_dir", _dir_of_file())
    return rows.unionByName(docs.select("eval_dir", F.col("summary.experiment_name").alias("experiment_name"),
                                        F.inline("details")))


def write_comparison_csv(report: DataFrame, path: str, single_file: bool = False,
                         mode: str = "overwrite") -> None:
    """Comparison table as CSV with a header and no index column. Booleans are
    written ``true``/``false``. ``single_file`` gathers the (small, one row per
    run) report into one file. A null is an empty field, an empty text a quoted one."""
    out = report.coalesce(1) if single_file else report
    (out.write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def read_comparison_csv(spark: SparkSession, path: str, schema: Ty.StructType) -> DataFrame:
    # a null marker of its own: else quoted empty texts would be read as nulls
    return spark.read.option("header", True).option("nullValue", "\\N").schema(schema).csv(path)


def write_run_info(run_info: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Run metadata (config path, CLI flags, timestamp) as JSON lines in a folder for each
    ``model_path``, nulls included. Other models in the folder stay."""
    rows = run_info.withColumn("model", F.col("model_path"))
    _by_folder(rows, "model", mode).option("ignoreNullFields", False).json(path)


def read_run_info(spark: SparkSession, path: str) -> DataFrame:
    """Run metadata flattened to the run-info dimension used by enrichment. A flag that is absent
    from ``cli_args`` is false, a present null stays null."""
    docs = spark.read.option("singleVariantColumn", "_doc").option("recursiveFileLookup", True) \
        .option("pathGlobFilter", DETAIL_FILES).json(path)
    whole = docs.select(F.expr("try_cast(_doc as map<string,variant>)").alias("_keys"))
    args = F.expr("coalesce(try_cast(element_at(_keys, 'cli_args') as map<string,variant>), "
                  "map_filter(_keys, (k, v) -> false))")
    df = whole.select("_keys", args.alias("_args"))
    kinds = {f.name: f.dataType.simpleString() for f in RUN_INFO_FILE_SCHEMA.fields if f.name != "cli_args"}
    top = {c: _scalar(F.element_at("_keys", F.lit(c)), kind).alias(c) for c, kind in kinds.items()}
    flags = [F.when(F.map_contains_key("_args", F.lit(c)), _scalar(F.element_at("_args", F.lit(c)), "boolean"))
             .otherwise(F.lit(False)).alias(c) for c in ("use_chat_template", "mask_question")]
    return df.select(top["model_path"], top["original_config_path"], *flags, top["timestamp"])
