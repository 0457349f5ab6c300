"""Nested results documents: one ``{"summary": {...}, "details": [...]}`` file a run.

Details are range-partitioned by (run, index), so a run of any size is spread over tasks. A Python data source
writes them: every task turns its slice of a run into a fragment (a file of JSON objects between commas) in a
staging folder and reports its fragments in the commit message. ``commit`` lists them, ``abort`` removes the
staging folder, so a failed write leaves nothing behind. A second job then makes the documents: a task streams
one run's header, fragments in order and footer into a file of its own and moves it to its name. It copies
bytes in blocks of fixed size, so neither a task nor the driver ever holds a run.

Folders may be any file system that ``pyarrow.fs`` opens. Documents of other runs in the folder stay.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from qamill.sources.files import DETAIL_SCHEMA, SUMMARY_SCHEMA

#: Bytes copied at once when fragments are joined.
BLOCK = 4 << 20
LISTING = "fragments.json"


def _fs(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


class Fragments(WriterCommitMessage):
    """(run, partition, file, rows) of a task's fragments."""

    def __init__(self, found: list[tuple[str, int, str, int]]) -> None:
        self.found = found


class FragmentSource(DataSource):
    """Write-only source of rows (run_id, detail): ``detail`` is the JSON text of one detail row."""

    @classmethod
    def name(cls) -> str:
        return "result_fragments"

    def writer(self, schema, overwrite: bool) -> FragmentWriter:
        return FragmentWriter(self.options["path"])


class FragmentWriter(DataSourceArrowWriter):
    """A task's rows come sorted by run, so one fragment is open at a time."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator) -> Fragments:
        files, base = _fs(self.folder)
        part, found, out, own, rows = TaskContext.get().partitionId(), [], None, None, 0
        name = ""
        for batch in iterator:
            runs, details = (batch.column(c).to_pylist() for c in ("run_id", "detail"))
            at = 0
            while at < len(runs):
                stop = at
                while stop < len(runs) and runs[stop] == runs[at]:
                    stop += 1
                if out is None or runs[at] != own:
                    if out is not None:
                        out.close()
                        found.append((own, part, name, rows))
                    own, rows, name = runs[at], 0, f"{part:06d}-{len(found):06d}-{uuid.uuid4().hex}.json"
                    out = files.open_output_stream(f"{base}/{name}")
                out.write(((",\n" if rows else "") + ",\n".join(details[at:stop])).encode())
                rows, at = rows + stop - at, stop
        if out is not None:
            out.close()
            found.append((own, part, name, rows))
        return Fragments(found)

    def commit(self, messages: list) -> None:
        files, base = _fs(self.folder)
        found = sorted(x for m in messages if m is not None for x in m.found)
        with files.open_output_stream(f"{base}/{LISTING}") as out:
            out.write(json.dumps(found).encode())

    def abort(self, messages: list) -> None:
        files, base = _fs(self.folder)
        files.delete_dir(base)


def document_folder(base: str, run_id: str) -> str:
    """The folder of a run's document; characters that paths may not hold are escaped."""
    return f"{base.rstrip('/')}/{quote(run_id, safe='=')}"


def _join(batches: Iterator[pd.DataFrame], base: str, staging: str) -> Iterator[pd.DataFrame]:
    """Write the documents of the given runs."""
    files, source = _fs(staging)
    for b in batches:
        for run, summary, names in zip(b["run_id"].tolist(), b["summary"].tolist(), b["files"].tolist()):
            target, folder = _fs(document_folder(base, run))
            target.create_dir(folder, recursive=True)
            own = f"{folder}/.{uuid.uuid4().hex}"
            with target.open_output_stream(own) as out:
                out.write(f'{{"summary": {summary}, "details": ['.encode())
                for k, name in enumerate(names):
                    out.write(b",\n" if k else b"\n")
                    with files.open_input_stream(f"{source}/{name}") as part:
                        while block := part.read(BLOCK):
                            out.write(block)
                out.write(b"\n]}\n")
            if target.get_file_info(f"{folder}/results.json").is_file:
                target.delete_file(f"{folder}/results.json")
            target.move(own, f"{folder}/results.json")
        yield b[["run_id"]]


def write_result_documents(summaries: DataFrame, details: DataFrame, base: str) -> None:
    """``base/<run>/results.json`` for every run of ``summaries`` (run_id and the summary's columns): its
    details (run_id and the detail columns) in the order of ``index``. A run without details has an empty list;
    details of runs without a summary are not written. Nulls are written as JSON nulls."""
    spark: SparkSession = summaries.sparkSession
    spark.dataSource.register(FragmentSource)
    options = {"ignoreNullFields": "false"}
    heads = summaries.select(F.col("run_id").cast("string").alias("run_id"), F.to_json(
        F.struct(*[c for c in SUMMARY_SCHEMA.fieldNames()]), options).alias("summary"))
    text = F.to_json(F.struct(*DETAIL_SCHEMA.fieldNames()), options)
    rows = details.join(heads.select("run_id"), "run_id", "left_semi") \
        .repartitionByRange("run_id", "index").sortWithinPartitions("run_id", "index") \
        .select(F.col("run_id").cast("string").alias("run_id"), text.alias("detail"))
    staging = f"{base.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    files, folder = _fs(staging)
    files.create_dir(folder, recursive=True)
    try:
        rows.write.format("result_fragments").mode("append").option("path", staging).save()
        with files.open_input_stream(f"{folder}/{LISTING}") as f:
            found = json.loads(f.read())
        names: dict[str, list[str]] = {}
        for run, _, name, _ in sorted(found):
            names.setdefault(run, []).append(name)
        # one row a run: its summary and the names of its fragments
        runs = [(r[0], r[1], names.get(r[0], [])) for r in heads.collect()]
        if runs:
            jobs = spark.createDataFrame(spark.sparkContext.parallelize(runs, len(runs)),
                                         "run_id string, summary string, files array<string>")
            jobs.mapInPandas(lambda batches: _join(batches, base, staging), "run_id string").count()
    finally:
        if files.get_file_info(folder).type.name == "Directory":  # an aborted write has removed it
            files.delete_dir(folder)
