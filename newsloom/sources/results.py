"""A sink of JSON results whose files count only once a whole write has succeeded.

Each task writes a file of its own in its write's folder. When all tasks are done, one manifest that
names their files is put in place; a write that fails takes its folder away and leaves no manifest. Readers take the files that manifests name, so neither a failed task's file nor a retried
task's first one is ever read.

``frame.write.format("json_results").mode("append" or "overwrite").save(folder)`` and ``read_results``.
Rows are JSON objects, one a line; an overwrite names what it replaces only after it is whole.
"""

from __future__ import annotations

import datetime
import decimal
import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _store(folder: str):
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _plain(value):
    """A value as JSON has it; bytes and times as text."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    return value.hex() if isinstance(value, (bytes, bytearray)) else value


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class ResultWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.own = folder, overwrite, f"files/{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        store, folder = _store(self.folder)
        store.create_dir(f"{folder}/{self.own}", recursive=True)
        file, count = f"{self.own}/{uuid.uuid4().hex}.jsonl", 0
        try:
            with store.open_output_stream(f"{folder}/{file}") as out:
                for row in rows:
                    out.write((json.dumps(_plain(row), ensure_ascii=False) + "\n").encode())
                    count += 1
        except BaseException:
            self._drop([file])
            raise
        return Written(file, count)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.folder)
        found = [m for m in messages if m is not None]
        before = [i.path for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.base_name.startswith("result-")] if self.overwrite else []
        store.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}"
        with store.open_output_stream(f"{folder}/_{name}") as out:
            out.write(json.dumps({"files": [m.file for m in found], "rows": sum(m.rows for m in found)}).encode())
        store.move(f"{folder}/_{name}", f"{folder}/result-{name}.json")  # from here on it counts
        for path in before:
            with store.open_input_stream(path) as held:
                old = json.loads(held.read())["files"]
            store.delete_file(path)
            self._drop(old)

    def abort(self, messages: list[Written | None]) -> None:
        """Also what tasks have left that were ended before they could say so."""
        store, folder = _store(self.folder)
        if store.get_file_info(f"{folder}/{self.own}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.own}")

    def _drop(self, files: list[str]) -> None:
        store, folder = _store(self.folder)
        for file in files:
            if store.get_file_info(f"{folder}/{file}").type == fs.FileType.File:
                store.delete_file(f"{folder}/{file}")


class JsonResults(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_results"

    def writer(self, schema: StructType, overwrite: bool) -> ResultWriter:
        return ResultWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(JsonResults)
    return spark


def read_results(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of all whole writes: lines of those files only that a manifest names."""
    named = spark.read.schema("files array<string>, rows long").json(f"{folder}/result-*.json").select(F.explode("files").alias("file"))
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{folder}/files").select(F.regexp_extract(F.col("_metadata.file_path"), "files/[^/]+/[^/]+$", 0).alias("file"), "value")
    return lines.join(named, "file", "left_semi").select(F.from_json("value", schema).alias("row")).select("row.*")
