"""Sizes that plans are cut by, and places that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.batches import bounded_batches


def text_bytes(frame: DataFrame, text: str = "text") -> int:
    """Bytes of all texts of a frame, counted by one pass over that column."""
    return frame.agg(F.coalesce(F.sum(F.octet_length(F.col(quoted(text)).cast("string"))), F.lit(0))).first()[0]


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def unused(frame: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(docs: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int]:
    """The columns ``keep`` and the text, sent once, and the text's position."""
    bounded_batches(docs.sparkSession)
    columns = [F.col(quoted(c)) for c in keep]
    if text in keep and docs.schema[text].dataType.simpleString() == "string":
        return docs.select(*columns), keep.index(text)
    return docs.select(*columns, F.col(quoted(text)).cast("string").alias(unused(docs, "_text"))), len(keep)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts(frame: DataFrame, size: int, least: int = 1, text: str = "text") -> int:
    """How many parts of about ``size`` bytes the frame's texts make."""
    return max(least, -(-text_bytes(frame, text) // size))


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the cluster's checkpoint folder.

    Where no folder is set, only a driver whose executors are its own threads may make one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/newsloom-{context.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by then
        _delete(spark, path)


_kept: set[str] = set()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends there.

    Rows of one value of the columns ``by`` are in files of their own. What is left when the Python process ends is deleted then; ``release`` deletes earlier.
    """
    spark = frame.sparkSession
    folder = shared_folder(spark)
    if folder not in _kept:
        _kept.add(folder)
        atexit.register(_delete_at_exit, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    # what was shuffled for it is deleted once it is written, not when the driver happens to collect its garbage
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (frame.write.partitionBy(*by) if by else frame.write).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    found = spark.read.schema(frame.schema).parquet(path)
    found._stored_at = path
    return found


def release(*frames: DataFrame | None) -> None:
    """Delete what ``stored`` wrote for frames that nothing reads any more."""
    for frame in frames:
        if frame is not None:
            _delete(frame.sparkSession, frame._stored_at)
