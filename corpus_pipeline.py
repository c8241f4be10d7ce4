"""A corpus pipeline: quality filter, near and exact duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the
last return the columns of ``docs``. Duplicate stages never drop a class's earliest document.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import bags, bpe, leaks, quality, suffixes
from newsloom.llm.plan import release, stored
from newsloom.llm.queries import VOCABULARY, table
from newsloom.llm.sampling import split


#: The columns that stages work on; all others travel under numbers, so that no name of theirs can clash.
OWN = ("doc_id", "text", "n_chars")


def numbered(stage):
    """The stage with all columns but OWN renamed while it runs, and its result's columns as they were."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in OWN else f"column_{i}" for i, c in enumerate(docs.columns)]
        made = stage(spark, docs.toDF(*names), sf_dir)
        return made.select(*names).toDF(*docs.columns)

    return run


@numbered
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7.

    Null and empty texts, repeated rows and rows without id are scored as any; without labels every
    row has the same score. An empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, "quality", split(F.col("doc_id"), 4) != 2)
    return quality.score(docs, model, docs.columns, name="quality").where("quality >= 0.7")


@numbered
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class one row: of its least doc_id, the row that comes first by text and then by all other columns.

    An id with several texts is in the class of each of them and kept only where it comes first in
    all; rows without doc_id stay. Texts without words, null ones too, are one class.
    """
    classes = bags.classes(docs)
    first = classes.groupBy("doc_id").agg(F.max(F.col("doc_id") > F.col("class_id")).alias("copy")).where("NOT copy").select("doc_id")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", *(F.to_json(F.struct(F.col(c))) for c in docs.columns if c not in ("doc_id", "text"))))
    kept = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").withColumn("rank", rank).where("rank = 1").drop("rank")
    return kept.unionByName(docs.where("doc_id is null"))


@numbered
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that an earlier document has; texts left empty go, unless they were.

    A character cut in two goes whole, and n_chars follows the text. Null texts become empty; rows
    without doc_id, and rows of one doc_id against each other, lose nothing.
    """
    keep = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = suffixes.deduplicate(docs, keep, texts_too=True)
    text = F.expr("CAST(try_validate_utf8(CAST(kept AS STRING)) AS STRING)")
    whole = F.expr(r"regexp_replace(make_valid_utf8(CAST(kept AS STRING)), '\\x{FFFD}', '')")
    found = found.where("n_removed < n_bytes OR n_bytes = 0").withColumn("text", F.coalesce(text, whole))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@numbered
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Rows without doc_id, and null or empty texts, hold none and stay; all rows of an id go together.
    """
    found = leaks.leaks(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and hashes of the ids and of what they decode to; one row for each row."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontaminate),
    ("byte_bpe", tokens),
]
#: SQL can't express fitted models, weighted signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each but the last written before the next reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
