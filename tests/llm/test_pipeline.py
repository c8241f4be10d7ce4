"""The pipeline's stages on odd, repeated and empty rows and on columns of any name."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import LONG, PASSAGE

#: Names that operators use inside or make.
NAMES = ("a.b", "kept", "n_bytes", "_quality", "_text", "quality", "class_id", "copy", "rank", "chunk", "score")


@pytest.fixture(scope="module")
def docs(spark, odd):
    frame = odd.select("doc_id", "text", *(F.lit(k).alias(c) for k, c in enumerate(NAMES)))
    return frame.unionByName(frame.where("doc_id = 5").select("doc_id", "text", *(F.lit(k + 1).alias(c) if c == "rank" else F.col(f"`{c}`") for k, c in enumerate(NAMES))))


@pytest.fixture(scope="module")
def stages():
    return dict(corpus_pipeline.STAGES)


def test_filter_stages_keep_columns_and_stand_empty_tables(spark, sf_dir, docs, stages):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        assert made.columns == docs.columns, name
        assert [f.dataType for f in made.schema] == [f.dataType for f in docs.schema], name
        assert all(r[k + 2] == k or c == "rank" for r in made.collect() for k, c in enumerate(NAMES)), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_quality_stage_scores_rows_alike(spark, sf_dir, docs, stages):
    got = [r.text for r in stages["quality"](spark, docs, sf_dir).collect()]
    every = [r.text for r in docs.collect()]
    assert all(got.count(t) in (0, every.count(t)) for t in every)


def test_near_duplicate_stage_keeps_one_row_of_a_class(spark, sf_dir, docs, stages):
    more = docs.unionByName(docs.where("doc_id = 8").withColumn("text", F.lit("the quick brown fox jumps over the lazy dog and " + PASSAGE)))
    got = sorted(((r.doc_id, r.text or "", r["rank"]) for r in stages["near_duplicates"](spark, more, sf_dir).collect()), key=str)
    ids = [i for i, *_ in got]
    # 5 copies 1, 3 is empty like 2, 6 is like 1 and there twice, 8 has a text that copies 1; rows without id stay
    assert sorted(i for i in ids if i) == [1, 2, 4, 7, 9] and ids.count(None) == 2
    again = sorted(((r.doc_id, r.text or "", r["rank"]) for r in stages["near_duplicates"](spark, more.repartition(7), sf_dir).collect()), key=str)
    assert again == got


def test_repeated_strings_stage(spark, sf_dir, docs, stages):
    got = {}
    for r in stages["repeated_strings"](spark, docs, sf_dir).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert 5 not in got and got[4] == [LONG] and got[2] == got[3] == [""] and len(got[None]) == 2
    assert len(got[6]) == 2 and all(PASSAGE not in t and t.startswith("other words") for t in got[6])
    assert any(PASSAGE in t for t in got[None])


def test_decontamination_stage(spark, sf_dir, docs, stages):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    more = docs.unionByName(docs.where("doc_id = 8").withColumn("text", F.concat(F.lit("before "), F.lit(item), F.lit(" after"))))
    more = more.unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(item)))
    got = [r.doc_id for r in stages["decontamination"](spark, more, sf_dir).collect()]
    assert 8 not in got and sorted(i for i in got if i) == [1, 2, 3, 4, 5, 5, 6, 6, 7, 9] and got.count(None) == 3
