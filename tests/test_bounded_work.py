"""Work that stays in proportion to what is read, and batches that stay bounded."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from newsloom.functions import batches, fixed, text
from newsloom.llm import passages
from newsloom.operators import dedup, editions


def plan(frame) -> str:
    return frame._jdf.queryExecution().analyzed().toString()


def test_issues_are_folded_in_batches(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 1, "a"), (None, 5, "a"), (None, None, "a"), (2, 7, None), (2, 8, None)], "g long, pos long, k string")
    found = dedup.first_of_any_key(rows, "g", "pos", ["k"])
    assert {(r.g, r.pos) for r in found.collect()} == {(1, 1), (None, 5), (2, 7), (2, 8)}
    assert "MapInArrow" in plan(found) and "FlatMapGroups" not in plan(found)


def test_arrow_batches_of_folds_are_bounded(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    dedup.first_of_any_key(spark.createDataFrame([(1, 1, "a")], "g long, pos long, k string"), "g", "pos", ["k"]).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(batches.BATCH_BYTES)


def test_catalog_repairs_each_url_once(spark):
    rows = spark.createDataFrame([([("A", "http://a.example/1"), ("B", "https://a.example/1"), (None, None)],)], "anchors array<struct<label:string,url:string>>")
    found = rows.select(editions.catalog(F.col("anchors")).alias("c"))
    assert [(x.url, x.label) for x in found.first().c] == [("http://a.example/1", "A"), ("https://a.example/1", "A")]
    assert plan(found).count("regexp_replace") <= 4


def test_pairs_of_sets_are_not_sent_on(spark):
    words = [f"w{i}" for i in range(30)]
    sets = [(i, sorted({words[(i * k + k * k) % 30] for k in range(3 + i % 9)} | ({"common"} if i % 2 else set()))) for i in range(60)]
    frame = spark.createDataFrame(sets, "id long, tokens array<string>")
    found = dedup.similar_pairs(frame, frame.where("id % 3 > 0"))
    want = set()
    for a, x in sets:
        for b, y in sets:
            both, least = len({*x} & {*y}), min(len(x), len(y))
            if b % 3 and least >= 3 and max(both / len({*x} | {*y}), both / least * 0.9) >= 0.62:
                want.add((a, b))
    got = [(r.left_id, r.right_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # compared where they meet: pairs are not sent on to be told apart
    assert "Deduplicate" not in plan(found) and "Distinct" not in plan(found)


def test_repeated_lines_are_searched_once(monkeypatch):
    line = np.arange(45, dtype=np.uint64) * np.uint64(977) + np.uint64(5)
    a, b = np.tile(line, 9), np.concatenate((line, np.arange(40, dtype=np.uint64) + np.uint64(10**6)))
    calls, numbered = [], passages._numbered
    monkeypatch.setattr(passages, "_numbered", lambda x: calls.append(len(x)) or numbered(x))
    assert passages.all_alike(a, b, 0.8) == []
    assert len(calls) < 300
    # texts without repeated tokens are not numbered at all
    calls.clear()
    rest = np.arange(200, dtype=np.uint64)
    far = np.concatenate((np.arange(60, dtype=np.uint64) + np.uint64(30), np.uint64(500) + rest))
    assert passages.all_alike(rest, far, 0.8) == [(30, 90, 0, 60, 1.0)] and not calls


def test_patterns_look_at_the_next_letter_first_and_match_the_same(spark):
    patterns = [*fixed.CATEGORY_TERMS.values(), *fixed.SCORE_ONLY_TERMS.values(), fixed.DEPRIORITIZED, fixed.EXCEPTIONAL, fixed.EXCEPTIONAL_BOUNDED, fixed.GEOGRAPHY, "|".join(f"(?:{p})" for p in fixed.PERMISSION_DESIGN)]
    assert all(fixed.led(p).startswith("(?i)(?=[") for p in patterns)
    assert [fixed.first_letters(p) for p in (r"\bagent(?:s|ic)?\b|autonom", r"(?:\b(?:a|b[|(]) x)|\(c", r"^AI News\b", r"a?b", r"(?:a|b)?c", r"(?:x\)|y)z")] == [{"a"}, None, None, None, None, {"x", "y"}]
    rng = random.Random(5)
    words = re.findall("[A-Za-z0-9]+", " ".join(patterns)) + ["-", ".", "u.s.", "_", "K", "ſ", "é", "first-ever", "data  center"]
    texts = ["".join(rng.choice((w, w.upper(), w.title())) + rng.choice((" ", " ", "", "-", "_")) for w in rng.choices(words, k=60)) for _ in range(400)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    unlike = [F.count_if(F.regexp_count("text", F.lit(fixed.led(p))) != F.regexp_count("text", F.lit(fixed.java(p)))) for p in patterns]
    assert sum(frame.agg(*unlike).first()) == 0
    assert sum(frame.agg(*(F.sum(F.regexp_count("text", F.lit(fixed.led(p)))) for p in patterns)).first()) > 2_000


def test_titles_and_summaries_take_their_text_apart_once(spark):
    frame = spark.createDataFrame([("Lead: What came of it , and more. (Activity: 5) gone",), (None,), ("",), (" x " * 60,)], "t string")
    made = frame.select(text.candidate_title(F.col("t")).alias("title"), text.candidate_summary(F.col("t")).alias("summary"))
    assert plan(made).count("Activity") == 2
    assert [tuple(r) for r in made.collect()] == [("Lead: What came of it", "Lead: What came of it, and more."), ("AI update", None), ("AI update", "AI update"), (" ".join(["x"] * 14), " ".join(["x"] * 45) + "…")]
