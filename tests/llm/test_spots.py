"""Spot signatures against their definition in plain Python, and ids of every kind."""

import hashlib
import random
import re

import pytest

from newsloom.llm import spots


def signatures(text):
    """A chain for each common word: the word and the next two other words within six."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]
    common = set(spots.ANCHORS)
    chains = {" ".join(["|" + w, *[x for x in words[i + 1 : i + 7] if x not in common][:2]]) for i, w in enumerate(words) if w in common}
    return chains or {" ".join(words)}


def model(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1].encode()))
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = signatures(t), signatures(edited), signatures(after)
        out[i, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), len(a), len(b), len(a & b) / len(a | b), len(a & c) / len(a | c))
    return out


def check(spark, rows):
    got = spots.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = model(rows)
    assert len(got) == len(rows)
    by_id = {i: v for (i, _), v in want.items()}
    for r in got:
        n, digest, one, two, near, follow = by_id[r.doc_id]
        assert (r.n_chars, r.edited_sha256, len(r.fingerprint) // 8, len(r.edited_fingerprint) // 8) == (n, digest, one, two)
        assert r.near_edited == pytest.approx(near) and r.near_next == pytest.approx(follow)


def test_signatures_follow_the_definition(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check(spark, rows)


@pytest.mark.parametrize("kind", ["hashed", "negative", "far"])
def test_ids_of_every_kind(spark, kind, monkeypatch):
    monkeypatch.setattr(spots.with_next, "__defaults__", (16, 64))
    rng = random.Random(4)
    ids = {
        "hashed": [rng.randrange(-(1 << 63), 1 << 63) for _ in range(700)],
        "negative": [-(1 << 63), *range(-500, 100), (1 << 63) - 1],
        "far": [*range(1000), 1 << 60],
    }[kind]
    check(spark, [(i, " ".join(rng.choice(["the", "of", "red", "blue", "green", "and", "tree"]) for _ in range(rng.randrange(12)))) for i in ids])
    firsts = spots._quantiles(spark.createDataFrame([(i, "") for i in ids], "doc_id long, text string"), 16, 64)
    held = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(spots._block(firsts).alias("b")).groupBy("b").count().collect()
    assert len(held) == len(firsts) and max(r["count"] for r in held) <= 5 * len(ids) / len(firsts)
