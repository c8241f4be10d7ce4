"""Periodic runs, held against a definition in plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from newsloom.llm import periods
from newsloom.llm.periods import lag_range, least_periods, numbers, stretches


def plain_words(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i - q] for i in range(q, len(words))))


def plain_runs(words):
    """Every maximal stretch whose smallest period repeats often enough."""
    n, out = len(words), []
    for q in range(1, n):
        at = q
        while at < n:
            if words[at] != words[at - q]:
                at += 1
                continue
            begin = at - q
            while at < n and words[at] == words[at - q]:
                at += 1
            if at - begin >= max(6, 4 * q) and smallest_period(words[begin:at]) == q:
                out.append((begin, at - begin, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = plain_words(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), *head, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_stretches_match_the_definition(letters):
    rng = np.random.default_rng(letters)
    for _ in range(60):
        words = [bytes([97 + x]) for x in rng.integers(0, letters, rng.integers(0, 60))]
        words = words + words[-7:] * int(rng.integers(0, 6))
        got = least_periods(*stretches(numbers(words), np.array([len(words)]), 1, len(words) // 4 + 1))
        assert [tuple(r) for r in got.tolist()] == plain_runs(words)


def test_ranges_of_lags_meet_to_the_same_runs():
    rng = np.random.default_rng(5)
    words = [bytes([97 + x]) for x in rng.integers(0, 2, 300)] * 5
    n = len(words)
    parts = [stretches(numbers(words), np.array([n]), *lag_range(n, k, 7)) for k in range(7)]
    got = least_periods(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    assert got.tolist() == least_periods(*stretches(numbers(words), np.array([n]), 1, n // 4 + 1)).tolist()
    assert [0, n, 300] in got.tolist()


def test_whole_table_matches_the_definition(spark, documents):
    rows = [r for r in documents.select("doc_id", "text").collect() if len(r.text) < 6000]
    got = periods.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert ordered(got) == ordered(plain_row(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 5


def test_odd_rows(spark, odd, empty, monkeypatch):
    want = ordered(plain_row(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 6000)
    got = periods.found(odd)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert ordered(r for r in got.collect() if r.doc_id != 4) == want
    assert got.where("doc_id = 4").count() == 1
    assert periods.found(empty).count() == 0


def test_long_texts_in_ranges_give_the_same(spark, monkeypatch):
    """Repeated rows, ties and a null id, all worked off by ranges of lags."""
    rows = [(1, "a b " * 40), (1, "a b " * 40), (None, "x y z " * 30 + "q " * 9), (2, "one two three"), (3, " ".join(f"w{i % 17}" for i in range(200)) + " end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    short = ordered(periods.found(frame).collect())
    monkeypatch.setattr(periods, "LONG_BYTES", 5)
    monkeypatch.setattr(periods, "RANGE_WORK", 50)
    assert ordered(periods.found(frame).collect()) == short == ordered(plain_row(*r) for r in rows)
