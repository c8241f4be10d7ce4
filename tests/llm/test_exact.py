"""Operators whose results a plain model gives exactly: suffixes, tokens, licences, spots, shards."""

import base64
import glob
import hashlib
import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from newsloom.llm import bpe, licences, queries, sharding, spots, suffixes, words

PATH = public_tokenizers.path(queries.VOCABULARY)


def removed_by_model(rows):
    seen: dict[bytes, int] = {}
    for i, b in rows:
        for p in range(len(b) - 49):
            seen[b[p : p + 50]] = min(seen.get(b[p : p + 50], i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffixes_match_the_model(spark, documents):
    rows = [(r.doc_id, (r.text or "").encode()) for r in documents.collect()]
    got = suffixes.deduplicate(documents, texts_too=False).select("doc_id", "n_bytes", "n_removed", F.size("removed"), "kept_sha256")
    assert sorted(map(tuple, got.collect())) == removed_by_model(rows)


def test_suffixes_of_repetitive_and_odd_texts(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(200))) for i in range(10)] + [(20, "a" * 500), (21, "b" + "a" * 400), (22, "ab" * 150), (23, "ab" * 100), (21, "a" * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.deduplicate(frame, texts_too=False).select("doc_id", "n_bytes", "n_removed", F.size("removed"), "kept_sha256")
    assert sorted(map(tuple, got.collect())) == removed_by_model([(i, t.encode()) for i, t in rows])
    made = suffixes.deduplicate(odd, odd.columns)
    assert made.columns[: len(odd.columns)] == odd.columns
    by = sorted(((r.doc_id, r.n_removed, bytes(r.kept).decode()) for r in made.collect() if r.doc_id), key=str)
    assert sum(n for i, n, _ in by if i == 1) == 0 and all(k == "" for i, _, k in by if i == 5)
    assert made.where("doc_id IS NULL AND n_removed > 0").count() == 0 and made.count() == odd.count()
    assert len({(n, k) for i, n, k in by if i == 6}) == 1
    assert suffixes.deduplicate(empty).count() == 0


def test_runs_do_not_depend_on_the_order_of_documents(monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 500)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.choice([10, 80, 300, 2000]))) for _ in range(40)]

    def found(order):
        raw, offs = words.buffers(pa.array([texts[i] for i in order]))
        start, count, place, hashed = suffixes.runs(raw, offs)
        doc = np.searchsorted(offs, start, "right") - 1
        return sorted((order[d], int(a - offs[d]), int(n), int(p - offs[d]), int(h)) for d, a, n, p, h in zip(doc, start, count, place, hashed, strict=True))

    order = list(range(40))
    first = found(order)
    rng.shuffle(order)
    assert found(order) == first and len(first) > 100


def test_suffix_sort_is_the_order_of_suffixes():
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    group, start, length = rng.integers(0, 7, 500), rng.integers(0, 2900, 500), rng.integers(1, 90, 500)
    order, equal = suffixes.suffix_sort(raw, group, start, length)
    key = lambda i: (group[i], raw[start[i] : start[i] + length[i]].tobytes())
    keys = [key(i) for i in order]
    assert keys == sorted(keys)
    assert equal.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:], strict=False)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_match_the_library(spark, documents, odd, empty, reference):
    for frame in (documents, odd):
        texts = sorted((r.doc_id or 0, r.text or "") for r in frame.collect())
        want = []
        for i, t in texts:
            ids = reference.encode_ordinary(t)
            want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        got = bpe.encode_documents(frame, PATH, public_tokenizers.PATTERN)
        assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted(want)
        assert all(len(r.token_ids) == r.n_tokens for r in got.collect())
    assert bpe.encode_documents(empty, PATH, public_tokenizers.PATTERN).count() == 0


def test_transducer_on_random_texts(reference):
    codec = bpe.codec(bpe.vocabulary(PATH), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("aeéüöth inß字漢😀!#'s  \n\n\t1  \x1c") for _ in range(rng.randint(0, 60)))
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text), repr(text)
        assert "".join(codec.decode_stream(ids, 3)) == text
    for text in ("a" * 500, "字" * 100, "=" * 300, " " * 77 + "x"):
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_transducer_streams(reference):
    codec = bpe.codec(bpe.vocabulary(PATH), public_tokenizers.PATTERN)
    for piece in (" extraordinarily", "hello", "漢字", "=" * 40):
        data = piece.encode()
        given = []

        def parts(data=data, given=given):
            for k in range(len(data)):
                given.append(k)
                yield data[k : k + 1]

        emitted = []
        for out in codec.transducer.stream(parts()):
            emitted += out
            assert emitted == codec.transducer.encode(data)[: len(emitted)]
            # what is not out yet starts no longer token than the vocabulary has
            done = sum(len(codec.transducer.bytes_of[t]) for t in emitted)
            assert len(given) - done <= 2 * max(map(len, codec.transducer.ranks))
        assert emitted == codec.transducer.encode(data)
        assert [t for out in codec.transducer.stream([data[:3], data[3:]], 5) for t in out] == emitted
    long = "abcdefgh" * 4000
    assert codec.transducer.encode(long.encode()) == reference.encode_ordinary(long)


def test_utf8_machine_waits_for_the_rest():
    machine = bpe.Utf8Decoder()
    data = "é漢😀x".encode()
    assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.feed(b"", last=True) == "é漢😀x"
    assert bpe.Utf8Decoder().feed(b"\xe6\xbc", last=True) == "�"


def oracle(name, frame, sf_dir=None):
    db = duckdb.connect()
    if sf_dir:
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    else:
        documents = pa.table({"doc_id": pa.array([r[0] for r in frame], pa.int64()), "text": pa.array([r[1] for r in frame], pa.string())})
        db.register("documents", documents)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in db.sql(queries.ORACLE_SQL[name]).fetchall()), key=str)


def rows(frame):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert rows(queries.QUERIES[name](spark, sf_dir)) == oracle(name, None, sf_dir)


def test_licences_of_odd_texts(spark, odd, empty):
    got = {r.doc_id: r for r in licences.scan(odd, ["doc_id"]).where("doc_id IS NOT NULL").collect()}
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].base_labels, got[2].labels, got[2].score) == (0, 0, None, "", "", 0.0)
    assert (got[9].n_words, got[9].n_base, got[9].first_word, got[9].labels) == (5, 1, 3, "mit")
    assert licences.scan(odd, odd.columns).count() == odd.count()
    assert licences.scan(empty, ["doc_id"]).count() == 0


def test_licence_templates_are_found_with_a_changed_word(spark):
    notice = next(n for label, n, _ in licences.TEMPLATES if label == "bsd").replace("following", "coming")
    frame = spark.createDataFrame([(1, "Intro. " + notice.upper() + ". End"), (2, "source and binary forms")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score > 0.9) for r in licences.scan(frame, ["doc_id"]).collect()}
    assert got == {1: ("bsd", True), 2: ("", False)}


def test_spots_match_the_model(spark, documents, odd, empty):
    for frame in (documents, odd):
        texts = sorted((r.doc_id, r.text or "") for r in frame.collect() if r.doc_id is not None)
        got = sorted((r for r in spots.compared(frame).collect() if r.doc_id is not None), key=lambda r: (r.doc_id, r.n_chars))
        assert len(got) == len(texts)
        sets = [{r.fingerprint[k : k + 8] for k in range(0, len(r.fingerprint), 8)} for r in got]
        for k, ((i, t), r) in enumerate(zip(texts, got, strict=True)):
            half = len(t) // 2
            after = texts[(k + 1) % len(texts)][1]
            edited = t[: len(t) - half] + after[:half]
            assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
            other = {r.edited_fingerprint[k : k + 8] for k in range(0, len(r.edited_fingerprint), 8)}
            assert r.near_edited == pytest.approx(len(sets[k] & other) / len(sets[k] | other))
            follow = sets[(k + 1) % len(texts)]
            assert r.near_next == pytest.approx(len(sets[k] & follow) / len(sets[k] | follow))
        by_text = {}
        for (_, t), r in zip(texts, got, strict=True):
            assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert spots.compared(empty).count() == 0


def test_alike_spots_match_all_pairs(spark, documents):
    sets = {r.doc_id: set(r.signatures) for r in spots.fingerprints(documents).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in spots.alike(documents).collect()} == want


def test_shards_match_a_directory(spark, documents, odd, empty):
    for frame, limit in ((documents, 20_000), (odd, 500), (documents, 1)):
        got = sharding.assign(frame, limit).collect()
        assert len(got) == frame.count()
        sums = {}
        for r in got:
            n, held = sums.get(r.shard, (0, 0))
            sums[r.shard] = n + 1, held + r.n_bytes
        for r in got:
            assert (r.shard_docs, r.shard_bytes) == sums[r.shard] and r.overfull == (r.shard_bytes > limit) and r.depth == len(r.shard)
            parent = sum(v[1] for k, v in sums.items() if k.startswith(r.shard[:-1]))
            assert not r.shard or parent > limit
            assert not r.overfull or r.depth == sharding.BITS
    assert sharding.assign(empty, 10).count() == 0


def test_word_hashes():
    texts = ["", "One two\tTWO", "é1-b", "x" * 10]
    raw, offs = words.buffers(pa.array(texts))
    hashes, counts, first, last = words.word_hashes(raw, offs, spans=True)
    assert counts.tolist() == [0, 3, 2, 1]
    assert [raw[a:b].tobytes().decode() for a, b in zip(first, last, strict=True)] == ["One", "two", "TWO", "é1", "b", "x" * 10]
    assert hashes[1] == hashes[2] and len(set(hashes.tolist())) == 5


def test_shards_of_rows_without_id_or_text_and_columns_of_any_name(spark):
    rows = [(None, "a text", 1, "x"), (None, "a text", 1, "x"), (3, None, 2, "y"), (4, "long " * 500, 3, "z"), (5, "", 4, "w")]
    frame = spark.createDataFrame(rows, "`the.id` int, `the text` string, cell int, hash string").withColumnRenamed("cell", "leaf")
    got = sorted(((r.doc_id, r.n_bytes, r.overfull, r.shard_docs) for r in sharding.assign(frame, 100, "the.id", "the text").collect()), key=str)
    assert [g[:2] for g in got] == sorted([(None, 6), (None, 6), (3, 0), (4, 2500), (5, 0)], key=str)
    assert [g for g in got if g[2]] == [(4, 2500, True, 1)]
