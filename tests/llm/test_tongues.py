"""The byte network: its gradients against differences, its predictions against held-out languages."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import tongues
from newsloom.llm.queries import op13_language_id
from newsloom.llm.sampling import split


@pytest.fixture(scope="module")
def model(documents):
    return tongues.train(documents, "lang", split(F.col("doc_id"), 4) != 2)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = tongues.Network.fresh(["a", "b", "c"], 1)
    x = rng.integers(60, 130, (9, 6)).astype(np.uint8)
    y = rng.integers(0, 3, 6)
    _, g = net.gradients(x, y)
    for name in net.WEIGHTS:
        w = getattr(net, name)
        places = [tuple(rng.integers(0, n) for n in w.shape) for _ in range(6)]
        if name == "byte":
            places = [(e, int(x[t, k])) for e, t, k in ((0, 0, 0), (1, 4, 2), (3, 8, 5))]
        for at in places:
            kept, step = w[at], 3e-2
            w[at] = kept + step
            up = net.gradients(x, y)[0]
            w[at] = kept - step
            down = net.gradients(x, y)[0]
            w[at] = kept
            assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3, rel=0.05), name


def test_each_position_reads_both_sides():
    net = tongues.Network.fresh(["a", "b"], 2)
    x = np.frombuffer(b"some words in a row and others here", np.uint8)[:, None].copy()
    p = net.labels(x)
    for changed, seen in ((0, -1), (-1, 0)):
        other = x.copy()
        other[changed] = 1
        assert (net.labels(other)[seen] != p[seen]).any()
    assert p.shape == (len(x), 2, 1) and np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_whole_texts_are_pooled():
    """A text's probabilities are the mean over all letters, in whatever batch it is read."""
    net = tongues.Network.fresh(["a", "b", "c"], 3)
    rng = np.random.default_rng(4)
    texts = ["".join(chr(c) for c in rng.integers(32, 400, n)) for n in (0, 1, 63, 64, 65, 1000, 5)] + [None, "12 34"]
    got = net.pooled(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        raw = (text or "").encode()
        p, n = np.zeros(3), 0
        for k in range(0, len(raw), tongues.STRETCH):
            x = np.frombuffer(raw[k : k + tongues.STRETCH].ljust(tongues.STRETCH, b"\0"), np.uint8)[:, None]
            letters = tongues.LETTER[x[:, 0]]
            p += net.labels(x)[letters, :, 0].sum(axis=0)
            n += letters.sum()
        assert row.tolist() == pytest.approx((p / max(n, 1)).tolist(), abs=0.02)


def test_held_out_languages_are_found(spark, model):
    for size, floor in (("0.001", 0.95), ("0.01", 0.98)):
        docs = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet")
        rows = tongues.predict(docs, model, ["doc_id", "lang"]).where(split(F.col("doc_id"), 4) == 2).collect()
        by = {}
        for r in rows:
            by.setdefault(r.lang, []).append(r.lang_pred == r.lang)
        assert np.mean(sum(by.values(), [])) >= floor
        assert all(np.mean(v) >= 0.9 for v in by.values()), by  # each language by itself: always answering the commonest is not enough


def test_query_columns_and_split(spark, sf_dir):
    out = op13_language_id(spark, sf_dir)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_odd_rows(odd, empty, model):
    got = tongues.predict(odd, model, ["doc_id", "text", "score", "chunk"])
    assert got.columns == ["doc_id", "text", "chunk", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred == "und" and r.score == 0) == (r.text is None or not any(map(str.isalpha, r.text))) for r in rows)
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 6}) == 1
    assert tongues.predict(empty, model, ["doc_id"]).count() == 0


def test_few_or_no_labels(spark, odd, empty):
    docs = spark.createDataFrame([(1, "word one", "xx"), (2, "123", "yy"), (3, None, "zz"), (None, "text", "ww"), (4, "more words", None)], "doc_id long, text string, lang string")
    one = tongues.train(docs, "lang", F.lit(True))
    assert one.langs == ["xx"]
    assert [(r.lang_pred, r.score) for r in tongues.predict(docs, one, ["doc_id"]).orderBy("doc_id").collect()] == [("xx", 1.0), ("xx", 1.0), ("und", 0.0), ("und", 0.0), ("xx", 1.0)]
    none = tongues.train(docs.limit(0), "lang", F.lit(True))
    assert {r.lang_pred for r in tongues.predict(docs, none, ["doc_id"]).collect()} == {"und"}
