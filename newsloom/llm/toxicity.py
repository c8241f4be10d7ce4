"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the presence of words is trained from texts known to be toxic and unlabelled
texts. The risk of the unlabelled texts as negatives, less the prior times that of the positives,
is kept from going below zero: where it would, the step goes the other way. The features are the
words that positives hold more often than chance allows.

Null text counts as empty; a text without features gets the score of the intercept. Every row gets a
score, repeated rows and rows without id too; an empty table gives none. Very long texts count as any:
a word is there or not. Of several labels of one id the highest counts; ids tied in the sample's order
are all one id. Kept columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from newsloom.llm.plan import bounded_batches, quoted, with_text
from newsloom.llm.sampling import lowest
from newsloom.llm.words import buffers, give_back, mix, slices, word_hashes

#: Models made one after another, each with words chosen against the texts its predecessor does not call positive.
PASSES = 2
U = np.uint64


@dataclass
class Linear:
    """Sorted word hashes, their weights and a bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def presence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, word) pairs of a column of texts."""
    words, counts = word_hashes(*buffers(column))
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    order = np.lexsort((words, doc))
    doc, words = doc[order], words[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (words[1:] != words[:-1])
    return doc[fresh], words[fresh]


def hits(column: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct (document, place in ``known``) pairs of the words that are known, and the number of documents."""
    words, counts = word_hashes(*buffers(column))
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), len(counts)
    place = np.minimum(np.searchsorted(known, words), len(known) - 1)
    found = np.flatnonzero(known[place] == words)
    doc = np.searchsorted(np.cumsum(counts), found, "right")
    both = np.unique(doc.astype(np.int64) << 32 | place[found])
    return both >> 32, both & 0xFFFFFFFF, len(counts)


def features(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """The words that positives hold more often than chance allows, by the Chernoff bound of the binomial
    tail at the unlabelled rate. The level is one over the number of words, so about one is there by chance."""
    rate, base = np.minimum(p / n_p, 1 - 1e-9), (u + 1) / (n_u + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.where(rate > 0, rate * np.log(rate / base), 0) + (1 - rate) * np.log((1 - rate) / (1 - base))
    return np.flatnonzero((rate > base) & (n_p * gap > np.log(max(len(p), 2))))


def fit(row: np.ndarray, feature: np.ndarray, positive: np.ndarray, prior: float, start: np.ndarray, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights under the non-negative risk with log loss, by Adam over all rows.

    Rows are positives or unlabelled; row ``row[i]`` has the feature ``feature[i]``.
    """
    w = np.append(start, np.log(prior / (1 - prior)) - 1.0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    n_p, n_u = positive.sum(), (~positive).sum()
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)

    def grad(by_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(feature, by_row[row], len(start)), by_row.sum())

    for t in range(1, steps + 1):
        z = np.bincount(row, w[feature], len(positive)) + w[-1]
        negative = soft(z[~positive]).mean() - prior * soft(z[positive]).mean()
        toward = grad(np.where(positive, -prior / n_p, 1 / n_u) * sigmoid(z))
        g = -toward if negative < 0 else toward - prior * grad(np.where(positive, sigmoid(-z) / n_p, 0))
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, positives: int = 6_000, unlabelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Linear:
    """Fit on at most ``positives`` confirmed and ``unlabelled`` other texts, drawn from all documents
    whether positive or not; the prior is the rate of positives among the labelled rows. Without
    positives every score is the bare prior."""
    bounded_batches(docs.sparkSession)
    own = F.col(quoted(id_col))
    rows = labels.where(allowed & F.col(label).isNotNull() & own.isNotNull()).groupBy(own.alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    n, n_positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = (n_positive + 0.5) / (n + 1)
    plain = Linear(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not n_positive:
        return plain
    known = lowest(rows.where("y = 1"), "doc_id", positives).select("doc_id", F.lit(True).alias("positive"))
    others = lowest(docs.where(own.isNotNull()).select(own.alias("doc_id")), "doc_id", unlabelled).select("doc_id", F.lit(False).alias("positive"))
    chosen = known.unionByName(others)
    joined = docs.select(own.alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("positive", "text")

    def count(batches):
        for batch in batches:
            for part in slices(batch.filter(batch.column(0)), 1):
                words = np.unique(presence(part.column(1))[1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"word": pa.array(words[0].view(np.int64)), "n": pa.array(words[1])})

    # words in two positives or more, of which a bounded number of texts has a bounded number
    table = joined.where("positive").mapInArrow(lambda batches: give_back(count(batches)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    known = np.sort(table["word"].to_numpy().view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def gather(batches):
        for batch in batches:
            for part in slices(batch, 1):
                doc, place, n = hits(part.column(1), sent.value)
                cut = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_pydict({"positive": part.column(0), "x": pa.ListArray.from_arrays(cut, pa.array(place, pa.int32()))})

    found = joined.mapInArrow(lambda batches: give_back(gather(batches)), "positive boolean, x array<int>").toArrow()
    positive = found["positive"].to_numpy().astype(bool)
    lists = found["x"].combine_chunks()
    # in an order that does not depend on how rows were dealt to tasks
    total = np.add.reduceat(np.append(mix(known[lists.flatten().to_numpy()]), U(0)), np.minimum(lists.offsets.to_numpy()[:-1], len(lists.flatten()))) if len(lists) else np.zeros(0, np.uint64)
    total[lists.value_lengths().to_numpy(zero_copy_only=False) == 0] = 0
    order = np.lexsort((total, positive))
    positive, lists = positive[order], lists.take(pa.array(order))
    row = np.repeat(np.arange(len(positive)), lists.value_lengths().to_numpy(zero_copy_only=False)) if len(positive) else np.zeros(0, np.int64)
    feature = lists.flatten().to_numpy()
    if not positive.any() or positive.all():
        return plain
    p = np.bincount(feature[positive[row]], minlength=len(known))
    model, called = plain, np.zeros(len(positive), dtype=bool)
    for _ in range(PASSES):
        live = ~positive & ~called
        u, n_p, n_u = np.bincount(feature[live[row]], minlength=len(known)), positive.sum(), live.sum()
        picked = features(p, u, n_p, n_u)
        number = np.full(len(known), -1)
        number[picked] = np.arange(len(picked))
        some = number[feature] >= 0
        odds = np.log(((p[picked] + 0.5) / (n_p + 1)) / ((u[picked] + 0.5) / (n_u + 1)))
        weights, bias = fit(row[some], number[feature[some]], positive, prior, np.clip(odds, -1, 1))
        model = Linear(known[picked], weights, bias)
        called = np.bincount(row[some], weights[number[feature[some]]], len(positive)) + bias >= 0
    return model


def score(docs: DataFrame, model: Linear, keep: list[str], text_col: str = "text", name: str = "toxicity_score") -> DataFrame:
    """The columns ``keep`` and the score, row by row; the score takes the place of a kept column of its name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c.lower() != name.lower()]
    frame, place = with_text(docs, keep, text_col)
    schema = StructType([*frame.schema.fields[: len(keep)], StructField(name, DoubleType())])

    def run(batches):
        words, weights, bias = sent.value.words, sent.value.weights, sent.value.bias
        for batch in batches:
            for part in slices(batch, place):
                doc, feature, n = hits(part.column(place), words)
                z = np.bincount(doc, weights[feature], minlength=n) + bias if len(doc) else np.full(n, bias)
                found = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], found], [*keep, name])

    return frame.mapInArrow(lambda batches: give_back(run(batches)), schema)
