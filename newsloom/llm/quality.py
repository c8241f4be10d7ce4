"""Quality scores by a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one binned feature at a time (then on chosen pairs of
features) and added into lookup tables, so a score is a sum of table entries under a sigmoid.
Features come from the text alone. Null text counts as empty; empty text has the features of no
characters and gets a score like any other. Every row gets a score, repeated rows and rows without id
too; an empty table gives none. Very long texts are worked off by segments of words. Of several labels
of one id the highest counts. All labelled rows are learned from: where they are more than one part, each part
fits a model of its own over common bins, and the tables' means are the model. Kept columns may have any names; a value on a bin's edge is in the bin above.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from newsloom.llm.plan import bounded_batches, quoted, release, stored, with_text
from newsloom.llm.words import buffers, give_back, slices, word_hashes

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "short_words", "long_words", "upper", "digits", "stops",
    "symbols", "spaces", "newlines", "non_ascii", "distinct_words", "distinct_pairs", "distinct_lines", "symbols_per_word",
)

#: Bins of a feature by itself and in a pair.
BINS, COARSE = 64, 12
#: Labelled rows that one model is fitted on.
PART_ROWS = 20_000

KIND = np.zeros((7, 256), dtype=bool)
KIND[0, 65:91] = True
KIND[1, 48:58] = True
KIND[2, [33, 44, 46, 58, 59, 63]] = True
KIND[3, 33:48] = KIND[3, 58:65] = KIND[3, 91:97] = KIND[3, 123:127] = True
KIND[3, [33, 44, 46, 58, 59, 63]] = False
KIND[4, [9, 32]] = True
KIND[5, 10] = True
KIND[6, 128:] = True


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of values in [offs[i], offs[i+1]), empty ranges included."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def _distinct(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct values of each document."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return np.bincount(doc[fresh], minlength=len(counts))


def text_features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    raw, offs = buffers(column)
    n_bytes = np.diff(offs)
    words, counts, first, last = word_hashes(raw, offs, spans=True)
    kinds = [_sums(k[raw], offs) for k in KIND]
    size = last - first
    word_offs = np.concatenate(([0], np.cumsum(counts)))
    pairs = words[:-1] * np.uint64(31) + words[1:] if len(words) else words
    doc = np.repeat(np.arange(len(counts)), counts)
    same = doc[:-1] == doc[1:]
    pair_counts = np.bincount(doc[:-1][same], minlength=len(counts))
    ends = np.union1d(np.flatnonzero(raw == 10) + 1, offs).astype(np.int64)
    line_words = np.searchsorted(first, ends)
    total = np.concatenate(([np.uint64(0)], np.cumsum(words * (first - np.repeat(ends[:-1], np.diff(line_words)) + 1).astype(np.uint64)))) if len(words) else np.zeros(1, np.uint64)
    lines = total[line_words[1:]] - total[line_words[:-1]]
    line_counts = np.diff(np.searchsorted(ends[:-1], offs))
    per = lambda a, b: a / np.maximum(b, 1)
    return np.column_stack([
        np.log1p(n_bytes), np.log1p(counts), per(_sums(size, word_offs), counts), per(_sums(size <= 3, word_offs), counts), per(_sums(size >= 10, word_offs), counts),
        per(kinds[0], n_bytes), per(kinds[1], n_bytes), per(kinds[2], counts), per(kinds[3], n_bytes), per(kinds[4], n_bytes), per(kinds[5], n_bytes), per(kinds[6], n_bytes),
        per(_distinct(words, counts), counts), per(_distinct(pairs[same], pair_counts), pair_counts), per(_distinct(lines, line_counts), line_counts), per(kinds[3], counts),
    ]).astype(np.float32)


@dataclass
class Additive:
    """Bin edges and tables: a score is base + sum of single[j][bin] + pair[p][bin_a, bin_b]."""

    base: float
    edges: list[np.ndarray]
    single: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair: list[np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.single):
            out += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.pair, strict=True):
            out += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges halfway between neighbouring values, at quantiles where there are more values than bins."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest"))
        above = np.unique(x)[np.minimum(np.searchsorted(np.unique(x), values, "right"), len(np.unique(x)) - 1)]
        return np.unique((values + above) / 2).astype(np.float32)
    return ((values[1:] + values[:-1]) / 2).astype(np.float32)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: float, ridge: float) -> tuple[float, int]:
    """Best cut of ordered bins: gain and how many bins go left (0: none)."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    enough = (nl >= least) & (n.sum() - nl >= least)
    gain = np.where(enough, gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge), 0)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) and gain.max() > 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int, least: float, ridge: float) -> np.ndarray:
    """Leaf values of a tree over ordered bins with n rows each."""
    _, cut = _split(g, h, n, least, ridge) if depth else (0.0, 0)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([_tree(g[part], h[part], n[part], depth - 1, least, ridge) for part in (slice(0, cut), slice(cut, None))])


def _tree2(g: np.ndarray, h: np.ndarray, n: np.ndarray, least: float, ridge: float) -> tuple[float, np.ndarray]:
    """Best cut along one axis, then one cut along the other in each half."""
    best, values = 0.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b, c = (g, h, n) if axis == 0 else (g.T, h.T, n.T)
        gain, cut = _split(a.sum(1), b.sum(1), c.sum(1), least, ridge)
        if cut:
            out = np.zeros_like(a)
            for part in (slice(0, cut), slice(cut, None)):
                gain += _split(a[part].sum(0), b[part].sum(0), c[part].sum(0), least, ridge)[0]
                out[part] = _tree(a[part].sum(0), b[part].sum(0), c[part].sum(0), 1, least, ridge)
            if gain > best:
                best, values = gain, out if axis == 0 else out.T
    return best, values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 30, folds: int = 5, **how) -> Additive:
    """Cyclic boosting under log loss, for as many rounds as rows left out in turn are predicted best by.

    Every row is left out once; each class is dealt evenly. With one class only, the score is that
    class's smoothed rate.
    """
    if len(y) < 2 or len(np.unique(y)) < 2:
        return boosted(x, y, 0, 0, **how)[0]
    fold = np.empty(len(y), dtype=np.int64)
    for value in (0, 1):
        fold[y == value] = np.arange((y == value).sum()) % folds
    losses = []
    for k in range(folds):
        out = fold == k
        if out.any() and len(np.unique(y[~out])) == 2:
            losses.append(boosted(x[~out], y[~out], rounds, pair_rounds, watch=(x[out], y[out]), **how)[1] * out.sum())
    best = int(np.argmin(np.sum(losses, axis=0))) if losses else rounds
    return boosted(x, y, min(best, rounds), max(best - rounds, 0), **how)[0]


def boosted(x: np.ndarray, y: np.ndarray, rounds: int, pair_rounds: int, watch=None, bins: int = BINS, n_pairs: int = 6, rate: float = 0.12, ridge: float = 1.0, rows: int = 3, cuts: tuple[list[np.ndarray], list[np.ndarray]] | None = None) -> tuple[Additive, np.ndarray]:
    """A model of ``rounds`` over features, then ``pair_rounds`` over pairs, and the mean log loss on
    the watched rows before the first and after each of them. A leaf has ``rows`` rows or more, or
    a two-thousandth of all. ``cuts`` are edges of fine and coarse bins; without them they come from the rows."""
    rate_1 = (y.sum() + 1) / (len(y) + 2)
    d = x.shape[1] if x.ndim == 2 and len(x) else len(FEATURES)
    model = Additive(float(np.log(rate_1 / (1 - rate_1))), [], [], [], [], [])
    x = x.reshape(-1, d)
    model.edges = [_edges(x[:, j], bins) if len(x) else np.zeros(0, np.float32) for j in range(d)]
    model.coarse = [_edges(x[:, j], COARSE) if len(x) else np.zeros(0, np.float32) for j in range(d)]
    if cuts:
        model.edges, model.coarse = cuts
    model.single = [np.zeros(len(e) + 1) for e in model.edges]
    least = max(rows, 0.0005 * len(y))
    place = lambda z, edges: [np.searchsorted(edges[j], z[:, j], "right") for j in range(d)]
    fine, rough = place(x, model.edges), place(x, model.coarse)
    size = [np.bincount(fine[j], minlength=len(e) + 1) for j, e in enumerate(model.edges)]
    raw = np.full(len(y), model.base)
    losses = []
    if watch is not None:
        seen, truth = watch
        seen_fine, seen_rough, seen_raw = place(seen, model.edges), place(seen, model.coarse), np.full(len(truth), model.base)

    def note() -> None:
        if watch is not None:
            losses.append(np.mean(np.logaddexp(0, np.where(truth > 0, -seen_raw, seen_raw))))

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    note()
    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            n = len(model.single[j])
            step = rate * _tree(np.bincount(fine[j], g, n), np.bincount(fine[j], h, n), size[j], 2, least, ridge)
            model.single[j] += step
            raw += step[fine[j]]
            if watch is not None:
                seen_raw += step[seen_fine[j]]
        note()

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        at = rough[a] * shape[1] + rough[b]
        return tuple(np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (g, h, None))

    if pair_rounds:
        gains = sorted(((_tree2(*grid(a, b), least, ridge)[0], a, b) for a in range(d) for b in range(a)), reverse=True)
        model.pairs = [(a, b) for gain, a, b in gains[:n_pairs] if gain > 0]
        model.pair = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            step = rate * _tree2(*grid(a, b), least, ridge)[1]
            model.pair[k] += step
            raw += step[rough[a], rough[b]]
            if watch is not None:
                seen_raw += step[seen_rough[a], seen_rough[b]]
        note()
    return model, np.array(losses)


def mean(models: list[Additive]) -> Additive:
    """The model whose raw score is the mean of the others'; all have the same bins."""
    first, n = models[0], len(models)
    pairs = sorted({p for m in models for p in m.pairs})
    pair = [sum(m.pair[m.pairs.index(p)] for m in models if p in m.pairs) / n for p in pairs]
    return Additive(sum(m.base for m in models) / n, first.edges, [sum(t) / n for t in zip(*(m.single for m in models), strict=True)], pairs, first.coarse, pair)


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels, in an order that depends on nothing but the rows."""
    order = np.argsort([str(v) for v in zip(table["y"].to_pylist(), table["x"].to_pylist(), strict=True)], kind="stable")
    y = table["y"].to_numpy()[order] if len(table) else np.zeros(0)
    return np.array(table["x"].to_pylist(), dtype=np.float32).reshape(-1, len(FEATURES))[order], y


def _common_cuts(rows: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of fine and coarse bins just above quantiles of all rows' features."""
    at = [[k / bins for k in range(1, bins)] for bins in (BINS, COARSE)]
    found = rows.agg(*(F.percentile_approx(F.col("x")[j], at[0] + at[1], 10_000).alias(str(j)) for j in range(len(FEATURES)))).first()
    edges = lambda values: np.unique(np.nextafter(np.array(values, dtype=np.float32), np.float32(np.inf)))
    return [edges(v[: BINS - 1]) for v in found], [edges(v[BINS - 1 :]) for v in found]


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, part_rows: int = PART_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Fit on all labelled rows, in parts of about ``part_rows``; one part is fitted by the driver, more are by tasks."""
    bounded_batches(docs.sparkSession)
    own = F.col(quoted(id_col))
    rows = labels.where(allowed & F.col(label).isNotNull()).select(own.alias("doc_id"), F.col(label).cast("double").alias("y"))
    rows = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.where(own.isNotNull()).select(own.alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                x = text_features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "x"])

    # features are small and go to their labels; texts stay where they are
    made = texts.mapInArrow(lambda batches: give_back(run(batches)), StructType([texts.schema["doc_id"], StructField("x", ArrayType(FloatType()))]))
    known = stored(made.join(rows, "doc_id").select("doc_id", "y", "x"))
    parts = -(-known.count() // part_rows)
    if parts <= 1:
        model = fit(*_ordered(known.select("y", "x").toArrow()))
    else:
        cuts = _common_cuts(known)

        def one(table: pa.Table) -> pa.Table:
            return pa.table({"part": table["part"][:1], "model": pa.array([pickle.dumps(fit(*_ordered(table), cuts=cuts))], pa.binary())})

        dealt = known.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"), "y", "x")
        found = dealt.groupBy("part").applyInArrow(one, "part long, model binary").collect()
        model = mean([pickle.loads(r.model) for r in sorted(found, key=lambda r: r.part)])
    release(known)
    return model


def score(docs: DataFrame, model: Additive, keep: list[str], text_col: str = "text", name: str = "quality_score") -> DataFrame:
    """The columns ``keep`` and the score, row by row; the score takes the place of a kept column of its name."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c.lower() != name.lower()]
    frame, at = with_text(docs, keep, text_col)
    schema = StructType([*frame.schema.fields[: len(keep)], StructField(name, DoubleType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                found = pa.array(sent.value.score(text_features(part.column(at))), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], found], [*keep, name])

    return frame.mapInArrow(lambda batches: give_back(run(batches)), schema)
