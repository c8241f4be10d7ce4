"""Language of a text by a bidirectional gated recurrent network over its bytes.

A text is cut into stretches of STRETCH bytes, all of them, and one recurrent unit reads each
stretch forwards, another backwards. From both states every position gets a probability for each language,
and a text's are the mean over its positions that belong to letters. The units are gated as usual
(reset, update, candidate), with x / (1 + |x|) in place of the hyperbolic tangent, which numpy
divides faster than it exponentiates. The network is trained by backpropagation through time on
stretches of a bounded sample of labelled texts, as many of each language.

Null texts and texts without a letter are ``und`` with score 0; so are all where nothing was learned.
Probabilities are rounded to five places; ties go to the language that comes first by name. Every row gets a prediction, repeated rows and
rows without id too; an empty table gives none. Very long texts are read by groups of stretches.
Kept columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from newsloom.llm.plan import bounded_batches, quoted, with_text
from newsloom.llm.words import buffers, give_back, slices

UNKNOWN = "und"
STRETCH = 64
#: Numbers that stand for a byte, and that a unit keeps of each direction.
EMBEDDED, STATE = 4, 8
#: Stretches read at once.
LANES = 4096

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def squash(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """x / (1 + |x|)"""
    below = np.abs(x)
    below += 1
    return np.divide(x, below, out=out)


@dataclass
class Network:
    """Weights of both directions (first axis), and the languages in order."""

    langs: list[str]
    byte: np.ndarray  # EMBEDDED x 256
    inward: np.ndarray  # 2 x 3 STATE x EMBEDDED: reset, update, candidate
    inner: np.ndarray  # 2 x 3 STATE x STATE
    bias: np.ndarray  # 2 x 3 STATE x 1
    reset_bias: np.ndarray  # 2 x STATE x 1, of the candidate's part under the reset gate
    outward: np.ndarray  # 2 x langs x STATE
    prior: np.ndarray  # langs x 1

    WEIGHTS = ("byte", "inward", "inner", "bias", "reset_bias", "outward", "prior")

    @staticmethod
    def fresh(langs: list[str], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        made = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1]), shape).astype(np.float32)
        none = lambda *shape: np.zeros(shape, dtype=np.float32)
        return Network(langs, rng.normal(0, 1, (EMBEDDED, 256)).astype(np.float32), made(2, 3 * STATE, EMBEDDED), made(2, 3 * STATE, STATE), none(2, 3 * STATE, 1), none(2, STATE, 1), made(2, len(langs), STATE), none(len(langs), 1))

    def states(self, x: np.ndarray, keep: list | None = None):
        """Yields both directions' states after each step over stretches x (STRETCH x lanes); backwards ones from the end."""
        h = np.zeros((2, STATE, x.shape[1]), dtype=np.float32)
        seen = np.empty((2, EMBEDDED, x.shape[1]), dtype=np.float32)
        s = STATE
        for t in range(len(x)):
            np.take(self.byte, x[t], axis=1, out=seen[0], mode="clip")
            np.take(self.byte, x[-1 - t], axis=1, out=seen[1], mode="clip")
            given = self.inward @ seen
            given += self.bias
            held = self.inner @ h
            gates = given[:, : 2 * s]
            gates += held[:, : 2 * s]
            gate = squash(gates)
            gate += 1
            gate *= 0.5
            reset, update = gate[:, :s], gate[:, s:]
            under = held[:, 2 * s :]
            under += self.reset_bias
            candidate = given[:, 2 * s :]
            candidate += reset * under
            n = squash(candidate)
            if keep is not None:
                keep.append((seen.copy(), h, gates, reset, update, under, candidate, n))
            h = h - n
            h *= update
            h += n
            yield h

    def labels(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Probabilities of each language at every position: STRETCH x langs x lanes."""
        out = np.empty((len(x), len(self.langs), x.shape[1]), dtype=np.float32)
        out[:] = self.prior
        for t, h in enumerate(self.states(x, keep)):
            both = self.outward @ h
            out[t] += both[0]
            out[-1 - t] += both[1]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the letters of stretches with languages y, and its gradients through time."""
        keep: list = []
        p = self.labels(x, keep)
        weight = LETTER[x].astype(np.float32)
        weight /= max(weight.sum(), 1)
        lanes, s = np.arange(x.shape[1]), STATE
        loss = -float((np.log(p[:, y, lanes] + 1e-9) * weight).sum())
        p[:, y, lanes] -= 1
        p *= weight[:, None, :]
        g = {k: np.zeros_like(getattr(self, k)) for k in self.WEIGHTS}
        g["prior"] = p.sum(axis=(0, 2))[:, None]
        dh = np.zeros((2, s, x.shape[1]), dtype=np.float32)
        slope = lambda z: 1 / (1 + np.abs(z)) ** 2  # noqa: E731  of x / (1 + |x|)
        for t in reversed(range(len(x))):
            seen, before, gates, reset, update, under, candidate, n = keep[t]
            after = (before - n) * update + n
            out = np.stack((p[t], p[-1 - t]))
            g["outward"] += out @ after.transpose(0, 2, 1)
            dh += self.outward.transpose(0, 2, 1) @ out
            inside = dh * (1 - update) * slope(candidate)
            toward = np.concatenate((inside * under, dh * (before - n)), axis=1) * 0.5 * slope(gates)
            to_held = np.concatenate((toward, inside * reset), axis=1)
            to_given = np.concatenate((toward, inside), axis=1)
            g["reset_bias"] += (inside * reset).sum(axis=2, keepdims=True)
            g["inner"] += to_held @ before.transpose(0, 2, 1)
            g["inward"] += to_given @ seen.transpose(0, 2, 1)
            g["bias"] += to_given.sum(axis=2, keepdims=True)
            to_byte = self.inward.transpose(0, 2, 1) @ to_given
            for k, place in ((0, x[t]), (1, x[-1 - t])):
                for e in range(EMBEDDED):
                    g["byte"][e] += np.bincount(place, to_byte[k, e], 256)
            dh = dh * update + self.inner.transpose(0, 2, 1) @ to_held
        return loss, g

    def pooled(self, column: pa.Array) -> np.ndarray:
        """Each text's mean probabilities over its letters' positions; zeros for a text without any."""
        raw, offs = buffers(column)
        size = np.diff(offs)
        many = -(-size // STRETCH)
        doc = np.repeat(np.arange(len(size)), many)
        first = np.repeat(offs[:-1] - STRETCH * (np.cumsum(many) - many), many) + STRETCH * np.arange(len(doc))
        length = np.minimum(offs[1:][doc] - first, STRETCH)
        total, letters = np.zeros((len(size), len(self.langs))), np.zeros(len(size))
        raw = np.append(raw, np.zeros(STRETCH, np.uint8))
        # stretches of like length together, so that short ones are read no further than they go
        order = np.argsort(-length, kind="stable")
        for a in range(0, len(order), LANES):
            lane = order[a : a + LANES]
            x = raw[first[lane] + np.arange(int(length[lane[0]]))[:, None]]
            x[np.arange(len(x))[:, None] >= length[lane]] = 0
            weight = LETTER[x]
            found = np.einsum("tln,tn->nl", self.labels(x), weight.astype(np.float32))
            np.add.at(total, doc[lane], found)
            np.add.at(letters, doc[lane], weight.sum(axis=0))
        return total / np.maximum(letters, 1)[:, None]


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 240, lanes: int = 256, rate: float = 0.02, seed: int = 0) -> Network:
    """Trained by Adam on stretches x (rows) of languages y, as many of each language in every step; the rate falls to nothing."""
    net, rng = Network.fresh(langs, seed), np.random.default_rng(seed)
    of = [np.flatnonzero(y == k) for k in range(len(langs))]
    if len(langs) < 2:
        return net
    moved = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in net.WEIGHTS}
    for t in range(1, steps + 1):
        some = np.concatenate([rng.choice(own, max(lanes // len(langs), 1)) for own in of])
        _, g = net.gradients(np.ascontiguousarray(x[some].T), y[some])
        norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
        for k, (m, v) in moved.items():
            d = g[k] / max(norm, 1.0)
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            w = getattr(net, k)
            w -= rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return net


def train(docs: DataFrame, lang: str, allowed: Column, sample: int = 3_000, each: int = 4, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Fit on about ``sample`` texts, as many of each language where there are, and ``each`` stretches at most of a text,
    spread over all of it: the bound of what reaches the driver."""
    bounded_batches(docs.sparkSession)
    known = docs.where(allowed & F.col(quoted(lang)).isNotNull() & F.col(quoted(id_col)).isNotNull())
    known = known.select(F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(text_col)).cast("string").alias("text"), F.xxhash64(quoted(id_col)).alias("drawn"))
    known = known.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Network.fresh([])
    share = -(-sample // len(langs))
    # the ids that hash lowest, by each language's own bound
    bound = {k: int(min(share / n, 1) * (2**64 - 1)) - 2**63 for k, n in counts.items()}
    limits = docs.sparkSession.createDataFrame([(i, k, bound[k]) for i, k in enumerate(langs)], "y int, lang string, below long")
    drawn = known.join(F.broadcast(limits), "lang").where("drawn <= below").select("y", "text")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                y, out = [], []
                for label, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    many = -(-len(text) // STRETCH)
                    for k in {many * i // each for i in range(each)}:
                        y.append(label)
                        out.append(text[STRETCH * k : STRETCH * (k + 1)].ljust(STRETCH, b"\0"))
                yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "x": pa.array(out, pa.binary())})

    found = drawn.mapInArrow(lambda b: give_back(cut(b)), "y int, x binary").toArrow()
    rows = sorted(zip(found["y"].to_pylist(), found["x"].to_pylist(), strict=True))
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, STRETCH)
    return fit(x, np.array([r[0] for r in rows], dtype=np.int64), langs)


def predict(docs: DataFrame, model: Network, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep``, the language and its probability; these take the place of kept columns of their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c.lower() not in {n.lower() for n in names}]
    frame, at = with_text(docs, keep, text_col)
    schema = StructType([*frame.schema.fields[: len(keep)], StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches):
        langs = np.array([*sent.value.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at)
                raw, offs = buffers(texts)
                ascii_ = np.concatenate(([0], np.cumsum(LETTER[raw] & (raw < 128))))
                lettered = np.diff(ascii_[offs]) > 0
                for i in np.flatnonzero(~lettered):
                    lettered[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
                # what a text's neighbours in a batch change in its last places is rounded away
                p = sent.value.pooled(texts).round(5) if sent.value.langs else np.zeros((len(part), 1))
                best = np.where(lettered & bool(sent.value.langs), p.argmax(axis=1), len(langs) - 1)
                score = np.where(best < len(langs) - 1, np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(langs[best], pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    return frame.mapInArrow(lambda b: give_back(run(b)), schema)
