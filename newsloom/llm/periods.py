"""Periodic runs of words, found by comparing a text's word numbers with themselves at every lag.

For each lag up to a quarter of a text's words the array of word numbers is compared with itself
shifted by the lag, and true stretches are run-length coded: a stretch of t matches at lag q is a
stretch of t + q words with period q. A stretch found at several lags has the least of them as its
period (the others are its multiples). Texts are worked off together, longest first, so that one
comparison serves all texts that are long enough for its lag. A text above LONG_BYTES is dealt out
as ranges of lags, about RANGE_WORK comparisons each, which meet again by text.

Words are ``[^\\x20\\x09-\\x0D]+`` and numbered exactly, by a dictionary for each text. Null and empty
texts have no words. Before the search the texts of some ids are made periodic (``woven``); those of
null ids never. Repeated rows give a row each, worked off once where they are long. An empty table
gives no rows. Other columns go; the columns made are only those of ``found``.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.plan import bounded_batches, quoted, shuffle_partitions
from newsloom.llm.words import give_back, slices

#: A run has at least LEAST words and EXPONENT times its period.
LEAST, EXPONENT = 6, 4
LONG_BYTES = 1 << 16
RANGE_WORK = 1 << 26
ONES = np.uint64(0x0101010101010101)

MADE = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def woven(doc_id: int | None, n: int) -> tuple[int, int]:
    """(a, p): words from a on repeat those of a..a+p-1; a = n where the text stays as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return n, 1
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def words_of(doc_id: int | None, text: bytes | None) -> list[bytes]:
    words = text.split() if text else []
    n = len(words)
    a, p = woven(doc_id, n)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a] if a < n else words


def numbers(words: list[bytes], base: int = 0) -> np.ndarray:
    """A number for each word, the same for the same word, from ``base`` on."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words), base)}
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def stretches(value: np.ndarray, sizes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, lag) of stretches with a period of low..high-1 in texts laid end to end, longest first.

    Texts share no number, so no stretch crosses from one to the next.
    """
    ends = np.cumsum(sizes)
    out = []
    # how many texts, and so how many words, are long enough for each lag
    for q in range(low, high):
        many = int(np.searchsorted(-sizes, -max(LEAST, EXPONENT * q), "right"))
        if not many:
            break
        n = int(ends[many - 1])
        same = value[: n - q] == value[q:n]
        need = max(LEAST - q, (EXPONENT - 1) * q)
        if need >= 15:  # so long a stretch fills eight aligned places
            whole = len(same) & ~7
            blocks = same[:whole].view(np.uint64) == ONES
            if not blocks.any() and not same[whole:].all():
                continue
        elif np.count_nonzero(same) < need:
            continue
        edge = np.flatnonzero(np.diff(same, prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        good = end - begin >= need
        if good.any():
            out.append((begin[good], end[good] + q, np.full(good.sum(), q)))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def least_periods(begin: np.ndarray, end: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) in order of start and period: each stretch with its least lag."""
    order = np.lexsort((lag, end, begin))
    begin, end, lag = begin[order], end[order], lag[order]
    fresh = np.ones(len(begin), dtype=bool)
    fresh[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, lag = begin[fresh], end[fresh], lag[fresh]
    order = np.lexsort((lag, begin))
    return np.column_stack((begin, end - begin, lag))[order]


def digest(words: list[bytes], runs: np.ndarray) -> tuple:
    """The columns MADE of one text."""
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    kept = words if not len(runs) else compress(words, (np.cumsum(step[:-1]) == 0).tolist())
    rows = runs.tolist()
    best = None
    for r in rows:  # in order of start and period: a later one must be greater
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    text = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(rows), *head, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def lag_range(n: int, part: int, of: int) -> tuple[int, int]:
    """The lags of one part of ``of`` parts of a text of n words."""
    top = n // EXPONENT if n >= LEAST else 0
    return 1 + top * part // of, 1 + top * (part + 1) // of


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, runs_sha256 and collapsed_sha256."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))

    def table(ids, made) -> pa.RecordBatch:
        kinds = (pa.int64(),) * 5 + (pa.string(),) * 2
        columns = zip(*made, strict=True) if made else [[]] * 7
        names = [x.split()[0] for x in MADE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    def short(batches):
        for batch in batches:
            for part in slices(batch, 1):
                ids = part.column(0).to_pylist()
                texts_ = part.column(1).cast(pa.binary()).to_pylist()
                words = [words_of(i, t) for i, t in zip(ids, texts_, strict=True)]
                order = sorted(range(len(words)), key=lambda k: -len(words[k]))
                values, base = [], 0
                for k in order:
                    values.append(numbers(words[k], base))
                    base += len(words[k])
                sizes = np.array([len(words[k]) for k in order], dtype=np.int64)
                begin, end, lag = stretches(np.concatenate(values), sizes, 1, max(len(w) for w in words) // EXPONENT + 1)
                firsts = np.cumsum(sizes) - sizes
                at = np.searchsorted(np.cumsum(sizes), begin, "right")
                by = np.argsort(at, kind="stable")
                cut = np.searchsorted(at[by], np.arange(len(order) + 1))
                made: list = [None] * len(order)
                for j, k in enumerate(order):
                    own = by[cut[j] : cut[j + 1]]
                    made[k] = digest(words[k], least_periods(begin[own] - firsts[j], end[own] - firsts[j], lag[own]))
                yield table(ids, made)

    def scan(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words = words_of(r["doc_id"], r["text"].encode())
                low, high = lag_range(len(words), r["part"], r["of"])
                runs = least_periods(*stretches(numbers(words), np.array([len(words)]), low, high))
                first = r["part"] == 0
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([r["doc_id"]], pa.int64()), "key": pa.array([r["key"]]), "copies": pa.array([r["copies"]], pa.int64()),
                    "text": pa.array([r["text"] if first else None], pa.string()), "runs": pa.array([runs.astype(np.int64).tobytes()], pa.binary()),
                })

    def meet(group: pa.Table) -> pa.Table:
        text = next(t for t in group["text"].to_pylist() if t is not None)
        doc_id, copies = group["doc_id"][0].as_py(), group["copies"][0].as_py()
        runs = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 3) for b in group["runs"].to_pylist()])
        words = words_of(doc_id, text.encode())
        row = table([doc_id], [digest(words, least_periods(runs[:, 0], runs[:, 0] + runs[:, 1], runs[:, 2]))])
        return pa.Table.from_batches([row]).append_column("copies", pa.array([copies], pa.int64()))

    done = texts.where(size <= LONG_BYTES).mapInArrow(lambda b: give_back(short(b)), f"doc_id long, {MADE}")
    # equal rows are worked off once; a word and the space after it take two bytes at least, but mostly six
    long = texts.where(size > LONG_BYTES).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    parts = F.greatest(F.lit(1), F.ceil(F.pow(F.octet_length("text") / 6, 2) / EXPONENT / RANGE_WORK)).cast("long")
    ranges = long.withColumn("key", F.sha2("text", 256)).withColumn("of", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))
    spread = ranges.repartition(shuffle_partitions(docs.sparkSession), "key", "doc_id", "part")
    scanned = spread.mapInArrow(lambda b: give_back(scan(b)), "doc_id long, key string, copies long, text string, runs binary")
    met = scanned.groupBy("doc_id", "key").applyInArrow(meet, f"doc_id long, {MADE}, copies long")
    again = met.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    return done.unionByName(again)
