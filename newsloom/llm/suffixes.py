"""Suffix-array removal of byte strings that already stand in an earlier document.

Each 50-byte string has a leading 24-byte piece, the one whose hash is least; equal strings have
equal pieces at equal places, so only suffixes around the same piece are compared. Documents are
dealt to chunks. (1) A chunk sends the distinct pieces it holds and learns which of them stand in
two documents or more. (2) Around those it sends the distinct stretches of bytes whose strings
they lead, with the least doc_id of each. Suffixes around one piece are sorted, one for all that
have the same prefix polynomial hash and, as is confirmed, the same bytes: by their first bytes eight
at once, and by mergesort where those tie, two being compared by binary search for their common
extension on prefix hashes. Equal strings get the least doc_id. (3) A chunk removes the strings
whose least doc_id is below the document's own.

A chunk sends each piece or stretch once, so a passage in a third of all documents makes one entry
for each chunk. Null text counts as empty. Rows without doc_id are left as they are and remove
nothing; rows of one doc_id, equal or not, do not affect each other and each gives a row. Texts under
50 bytes are kept. A very long text is one chunk, hashed by segments. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from newsloom.llm.plan import bounded_batches, quoted, shuffle_partitions, text_bytes
from newsloom.llm.words import TOP, buffers, mix, power, prefix_hashes

LENGTH = 50
PIECE = 24
SEGMENT = 1 << 16
INDEX = 20
CHUNK_BYTES = 1 << 20
BUCKET_BYTES = 5 << 20
#: Texts from which on chunks and buckets grow with the square root of the input, and so the blobs between them in proportion to it.
GROW_FROM = 1 << 29
#: Bytes by which suffixes are told apart, eight at once, before they are merge-sorted.
FIRST = 48
#: Stretches sorted at once.
AT_ONCE = 6_000
U = np.uint64
#: Columns that ``deduplicate`` adds.
MADE = ("n_bytes", "n_removed", "removed", "kept", "kept_sha256")


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, without a copy."""
    raw = np.ascontiguousarray(raw)
    return np.ndarray((max(len(raw) - 7, 0),), dtype=np.uint64, buffer=raw, strides=(1,)) if len(raw) > 7 else np.zeros(0, np.uint64)


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hashes of all pieces of PIECE bytes, three times eight."""
    word, n = eights(raw), len(raw) - PIECE + 1
    out = word[:n] * U(0x9E3779B97F4A7C15)
    for k in (8, 16):
        out ^= out >> U(29)
        out += word[k : k + n]
        out *= U(0xC2B2AE3D27D4EB4F)
    return mix(out)


def runs(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH):
    """Runs of windows of ``length`` bytes that one piece leads.

    Arrays: first window's start, number of windows, the piece's start, its hash. Windows stay
    inside documents. Segments end where documents do, and in a long one at set distances from its
    start, so the runs of a document are the same whatever stands around it.
    """
    starts, counts, places, hashes = [], [], [], []
    width = length - PIECE + 1
    usable = np.maximum(np.diff(offs) - length + 1, 0)
    cuts = [0]
    for begin, end in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if end - cuts[-1] > SEGMENT and begin > cuts[-1]:
            cuts.append(begin)
        while end - cuts[-1] > SEGMENT:
            cuts.append(cuts[-1] + SEGMENT)
    for lo, hi in zip(cuts, [*cuts[1:], len(raw)], strict=True):
        hi = min(hi, len(raw) - length + 1)
        if hi <= lo:
            continue
        part = raw[lo : hi + length - 1]
        grams = _grams(part)
        least = grams >> U(INDEX) << U(INDEX) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        at = (least & U((1 << INDEX) - 1)).astype(np.int64)
        delta = np.zeros(hi - lo + 1, dtype=np.int64)
        a, b = np.clip(offs[:-1], lo, hi), np.clip(offs[:-1] + usable, lo, hi)
        full = b > a
        np.add.at(delta, a[full] - lo, 1)
        np.add.at(delta, b[full] - lo, -1)
        window = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
        if not len(window):
            continue
        led = at[window]
        fresh = np.ones(len(window), dtype=bool)
        fresh[1:] = (led[1:] != led[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(fresh)
        starts.append(window[first] + lo)
        counts.append(np.diff(np.append(first, len(window))))
        places.append(led[first] + lo)
        hashes.append(grams[led[first]])
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(starts, np.int64), cat(counts, np.int64), cat(places, np.int64), cat(hashes, np.uint64)


def _extension(total, a, b, most):
    """Length of the common extension of suffixes a and b, at most ``most``, by binary search."""
    low, high = np.zeros(len(a), dtype=np.int64), most.copy()
    up_a, up_b = power(TOP - a), power(TOP - b)
    whole = (total[a + most] - total[a]) * up_a == (total[b + most] - total[b]) * up_b
    low[whole] = most[whole]
    open_ = np.flatnonzero(~whole)
    high[open_] -= 1
    while len(open_):
        x, y = a[open_], b[open_]
        mid = (low[open_] + high[open_] + 1) >> 1
        same = (total[x + mid] - total[x]) * up_a[open_] == (total[y + mid] - total[y]) * up_b[open_]
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)
        open_ = open_[low[open_] < high[open_]]
    return low


def suffix_sort(raw: np.ndarray, group: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, suffix up to length), and which neighbours are equal.

    Of suffixes with one hash and the same bytes one is sorted for all, so what is sorted grows with how
    many differ, not with how often each stands in the texts.
    """
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    total = prefix_hashes(raw)
    key = mix((total[start + length] - total[start]) * power(TOP - start) + mix((group * (1 << 8) + length).astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = order[again], order[again + 1]
    same = (group[a] == group[b]) & (length[a] == length[b])
    same[same] = _same_bytes(raw, start[a[same]], start[b[same]], length[a[same]])
    fresh = np.ones(len(order), dtype=bool)
    fresh[again[same] + 1] = False
    head = np.flatnonzero(fresh)
    size = np.diff(np.append(head, len(order)))
    one = order[head]
    place, alike = _merged(raw, total, _by_first_words(raw, group[one], start[one], length[one]), start[one], length[one])
    size = size[place]
    equal = np.ones(len(order), dtype=bool)
    equal[np.cumsum(size) - size] = alike
    return order[_places(head[place], size)], equal


def _by_first_words(raw: np.ndarray, group: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Smaller groups in the same order: suffixes of one group whose first FIRST bytes differ are apart, as far as all are as long."""
    word = eights(raw)
    rank = np.searchsorted(np.sort(group), group)
    for k in range(0, FIRST, 8):
        tied = np.flatnonzero(np.bincount(rank)[rank] > 1)
        if not len(tied) or length[tied].min() < k + 8:
            break
        w = word[start[tied] + k].byteswap()
        order = np.lexsort((w, rank[tied]))
        r, w = rank[tied][order], w[order]
        at, new = np.arange(len(r)), np.concatenate(([True], r[1:] != r[:-1]))
        fresh = new.copy()
        fresh[1:] |= w[1:] != w[:-1]
        rank[tied[order]] = r + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(new, at, 0))
    return rank


def _merged(raw: np.ndarray, total: np.ndarray, group: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``suffix_sort`` by mergesort: runs of doubling width are merged by ranking every suffix in the run beside its own."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(g)))
    base, n = np.repeat(head, size), np.repeat(size, size)
    at = np.arange(len(g))
    width = 1
    while len(size) and width < size.max():
        live = np.flatnonzero(n > width)
        place = live - base[live]
        pair = place // (2 * width) * (2 * width)
        left = place < pair + width
        low = np.where(left, pair + width, pair)
        low = np.minimum(low, n[live])
        high = np.minimum(low + width, n[live])
        first, own = low.copy(), order[live]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            other = order[base[live[open_]] + mid]
            mine = own[open_]
            most = np.minimum(length[mine], length[other])
            shared = _extension(total, start[mine], start[other], most)
            ended = shared >= most
            inside = np.minimum(shared, most - 1)
            below = np.where(ended, length[other] < length[mine], raw[start[other] + inside] < raw[start[mine] + inside])
            tie = ended & (length[other] == length[mine])
            up = below | tie & ~left[open_]
            low[open_] = np.where(up, mid + 1, low[open_])
            high[open_] = np.where(up, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        target = base[live] + pair + np.where(left, place - pair, place - pair - width) + (low - first)
        merged = at.copy()
        merged[target] = live
        order = order[merged]
        width *= 2
    equal = np.zeros(len(order), dtype=bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        near = np.flatnonzero((group[a] == group[b]) & (length[a] == length[b]))
        a, b = a[near], b[near]
        same = _extension(total, start[a], start[b], length[a]) == length[a]
        equal[near[same] + 1] = _same_bytes(raw, start[a[same]], start[b[same]], length[a[same]])
    return order, equal


def _same_bytes(raw, a, b, length):
    """Whether the bytes are the same, looked at eight by eight, the last eight from the end on; short ones one by one."""
    out = np.ones(len(a), dtype=bool)
    word, least = eights(raw), int(length.min()) if len(length) else 0
    if least < 8:
        for k in range(int(length.max()) if len(length) else 0):
            live = np.flatnonzero(length > k)
            out[live] &= raw[a[live] + k] == raw[b[live] + k]
        return out
    for k in range(0, int(length.max()) - 7, 8):
        live = np.flatnonzero(length >= k + 8) if k + 8 > least else slice(None)
        out[live] &= word[a[live] + k] == word[b[live] + k]
    end = length - 8
    out &= word[a + end] == word[b + end]
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    data = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], dtype=np.int64).tobytes()
    return sizes + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, dtype=np.int64, count=int(np.frombuffer(blob, np.int64, 1)[0]) + 1)[1:]
    data = pa.decompress(blob[8 * (len(sizes) + 1) :], decompressed_size=int(sizes.sum()), codec="zstd", asbytes=True) if sizes.sum() else b""
    ends = np.cumsum(sizes)
    return [np.frombuffer(data, dtype=k, count=int(s) // np.dtype(k).itemsize, offset=int(e - s)) for k, s, e in zip(kinds, sizes, ends, strict=True)]


def bucket_of(value: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the first 32 bits, so values in order have their buckets in order; the last 32 bits tell values apart."""
    return ((value >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


class Chunk:
    """The rows of one chunk and what its windows hold."""

    def __init__(self, table: pa.Table, buckets: int):
        self.raw, self.offs = buffers(table["text"])
        ids = table["doc_id"].combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        start, count, place, hashed = runs(self.raw, self.offs)
        doc = np.searchsorted(self.offs, start, "right") - 1
        held = self.known[doc]
        # the least of many hashes is small: mixed again, pieces spread over all buckets
        self.start, self.count, self.lead, hashed, self.doc = start[held], count[held], (place - start)[held], mix(hashed[held]), doc[held]
        self.bucket = bucket_of(hashed, buckets)
        self.hashed = hashed

    def pieces(self):
        """Distinct pieces in order of bucket and hash: bucket, hash, whether in two ids, each run's number."""
        order = np.argsort(self.hashed)
        b, h = self.bucket[order], self.hashed[order]
        fresh = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        head = np.flatnonzero(fresh)
        number = np.empty(len(h), dtype=np.int64)
        number[order] = np.cumsum(fresh) - 1
        ids = self.ids[self.doc[order]]
        two = np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head) if len(head) else np.zeros(0, bool)
        return b[head], h[head], two, number

    def stretches(self, shared: np.ndarray, number: np.ndarray):
        """Distinct stretches of runs whose piece is shared: the runs, each run's stretch, one run of each, least id."""
        run = np.flatnonzero(shared[number])
        total = prefix_hashes(self.raw)
        s, e = self.start[run], self.start[run] + self.count[run] + LENGTH - 1
        shape = mix((self.count[run] << 8 | self.lead[run]).astype(np.uint64) + U(1))
        content = mix(mix((total[e] - total[s]) * power(TOP - s)) + shape)
        order = np.lexsort((content, self.hashed[run]))
        r, c = run[order], content[order]
        if len(r):
            fresh = np.concatenate(([True], (c[1:] != c[:-1]) | (self.hashed[r[1:]] != self.hashed[r[:-1]])))
            again = np.flatnonzero(~fresh)
            a, b = r[again - 1], r[again]
            size = self.count[a] + LENGTH - 1
            good = (self.count[a] == self.count[b]) & (self.lead[a] == self.lead[b])
            good[good] = _same_bytes(self.raw, self.start[a[good]], self.start[b[good]], size[good])
            fresh[again[~good]] = True
        else:
            fresh = np.zeros(0, bool)
        head = np.flatnonzero(fresh)
        stretch = np.empty(len(r), dtype=np.int64)
        stretch[order] = np.cumsum(fresh) - 1
        least = np.minimum.reduceat(self.ids[self.doc[r]], head) if len(head) else np.zeros(0, np.int64)
        return run, stretch, r[head], least


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all stretches, one after another."""
    return raw[_places(start, size)]


def _by_bucket(chunk, bucket: np.ndarray, packed) -> pa.Table:
    """One row for each bucket present: packed(lo, hi) of its slice."""
    head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(head[1:], len(bucket))[: len(head)]
    return pa.table({
        "bucket": pa.array(bucket[head], pa.int64()), "chunk": pa.array(np.full(len(head), chunk), pa.int64()),
        "blob": pa.array([packed(int(a), int(b)) for a, b in zip(head, ends, strict=True)], pa.binary()),
    })


def _in_order(table: pa.Table) -> list[bytes]:
    """Blobs of one chunk by bucket, or of one bucket by chunk."""
    return table.sort_by([("bucket", "ascending"), ("chunk", "ascending")])["blob"].to_pylist()


def shared_pieces(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, which of its pieces stand in two documents or more."""
    table = table.sort_by("chunk")
    parts_ = [_unpack(b, np.uint32, np.uint8) for b in table["blob"].to_pylist()]
    values = np.concatenate([p[0] for p in parts_])
    two = np.concatenate([np.unpackbits(p[1], count=len(p[0])).astype(bool) for p in parts_])
    order = np.argsort(values, kind="stable")
    v = values[order]
    head = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    size = np.diff(np.append(head, len(v)))
    shared = np.empty(len(v), dtype=bool)
    shared[order] = np.repeat((size > 1) | np.logical_or.reduceat(two[order], head), size)
    ends = np.cumsum([len(p[0]) for p in parts_])
    blobs = [_pack(np.packbits(x), np.array([len(x)])) for x in np.split(shared, ends[:-1])]
    return pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "blob": pa.array(blobs, pa.binary())})


def _least_of(raw: np.ndarray, piece: np.ndarray, count: np.ndarray, lead: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least doc_id of every window of some stretches, which hold all of their pieces' stretches."""
    size = count + LENGTH - 1
    start = np.cumsum(size) - size
    order, equal = suffix_sort(raw, piece << 16 | lead << 8 | count, start, size)
    kind = np.empty(len(order), dtype=np.int64)
    kind[order] = np.cumsum(~equal) - 1
    one = order[~equal]
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids)
    # windows of one stretch for each kind; a kind alone with its piece needs no more
    ends = np.cumsum(count[one])
    window = np.repeat(least, count[one])
    several = np.flatnonzero(np.bincount(piece[one])[piece[one]] > 1)
    if len(several):
        rep = one[several]
        win = np.repeat(np.arange(len(rep)), count[rep])
        step = np.arange(len(win)) - np.repeat(np.cumsum(count[rep]) - count[rep], count[rep])
        group = piece[rep][win] << 8 | (lead[rep][win] - step + 128)
        worder, wequal = suffix_sort(raw, group, start[rep][win] + step, np.full(len(win), LENGTH, dtype=np.int64))
        wkind = np.empty(len(worder), dtype=np.int64)
        wkind[worder] = np.cumsum(~wequal) - 1
        wleast = np.full(int((~wequal).sum()), np.iinfo(np.int64).max)
        np.minimum.at(wleast, wkind, least[several][win])
        window[np.repeat(ends[several] - count[rep], count[rep]) + step] = wleast[wkind]
    return window[_places((ends - count[one])[kind], count)]


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``start``, one range after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def least_ids(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk's stretches, the least doc_id of every window.

    Pieces are worked off some at a time, so what sorting needs does not grow with the bucket.
    """
    table = table.sort_by("chunk")
    parts_ = [_unpack(b, np.uint64, np.uint8, np.uint8, np.int64, np.uint8) for b in table["blob"].to_pylist()]
    piece, count, lead, ids, raw = (np.concatenate(x) for x in zip(*parts_, strict=True))
    count, lead = count.astype(np.int64), lead.astype(np.int64)
    size = count + LENGTH - 1
    start, first = np.cumsum(size) - size, np.cumsum(count) - count
    _, piece = np.unique(piece, return_inverse=True)
    order = np.argsort(piece, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], np.diff(piece[order]) > 0)))
    stops = np.searchsorted(head, np.arange(0, len(order), AT_ONCE))
    cut = np.unique(np.append(head[stops[stops < len(head)]], [0, len(order)]))
    window = np.empty(int(count.sum()), dtype=np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        some = order[a:b]
        found = _least_of(_gather(raw, start[some], size[some]), piece[some] - piece[some[0]], count[some], lead[some], ids[some])
        window[_places(first[some], count[some])] = found
    low, high = np.minimum.reduceat(window, first), np.maximum.reduceat(window, first)
    uniform = low == high
    blobs, at = [], 0
    for p in parts_:
        own = slice(at, at + len(p[0]))
        at += len(p[0])
        mixed = np.flatnonzero(~uniform[own])
        inner = window[_places(first[own][mixed], count[own][mixed])]
        blobs.append(_pack(uniform[own].astype(np.uint8), low[own], inner))
    return pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "blob": pa.array(blobs, pa.binary())})


def cuts(total: int, least: int) -> tuple[int, int]:
    """How many chunks and buckets texts of ``total`` bytes are dealt to, ``least`` of each at least."""
    grown = max(1.0, total / GROW_FROM) ** 0.5
    return tuple(max(least, math.ceil(total / (size * grown))) for size in (CHUNK_BYTES, BUCKET_BYTES))


def deduplicate(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", texts_too: bool = True) -> DataFrame:
    """``keep`` with n_bytes, n_removed, removed (array of start and end bytes), kept (binary, with ``texts_too``) and kept_sha256.

    A made column takes the place of a kept one of its name; other names can't clash.
    """
    keep = [c for c in keep or [id_col] if c.lower() not in MADE]
    bounded_batches(docs.sparkSession)
    n = shuffle_partitions(docs.sparkSession)
    chunks, buckets = cuts(text_bytes(docs, text_col), n)
    names = [f"_k{i}" for i in range(len(keep))]
    own, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    dealt = F.pmod(F.xxhash64(own, F.when(own.isNull(), text)), F.lit(chunks))
    texts = docs.select(*(F.col(quoted(c)).alias(k) for c, k in zip(keep, names, strict=True)), own.cast("long").alias("doc_id"), text.cast("string").alias("text"), dealt.alias("chunk"))
    blobs = "bucket long, chunk long, blob binary"

    def number(key, table: pa.Table) -> int:
        return table["chunk"][0].as_py()

    def send_pieces(table: pa.Table) -> pa.Table:
        c = Chunk(table, buckets)
        bucket, hashed, two, _ = c.pieces()
        low = (hashed & U(0xFFFFFFFF)).astype(np.uint32)
        return _by_bucket(table["chunk"][0].as_py(), bucket, lambda a, b: _pack(low[a:b], np.packbits(two[a:b])))

    def known(c: Chunk, found: pa.Table):
        *_, number = c.pieces()
        flags = [np.unpackbits(bits, count=int(n[0])).astype(bool) for bits, n in (_unpack(b, np.uint8, np.int64) for b in _in_order(found))]
        return c.stretches(np.concatenate(flags) if flags else np.zeros(0, bool), number)

    def send_stretches(table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"bucket": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        c = Chunk(table, buckets)
        _, _, one, least = known(c, found)

        def packed(a: int, b: int) -> bytes:
            r = one[a:b]
            return _pack(c.hashed[r], c.count[r].astype(np.uint8), c.lead[r].astype(np.uint8), least[a:b], _gather(c.raw, c.start[r], c.count[r] + LENGTH - 1))

        return _by_bucket(table["chunk"][0].as_py(), c.bucket[one], packed)

    schema = texts.select(*names).schema.add("n_bytes", "long").add("n_removed", "long").add("starts", ArrayType(LongType())).add("ends", ArrayType(LongType())).add("kept", "binary").add("kept_sha256", "string")

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        if len(table):
            c = Chunk(table, buckets)
            flags = found.filter(pc.equal(found["step"], 1)).drop(["step"])
            answers = found.filter(pc.equal(found["step"], 2)).drop(["step"])
            run, stretch, _, _ = known(c, flags)
            delta = np.zeros(len(c.raw) + 1, dtype=np.int64)
            if len(run):
                got = [_unpack(b, np.uint8, np.int64, np.int64) for b in _in_order(answers)]
                uniform, value, inner = (np.concatenate(x) for x in zip(*got, strict=True))
                uniform = uniform.astype(bool)
                own = c.ids[c.doc[run]]
                gone = run[uniform[stretch] & (value[stretch] < own)]
                np.add.at(delta, c.start[gone], 1)
                np.add.at(delta, c.start[gone] + c.count[gone] + LENGTH - 1, -1)
                counts = np.zeros(len(uniform), dtype=np.int64)
                counts[stretch] = c.count[run]
                at = np.cumsum(np.where(uniform, 0, counts)) - np.where(uniform, 0, counts)
                some = np.flatnonzero(~uniform[stretch])
                r, k = run[some], c.count[run[some]]
                step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                hit = inner[np.repeat(at[stretch[some]], k) + step] < np.repeat(own[some], k)
                begin = (np.repeat(c.start[r], k) + step)[hit]
                np.add.at(delta, begin, 1)
                np.add.at(delta, begin + LENGTH, -1)
            gone = np.cumsum(delta[:-1]) > 0
            before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
            before[c.offs[c.offs < len(gone)]] = False
            after = np.concatenate((gone[1:], [False])) if len(gone) else gone
            last = c.offs[(c.offs > 0)] - 1
            after[last[last < len(gone)]] = False
            first, end = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
            in_doc = np.searchsorted(first, c.offs)
            removed = np.concatenate(([0], np.cumsum(gone)))[c.offs]
            rest = c.raw[~gone].tobytes()
            cut = (c.offs - removed).tolist()
            texts_kept = [rest[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            base = np.repeat(c.offs[:-1], np.diff(in_doc))
            offsets = pa.array(in_doc, pa.int32())
            columns = {k: table[k].combine_chunks() for k in names} | {
                "n_bytes": pa.array(np.diff(c.offs)), "n_removed": pa.array(np.diff(removed)),
                "starts": pa.ListArray.from_arrays(offsets, pa.array(first - base, pa.int64())), "ends": pa.ListArray.from_arrays(offsets, pa.array(end - base, pa.int64())),
                "kept": pa.array(texts_kept if texts_too else [None] * len(texts_kept), pa.binary()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts_kept], pa.string()),
            }
            return pa.table(columns)
        return pa.table({f.name: pa.array([], table.schema.field(f.name).type if f.name in names else None) for f in schema}).cast(pa.schema([(k, table.schema.field(k).type) for k in names] + [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary()), ("kept_sha256", pa.string())]))

    by_chunk = texts.groupBy("chunk")
    pieces = by_chunk.applyInArrow(send_pieces, blobs)
    shared = pieces.groupBy("bucket").applyInArrow(shared_pieces, blobs)
    stretches = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(send_stretches, blobs)
    answers = stretches.groupBy("bucket").applyInArrow(least_ids, blobs)
    both = shared.withColumn("step", F.lit(1)).unionByName(answers.withColumn("step", F.lit(2)))
    out = by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(remove, schema)
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, names, strict=True)), "n_bytes", "n_removed", spans.alias("removed"), "kept", "kept_sha256")
