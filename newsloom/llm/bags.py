"""Near-duplicate documents by BagMinHash over bags of five-word shingles.

A bag's weights are counts. Every shingle owns Poisson processes over its weight axis, one for
each interval [0,1), [1,2), [2,4), [4,8), ... up to its count; a point carries a time, a weight
and a register, and a register keeps the earliest time among points under the count. Two bags
agree in a register with the probability of their weighted Jaccard similarity. Registers are
banded; bags that share a band are compared exactly by multiset overlap.

Equal bags are one node. In a band's group, nodes are compared with the band's head first, the node
with the most mates. Where a group then still lies in several components, nodes of different
components are compared, unless they can't be alike: sizes too far apart, too little that any other
bag has at all, or too little in common by what each has of the head's shingles (bits, counted
exactly) and elsewhere. Every bound is exact, so no link is lost to it; nothing is capped.

Texts of one to four words have one shingle of all their words; texts without words are one class.
Null text counts as empty. Rows without doc_id have no class. Classes are named by their least doc_id.
Rows of one doc_id with different texts each have their text's class. A very long text is one bag.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.llm.components import components
from newsloom.llm.plan import bounded_batches, parts, quoted, release, shuffle_partitions, stored
from newsloom.llm.suffixes import _by_bucket, _in_order, _pack, _unpack, bucket_of, shared_pieces
from newsloom.llm.words import buffers, give_back, mix, slices, word_hashes

SHINGLE = 5
BANDS, ROWS = 24, 4
KEY = 52
CHUNK_BYTES = 2 << 20
#: Nodes of a band that one task compares with all of the band.
PART = 256
#: Bounds on whole numbers give way by this much, so that rounding drops no pair at ``least`` itself.
SLACK = 1e-6
U = np.uint64


def shingles(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit shingle) of all runs of ``size`` words, or of all words where there are fewer."""
    doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    n = len(words) - size + 1
    out_doc, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n > 0:
        inside = doc[:n] == doc[size - 1 :]
        value = words[:n].copy()
        for k in range(1, size):
            value *= U(0x9E3779B97F4A7C15)
            value += words[k : k + n]
        out_doc, out = doc[:n][inside], mix(value[inside])
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        short = np.isin(doc, few)
        place = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc]
        total = np.zeros(len(counts), dtype=np.uint64)
        np.add.at(total, doc[short], mix(words[short] + place[short].astype(np.uint64)))
        out_doc, out = np.concatenate((out_doc, few)), np.concatenate((out, mix(total[few])))
    return out_doc, out


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document, 52-bit shingle, count) in order, and the number of documents (at most 4096)."""
    return summed_bags(column)[:4]


def summed_bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """What ``bags`` gives, and a sum for each document over its shingles in their full length."""
    raw, offs = buffers(column)
    words, counts = word_hashes(raw, offs)
    doc, whole = shingles(words, counts)
    total = np.zeros(len(counts), dtype=np.uint64)
    np.add.at(total, doc, mix(whole ^ U(0xA0761D6478BD642F)))
    key = np.sort(doc.astype(np.uint64) << U(KEY) | whole >> U(64 - KEY))
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(key)))
    return (key[head] >> U(KEY)).astype(np.int64), key[head] & U((1 << KEY) - 1), size, len(counts), total


def signatures(doc: np.ndarray, value: np.ndarray, count: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """Earliest times, n x registers; infinite where a document has no shingle."""
    least = np.full(n * registers, np.inf)
    level = 0
    while len(value):
        low, size = (0, 1) if level == 0 else (1 << level - 1, 1 << level - 1)
        some = np.flatnonzero(count > low)
        if not len(some):
            break
        d, c = doc[some], count[some]
        seed = mix(value[some] + U((level + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        time = np.zeros(len(some))
        step = 0
        while len(d):
            step += 1
            draw = mix(seed + U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            time = time - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (size * registers)
            other = mix(draw ^ U(0xA0761D6478BD642F))
            register = ((other >> U(32)) * U(registers) >> U(32)).astype(np.int64)
            weight = low + ((other & U(0xFFFFFFFF)) * U(size) >> U(32)).astype(np.int64)
            under = weight < c
            np.minimum.at(least, (d * registers + register)[under], time[under])
            open_ = time < least.reshape(n, registers).max(1)[d]
            d, c, seed, time = d[open_], c[open_], seed[open_], time[open_]
        level += 1
    return least.reshape(n, registers)


def bands(times: np.ndarray) -> np.ndarray:
    """One hash for each band of registers; none (0 rows kept apart by the caller) for empty bags."""
    bits = times.view(np.uint64).reshape(len(times), BANDS, ROWS)
    out = np.zeros((len(times), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * U(0x9E3779B97F4A7C15) + bits[:, :, k])
    return out.view(np.int64)


def _digest(doc: np.ndarray, value: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """A hash of each bag that does not depend on order."""
    total = np.zeros(n, dtype=np.uint64)
    np.add.at(total, doc, mix(value * U(3) + U(1)) * count.astype(np.uint64))
    return mix(total).view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest_a (of the bag as it is compared), digest_b (of the shingles in full length), size and bands, for frames of doc_id and text."""

    def run(batches):
        for batch in batches:
            for wide in slices(batch, 1):
                for i in range(0, wide.num_rows, 2048):
                    part = wide.slice(i, 2048)
                    doc, value, count, n, total = summed_bags(part.column(1))
                    found = bands(signatures(doc, value, count, n))
                    size = np.bincount(doc, count, minlength=n).astype(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(found.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_digest(doc, value, count, n)), pa.array(mix(total).view(np.int64)), pa.array(size), lists], ["doc_id", "digest_a", "digest_b", "size", "bands"])

    return docs.mapInArrow(lambda batches: give_back(run(batches)), "doc_id long, digest_a long, digest_b long, size long, bands array<long>")


def _bag_table(docs: DataFrame) -> DataFrame:
    """node and its bag, packed as sorted shingles and counts."""

    def run(batches):
        for batch in batches:
            for wide in slices(batch, 1):
                for i in range(0, wide.num_rows, 2048):
                    doc, value, count, n = bags(wide.slice(i, 2048).column(1))
                    cut = np.searchsorted(doc, np.arange(n + 1))
                    blobs = [value[a:b].tobytes() + count[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(_digest(doc, value, count, n)), pa.array(blobs, pa.binary())], ["node", "bag"])

    return docs.mapInArrow(lambda batches: give_back(run(batches)), "node long, bag binary")


def _unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(bag) // 12
    return np.frombuffer(bag, np.uint64, n), np.frombuffer(bag, np.uint32, n, 8 * n)


def shared_parts(held: DataFrame, chunks: int) -> DataFrame:
    """node, the part of its bag that some other bag could share, and that part's weight, ``reach``.

    Bags are dealt to chunks; a chunk sends each shingle's hash once and learns which stand in two
    bags or more. Hashes that meet by chance only raise the reach.
    """
    buckets = chunks
    rows = held.withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(chunks)))

    def known(table: pa.Table):
        table = table.sort_by("node")
        bags_ = [_unpacked(b) for b in table["bag"].to_pylist()]
        value = mix(np.concatenate([b[0] for b in bags_]))
        bucket = bucket_of(value, buckets)
        order = np.argsort(value)
        fresh = np.concatenate(([True], value[order][1:] != value[order][:-1])) if len(order) else np.zeros(0, bool)
        head = np.flatnonzero(fresh)
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(fresh) - 1
        return table["node"], bags_, number, value[order][head], bucket[order][head], np.diff(np.append(head, len(order))) > 1

    def send(table: pa.Table) -> pa.Table:
        _, _, _, value, bucket, two = known(table)
        low = (value & U(0xFFFFFFFF)).astype(np.uint32)
        return _by_bucket(table["chunk"][0].as_py(), bucket, lambda a, b: _pack(low[a:b], np.packbits(two[a:b])))

    def add(table: pa.Table, found: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"node": pa.array([], pa.int64()), "reach": pa.array([], pa.int64()), "bag": pa.array([], pa.binary())})
        nodes, bags_, number, *_ = known(table)
        flags = [np.unpackbits(bits, count=int(k[0])).astype(bool) for bits, k in (_unpack(b, np.uint8, np.int64) for b in _in_order(found))]
        shared = np.concatenate(flags)[number] if flags else np.zeros(0, bool)
        ends = np.cumsum([len(b[0]) for b in bags_])
        left = [(v[f], c[f]) for (v, c), f in zip(bags_, np.split(shared, ends[:-1]), strict=True)]
        return pa.table({"node": nodes, "reach": pa.array([int(c.sum()) for _, c in left], pa.int64()), "bag": pa.array([v.tobytes() + c.tobytes() for v, c in left], pa.binary())})

    by_chunk = rows.groupBy("chunk")
    flags = by_chunk.applyInArrow(send, "bucket long, chunk long, blob binary").groupBy("bucket").applyInArrow(shared_pieces, "bucket long, chunk long, blob binary")
    return by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(add, "node long, reach long, bag binary")


def intersection(a: bytes, b: bytes) -> int:
    """Weight that two packed bags share."""
    (va, ca), (vb, cb) = _unpacked(a), _unpacked(b)
    if not len(va) or not len(vb):
        return 0
    at = np.minimum(np.searchsorted(va, vb), len(va) - 1)
    both = va[at] == vb
    return int(np.minimum(ca[at[both]], cb[both]).sum())


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed bags."""
    size = int(_unpacked(a)[1].sum()) + int(_unpacked(b)[1].sum())
    inter = intersection(a, b)
    return inter / (size - inter) if size else 1.0


def profile(bag: bytes, core: bytes) -> tuple[np.ndarray, int, int]:
    """Which of the core's shingles a bag has, as bits of long numbers, its weight there beyond one of each, and its weight elsewhere."""
    (v, c), (w, _) = _unpacked(bag), _unpacked(core)
    inside = np.isin(v, w, assume_unique=True)
    bits = np.zeros(-(-max(len(w), 1) // 64) * 64, dtype=np.uint8)
    bits[np.searchsorted(w, v[inside])] = 1
    return np.packbits(bits).view(np.int64), int(c[inside].sum()) - int(inside.sum()), int(c[~inside].sum())


def _meet(pairs: DataFrame, held: DataFrame, chunks: int, each, schema: str) -> DataFrame:
    """Rows of each(a, b, total, bag_a, bag_b), where not None, for pairs (a, b, total).

    Nodes are dealt to chunks. Pairs meet where the chunks of their ends do, and a bag goes there
    once however many pairs it has there: a task holds the bags of two chunks at most.
    """
    chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks))
    dealt = pairs.select(chunk(F.col("a")).alias("low"), chunk(F.col("b")).alias("high"), "a", "b", "total")
    wanted = dealt.select("low", "high", F.explode(F.array("a", "b")).alias("node")).distinct()
    none = F.lit(None).cast("long")
    sent = wanted.hint("merge").join(held, "node").select("low", "high", F.col("node").alias("a"), none.alias("b"), none.alias("total"), "bag")
    rows = sent.unionByName(dealt.withColumn("bag", F.lit(None).cast("binary")))
    rows = rows.repartition("low", "high").sortWithinPartitions("low", "high", F.col("b").asc_nulls_first())
    made = pa.schema([(f.name, pa.list_(pa.int64()) if f.name == "bits" else pa.int64()) for f in StructType.fromDDL(schema)])

    def run(batches):
        place, known = None, {}
        for batch in batches:
            out = []
            for low, high, a, b, total, bag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (low, high) != place:
                    place, known = (low, high), {}
                if b is None:
                    known[a] = bag
                elif (row := each(a, b, total, known[a], known[b])) is not None:
                    out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(made)], schema=made)

    return rows.select("low", "high", "a", "b", "total", "bag").mapInArrow(lambda batches: give_back(run(batches)), schema)


def classes(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id, one row for each row of ``docs``, repeated ones too; other columns go."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    chunks = parts(texts, CHUNK_BYTES, shuffle_partitions(docs.sparkSession))
    sketches = stored(sketch(texts))
    known = sketches.where("doc_id is not null")
    nodes = stored(known.groupBy(F.col("digest_a").alias("node"), "digest_b").agg(F.min("doc_id").alias("first"), F.max("size").alias("size"), F.max("bands").alias("bands")))
    rows = nodes.where("size > 0").select("node", "size", "first", F.explode("bands").alias("band"))
    shared = stored(rows.groupBy("band").agg(F.count("*").alias("mates")).where("mates > 1"))
    members = stored(rows.join(shared, "band"))
    release(shared)
    # The node with the most mates over all its bands is likeliest alike to all of a group.
    central = members.groupBy("node").agg(F.sum("mates").alias("weight"))
    # One way to join at every size: texts may be of any size, and so may the nodes.
    held = texts.hint("merge").join(members.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    held = stored(_bag_table(held).dropDuplicates(["node"]))
    able = stored(shared_parts(held, chunks))
    release(held)
    held = able.select("node", "bag")
    every_member = members
    members = every_member.join(central, "node").join(able.select("node", "reach"), "node").where(F.col("reach") >= least * F.col("size") - SLACK)
    members = stored(members.select("band", "node", "size", "weight", "reach"))
    release(every_member)
    heads = stored(members.groupBy("band").agg(F.max_by(F.struct("node", "size", "reach"), F.struct("weight", "node")).alias("head"), F.count("*").alias("mates")))
    heads = heads.select("band", "mates", F.col("head.node").alias("other"), F.col("head.size").alias("other_size"), F.col("head.reach").alias("other_reach"))

    # Bags alike enough share this part of both weights together, and only what others have.
    share = least / (1 + least)
    total = F.col("size") + F.col("other_size")
    could = (F.least("size", "other_size") >= least * F.greatest("size", "other_size") - SLACK) & (F.least("reach", "other_reach") >= share * total - SLACK)
    pair = [F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"), total.alias("total")]

    def alike(a, b, total, bag_a, bag_b):
        inter = intersection(bag_a, bag_b)
        return (a, b) if inter / (total - inter) >= least else None

    first = members.join(heads, "band").where((F.col("node") != F.col("other")) & could).select(*pair).distinct()
    edges = stored(_meet(first, held, chunks, alike, "a long, b long"))
    found = stored(components(edges))

    # Bands whose nodes lie in several components yet: what a node has of the head's shingles bounds what two of them share.
    now = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = now.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("most")).where("parts > 1")
    open_ = now.join(spread, "band").join(heads.select("band", "mates", F.col("other").alias("head")), "band").join(nodes.select("node", "bands"), "node")
    open_ = stored(open_.select("band", "node", "size", "reach", "component", "most", "mates", "head", "bands"))

    def seen(a, b, _, bag_a, bag_b):
        bits, beyond, outside = profile(bag_a, bag_b)
        return a, b, bits, beyond, outside

    asked = open_.select(F.col("node").alias("a"), F.col("head").alias("b"), F.lit(0).cast("long").alias("total")).distinct()
    profiles = _meet(asked, held, chunks, seen, "node long, head long, bits array<long>, beyond long, outside long")
    sides = stored(open_.join(profiles, ["node", "head"]))
    # Of two components one is not the largest: nodes outside it meet every pair. A band's are dealt
    # to parts of about PART, each of which meets the band by itself.
    split = F.ceil(F.col("mates") / PART)
    outside = sides.where((F.col("component") != F.col("most.component")) | (F.col("most.n") == 1)).withColumn("part", F.pmod(F.xxhash64("node"), split))
    outside = outside.select("band", "part", *(F.col(c).alias(f"other_{c}") for c in ("node", "size", "reach", "component", "bands", "bits", "beyond", "outside"))).withColumnRenamed("other_node", "other")
    both = F.expr("aggregate(zip_with(bits, other_bits, (x, y) -> bit_count(x & y)), 0L, (s, x) -> s + x) + least(beyond, other_beyond) + least(outside, other_outside)")
    # a pair that shares several bands is named in the first of them only
    once = F.expr("get(filter(bands, (x, i) -> x = other_bands[i]), 0) = band")
    rest = sides.withColumn("part", F.explode(F.sequence(F.lit(0), split - 1))).join(outside, ["band", "part"])
    rest = rest.where((F.col("component") != F.col("other_component")) & could & (both >= share * total - SLACK) & once).select(*pair).distinct()
    more = stored(_meet(rest, held, chunks, alike, "a long, b long"))
    found = stored(components(edges.unionByName(more)))
    named = nodes.select("node", "digest_b", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min("first").alias("class_id"))
    named = stored(named.join(least_id, "component").select(F.col("node").alias("digest_a"), "digest_b", "class_id"))
    release(able, members, open_, sides, nodes)
    out = sketches.select("doc_id", "digest_a", "digest_b").join(named, ["digest_a", "digest_b"], "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))
