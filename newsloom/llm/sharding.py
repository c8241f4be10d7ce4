"""Shards by extendible hashing.

A directory is indexed by the first bits of a row's hash. A bucket over the byte limit, and no
other, splits on its next bit, until every bucket fits. Bytes are summed for cells of a few more
bits than an even spread needs; a bucket at any depth is a sum of cells, so only small numbers are
shuffled, never texts. A cell that is itself over the limit is divided by all bits of its rows.

The hash is of the id and the text, so one id that holds many different texts splits as well.
Rows equal in both can't be told apart by any bit: they share a bucket of the greatest depth, as
does a single row over the limit, and ``overfull`` marks such buckets.

Texts are read and hashed once, for a table of id, bytes and hash that all later steps read. Null
text counts 0 bytes and is hashed as empty; rows of null id are hashed by their text alone and kept.
A very long text is a row like others, alone in its bucket if it is over the limit. Repeated rows
each count. An empty table gives no rows; of other columns none is kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.plan import quoted, stored

BITS = 60


def _leaves(cells: DataFrame, bits: int, limit: int) -> DataFrame:
    """For each cell of ``bits`` bits, the least depth whose bucket fits, with the bucket's sums."""
    levels = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    levels = levels.withColumn("bucket", F.expr(f"shiftright(cell, {bits} - depth)"))
    sums = levels.groupBy("depth", "bucket").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("depth") == bits))
    # buckets above the shallowest that fits hold many cells each and are no one's answer
    shallowest = fits.agg(F.coalesce(F.min("depth"), F.lit(0))).first()[0]
    found = levels.select("cell", "depth", "bucket").where(F.col("depth") >= shallowest).join(fits, ["depth", "bucket"])
    return found.groupBy("cell").agg(F.min(F.struct("depth", "bucket", "shard_bytes", "shard_docs")).alias("leaf"))


def assign(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard (the bucket's bits as text), depth, shard_bytes, shard_docs, overfull."""
    key, text = F.col(quoted(id_col)), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(text)).cast("binary"))
    rows = docs.select(
        key.cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("hash"),
    )
    rows = stored(rows)
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits = min(BITS, max(1, math.ceil(math.log2(max(total, 1) / limit))) + 6)
    rows = rows.withColumn("cell", F.shiftright("hash", BITS - bits))
    cells = rows.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))
    leaves = _leaves(cells, bits, limit)
    large = leaves.where(F.col("leaf.shard_bytes") > limit).select("cell")
    deep = rows.join(large, "cell", "left_semi").groupBy(F.col("hash").alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"))
    deep = _leaves(deep, BITS, limit).withColumnRenamed("cell", "hash").withColumnRenamed("leaf", "deep")
    joined = rows.join(leaves, "cell").join(deep, "hash", "left").withColumn("leaf", F.coalesce("deep", "leaf"))
    bits_text = F.expr("CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(conv(leaf.bucket, 10, 2), leaf.depth, '0') END")
    return joined.select("doc_id", "n_bytes", bits_text.alias("shard"), F.col("leaf.depth").alias("depth"), F.col("leaf.shard_bytes").alias("shard_bytes"), F.col("leaf.shard_docs").alias("shard_docs"), (F.col("leaf.shard_bytes") > limit).alias("overfull"))


def oracle(limit: int) -> str:
    return f"""
WITH r AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
             ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, {BITS // 4}))::BIGINT AS hash
           FROM documents),
l AS (SELECT doc_id, n_bytes, hash, depth, hash >> ({BITS} - depth) AS bucket FROM r, (SELECT unnest(range(0, {BITS + 1}))::INT AS depth)),
s AS (SELECT depth, bucket, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM l GROUP BY ALL),
f AS (SELECT doc_id, n_bytes, hash, min(depth) AS depth FROM l JOIN s USING (depth, bucket)
      WHERE shard_bytes <= {limit} OR depth = {BITS} GROUP BY ALL)
SELECT r.doc_id, r.n_bytes, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(s.bucket), f.depth, '0') END AS shard,
  f.depth, s.shard_bytes, s.shard_docs, s.shard_bytes > {limit} AS overfull
FROM r JOIN f USING (doc_id, n_bytes, hash) JOIN s ON s.depth = f.depth AND s.bucket = r.hash >> ({BITS} - f.depth)"""
