"""Document fingerprints by spot signatures, in SQL functions only.

A signature starts at a common word and chains the next CHAIN content words within REACH words.
A document's fingerprint is the sorted set of its signatures' hashes; likeness is Jaccard's. A text
without any signature has one made of its words, so equal texts have equal fingerprints and texts
that differ in words differ. Pairs are found within partitions of set length: alike sets differ in
length by at most the threshold, and share a signature among the first of a common order.

Null text counts as empty. Rows without doc_id have no next document and follow none. Rows of one
doc_id are ordered by their text, so equal rows have equal results. Ids may be any longs. Other columns
go; an empty table gives no rows; a single row follows itself. Very long texts are split whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.plan import quoted

#: Common words of the languages at hand, which anchor signatures.
ANCHORS = (
    "the of and to in is that it for on was as with be by are this from at an a he or have not "
    "der die und das den von zu mit ist des im dem ein eine auf für nicht sich "
    "le la les et des du un une est que dans pour qui par sur pas avec au "
    "el los las y en que del se por con una su para es al lo"
).split()
CHAIN = 2
REACH = 6
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def marked_words(text: Column) -> Column:
    """Words in order, each common word with a leading bar."""
    lowered = F.translate(text, UPPER, LOWER)
    spaced = F.concat(F.lit("  "), F.regexp_replace(lowered, SEPARATOR, "  "), F.lit("  "))
    found = F.regexp_replace(spaced, " (" + "|".join(sorted(set(ANCHORS))) + ") ", " |$1 ")
    return F.filter(F.split(found, " +"), lambda w: w != "")


def signature_set(words: str) -> str:
    """SQL for the sorted distinct 32-bit hashes of a column of marked words."""
    chains = f"""transform(filter(transform({words}, (w, i) -> CASE WHEN startswith(w, '|')
        THEN concat_ws(' ', w, array_join(slice(filter(slice({words}, i + 2, {REACH}), x -> NOT startswith(x, '|')), 1, {CHAIN}), ' ')) END),
        x -> x IS NOT NULL), x -> hash(x))"""
    return f"(CASE WHEN exists({words}, w -> startswith(w, '|')) THEN array_sort(array_distinct({chains})) ELSE array(hash(array_join({words}, ' '))) END)"


def fingerprint_text(signatures: str) -> str:
    """The set as hexadecimal text, eight digits for each signature."""
    return f"array_join(transform({signatures}, x -> lpad(hex(x & 4294967295L), 8, '0')), '')"


def likeness(a: str, b: str) -> str:
    return f"(size(array_intersect({a}, {b})) / CAST(size({a}) + size({b}) - size(array_intersect({a}, {b})) AS DOUBLE))"


def signed(texts: DataFrame) -> DataFrame:
    """The rows with the signatures (sorted array<int>) of their text."""
    columns = texts.columns
    return texts.withColumn("words", marked_words(F.col("text"))).select(*columns, F.expr(signature_set("words")).alias("signatures"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and signatures for each row."""
    return signed(_texts(docs, id_col, text_col))


def _quantiles(texts: DataFrame, rows: int, most: int) -> list[int]:
    """Ids that begin blocks of about ``rows`` rows, the least id first; at most ``most`` of them."""
    n = texts.agg(F.count("doc_id")).first()[0]
    blocks = min(max(n // rows, 1), most)
    if not n:
        return []
    shares = [k / blocks for k in range(blocks)]
    found = texts.where("doc_id is not null").agg(F.min("doc_id"), F.percentile_approx("doc_id", shares, max(10_000, 4 * blocks))).first()
    # quantiles are found in doubles, so they need not be ids: the least id from each on is one
    held = texts.where("doc_id is not null").groupBy(_block(sorted({found[0], *found[1]}))).agg(F.min("doc_id"))
    return sorted(r[1] for r in held.collect())


def _longs(values) -> str:
    """SQL for an array of longs; the least long has no literal of its own."""
    return "array(" + ", ".join(f"{v}L" if v != -(1 << 63) else "CAST('-9223372036854775808' AS BIGINT)" for v in values) + ")"


def _block(firsts: list[int]) -> Column:
    """The number, from 1, of the block that begins at the last of ``firsts`` not above doc_id.

    Looked up in two steps, so a row costs twice the root of the number of blocks.
    """
    width = max(1, int(len(firsts) ** 0.5))
    groups = [firsts[k : k + width] for k in range(0, len(firsts), width)]
    at = f"size(filter({_longs(g[0] for g in groups)}, x -> x <= doc_id))"
    inside = "array(" + ", ".join(_longs(g) for g in groups) + ")"
    return F.expr(f"({at} - 1) * {width} + size(filter(element_at({inside}, greatest({at}, 1)), x -> x <= doc_id))")


def with_next(texts: DataFrame, rows: int = 512, most: int = 1 << 14) -> DataFrame:
    """doc_id, text, signatures, and next_text and next_signatures of the row that follows by doc_id.

    Rows are ordered inside blocks of consecutive ids that hold about ``rows`` rows each wherever
    the ids lie (more where there would be over ``most`` blocks). A block's first id is an id of
    the table, so no block is empty; only each block's first row goes to the block before.
    """
    lone = signed(texts.where("doc_id is null")).withColumn("next", F.lit(None).cast("struct<text:string,signatures:array<int>>"))
    if firsts := _quantiles(texts, rows, most):
        blocks = texts.where("doc_id is not null").withColumn("block", _block(firsts).cast("long"))
        inside = Window.partitionBy("block").orderBy("doc_id", "text")
        chained = signed(blocks).withColumn("next", F.lead(F.struct("text", "signatures")).over(inside))
        begins = texts.sparkSession.range(1).select(F.expr(f"inline(transform({_longs(firsts)}, (x, i) -> struct(x AS doc_id, CAST(pmod(i - 1, {len(firsts)}) + 1 AS BIGINT) AS block)))"))
        # ``firsts`` bounds what is broadcast; rows that share a first id are told apart by their text
        heads = texts.join(F.broadcast(begins), "doc_id").withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("rank = 1")
        heads = signed(heads.select("text", "block")).select("block", F.struct("text", "signatures").alias("head"))
        joined = chained.join(heads, "block", "left")
        lone = joined.select("doc_id", "text", "signatures", F.coalesce("next", "head").alias("next")).unionByName(lone)
    return lone.select("doc_id", "text", "signatures", F.col("next.text").alias("next_text"), F.col("next.signatures").alias("next_signatures"))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, its edited text's and the likeness to that and the next document's."""
    both = with_next(_texts(docs, id_col, text_col))
    half = "CAST(floor(char_length(text) / 2) AS INT)"
    edited = both.select("doc_id", "text", "signatures", "next_signatures", F.expr(f"concat(left(text, char_length(text) - {half}), left(coalesce(next_text, ''), {half}))").alias("edited"))
    edited = edited.withColumn("words", marked_words(F.col("edited")))
    edited = edited.withColumn("edited_signatures", F.expr(signature_set("words")))
    return edited.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(fingerprint_text("signatures")).alias("fingerprint"),
        F.expr(fingerprint_text("edited_signatures")).alias("edited_fingerprint"),
        F.expr(likeness("signatures", "edited_signatures")).alias("near_edited"),
        F.expr(f"coalesce({likeness('signatures', 'next_signatures')}, 0D)").alias("near_next"),
    )


def alike(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b, likeness) of differing fingerprints, one representative id for equal ones.

    Sets are partitioned by length, one partition reaching 1/least times its shortest length, so
    alike sets lie in the same partition or the next. Of a set, the signatures that come first in
    a fixed order, enough that alike sets share one, are looked up; likeness is then computed.
    """
    sets = fingerprints(docs, id_col, text_col).where("doc_id is not null").groupBy("signatures").agg(F.min("doc_id").alias("id")).withColumn("n", F.size("signatures"))
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least))).cast("int")
    sets = sets.withColumn("part", part)
    keep = F.expr(f"n - CAST(ceil(n * {least}D) AS INT) + 1")
    firsts = F.expr("transform(array_sort(transform(signatures, x -> struct(hash(x) AS h, x AS x))), y -> y.x)")
    looked = sets.withColumn("look", F.explode(F.slice(firsts, 1, keep)))
    near = looked.select("look", "id", "n", F.explode(F.array("part", F.col("part") + 1)).alias("part"), "signatures")
    pairs = looked.select("look", "part", F.col("id").alias("a"), F.col("n").alias("na"), F.col("signatures").alias("sa")).join(near.select("look", "part", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("signatures").alias("sb")), ["look", "part"])
    pairs = pairs.where(f"a <> b AND least(na, nb) >= {least}D * greatest(na, nb)")
    found = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), F.expr(likeness("sa", "sb")).alias("likeness")).where(F.col("likeness") >= least)
    return found.select(F.col("low").alias("a"), F.col("high").alias("b"), "likeness").distinct()
