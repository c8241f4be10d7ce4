"""License scans by a positional rare-token index, in SQL functions only.

A posting table names, for each template's words of highest inverse document frequency, counted over
all texts, the templates that have the word and its place there. A text's words are looked up in it;
each posting gives a place where its template would begin. Where two or more postings agree on one,
the words there are compared with the template's, and the label stands if enough are the same and the
text has the template's key phrase, which is looked up by its first word.

Null text counts as empty: no words, no labels, score 0. Rows are answered one by one, repeated
rows and clashing column names included; only ``keep`` columns pass through. An empty table gives no
rows. Very long texts are looked up whole. Places that tie all count; of equal frequencies the word
that comes first in the alphabet is rarer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.plan import quoted

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose words, one after another, give a label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, words of the usual notice, key phrase that must be in the text.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("cc", "this work is licensed under a creative commons attribution license", "creative commons"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("mit", "released under the mit license", "mit license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)
RARE = 4
LEAST = 0.7
#: Columns that ``scan`` adds.
MADE = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATOR), lambda w: w != "")


def _array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def document_frequencies(tokens: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows of the column ``words`` each of the vocabulary's words stands."""
    held = tokens.select(F.explode(F.expr(f"array_intersect({_array(vocabulary)}, words)")).alias("word"))
    return {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def rare_words(seen: dict[str, int]) -> list[list[tuple[str, int]]]:
    """Each template's RARE words of highest inverse document frequency, as (word, place)."""
    out = []
    for _, notice, _ in TEMPLATES:
        split = notice.split()
        first = {w: i for i, w in reversed(list(enumerate(split)))}
        out.append(sorted(((w, i) for w, i in first.items() if split.count(w) == 1), key=lambda x: (seen.get(x[0], 0), x[0]))[:RARE])
    return out


def _templates() -> str:
    """SQL for the templates' labels and words, in order."""
    return "array(" + ", ".join(f"named_struct('label', '{label}', 'words', {_array(notice.split())})" for label, notice, _ in TEMPLATES) + ")"


def _postings(entries: dict[str, list[str]]) -> str:
    """SQL for a map from words to arrays of what stands under them."""
    return "map(" + ", ".join(f"'{w}', array({', '.join(found)})" for w, found in sorted(entries.items())) + ")"


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` with n_words, n_base, first_word, last_word, base_labels, labels and score; made columns take the place of kept ones."""
    keep = [c for c in keep if c.lower() not in MADE]
    held = [f"_k{i}" for i in range(len(keep))]
    tokens = docs.select(*(F.col(quoted(c)).alias(k) for c, k in zip(keep, held, strict=True)), words(F.col(quoted(text_col))).alias("words"))
    vocabulary = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
    rare = rare_words(document_frequencies(tokens, vocabulary))
    # word -> (template, place of the word in it), for the words of highest inverse document frequency
    index: dict[str, list[str]] = {}
    for t, found in enumerate(rare):
        for w, i in found:
            index.setdefault(w, []).append(f"named_struct('t', {t}, 'i', {i})")
    # first word -> phrases: base ones by their label, key phrases by their template
    phrases: dict[str, list[str]] = {}
    for phrase, t, label in [*((p, -1, label) for p, label in BASE.items()), *((key, t, "") for t, (_, _, key) in enumerate(TEMPLATES))]:
        phrases.setdefault(phrase.split()[0], []).append(f"named_struct('t', {t}, 'label', '{label}', 'words', {_array(phrase.split())})")
    marks = f"""CASE WHEN arrays_overlap(words, {_array(sorted({*index, *(p.split()[-1] for p in BASE)}))})
      THEN filter(transform(words, (w, i) -> struct(w AS w, i AS i)), x -> array_contains({_array(sorted({*index, *phrases}))}, x.w)) ELSE array() END"""
    looked_up = f"""flatten(transform(filter(marks, x -> array_contains({_array(sorted(phrases))}, x.w)),
      x -> transform(filter(element_at({_postings(phrases)}, x.w), p -> slice(words, x.i + 1, size(p.words)) = p.words), p -> struct(p.t AS t, p.label AS label, x.i AS i))))"""
    begins = f"""array_sort(flatten(transform(filter(marks, x -> array_contains({_array(sorted(index))}, x.w)),
      x -> transform(element_at({_postings(index)}, x.w), p -> struct(p.t AS t, x.i - p.i AS s)))))"""
    # a begin named twice stands beside itself once sorted; one of each run is kept, where the key phrase is there
    agreed = "filter(begins, (b, k) -> b = get(begins, k + 1) AND NOT coalesce(b = get(begins, k - 1), false) AND array_contains(keys, b.t))"
    hits = f"""filter(transform(transform({agreed}, b -> struct(element_at({_templates()}, b.t + 1) AS m, b.s AS s)),
      b -> struct(b.m.label AS label, size(filter(b.m.words, (w, i) -> b.s + i >= 0 AND get(words, b.s + i) = w)) / CAST(size(b.m.words) AS DOUBLE) AS share)), h -> h.share >= {LEAST}D)"""
    steps = (
        ("marks", marks),
        ("phrases", looked_up),
        ("base", "filter(phrases, p -> p.t < 0)"),
        ("keys", "array_distinct(transform(filter(phrases, p -> p.t >= 0), p -> p.t))"),
        ("begins", f"CASE WHEN size(keys) > 0 THEN {begins} ELSE array() END"),
        ("hits", hits),
    )
    found = tokens
    for name, sql in steps:
        found = found.withColumn(name, F.expr(sql))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base = F.expr("transform(base, p -> p.label)")
    return found.select(
        *(F.col(k).alias(c) for c, k in zip(keep, held, strict=True)),
        F.size("words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.expr("array_min(transform(base, p -> p.i))").cast("long").alias("first_word"),
        F.expr("array_max(transform(base, p -> p.i))").cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.expr("transform(hits, h -> h.label)"))).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.expr("array_max(transform(hits, h -> h.share))"), F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same answer from joins of all word places with the templates'."""
    quote = lambda x: "'" + x + "'"
    base = " UNION ALL ".join(f"SELECT {quote(p)} AS phrase, {quote(b)} AS label" for p, b in BASE.items())
    notices = " UNION ALL ".join(f"SELECT {k} AS t, {quote(a)} AS label, {quote(n)} AS notice, {quote(p)} AS key" for k, (a, n, p) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF w <> ''] AS ws FROM documents),
m AS (SELECT * FROM ({notices})),
b AS (SELECT * FROM ({base})),
tw AS (SELECT t, i, string_split(notice, ' ')[i] AS w FROM m, (SELECT unnest(range(1, 40)) AS i) WHERE i <= len(string_split(notice, ' '))),
df AS (SELECT w, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(list_distinct(ws)) AS w FROM d) WHERE w IN (SELECT w FROM tw) GROUP BY w),
one AS (SELECT t, w, min(i) AS i FROM tw GROUP BY t, w HAVING count(*) = 1),
rare AS (SELECT t, w, i FROM one LEFT JOIN df USING (w) QUALIFY row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), w) <= {RARE}),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d WHERE list_has_any(ws, (SELECT list(DISTINCT w) FROM rare)) OR list_contains(ws, 'license')),
al AS (SELECT doc_id, t, p.i - rare.i AS s FROM p JOIN rare USING (w) GROUP BY ALL HAVING count(*) >= 2),
sh AS (SELECT doc_id, t, s, count(*) AS n FROM al JOIN tw USING (t) JOIN p USING (doc_id) WHERE p.i = s + tw.i AND p.w = tw.w GROUP BY ALL),
best AS (SELECT doc_id, t, m.label, max(n) / len(string_split(notice, ' '))::DOUBLE AS share FROM sh JOIN m USING (t) JOIN d USING (doc_id)
  WHERE contains(' ' || list_aggregate(ws, 'string_agg', ' ') || ' ', ' ' || key || ' ') GROUP BY doc_id, t, m.label, notice HAVING share >= {LEAST}),
bp AS (SELECT doc_id, label, p.i - 1 AS i FROM p JOIN d USING (doc_id) JOIN b ON list_aggregate(list_slice(ws, p.i, p.i + len(string_split(phrase, ' ')) - 1), 'string_agg', ' ') = phrase),
ba AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bp GROUP BY doc_id),
la AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM bp UNION ALL SELECT doc_id, label FROM best) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce((SELECT max(share) FROM best WHERE best.doc_id = d.doc_id), 0.0::DOUBLE)) AS score
FROM d LEFT JOIN ba USING (doc_id) LEFT JOIN la USING (doc_id)"""
