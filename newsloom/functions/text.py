"""Text functions as column expressions; Arrow UDFs only for Unicode forms and entity decoding.

Lengths and cuts count code points. White space is a browser's (``fixed.SPACE``).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from newsloom.functions.fixed import SPACE, STOP_WORDS, SYNTHESIS_STOP_WORDS, TRAILING_WORDS, java

S = f"[{SPACE}]"


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), made)[0]


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{S}+|{S}+$", "")


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"{S}+", " "))


def words(text: Column) -> Column:
    return F.split(text, f"{S}+")


def compact_text(line: Column, limit: int = 900) -> Column:
    """Links as their labels, white space collapsed, cut."""
    return F.substring(collapse(F.regexp_replace(line, rf"\[([^\]]+)\]\(https://[^){SPACE}]+\)", "$1")), 1, limit)


def first_sentence(text: Column) -> Column:
    """What comes before the first full stop, question or exclamation mark that ends a word."""
    return trim(F.split(text, f"[.!?](?:{S}|$)", 2)[0])


def _without_activity(text: Column) -> Column:
    return F.regexp_replace(text, java(r"\s*\(Activity:\s*\d+\).*$"), "")


def _after_separator(text: Column) -> Column:
    """What follows a spaced colon, unless the text begins with it."""
    return F.when(text.rlike(f"(?s)^.+?{S}+:{S}+"), F.regexp_replace(text, f"(?s)^.+?{S}+:{S}+", "")).otherwise(text)


def candidate_title(text: Column) -> Column:
    """A headline of at most 14 words from a block's first sentence or clause."""
    return let(let(_without_activity(text), _opening), _headline)


def _opening(text: Column) -> Column:
    sentence = F.split(_after_separator(text), f"[.!?](?:{S}|$)", 2)[0]
    return trim(F.regexp_replace(sentence, f"{S}+([,.;:!?])", "$1"))


def _headline(sentence: Column) -> Column:
    head = F.regexp_extract(sentence, java(rf"(?s)^(.*?)(?:,(?=\s)|\s+(?:where|which|while|powering|reporting|described as|less for|sharing a story)\s+)"), 1)
    clause = let(head, lambda h: F.when(F.length(h) >= 16, h).otherwise(sentence))
    short = F.array_join(F.slice(words(clause), 1, 14), " ")
    # up to eleven last words may go, as three always stay
    bare = F.regexp_replace(short, rf"(?i)^((?:[^ ]+ ){{2}}[^ ]+(?: [^ ]+)*?)(?: (?:{'|'.join(TRAILING_WORDS)}))+$", "$1")
    return F.coalesce(F.nullif(F.regexp_replace(bare, "[,:;]+$", ""), F.lit("")), F.lit("AI update"))


def candidate_summary(text: Column) -> Column:
    clean = trim(_without_activity(text))
    evidence = let(clean, lambda whole: let(trim(_after_separator(whole)), lambda after: F.when(after != "", after).otherwise(whole)))
    return let(words(evidence), lambda found: let(_ended(F.array_join(F.slice(found, 1, 45), " ")), lambda short: F.when(short == "", F.lit("AI update")).otherwise(F.concat(short, F.when(F.size(found) > 45, "…").otherwise("")))))


def _ended(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"{S}+([,.;:!?])", "$1"), "[,:;]+$", "")


def concise_lead(summary: Column, fallback: Column) -> Column:
    """The text before a colon, or the first sentence, of at most 12 words."""
    colon = F.regexp_extract(summary, rf"^([^\n\r\u2028\u2029]{{6,140}}?):{S}+", 1)
    lead = trim(F.when(colon != "", colon).otherwise(F.split(summary, f"[.!?](?:{S}|$)", 2)[0]))
    lead = F.when(lead != "", lead).otherwise(fallback)
    return F.regexp_replace(F.array_join(F.slice(words(lead), 1, 12), " "), "[,:;]+$", "")


def strip_tags(text: Column) -> Column:
    return collapse(F.regexp_replace(text, "<[^>]*>", " "))


@F.pandas_udf(StringType())
def _nfkd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def normalized(text: Column) -> Column:
    """Lower case, compatibility forms taken apart, all but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(_nfkd(F.lower(text)), "[^a-z0-9]+", " "))


_NAMED_ONCE = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_NAMED = _NAMED_ONCE | {"nbsp": " "}


def _character(number: int, whole: str) -> str:
    return chr(number) if number <= 0x10FFFF and not 0xD800 <= number <= 0xDFFF else whole


def _decode(text: str | None, named: dict[str, str], flags: int) -> str | None:
    """Hexadecimal, then decimal, then named references, each kind in one pass."""
    if text is None or "&" not in text:
        return text
    text = re.sub("&#x([0-9a-f]+);", lambda m: _character(int(m[1], 16), m[0]), text, flags=re.I)
    text = re.sub("&#([0-9]+);", lambda m: _character(int(m[1]), m[0]), text)
    return re.sub(f"&({'|'.join(named)});", lambda m: named[m[1].lower()], text, flags=flags)


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """References decoded; names in any case, a no-break space as a space."""
    return text.map(lambda t: _decode(t, _NAMED, re.I))


@F.pandas_udf(StringType())
def decode_entities_once(text: pd.Series) -> pd.Series:
    """References decoded; the five names of XML in lower case."""
    return text.map(lambda t: _decode(t, _NAMED_ONCE, 0))


def _visible(markup: Column) -> Column:
    for element in ("script", "style"):
        markup = F.regexp_replace(markup, rf"(?is)<{element}(?![A-Za-z0-9_]).*?</{element}>", " ")
    return F.regexp_replace(markup, "<[^>]*>", " ")


def plain_text(markup: Column) -> Column:
    """Text of markup without scripts, styles and tags."""
    return collapse(decode_entities(_visible(markup)))


def element(markup: Column, name: str) -> Column:
    """Body of the first element of that name, character data unwrapped; '' without one."""
    body = F.regexp_extract(markup, rf"(?is)<{name}(?:{S}[^>]*)?>(.*?)</{name}>", 1)
    return trim(F.regexp_replace(body, r"(?is)^<!\[CDATA\[(.*)\]\]>$", "$1"))


def elements(markup: Column, name: str) -> Column:
    """Bodies of all elements of that name."""
    return F.regexp_extract_all(markup, F.lit(rf"(?is)<{name}(?:{S}[^>]*)?>(.*?)</{name}>"), F.lit(1))


def token_set(title: Column) -> Column:
    """Distinct words of two or more letters or digits that are no stop words."""
    found = F.split(F.regexp_replace(F.lower(plain_text(title)), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS)))


def distinctive_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized(text), " "), lambda w: (F.length(w) > 2) & ~w.isin(SYNTHESIS_STOP_WORDS)))


def _key(tokens: Column, pattern: str) -> Column:
    """The first token that fits, with the one before it."""
    at = F.array_position(F.transform(tokens, lambda t: t.rlike(pattern)), True)
    return F.when(at > 0, F.array_join(F.slice(tokens, F.greatest(at - 1, F.lit(1)).cast("int"), F.least(at, F.lit(2)).cast("int")), ":"))


def product_key(title: Column) -> Column:
    """Name and version by the wide rule: any token with a digit."""
    return _key(F.split(F.trim(F.regexp_replace(_nfkd(F.lower(title)), "[^a-z0-9.]+", " ")), " +"), "[0-9]")


def product_key_strict(title: Column) -> Column:
    """Name and version by the narrow rule: v1.2, 1.2 or letters with digits."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(plain_text(title)), "[^a-z0-9.]+", " ")), " +")
    return _key(tokens, r"^(?:v[0-9]+(?:\.[0-9]+)*|[0-9]+\.[0-9]+(?:\.[0-9]+)*|(?=[a-z0-9]*[a-z])(?=[a-z0-9]*[0-9])[a-z0-9]+)$")


def title_from_slug(url: Column) -> Column:
    """The last path segment as a title; short names of the field in capitals."""
    slug = F.element_at(F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda s: s != ""), -1)
    spaced = F.regexp_replace(F.coalesce(slug, F.lit("")), "-", " ")
    made = F.transform(F.split(spaced, " "), lambda w: F.when(w.rlike("(?i)^(?:ai|api|mcp|gpt|llm)$"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))))
    return trim(F.array_join(made, " "))


def clean_location(value: Column) -> Column:
    return F.substring(F.nullif(trim(value), F.lit("")), 1, 120)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def base64url(text: Column) -> Column:
    return F.rtrim(F.translate(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "[\r\n]", ""), "+/", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.decode(F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))), "UTF-8")


def is_plain(text: Column) -> Column:
    """Not blank and without tags."""
    return F.coalesce((trim(text) != "") & ~text.rlike("(?i)</?[a-z][^>]*>"), F.lit(False))


def anchors_to_markdown(markup: str) -> tuple[str, list[tuple[str, str]]]:
    """Markup as text whose https links read [label](url), with the links in order."""
    if not re.search(r"<a(?![A-Za-z0-9_])", markup, re.I):
        markup = _decode(markup, _NAMED_ONCE, 0)
    links: list[tuple[str, str]] = []
    bare = lambda t: re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", t)).strip()

    def rewrite(m: re.Match) -> str:
        url = _decode(m["url"].strip(), _NAMED_ONCE, 0)
        if not re.fullmatch(r"https://\S+", url, re.I):
            return bare(m["label"])
        links.append((bare(_decode(m["label"], _NAMED_ONCE, 0)) or "Read story", url))
        return f"[{links[-1][0]}]({url})"

    text = re.sub(r"""<a(?![A-Za-z0-9_])[^>]*?\bhref\s*=\s*(?P<q>["'])(?P<url>.*?)(?P=q)[^>]*>(?P<label>.*?)</a>""", rewrite, markup, flags=re.I | re.S)
    text = re.sub(r"</?(?:p|div|h[1-6]|li|br|tr|blockquote)[^>]*>", "\n", text, flags=re.I)
    text = re.sub(r"[ \t]{2,}", " ", re.sub(r"\n\s*\n+", "\n", re.sub("<[^>]*>", " ", text))).strip()
    return _decode(text, _NAMED_ONCE, 0)[:180_000], links


_ANCHOR = StructType().add("label", StringType()).add("url", StringType())
_MARKDOWN = StructType().add("markdown", StringType()).add("anchors", ArrayType(_ANCHOR))


@F.pandas_udf(_MARKDOWN)
def markdown_and_anchors(markup: pd.Series) -> pd.DataFrame:
    made = [anchors_to_markdown(m) if m is not None else (None, []) for m in markup]
    return pd.DataFrame({"markdown": [m[0] for m in made], "anchors": [[{"label": a, "url": b} for a, b in m[1]] for m in made]})
