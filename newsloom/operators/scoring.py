"""Scores, categories and similarity as column expressions over a taxonomy given as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import fixed
from newsloom.functions.fixed import led


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(led(pattern)))


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(led(pattern)), F.lit(False))


def permission_design(text: Column) -> Column:
    """Whether any wording of permission design occurs: one alternation, one scan."""
    return has(text, "|".join(f"(?:{p})" for p in fixed.PERMISSION_DESIGN))


def block_score(text: Column, links: Column, profile: dict, terms: dict = fixed.CATEGORY_TERMS, extra: dict = fixed.SCORE_ONLY_TERMS, low: str = fixed.DEPRIORITIZED) -> Column:
    """Two for each of up to three links, four for each match times weight less two, less six for each low term."""
    score = F.least(links, F.lit(fixed.MAX_LINKS)) * 2
    for weight in profile["weights"]:
        factor = (weight["value"] - 2) * 4
        for pattern in (terms.get(weight["id"]), extra.get(weight["id"])):
            if pattern and factor and weight["id"] in terms:
                score = score + count_matches(text, pattern) * factor
    return (score - count_matches(text, low) * 6).cast("long")


def category(text: Column, profile: dict, terms: dict = fixed.CATEGORY_TERMS, priority: tuple = fixed.CATEGORY_PRIORITY, fallback: str = fixed.FALLBACK_CATEGORY) -> Column:
    """struct(id, label) of the best category; earlier ones win ties."""
    weights = {w["id"]: w for w in profile["weights"]}
    other = weights.get(fallback, profile["weights"][0])
    none = F.struct(F.lit(other["id"]).alias("id"), F.lit(other["label"]).alias("label"))
    names = [p for p in priority if p in weights and p in terms]
    if not names:
        return none
    # each pattern is counted once: what the counts are used for takes them as a lambda's variable
    counts = F.array(*(count_matches(text, terms[name]) for name in names))

    def option(k: int, name: str, n: Column) -> Column:
        bonus = weights[name]["value"] * 3 + 3 * (weights[name]["label"] in profile["pinnedCategories"])
        return F.when(n > 0, F.struct((n * 10 + bonus).alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("id"), F.lit(weights[name]["label"]).alias("label")))

    best = F.transform(F.array(counts), lambda c: F.array_max(F.array(*(option(k, name, c[k]) for k, name in enumerate(names)))))
    return F.transform(best, lambda x: F.when(x.isNotNull(), F.struct(x["id"].alias("id"), x["label"].alias("label"))).otherwise(none))[0]


def set_similarity(left: Column, right: Column) -> Column:
    """The greater of Jaccard and 0.9 times the overlap coefficient; 0 under three tokens."""
    both = F.size(F.array_intersect(left, right))
    least = F.least(F.size(left), F.size(right))
    jaccard = both / (F.size(left) + F.size(right) - both)
    return F.when(least < 3, 0.0).otherwise(F.greatest(jaccard, both / least * 0.9))


def overlap_coefficient(left: Column, right: Column) -> Column:
    least = F.least(F.size(left), F.size(right))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / least)


def repeated_phrase(left_text: Column, right_text: Column, left: Column, right: Column, least_words: int, least: float) -> Column:
    """Equal normalised texts, or enough distinctive words that overlap enough."""
    return (left_text == right_text) | ((F.least(F.size(left), F.size(right)) >= least_words) & (overlap_coefficient(left, right) >= least))


def positional_base(place: Column, top: int = 100, step: int = 4, floor: int = 48) -> Column:
    """``place`` from 0."""
    return F.greatest(F.lit(floor), F.lit(top) - place * step).cast("int")
