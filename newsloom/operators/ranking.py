"""Personal ranking: scores, reasons and explanations under a profile, and viewer overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.fixed import WEIGHT_LABELS
from newsloom.operators.scoring import permission_design


def weight_rows(spark, profile: dict) -> DataFrame:
    """The profile's weights; a handful of rows, so joins with them broadcast them."""
    return spark.createDataFrame([(w["id"], w["label"], w["value"], w["label"] in profile["pinnedCategories"]) for w in profile["weights"]], "category string, weight_label string, weight int, pinned boolean")


def _with_weights(items: DataFrame, profile: dict) -> DataFrame:
    """Items (category, title, summary, base, exceptional, watch_permission, watch_geography) and what applies."""
    safe = profile["safeguards"]
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return items.join(F.broadcast(weight_rows(items.sparkSession, profile)), "category", "left").withColumns({
        "is_exceptional": flag("exceptional") & F.lit(profile["exceptionalStoryOverride"]),
        "is_permission": flag("watch_permission") & F.lit(safe["watchPermissions"]) & permission_design(text),
        "is_geography": flag("watch_geography") & F.lit(safe["watchGeography"]),
    })


def score(found: DataFrame) -> Column:
    return (
        F.coalesce("base", F.lit(0)) + F.coalesce("weight", F.lit(0)) * 10 + F.when(F.col("is_exceptional"), 45).otherwise(0)
        + F.when(F.col("is_permission"), 20).otherwise(0) + F.when(F.col("is_geography"), 20).otherwise(0)
    ).cast("long")


def ranked(items: DataFrame, profile: dict, issue: str, place: str) -> DataFrame:
    """Items with score and rank inside their issue; ties keep the order of ``place``."""
    found = _with_weights(items, profile)
    found = found.withColumn("score", score(found))
    order = Window.partitionBy(issue).orderBy(F.col("score").desc(), F.col(place))
    return found.withColumn("rank", F.row_number().over(order))


def tone(weight: Column) -> Column:
    return F.when(weight >= 3, "priority").when(weight <= 1, "background").otherwise("balanced")


def weight_label(weight: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, WEIGHT_LABELS)), weight), F.lit("Balanced"))


def strength_label(base: Column) -> Column:
    return F.when(base >= 80, "Strong editorial signal").when(base >= 60, "Useful editorial signal").otherwise("Supporting context")


def reason() -> Column:
    """struct(label, tone) of the first thing that applies; null for unknown categories."""
    pair = lambda label, tone_: F.struct(label.alias("label"), tone_.alias("tone"))
    return (
        F.when(F.col("is_exceptional"), pair(F.lit("Exceptional signal"), F.lit("exceptional")))
        .when(F.col("is_permission"), pair(F.lit("Watching · agent permission design"), F.lit("watched")))
        .when(F.col("is_geography"), pair(F.lit("Watching · AI cluster geography"), F.lit("watched")))
        .when(F.col("weight").isNull(), F.lit(None))
        .when(F.col("pinned"), pair(F.concat(F.lit("Pinned · "), "weight_label"), F.lit("pinned")))
        .otherwise(pair(F.concat("weight_label", F.lit(" · "), weight_label(F.col("weight"))), tone(F.col("weight"))))
    )


def explanation() -> Column:
    """All factors that apply, in order: array of struct(label, value, state, tone)."""
    factor = lambda when, *parts: F.when(when, F.struct(*(F.lit(p).alias(n) if isinstance(p, str) else p.alias(n) for n, p in zip(("label", "value", "state", "tone"), parts, strict=True))))
    known = F.col("weight").isNotNull()
    return F.array_compact(F.array(
        factor(F.col("is_exceptional"), "Editorial override", "Exceptional-story rule", "Applied", "exceptional"),
        factor(F.col("is_permission"), "Watched topic", "Agent permission design", "Applied", "watched"),
        factor(F.col("is_geography"), "Watched topic", "AI cluster geography", "Applied", "watched"),
        factor(known, "Category", F.col("weight_label"), weight_label(F.col("weight")), tone(F.col("weight"))),
        factor(known & F.col("pinned"), "Editorial marker", F.concat(F.lit("Pinned · "), "weight_label"), "Label only", "pinned"),
        factor(F.lit(True), "Editorial strength", strength_label(F.coalesce("base", F.lit(0))), "Underlying", "neutral"),
    ))


def explained(items: DataFrame, profile: dict) -> DataFrame:
    return _with_weights(items, profile).withColumn("reason", reason()).withColumn("factors", explanation())


def normalize_override(raw, profile: dict) -> dict | None:
    """The members of an override that differ from the profile; null if any member is not allowed."""
    is_int = lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer()
    known = {w["id"]: w["value"] for w in profile.get("weights") or []}
    allowed = {"version", "storyBudget", "weights", "exceptionalStoryOverride", "safeguards"}
    if not isinstance(raw, dict) or not is_int(raw.get("version")) or raw["version"] != 1 or set(raw) - allowed or not known:
        return None
    bounds = profile.get("storyBudgetRange") or [5, 14]
    budget, weights, override, safe = (raw.get(k) for k in ("storyBudget", "weights", "exceptionalStoryOverride", "safeguards"))
    legal = [
        "storyBudget" not in raw or is_int(budget) and max(5, bounds[0]) <= budget <= min(14, bounds[1]),
        "weights" not in raw or isinstance(weights, dict) and all(k in known and is_int(v) and 0 <= v <= 4 for k, v in weights.items()),
        "exceptionalStoryOverride" not in raw or isinstance(override, bool),
        "safeguards" not in raw or isinstance(safe, dict) and set(safe) <= set(profile["safeguards"]) and all(isinstance(v, bool) for v in safe.values()),
    ]
    if not all(legal):
        return None
    changed = {
        "storyBudget": budget if "storyBudget" in raw and budget != profile["storyBudget"] else None,
        "weights": {k: v for k, v in (weights or {}).items() if v != known[k]} or None,
        "exceptionalStoryOverride": override if "exceptionalStoryOverride" in raw and override != profile["exceptionalStoryOverride"] else None,
        "safeguards": {k: v for k, v in (safe or {}).items() if v != profile["safeguards"][k]} or None,
    }
    kept = {k: v for k, v in changed.items() if v is not None}
    return {"version": 1} | kept if kept else None


def merge_override(profile: dict, override) -> dict:
    found = normalize_override(override, profile) or {}
    plain = {k: v for k, v in found.items() if k in ("storyBudget", "exceptionalStoryOverride")}
    weights = [w | {"value": found.get("weights", {}).get(w["id"], w["value"])} for w in profile["weights"]]
    return profile | plain | {"weights": weights, "safeguards": profile["safeguards"] | found.get("safeguards", {})}


def create_override(profile: dict, candidate: dict) -> dict | None:
    raw = {k: candidate[k] for k in ("storyBudget", "exceptionalStoryOverride", "safeguards") if k in candidate}
    return normalize_override(raw | {"version": 1, "weights": {w["id"]: w["value"] for w in candidate.get("weights", [])}}, profile)


def merged_weights(weights: DataFrame, overrides: DataFrame) -> DataFrame:
    """Weights (viewer, category, value) where an override (viewer, category, value) stands, it wins."""
    return weights.join(overrides.withColumnRenamed("value", "own"), ["viewer", "category"], "left").select("viewer", "category", F.coalesce("own", "value").alias("value"))


def ranking_drivers(weights: DataFrame, items: DataFrame, top: int = 4) -> DataFrame:
    """The heaviest weights whose category occurs among the items."""
    return weights.join(items.select("category").distinct(), "category", "left_semi").orderBy(F.col("value").desc(), "place").limit(top)
