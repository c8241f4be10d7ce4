"""As-of joins: each row with the latest version that was in force at its time.

Both sides are put on one time line, sorted, and the last version is carried forward. The line is cut
into spans of time: within a span a window carries on; what a span begins with is the last version of
the spans before it, of which there is one small row for each. So neither a version that holds for
years nor a key with a third of all rows makes one long task, and no pair is made to be thrown away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, versions: DataFrame, time: str, since: str, order: str, by: list[str] | None = None, span: str = "day") -> DataFrame:
    """``rows`` with ``version``, a struct of the version's columns (null before the first).

    A version holds from ``since`` (its own moment too) until the next of its key ``by``; of versions of one moment
    the greatest ``order`` holds. ``span`` is the unit that cuts the line (day, hour, month). Null keys are a key as any; rows without a time have no version, versions without one none.
    """
    by = by or []
    on = [F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]
    keys = [f"_by{i}" for i in range(len(by))]
    at = lambda c: F.col(c).cast("timestamp_ntz")
    own = F.struct(*versions.columns)
    changes = versions.where(F.col(since).isNotNull()).select(*on, at(since).alias("_at"), F.lit(0).alias("_late"), F.col(order).alias("_order"), own.alias("_version"))
    changes = changes.withColumn("_span", F.date_trunc(span, "_at"))
    asked = rows.where(F.col(time).isNotNull()).select(*on, at(time).alias("_at"), F.lit(1).alias("_late"), F.struct(*rows.columns).alias("_row"))
    asked = asked.withColumn("_span", F.date_trunc(span, "_at"))
    last = changes.groupBy(*keys, "_span").agg(F.max_by("_version", F.struct("_at", "_order")).alias("_last"))
    spans = asked.select(*keys, "_span").distinct().unionByName(last, allowMissingColumns=True).groupBy(*keys, "_span").agg(F.max_by("_last", F.col("_last").isNotNull()).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, "_span", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    line = asked.unionByName(changes, allowMissingColumns=True)
    along = Window.partitionBy(*keys, "_span").orderBy("_at", "_late", "_order").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("_held", F.last("_version", ignorenulls=True).over(along)).where("_late = 1")
    match = F.lit(True)
    for k in [*keys, "_span"]:
        match &= F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}"))
    joined = line.alias("l").join(carried.alias("c"), match, "left").select("l._row.*", F.coalesce("l._held", "c._carried").alias("version"))
    return joined.unionByName(rows.where(F.col(time).isNull()), allowMissingColumns=True)


def profile_for(editions: DataFrame, profiles: DataFrame, published: str = "published_at", created: str = "created_at") -> DataFrame:
    """Editions with the profile (``version``) that they were made under: their own, if they hold one, else that of their time."""
    found = as_of(editions, profiles, published, created, "version")
    return found.withColumn("profile_json", F.coalesce("profile_json", F.col("version.profile_json"))) if "profile_json" in editions.columns else found
