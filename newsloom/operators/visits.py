"""Visits: one entry for each visitor and day, counts, places and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import trim

RETENTION_DAYS = 30


def first_per_day(visits: DataFrame) -> DataFrame:
    """The earliest entry of each visitor and day (ties: least id)."""
    order = Window.partitionBy("visitor_key", "visit_day").orderBy("visited_at", "id")
    return visits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def totals(visits: DataFrame, today: Column) -> DataFrame:
    """Entries and distinct visitors, in all and today, in one pass."""
    now = F.col("visit_day") == today
    return visits.agg(
        F.count("*").alias("total_entries"), F.count_distinct("visitor_key").alias("unique_visitors"),
        F.count_if(now).alias("today_entries"), F.count_distinct(F.when(now, F.col("visitor_key"))).alias("today_unique"),
    )


def by_location(visits: DataFrame, top: int = 30) -> DataFrame:
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown")).alias(c)
    found = visits.groupBy(known("country"), known("region")).agg(F.count_distinct("visitor_key").alias("unique_visitors"))
    return found.orderBy(F.col("unique_visitors").desc(), "country", "region").limit(top)


def recent(visits: DataFrame, limit: float | str | None = 50) -> DataFrame:
    """The latest entries; the limit is put between 1 and 100, and 50 if it is no number."""
    try:
        n = int(max(1, min(100, float(limit) // 1)))
    except (TypeError, ValueError):
        n = 50
    return visits.orderBy(F.col("visited_at").desc(), F.col("id")).limit(n)


def retained(visits: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return visits.where(F.col("visited_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def recorded(old: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Old and new entries, first per visitor and day with old ones first, within the retention."""
    both = old.withColumn("_late", F.lit(0)).unionByName(new.withColumn("_late", F.lit(1)))
    order = Window.partitionBy("visitor_key", "visit_day").orderBy("_late", "visited_at", "id")
    return retained(both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_late"), as_of)


def summary(visits: DataFrame, today: Column, as_of: Column, limit: float | str | None = 50, top: int = 30) -> DataFrame:
    """One row: what is within the retention counted, its latest entries and its places with most visitors.

    Entries beyond the retention are left out of everything, as if deleted first.
    """
    kept = retained(visits, as_of)
    latest = recent(kept, limit).agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("visited_at").cast("timestamp"))).alias("at"), "id"))).alias("r"))
    places = by_location(kept, top).agg(F.array_sort(F.collect_list(F.struct((-F.col("unique_visitors")).alias("n"), "country", "region"))).alias("p"))
    visit_ids = latest.select(F.transform("r", lambda x: x["id"]).alias("visit_ids"))
    locations = places.select(F.transform("p", lambda x: F.struct(x["country"].alias("country"), x["region"].alias("region"), (-x["n"]).alias("unique_visitors"))).alias("locations"))
    one = lambda frame: frame.withColumn("_row", F.lit(1))  # noqa: E731  each has one row
    return one(totals(kept, today)).join(one(visit_ids), "_row").join(one(locations), "_row").drop("_row")


def tracked(method: Column, path: Column, accept: Column) -> Column:
    """Whether a request is for a page that counts."""
    return (method == "GET") & path.isin("/", "/history", "/history/") & (accept.isNull() | accept.contains("text/html"))


def visitor_cookie(header: Column, name: str) -> Column:
    """The first cookie of that name if its value is well formed, else null."""
    values = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ";"), lambda p: F.split(p, "=", 2)), lambda p: (F.size(p) == 2) & (trim(p[0]) == name))
    value = F.try_url_decode(trim(F.get(F.get(values, F.lit(0)), F.lit(1))))
    return F.when(value.rlike("^[A-Za-z0-9_-]{20,80}$"), value)


def location_label(*parts: Column) -> Column:
    joined = F.concat_ws(", ", *(F.nullif(p, F.lit("")) for p in parts))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("Unknown"))
