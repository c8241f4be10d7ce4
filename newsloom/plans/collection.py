"""Collection of supplemental sources: feeds, the pages they name, candidates, health and the shadow run.

A collection is a row with a base feed and the feeds of three sources; any number of them are worked
off as one plan. What can't be fetched or parsed is a message in its source's health and ends nothing
but that source: no error leaves its row. Documents come through ``fetch``, a function from a frame of
URLs to (url, body, error): ``fetch.fetched`` for the network, ``fetch.archived`` for a table of pages.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import selection
from newsloom.operators.held import held
from newsloom.plans import edition as flow
from newsloom.sources import feeds

# The sources, how each is read, and the wording of an empty feed.
SOURCES = (("tldr-ai", "TLDR AI", "discovery"), ("alphasignal", "AlphaSignal", "discovery"), ("cloudflare-agents", "Cloudflare Agents", "primary"))
NO_ISSUE = "TLDR feed contains no current issue"
TOP = 5

Fetch = Callable[[DataFrame], DataFrame]
CANDIDATE = ["run_id", "source_id", "place", "title", "summary", "url", "published_at", "category", "category_label", "score", "exceptional", "attributions"]


@dataclass
class Collected:
    """Candidates of all sources, a health row for each source, and the base issue's stories."""

    candidates: DataFrame
    health: DataFrame
    base: DataFrame
    issues: DataFrame


def _fetched(rows: DataFrame, url: str, fetch: Fetch) -> DataFrame:
    """``rows`` with body and error of the document at ``url``, fetched once for all rows that name it."""
    got = held(fetch(rows.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct()))
    return rows.join(got.select(F.col("url").alias(url), "body", F.col("error").alias("fetch_error")), url, "left")


def _issues(found: DataFrame, fetch: Fetch, profile: dict) -> tuple[DataFrame, DataFrame]:
    """The first item of each feed, its page's articles, and facts for health."""
    source = SOURCES[0]
    items = feeds.feed_items(found.select("run_id", "body"), "run_id")
    first = items.groupBy("run_id").agg(F.min_by(F.struct(F.col("url").alias("issue"), "published_at"), "place").alias("item"))
    rows = found.select("run_id", F.col("fetch_error").alias("feed_error")).join(first, "run_id", "left").select("run_id", "feed_error", "item.issue", "item.published_at")
    pages = held(_fetched(rows, "issue", fetch))
    made = feeds.issue_articles(pages.where("body IS NOT NULL").select("run_id", F.col("issue").alias("url"), "published_at", "body"), profile, *source[:2], keep=["run_id"])
    candidates = made.withColumn("source_id", F.lit(source[0])).select(CANDIDATE)
    error = F.coalesce("feed_error", F.when(F.col("issue").isNull(), NO_ISSUE), "fetch_error")
    facts = pages.select("run_id", F.lit(source[0]).alias("source_id"), F.when(F.col("issue").isNull(), 1).otherwise(2).alias("requests"), F.when(F.col("issue").isNull(), 0).otherwise(1).alias("fetched_items"), error.alias("stopped"), F.array().cast("array<string>").alias("errors"))
    return candidates, facts


def _sitemap(found: DataFrame, as_of: Column, fetch: Fetch, profile: dict) -> tuple[DataFrame, DataFrame]:
    """The best entries of each sitemap's last day with their pages' fields; one whose page can't be had keeps its own."""
    source = SOURCES[1]
    items = feeds.sitemap_items(found.select("run_id", "body"), as_of, "run_id").drop("summary", "rank")
    best = held(_fetched(feeds.best_entries(items, profile, "run_id", TOP), "url", fetch))
    # entries that failed are an error each and stay as they were named
    rows = feeds.enriched_entries(best, best.where("body IS NOT NULL").select("url", "body").distinct(), profile, *source[:2], key="run_id")
    candidates = rows.withColumn("source_id", F.lit(source[0])).select(CANDIDATE)
    seen = items.groupBy("run_id").agg(F.count("*").alias("fetched_items"))
    failed = best.groupBy("run_id").agg(F.count("*").alias("asked"), F.array_sort(F.collect_list("fetch_error")).alias("errors"))
    facts = found.select("run_id", F.col("fetch_error").alias("stopped")).join(seen, "run_id", "left").join(failed, "run_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    return candidates, facts.select("run_id", F.lit(source[0]).alias("source_id"), (zero("asked") + 1).alias("requests"), zero("fetched_items").alias("fetched_items"), "stopped", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def _primary(found: DataFrame, as_of: Column, profile: dict) -> tuple[DataFrame, DataFrame]:
    """The last three days of each primary feed."""
    source = SOURCES[2]
    rows = feeds.recent_items(found.select("run_id", "body"), as_of, profile, *source[:2], key="run_id")
    candidates = rows.withColumn("source_id", F.lit(source[0])).select(CANDIDATE)
    size = F.coalesce(F.size(text.elements(F.col("body"), "item")), F.lit(0))
    facts = found.select("run_id", F.lit(source[0]).alias("source_id"), F.lit(1).alias("requests"), F.when(F.col("body").isNull(), 0).otherwise(size).alias("fetched_items"), F.col("fetch_error").alias("stopped"), F.array().cast("array<string>").alias("errors"))
    return candidates, facts


def health(facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(run_id, source_id, status, requests, fetched_items, accepted, errors): failed where a source stopped or, but for a primary one,
    accepted nothing; degraded where single items failed."""
    seen = candidates.groupBy("run_id", "source_id").agg(F.count("*").alias("accepted"))
    rows = facts.join(seen, ["run_id", "source_id"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    primary = F.col("source_id").isin(*(s[0] for s in SOURCES if s[2] == "primary"))
    status = F.when(F.col("stopped").isNotNull() | (~primary & (F.col("accepted") == 0)), "failed").when(F.size("errors") > 0, "degraded").otherwise("healthy")
    errors = F.concat("errors", F.array_compact(F.array("stopped")))
    return rows.select("run_id", "source_id", status.alias("status"), "requests", "fetched_items", "accepted", errors.alias("errors"))


def collect(runs: DataFrame, fetch: Fetch, profile: dict, as_of: Column) -> Collected:
    """``runs`` has run_id, base_url and feeds (a map from source_id to its feed's URL). A source without feed stops as one not found."""
    wanted = runs.select("run_id", F.explode(F.array(*(F.struct(F.lit(s[0]).alias("source_id"), F.element_at("feeds", s[0]).alias("feed")) for s in SOURCES))).alias("s")).select("run_id", "s.source_id", "s.feed")
    got = held(_fetched(wanted, "feed", fetch).withColumn("fetch_error", F.when(F.col("feed").isNull(), "no feed is named").otherwise(F.col("fetch_error"))))
    own = lambda n: got.where(F.col("source_id") == SOURCES[n][0])
    made = [_issues(own(0), fetch, profile), _sitemap(own(1), as_of, fetch, profile), _primary(own(2), as_of, profile)]
    candidates = held(functools.reduce(DataFrame.unionByName, (m[0] for m in made)))
    facts = functools.reduce(DataFrame.unionByName, (m[1] for m in made))
    base = _fetched(runs.select("run_id", "base_url"), "base_url", fetch)
    issues = held(feeds.latest_issue(base.select("run_id", "body", "fetch_error"), "run_id").join(base.select("run_id", "fetch_error"), "run_id").withColumn("error", F.coalesce("fetch_error", "error")).drop("fetch_error"))
    stories = flow.inventory_of(issues.where("error IS NULL"), profile, "run_id")
    stories = stories.select("run_id", F.col("candidate_id").alias("id"), "title", F.element_at("sources", 1)["url"].alias("url"))
    return Collected(candidates, held(health(facts, candidates)), held(stories), issues)


def shadow_runs(runs: DataFrame, fetch: Fetch, profile: dict, as_of: Column) -> DataFrame:
    """(run_id, status, error, base_url, candidates, after_deduplication, overlaps, would_add, sources): one row for each collection.

    A collection whose base issue can't be had is failed with its error; else its status follows its sources' health.
    """
    got = collect(runs, fetch, profile, as_of)
    order = F.array_position(F.array(*(F.lit(s[0]) for s in SOURCES)), F.col("source_id"))
    placed = got.candidates.withColumn("place", (order * 1_000_000 + F.col("place")).cast("long")).withColumnRenamed("run_id", "report_id")
    report = selection.shadow_reports(placed, got.base.withColumnRenamed("run_id", "report_id"))
    status = selection.source_status(got.health, "run_id")
    sources = got.health.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("source_id", "status", "requests", "fetched_items", "accepted", "errors"))).alias("sources"))
    rows = runs.select("run_id", "base_url").join(got.issues.select("run_id", "error"), "run_id", "left").join(status, "run_id", "left").join(sources, "run_id", "left").join(report.withColumnRenamed("report_id", "run_id"), "run_id", "left")
    bad = F.col("error").isNotNull()
    count = lambda c: F.when(~bad, F.coalesce(F.col(c), F.lit(0))).alias(c)
    added = F.when(~bad, F.coalesce("would_add", F.array().cast("array<string>"))).alias("would_add")
    return rows.select("run_id", F.when(bad, "failed").otherwise(F.col("status")).alias("status"), "error", "base_url", count("candidates"), count("after_deduplication"), count("overlaps"), added, "sources")
