"""Queries over feeds, sitemaps, issue pages, links and what is made of candidates.

As in the catalogue, the driver tables stand in for the model: a conversation is a feed or an issue
page whose turns are its items, fifty documents are a sitemap, sixteen a report or an issue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import fixed, text, urls
from newsloom.operators import selection
from newsloom.plans.catalogue import _titles, query, table
from newsloom.sources import feeds

NOW = "TIMESTAMP_SECONDS(1717200000)"
HOUR = 3600


def _markup(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _joined(rows: DataFrame, key: str, place: str, part) -> DataFrame:
    """(key, body): the parts of each key in order of place as one text."""
    parts = F.array_sort(F.collect_list(F.struct(place, part.alias("part"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("body"))


# --- feeds ------------------------------------------------------------------------------------

#: Items of the feeds below: those without an https link or a date are no stories.
STORIES = """i AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS title FROM conversations),
s AS (SELECT conv_id, place, title, 'https://turns.example/' || conv_id || '/' || turn || CASE WHEN turn % 2 = 0 THEN '?page=1' ELSE '' END AS url,
  1717200000 - 3600 * (conv_id * 5 % 120 + turn) AS published, CASE WHEN turn % 2 = 1 THEN 'About turn ' || turn ELSE title END AS summary
  FROM i WHERE turn % 4 <> 3 AND (conv_id + turn) % 5 <> 4 AND title <> '')"""


def conversation_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, body): conversations as feeds, their turns as items with links and dates of several forms."""
    turn, conv = F.col("turn"), F.col("conv_id")
    link = F.when(turn % 2 == 0, F.concat(F.lit("https://Turns.Example/"), conv, F.lit("/"), turn, F.lit("/?utm_source=x&amp;page=1#top"))).when(
        turn % 4 == 3, F.concat(F.lit("http://turns.example/"), conv, F.lit("/"), turn)).otherwise(F.concat(F.lit("https://turns.example/"), conv, F.lit("/"), turn))
    # the date's parts are made by whole numbers, so that they are the same in every time zone
    seconds = F.lit(1717200000) - HOUR * (conv * 5 % 120 + turn)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    hour = F.lpad(F.floor(seconds % 86400 / HOUR).cast("string"), 2, "0")
    when = F.when((conv + turn) % 5 == 4, "soon").when(turn % 3 == 0, F.concat(F.date_format(day, "E, d MMM yyyy "), hour, F.lit(":00:00 GMT"))).otherwise(F.concat(day.cast("string"), F.lit("T"), hour, F.lit(":00:00Z")))
    about = F.when(turn % 2 == 1, F.concat(F.lit("<description><![CDATA[<p>About turn "), turn, F.lit("</p>]]></description>"))).otherwise("")
    item = F.concat(F.lit("<item><title>"), _markup(F.coalesce("text", F.lit(""))), F.lit("</title><link>"), link, F.lit("</link><pubDate>"), when, F.lit("</pubDate>"), about, F.lit("</item>"))
    return _joined(table(spark, sf_dir, "conversations"), "conv_id", "turn", item)


@query(f"WITH {STORIES} SELECT conv_id, place, title, url, published, summary FROM s")
def feed_stories(spark, sf_dir):
    """All items of all feeds that have a title, an https URL and a date."""
    found = feeds.feed_items(conversation_feeds(spark, sf_dir), "conv_id")
    return found.select("conv_id", F.col("place").cast("long").alias("place"), "title", "url", F.unix_seconds("published_at").alias("published"), "summary")


@query(f"WITH {STORIES} SELECT conv_id, place, title, url AS source_url, 'turns' AS source_id, 'primary' AS kind FROM s WHERE published >= 1717200000 - 3 * 86400")
def primary_stories(spark, sf_dir):
    """Items of the last three days as prepared candidates of a primary source, each attributed to its own URL."""
    found = feeds.recent_items(conversation_feeds(spark, sf_dir), F.expr(NOW), fixed.DEFAULT_PROFILE, "turns", "Turns", key="conv_id")
    return found.select("conv_id", F.col("place").cast("long").alias("place"), "title", F.inline("attributions")).select("conv_id", "place", "title", "source_url", "source_id", "kind")


@query("""WITH d AS (SELECT doc_id // 50 AS map_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS place, doc_id % 1000 AS part, doc_id * 7 % 48 AS age FROM documents)
SELECT map_id, 'AI Notes Part ' || part AS title, 'https://maps.example/p/ai-notes-part-' || part AS url, row_number() OVER (PARTITION BY map_id ORDER BY age, place) AS rank FROM d WHERE age <= 24""")
def sitemap_stories(spark, sf_dir):
    """Entries of the last day of each sitemap with titles from their slugs, latest first."""
    doc = F.col("doc_id")
    age = (doc * 7 % 48) * HOUR
    seconds = F.lit(1717200000) - age
    stamp = F.concat(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string"), F.lit("T"), F.lpad(F.floor(seconds % 86400 / HOUR).cast("string"), 2, "0"), F.lit(":00:00Z"))
    entry = F.concat(F.lit("<url><loc>https://maps.example/p/ai-notes-part-"), doc % 1000, F.lit("/</loc><lastmod>"), stamp, F.lit("</lastmod></url>"))
    maps = _joined(table(spark, sf_dir, "documents").withColumn("map_id", F.floor(doc / 50).cast("long")), "map_id", "doc_id", entry)
    return feeds.sitemap_items(maps, F.expr(NOW), "map_id").select("map_id", "title", "url", F.col("rank").cast("long").alias("rank"))


# --- issue pages and links ----------------------------------------------------------------------


@query(r"""WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, 'Turn ' || turn || ' of ' || role AS title, trim(regexp_replace(text, '\s+', ' ', 'g')) AS body FROM conversations)
SELECT conv_id, place, title, substr(CASE WHEN turn % 3 <> 0 AND body <> '' THEN body ELSE title END, 1, 600) AS summary,
  CASE WHEN turn % 2 = 0 THEN 'https://issues.example/a/' || turn || '?k=2' ELSE 'https://other.example/Z' || turn END AS url, 'https://issues.example/' || conv_id AS issue_url
FROM a WHERE turn % 4 <> 3 AND (conv_id + turn) % 6 <> 5 AND (conv_id + turn) % 7 <> 6""")
def issue_stories(spark, sf_dir):
    """Each conversation as an issue page: one story for each article that is no promotion and links to https."""
    turn, both = F.col("turn"), F.col("conv_id") + F.col("turn")
    mark = F.when(both % 6 == 5, "Sponsored: ").when(both % 7 == 6, "⚡ ").otherwise("")
    href = F.when(turn % 2 == 0, F.concat(F.lit("/a/"), turn, F.lit("?ref=x&amp;k=2#top"))).when(turn % 4 == 3, F.concat(F.lit("http://other.example/Z"), turn)).otherwise(F.concat(F.lit("https://Other.Example/Z"), turn, F.lit("/")))
    block = F.when(turn % 3 != 0, F.concat(F.lit('<div class="a newsletter-html">'), _markup(F.coalesce("text", F.lit(""))), F.lit("</div>"))).otherwise("")
    article = F.concat(F.lit('<article><a href="'), href, F.lit('"><h3>'), mark, F.lit("Turn "), turn, F.lit(" of "), F.col("role"), F.lit(" (5 minute read)</h3></a>"), block, F.lit("</article>"))
    pages = _joined(table(spark, sf_dir, "conversations"), "conv_id", "turn", article)
    pages = pages.withColumns({"url": F.concat(F.lit("https://issues.example/"), F.col("conv_id")), "published_at": F.expr(NOW)})
    found = feeds.issue_articles(pages, fixed.DEFAULT_PROFILE, "turns", "Turns", ["conv_id"])
    return found.select("conv_id", F.col("place").cast("long").alias("place"), "title", "summary", "url", "issue_url")


@query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '(?i)^(https?)://', 1)) AS scheme, lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)) AS host,
  regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']+)["''][^>]*>(.*?)</a>', 1) AS hrefs, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']+)["''][^>]*>(.*?)</a>', 2) AS labels FROM pages),
l AS (SELECT page_id, scheme, host, unnest(hrefs) AS href, unnest(labels) AS label, unnest(range(len(hrefs))) AS place FROM p),
r AS (SELECT page_id, place, trim(regexp_replace(regexp_replace(label, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label,
  CASE WHEN href LIKE '/%' AND scheme = 'https' THEN 'https://' || host || href WHEN href LIKE 'https://%' THEN href END AS url FROM l)
SELECT page_id, url, trim(string_agg(label, ' ' ORDER BY place)) AS link_text, min(place) AS place FROM r WHERE url IS NOT NULL GROUP BY page_id, url""")
def page_link_texts(spark, sf_dir):
    """All https links of every page, each URL once with its texts in order."""
    found = feeds.page_links(table(spark, sf_dir, "pages"), "page_id", body="html")
    return found.select("page_id", "url", "link_text", F.col("place").cast("long").alias("place"))


@query()
def page_articles(spark, sf_dir):
    """Every page as an article: its heading, its summary and the link that is the best evidence of it. SQL can't resolve URLs; a test holds
    it against a plain model."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("https://pages.example/"), F.col("page_id"), F.lit("/")).alias("url"), F.col("html").alias("body"))
    return feeds.articles(pages)


# --- what is made of candidates -------------------------------------------------------------------


@query("""SELECT user_id, CASE WHEN bool_and(event_type = 'error') THEN 'failed' WHEN bool_or(event_type IN ('error', 'view')) THEN 'degraded' ELSE 'healthy' END AS status
FROM (SELECT user_id * 100 + event_id % 100 AS user_id, event_type FROM events) GROUP BY user_id""")
def source_statuses(spark, sf_dir):
    """The status of each run, whose sources are a hundredth of a user's events."""
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "degraded").otherwise("healthy")
    health = table(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("user_id"), kind.alias("status"))
    return selection.source_status(health, "user_id")


#: URLs with hosts of every authority.
HOSTS = ("https://tldr.tech", "https://x.com", "https://old.reddit.com", "https://blog.example")


@query(f"""WITH h AS (SELECT {list(HOSTS)} AS h), p AS (SELECT page_id, h[page_id % 4 + 1] || '/b/' || page_id AS base_url, h[page_id // 4 % 4 + 1] || '/s/' || page_id AS url, page_id % 9 = 0 AS is_primary FROM pages, h),
a AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS own, CASE WHEN is_primary THEN 4 ELSE CASE page_id // 4 % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END END AS other FROM p)
SELECT page_id, CASE WHEN other > own THEN url ELSE base_url END AS preferred FROM a""")
def preferred_urls(spark, sf_dir):
    """For each page's story, whether the URL of its base or the supplemental one is shown."""
    page = F.col("page_id")
    at = lambda n: F.element_at(F.array(*map(F.lit, HOSTS)), (n % 4 + 1).cast("int"))
    base, other = F.concat(at(page), F.lit("/b/"), page), F.concat(at(F.floor(page / 4)), F.lit("/s/"), page)
    return table(spark, sf_dir, "pages").select("page_id", selection.preferred_url(base, other, page % 9 == 0).alias("preferred"))


def report_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates of reports of sixteen, in order of doc_id; every third has a URL that others of its report share."""
    doc = F.col("id")
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    url = F.when(doc % 3 == 0, F.concat(F.lit("https://tldr.tech/a/"), doc % 2)).otherwise(F.concat(F.lit("https://blog.example/"), doc))
    named = F.struct(F.concat(F.lit("s"), doc % 4).alias("source_id"), F.col("source").alias("source_name"), F.when(doc % 5 == 0, "primary").otherwise("discovery").alias("kind"), url.alias("source_url"))
    return _titles(spark, sf_dir).join(source, "id").select(F.floor(doc / 16).cast("long").alias("report_id"), doc.alias("place"), "title", url.alias("url"), (F.col("n_chars") % 7).cast("long").alias("score"), F.array(named).alias("attributions"))


@query()
def merged_stories(spark, sf_dir):
    """Candidates of every report with those of one story merged. SQL has no fold over stories by three rules; a test holds it against a plain model."""
    found = selection.merged_supplemental(report_candidates(spark, sf_dir))
    ids = F.array_join(F.transform("attributions", lambda a: F.concat_ws("|", a["source_id"], a["source_url"])), ",")
    return found.select("report_id", "place", "url", "score", ids.alias("attributed"))


@query()
def materialized_signals(spark, sf_dir):
    """Every issue's signals: distinct candidates, at most fourteen, with bases that fall by place. SQL has no compatibility forms; a test
    holds it against a plain model."""
    stories = report_candidates(spark, sf_dir).select(F.col("report_id").alias("issue_id"), F.col("place").alias("candidate_id"), "title", F.array(F.struct(F.col("attributions")[0]["source_name"].alias("label"), "url")).alias("sources"))
    signals, hot = selection.materialized(stories, fixed.DEFAULT_PROFILE, "2024-01-01")
    kept = hot.select("issue_id", "candidate_id", F.col("base").alias("hot_base"))
    return signals.join(kept, ["issue_id", "candidate_id"], "left").select("issue_id", "candidate_id", "place", "base", "hot_base", "source")
