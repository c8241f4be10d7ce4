"""Collection of sources: each fails by itself, and what fails is told of."""

import json

import pytest
from pyspark.sql import functions as F

from newsloom.functions.fixed import DEFAULT_PROFILE
from newsloom.plans import collection, flows
from newsloom.sources import fetch

NOW = "Sat, 01 Jun 2024 10:00:00 GMT"


def item(title, link, date=NOW, more=""):
    return f"<item><title>{title}</title><link>{link}</link><pubDate>{date}</pubDate>{more}</item>"


def base(n, stories):
    body = "".join(f'<p>{t} <a href="{u}">{t}</a></p>' for t, u in stories)
    return item("Base", f"https://base.example/{n}", more=f"<content:encoded><![CDATA[{body}]]></content:encoded>")


ARTICLES = """<article><a href="https://x.example/agents?utm_source=t"><h3>Agents plan releases (3 minute read)</h3></a><div class="newsletter-html">How agents &amp; tools plan a release.</div></article>
<article><a href="https://x.example/ad"><h3>Sponsored: buy this</h3></a></article>
<article><a href="https://base-story.example/one"><h3>Codex ships version 2.0</h3></a></article>"""
PAGE = '<html><head><meta name="description" content="A platform for agents."></head><h1>Agent platform opens</h1><a href="https://evidence.example/news/agent-platform-opens">Agent platform opens</a></html>'
SITEMAP = "".join(f"<url><loc>https://alpha.example/p/{slug}</loc><lastmod>{day}</lastmod></url>" for slug, day in (("agent-platform-opens", "2024-06-01T12:00:00Z"), ("lost-agent-page", "2024-06-01T13:00:00Z"), ("old-news", "2024-05-01T13:00:00Z")))
PRIMARY = item("Enterprise agents use the platform", "https://blog.example/agents", more="<description>Agent workflow for enterprise.</description>") + item("Old agents", "https://blog.example/old", "Mon, 01 Jan 2024 10:00:00 GMT")

WEB = {
    "https://f/base": base(1, [("Codex ships version 2.0 to everyone with agents", "https://base-story.example/one"), ("Research on frontier benchmarks in science", "https://base-story.example/two")]),
    "https://f/tldr": item("Today", "https://f/issue"), "https://f/issue": ARTICLES, "https://f/map": SITEMAP, "https://alpha.example/p/agent-platform-opens": PAGE, "https://f/primary": PRIMARY,
    "https://f/empty": "<rss></rss>", "https://f/tldr-lost": item("Today", "https://f/nothing"),
}
RUNS = [
    (1, "https://f/base", {"tldr-ai": "https://f/tldr", "alphasignal": "https://f/map", "cloudflare-agents": "https://f/primary"}),
    (2, "https://f/none", {"tldr-ai": "https://f/tldr", "alphasignal": "https://f/map", "cloudflare-agents": "https://f/primary"}),
    (3, "https://f/base", {"tldr-ai": "https://f/empty", "alphasignal": "https://f/none", "cloudflare-agents": "https://f/empty"}),
    (4, "https://f/base", {"tldr-ai": "https://f/tldr-lost", "alphasignal": "https://f/empty"}),
    (5, "https://f/empty", {}),
]


@pytest.fixture(scope="module")
def got(spark):
    pages = spark.createDataFrame(list(WEB.items()), "url string, body string")
    runs = spark.createDataFrame(RUNS, "run_id long, base_url string, feeds map<string,string>")
    web = lambda wanted: fetch.archived(wanted, pages)
    return {r.run_id: r for r in collection.shadow_runs(runs, web, DEFAULT_PROFILE, F.expr("TIMESTAMP '2024-06-02 00:00:00'")).collect()}


def test_each_source_is_told_of(got):
    health = {(i, s.source_id): (s.status, s.requests, s.fetched_items, s.accepted, s.errors) for i, r in got.items() for s in r.sources}
    well = {"alphasignal": ("degraded", 3, 2, 2, ["alpha.example returned 404"]), "cloudflare-agents": ("healthy", 1, 2, 1, []), "tldr-ai": ("healthy", 2, 1, 2, [])}
    for n in (1, 2):
        assert {k[1]: v for k, v in health.items() if k[0] == n} == well
    assert health[3, "tldr-ai"] == ("failed", 1, 0, 0, ["TLDR feed contains no current issue"])
    assert health[3, "alphasignal"] == ("failed", 1, 0, 0, ["f returned 404"])
    assert health[3, "cloudflare-agents"] == ("healthy", 1, 0, 0, [])
    assert health[4, "tldr-ai"] == ("failed", 2, 1, 0, ["f returned 404"])
    assert health[4, "alphasignal"] == ("failed", 1, 0, 0, [])
    assert health[4, "cloudflare-agents"] == ("failed", 1, 0, 0, ["no feed is named"])


def test_runs_end_by_their_sources_or_base(got):
    assert {i: (r.status, r.error) for i, r in got.items()} == {1: ("degraded", None), 2: ("failed", "f returned 404"), 3: ("degraded", None), 4: ("failed", None), 5: ("failed", "RSS has no item")}
    assert (got[2].candidates, got[2].would_add) == (None, None)


def test_reports_compare_with_their_own_base(got):
    one = got[1]
    # the third article is the base's first story; the platform's page and the primary's post stay, the page that was lost by its slug
    assert (one.candidates, one.overlaps) == (5, 1) and "Codex ships version 2.0" not in one.would_add
    assert one.would_add[0] == "Enterprise agents use the platform" or "Agent platform opens" in one.would_add
    assert (got[3].candidates, got[3].overlaps, got[3].would_add) == (0, 0, [])


def test_all_pages_as_collections(spark, sf_dir):
    rows = {r.run_id: r for r in flows.shadow_collections(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert len(rows) == -(-pages // 10)
    for r in rows.values():
        sources = json.loads(r.sources)
        assert [s["source_id"] for s in sources] == ["alphasignal", "cloudflare-agents", "tldr-ai"]
        accepted = sum(s["accepted"] for s in sources)
        assert r.error or (r.candidates == accepted and r.after_deduplication <= accepted)
    assert any(r.would_add for r in rows.values())
