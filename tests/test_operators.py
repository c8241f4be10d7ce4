"""Folds, selection, ranking, checks, state and streams on hand-made rows and against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions.fixed import DEFAULT_PROFILE
from newsloom.operators import dedup, inventory, ranking, selection, store, validate, visits
from newsloom.plans import edition
from newsloom.sources import feeds


def test_distinct_candidates_claims_only_for_kept_rows(spark):
    rows = spark.createDataFrame([(1, 1, "One 2", "u1"), (1, 2, "Other", "u1"), (1, 3, "Other", "u2"), (1, 4, "one 2 again", "u3"), (1, 5, "日本", "u4"), (1, 6, "中国", "u5")], "issue_id int, candidate_id int, title string, url string")
    assert sorted(r.candidate_id for r in dedup.distinct_candidates(rows).collect()) == [1, 3, 5]


def test_best_of_story_matches_a_plain_model(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randint(0, 9), [rng.choice("abcdefgh") for _ in range(2)]) for g in range(20) for i in range(12)]
    frame = spark.createDataFrame(rows, "g int, pos int, base int, keys array<string>").repartition(5)
    want = set()
    for g in range(20):
        slots, where = [], {}
        for _, pos, base, keys in [r for r in rows if r[0] == g]:
            at = next((where[k] for k in keys if k in where), None)
            if at is None:
                slots.append((pos, base))
                where.update({k: len(slots) - 1 for k in keys})
            elif base > slots[at][1]:
                slots[at] = (pos, base)
                where.update({k: at for k in keys})
        want |= {(g, pos) for pos, _ in slots}
    assert {(r.g, r.pos) for r in dedup.best_of_story(frame, "g", "pos").collect()} == want


def test_hot_topics_merge_sources(spark):
    kind = "g int, pos int, base int, keys array<string>, sources array<struct<label:string,url:string>>"
    rows = spark.createDataFrame([(1, 1, 5, ["a"], [("x", "u1")]), (1, 2, 9, ["a", "b"], [("y", "u1"), ("z", "u2")]), (1, 3, 1, ["b"], [("q", "u3")])], kind)
    got = {r.pos: [s.url for s in r.sources] for r in dedup.best_of_story(rows, "g", "pos", merge_sources=True).collect()}
    assert got == {2: ["u1", "u2"], 3: ["u3"]}


def test_supplemental_merge(spark):
    kind = "report_id int, place int, title string, summary string, url string, published_at string, score long, exceptional boolean, attributions array<struct<source_id:string,source_name:string,kind:string,source_url:string>>"
    at = lambda s, k="discovery": [(s, s, k, f"https://{s}.io")]
    rows = spark.createDataFrame([
        (1, 1, "Acme ships new agent runtime", "s", "https://tldr.tech/a", "2026-01-01", 5, False, at("tldr-ai")),
        (1, 2, "Acme ships the new agent runtime", "s", "https://acme.io/a", "2026-01-01", 4, False, at("cloudflare-agents", "primary")),
        (1, 3, "Unrelated thing about approval workflow", "s", "https://b.io", "2026-01-02", 0, False, at("alphasignal")),
        (1, 4, "Base story known already here", "s", "https://known.io/x", "2026-01-02", 9, False, at("alphasignal")),
    ], kind)
    base = spark.createDataFrame([(1, "Something", "https://known.io/x/?utm_a=1")], "id int, title string, url string")
    made = selection.shadow_report(rows, base)
    merged = {r.title: r for r in selection.merged_supplemental(rows).collect()}
    assert merged["Acme ships the new agent runtime"].score == 5 and len(merged["Acme ships the new agent runtime"].attributions) == 2
    assert [r.title for r in made["overlaps"].collect()] == ["Base story known already here"]
    assert {r.title: r.counted_for for r in made["would_add"].collect()} == {"Acme ships the new agent runtime": "tldr-ai", "Unrelated thing about approval workflow": "alphasignal"}
    assert {r.counter: r.n for r in made["totals"].collect()} == {"base": 1, "supplemental": 4, "after_deduplication": 3, "overlaps": 1, "novel_qualified": 2, "would_add": 2}


def test_greedy_quota_matches_a_plain_model(spark):
    caps, rng = {"a": 3, "b": 2, "c": 1}, random.Random(5)
    rows = [(g, i, rng.randint(0, 4), f"2026-01-{i + 1:02d}", rng.sample("abc", 2)) for g in range(8) for i in range(12)]
    frame = spark.createDataFrame(rows, "g int, pos int, score int, published_at string, sources array<string>")
    want = set()
    for g in range(8):
        room = dict(caps)
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], [-ord(x) for x in r[3]])):
            s = next((s for s in r[4] if room[s]), None)
            if s:
                room[s] -= 1
                want.add((g, r[1], s))
    assert {(r.g, r.pos, r.counted_for) for r in selection.greedy_quota(frame, "g", caps).collect()} == want


def test_repaired_sources_reserve_across_lists():
    catalog, reserved = {"u1": "one", "u2": "two"}, set()
    assert dedup.repaired_sources([{"label": "", "url": "u1"}, {"label": "x", "url": "bad"}], catalog, 3, reserved) == [{"label": "one", "url": "u1"}]
    assert dedup.repaired_sources([{"label": "a", "url": "u1"}], catalog, 3, reserved) == [{"label": "two", "url": "u2"}]
    assert dedup.repaired_sources([], catalog, 3, reserved) == []


def test_inventory_end_to_end(spark):
    body = "\n".join(["Tools", "Codex terminal agent launch [A](https://a.io/1) today.", "1. Links", "A video [B](https://b.io/2)", "Top tweets", "More [A](https://a.io/1)", "AI News for x [A](https://a.io/1)"])
    issues = spark.createDataFrame([(1, body, [("A", "https://a.io/1"), ("B", "https://b.io/2")])], "issue_id int, body string, anchors array<struct<label:string,url:string>>")
    got = edition.inventory_of(issues, DEFAULT_PROFILE).orderBy("candidate_id").collect()
    assert [(r.candidate_id, r.heading, r.category) for r in got] == [(1, "Tools", "codex"), (2, "1. Links", "newly")]
    assert got[0].sources[0].url == "https://a.io/1" and got[1].score == 2 - 6 - 18
    signals, hot = edition.edition_stories(issues, DEFAULT_PROFILE, "1 January 2026")
    assert [r.base for r in signals.orderBy("place").collect()] == [100, 96] and hot.count() == 2
    assert "Candidate 1\nStory:" in edition.prompts(issues, DEFAULT_PROFILE).first().prompt


def test_sixty_lines_leave_eighteen_blocks(spark):
    blocks = spark.createDataFrame([(1, i, 0) for i in range(60)], "g int, place int, score int")
    places = sorted(r.place for r in inventory.select_blocks(blocks, "g").collect())
    assert places == [*range(15), 22, 37, 52]


def test_ranking_order_reason_and_factors(spark):
    kind = "edition int, pos int, category string, title string, summary string, base int, exceptional boolean, watch_permission boolean, watch_geography boolean"
    rows = spark.createDataFrame([(1, 0, "codex", "t", "s", 50, None, None, None), (1, 1, "codex", "t", "s", 50, None, None, None), (1, 2, "none", "tool permission", "s", 60, None, True, None), (1, 3, "harness", "t", "s", 10, True, None, None)], kind)
    got = ranking.ranked(rows, DEFAULT_PROFILE, "edition", "pos").orderBy("rank").collect()
    assert [(r.pos, r.score) for r in got] == [(0, 90), (1, 90), (2, 80), (3, 75)]
    said = {r.pos: r for r in ranking.explained(rows, DEFAULT_PROFILE).collect()}
    assert said[0].reason.label == "Codex & agent craft · Lead" and said[2].reason.tone == "watched" and said[3].reason.tone == "exceptional"
    assert [f.label for f in said[3].factors] == ["Editorial override", "Category", "Editorial marker", "Editorial strength"]


def test_overrides():
    assert ranking.normalize_override({"version": 1, "storyBudget": 7}, DEFAULT_PROFILE) is None
    assert ranking.normalize_override({"version": 1, "weights": {"codex": 5}}, DEFAULT_PROFILE) is None
    assert ranking.normalize_override({"version": 1, "x": 1}, DEFAULT_PROFILE) is None
    made = ranking.normalize_override({"version": 1, "weights": {"codex": 0, "agents": 3}, "storyBudget": 9}, DEFAULT_PROFILE)
    assert made == {"version": 1, "storyBudget": 9, "weights": {"codex": 0}}
    merged = ranking.merge_override(DEFAULT_PROFILE, made)
    assert merged["storyBudget"] == 9 and next(w["value"] for w in merged["weights"] if w["id"] == "codex") == 0
    assert ranking.create_override(DEFAULT_PROFILE, merged) == made


def test_profile_and_section_checks(spark):
    kind = "id int, version int, story_budget int, story_budget_range array<int>, weights array<struct<id:string,label:string,value:int>>, exceptional_story_override boolean, watch_permissions boolean, watch_geography boolean"
    good = [("a", "A", 1)]
    rows = spark.createDataFrame([(1, 1, 7, [5, 14], good, True, True, True), (2, 0, 7, [5, 14], good, True, True, True), (3, 1, 7, [9, 6], good, True, True, None), (4, 1, 7, [5, 14], good * 2, True, True, True)], kind)
    first = {r.id: r.rule for r in validate.first_failure(validate.profile_failures(rows), "id").collect()}
    assert first == {2: "version", 3: "story_budget_range reversed", 4: "weights.id"}
    kind = "id int, pos int, title string, kicker string, body string, sources array<struct<label:string,url:string>>"
    same = "Seven eight distinctive words stand here inside opening sentence. Rest"
    rows = spark.createDataFrame([(1, 0, "A", "k1", same, [("l", "u")]), (1, 1, "B", "k2", same, [("m", "u")]), (2, 0, "A", "k", "x", [("l", "u")])], kind)
    assert {(r.left_pos, r.right_pos, r.rule) for r in validate.section_repeats(rows).collect()} == {(0, 1, "body"), (0, 1, "sources")}
    views = spark.createDataFrame([(1, "TBD", "b", "c"), (2, "Same", "same!", "c")], "id int, a string, b string, c string")
    assert {(r.id, r.rule) for r in validate.presentation_failures(views, ["a", "b", "c"], ["a", "b", "c"]).collect()} == {(1, "a placeholder"), (2, "view titles")}


def test_permitted(spark):
    used = spark.createDataFrame([("a",), ("b",)], "url string")
    assert [r.url for r in validate.not_permitted(used, used.where("url = 'a'"), ["url"]).collect()] == ["b"]


def test_state_changes(spark, tmp_path):
    old = spark.createDataFrame([(1, "u1", "d1", "2026-01-01", "x"), (2, "u2", "d2", "2026-01-02", "y")], "id int, url string, date string, published_at string, body string")
    new = spark.createDataFrame([(3, "u1", "d9", "2026-01-03", "z"), (4, "u4", "d4", "2026-01-04", "w")], old.schema)
    by = [F.col("published_at").desc(), F.col("id")]
    assert sorted(r.id for r in store.insert_or_ignore(old, new, ["url", "date"], by).collect()) == [1, 2, 4]
    got = {r.id: r.body for r in store.replace_matching(old, new, ["url", "date"], ["body", "published_at"], by).collect()}
    assert got == {1: "z", 2: "y", 4: "w"}
    table = store.Versioned(spark, str(tmp_path / "t"))
    assert table.read() is None
    table.write(old)
    table.write(table.read().where("id = 1"))
    assert [r.id for r in table.read().collect()] == [1]
    profiles = spark.createDataFrame([("a", 1, '{"version": 1}', True)], "id string, version int, profile_json string, is_active boolean")
    after = store.next_profile(profiles, spark.createDataFrame([("b", 2, '{"version": 2}', None)], profiles.schema))
    assert store.active_profile(after, {})["version"] == 2 and after.where("is_active").count() == 1
    with pytest.raises(ValueError):
        store.next_profile(after, spark.createDataFrame([("c", 2, "{}", None)], profiles.schema))
    assert store.active_profile(profiles.limit(0), DEFAULT_PROFILE) == DEFAULT_PROFILE


def test_visits_helpers(spark):
    header = spark.createDataFrame([("a=1; vid=abcdefghij0123456789_-; b=2",), ("vid=short",), (None,)], "h string")
    assert [r.v for r in header.select(visits.visitor_cookie(F.col("h"), "vid").alias("v")).collect()] == ["abcdefghij0123456789_-", None, None]
    asked = spark.createDataFrame([("GET", "/", None), ("GET", "/", "image/png"), ("POST", "/", None)], "m string, p string, a string")
    assert [r.t for r in asked.select(visits.tracked(F.col("m"), F.col("p"), F.col("a")).alias("t")).collect()] == [True, False, False]


def test_feeds(spark):
    rss = "<rss><item><title>T</title><link>https://a.io/1?utm_x=1</link><pubDate>Thu, 01 Jan 2026 10:00:00 GMT</pubDate><description>D &amp;amp; E</description><content:encoded><![CDATA[<p><a href='https://b.io/x'>L</a> text</p>]]></content:encoded></item><item><title>Old</title><link>https://a.io/2</link><pubDate>bad</pubDate></item></rss>"
    frame = spark.createDataFrame([("p", rss), ("q", "<rss></rss>")], "path string, body string")
    got = {r.path: r for r in feeds.latest_issue(frame).collect()}
    assert got["q"].error == "RSS has no item" and got["p"].error is None
    assert (str(got["p"].issue_date), got["p"].publication_date, got["p"].anchors[0].url) == ("2026-01-01", "1 January 2026", "https://b.io/x")
    assert [(r.title, r.url) for r in feeds.feed_items(frame).collect()] == [("T", "https://a.io/1")]
    as_of = F.lit("2026-01-03").cast("timestamp")
    assert feeds.recent_items(frame, as_of, DEFAULT_PROFILE, "s", "S").count() == 1
    site = spark.createDataFrame([("p", "<url><loc>https://a.io/n/new-ai-tool</loc><lastmod>2026-01-02T12:00:00Z</lastmod></url><url><loc>https://a.io/n/x</loc><lastmod>2025-01-02</lastmod></url>")], "path string, body string")
    assert [r.title for r in feeds.sitemap_items(site, as_of).collect()] == ["New AI Tool"]
    page = "<h1>New tool from Acme</h1><meta name='description' content='About it'><a href='https://alphasignal.ai/x'>no</a><a href='https://acme.io/blog/new-tool'>Acme tool</a><a href='https://z.io/'>z</a>"
    pages = spark.createDataFrame([("https://a.io/n/new-ai-tool", page)], "url string, body string")
    assert feeds.articles(pages).first().asDict() == {"url": "https://a.io/n/new-ai-tool", "title": "New tool from Acme", "summary": "About it", "preferred_url": "https://acme.io/blog/new-tool"}
    made = feeds.enriched(feeds.sitemap_items(site, as_of).withColumn("path", F.lit("p")), pages, DEFAULT_PROFILE, "alphasignal", "Alpha").first()
    assert made.url == "https://acme.io/blog/new-tool" and not made.degraded
    issue = spark.createDataFrame([("https://t.io/1", "2026-01-01", "<article><a href='/x?ref=1'><h3>Title (3 minute read)</h3></a><div class='newsletter-html'>Sum</div></article><article><h3>We are hiring</h3><a href='/y'>y</a></article>")], "url string, published_at string, body string")
    assert [(r.title, r.url, r.summary) for r in feeds.issue_articles(issue, DEFAULT_PROFILE, "tldr-ai", "T").collect()] == [("Title", "https://t.io/x", "Sum")]


def test_retries():
    seen = []

    def call(model, error):
        seen.append((model, error))
        if len(seen) == 1:
            raise TimeoutError("request timeout")
        if len(seen) == 2:
            raise ValueError("bad json")
        return "ok"

    assert edition.with_retries(call, "big", "small") == "ok"
    assert seen == [("big", None), ("small", "request timeout"), ("small", "bad json")]


def test_stream_ledger(spark, tmp_path):
    from newsloom.streaming import visits as streaming

    rows = [("a", "2026-01-01 10:00:00", "AU"), ("a", "2026-01-01 11:00:00", "AU"), ("b", "2026-01-01 10:30:00", None), ("a", "2026-01-02 09:00:00", "AU")]
    kind = "visitor_key string, visited_at timestamp, country string"
    spark.createDataFrame(rows, "visitor_key string, visited_at string, country string").selectExpr("visitor_key", "CAST(visited_at AS timestamp) visited_at", "country").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    streaming.write_ledger(streaming.first_entries(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("visitor_key").count().orderBy("visitor_key").collect() == [("a", 2), ("b", 1)]
