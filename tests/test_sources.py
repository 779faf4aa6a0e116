import json

import pytest
from pyspark.sql import functions as F

from listwright.operators import providers
from listwright.sources import cards, detect, files, pages, settings
from listwright.sources.listing import enrich, gather, item_order

AT = "2024-02-01 00:00:00"


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("item_ord").collect()]


def test_api(spark):
    payload = {"JobPositionPostings": [
        {"Id": 1, "Title": " Dev ", "HiringOrgName": "Acme", "WorkPlaceCity": "Oslo", "Description": "<b>C#</b> &amp; more", "PostingCreated": "2024-01-05T00:00:00"},
        {"Id": 2, "Title": "", "Link": "x"}, {"Title": "No id", "PostingCreated": "Posted today"}, 7]}
    mapping = {"items_path": "JobPositionPostings", "id": "Id", "title": "Title", "company": "HiringOrgName", "location": "WorkPlaceCity", "description": "Description", "posted_at": "PostingCreated", "url_template": "https://x.example/{Id}"}
    docs = spark.createDataFrame([(json.dumps(payload), 0), ('{"JobPositionPostings": {}}', 1), ("<html>", 2)], "v string, page int").select(F.try_parse_json("v").alias("doc"), "page")
    out = files.payload_listings(docs, mapping, "p", AT)
    assert rows(out, "title", "company", "location", "description", "url") == [("Dev", "Acme", "Oslo", "C# & more", "https://x.example/1"), ("No id", None, None, "", "https://x.example/")]
    assert [r["posted_at"] is None for r in out.orderBy("item_ord").collect()] == [False, True]
    fixed = files.payload_listings(docs, mapping, "p", AT, {"company": "Fixed", "location": " "})
    assert {r["company"] for r in fixed.collect()} == {"Fixed"}


def test_manual(spark, tmp_path):
    (tmp_path / "m-1.json").write_text(json.dumps([{"Title": "Dev", "COMPANY": "A", "url": "https://x.example/1", "posted_at": "2024-01-02"}, {"title": "no url"}, {"title": "rel", "url": "/x"}]))
    (tmp_path / "m-2.json").write_text('{"not": "an array"}')
    assert rows(files.manual_json(spark, f"{tmp_path}/m-*.json", "m", AT), "title", "company", "url") == [("Dev", "A", "https://x.example/1")]
    (tmp_path / "m.csv").write_text('URL,Title,Company,Location,Description\nhttps://x.example/1,"Dev, senior","A ""B""",Oslo,"two\nlines"\n\nhttps://x.example/2,Short\n,No url\n')
    got = rows(files.manual_csv(spark, f"{tmp_path}/m.csv", "m", AT), "title", "company", "description")
    assert got == [("Dev, senior", 'A "B"', "two\nlines"), ("Short", None, "")]


def test_csv_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title,URL\nOne,https://x.example/1\n")
    (tmp_path / "b.csv").write_text("\ufeffURL,Title,Company\nhttps://x.example/2,Two,B\n")
    (tmp_path / "c.csv").write_text("title,url,TITLE\nold,https://x.example/3,Three\nkept,https://x.example/4\n")
    (tmp_path / "d.csv").write_text("title,company\nNo url,X\n")
    (tmp_path / "e.csv").write_text("")
    got = rows(files.manual_csv(spark, f"{tmp_path}/*.csv", "m", AT), "url", "title", "company")
    assert sorted(got) == [("https://x.example/1", "One", None), ("https://x.example/2", "Two", "B"), ("https://x.example/3", "Three", None), ("https://x.example/4", "kept", None)]


def test_json_items_cost_themselves_only(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"Title": "old", "title": "new", "URL": "https://x.example/1", "url": "https://x.example/2"}, 3, "x", null, [1], {"title": "dup", "title": "last", "url": "https://x.example/3", "company": {"a": 1}}]')
    (tmp_path / "b.json").write_text("[{broken")
    got = rows(files.manual_json(spark, f"{tmp_path}/*.json", "m", AT), "url", "title", "company")
    assert sorted(got) == [("https://x.example/2", "new", None), ("https://x.example/3", "last", None)]


def test_catalogue_of_providers(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"providers": [ {"id": 1, "name": "a // b", "rateLimitRps": 0.5,}, /* x */ {"id": 2, "name": "c,]",}, // y\n ],}')
    got = settings.read_catalogue(spark, f"{tmp_path}/c.json")
    assert [tuple(r) for r in got.orderBy("ord").select("id", "name", "rateLimitRps").collect()] == [(1, "a // b", 0.5), (2, "c,]", None)]
    (tmp_path / "d.json").write_text('{"sources": []}')
    with pytest.raises(Exception, match="providers"):
        settings.read_catalogue(spark, f"{tmp_path}/d.json").collect()


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        """<?xml version="1.0"?><rss><channel><title>t</title>
<item><title>Dev, Acme A/S</title><link>https://www.jobindex.dk/vis-job/h1</link><guid>g1</guid><description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>Fri, 05 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>Dev, Acme</title><link>https://x.example/2</link></item><item><title>No link</title></item></channel></rss>"""
    )
    got = files.feed(spark, f"{tmp_path}/f.xml", "r", AT)
    assert rows(got, "title", "company", "description", "url") == [("Dev", "Acme A/S", "Hi", "https://www.jobindex.dk/vis-job/h1"), ("Dev, Acme", None, "", "https://x.example/2")]
    (tmp_path / "a.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Dev</title><id>i1</id><link href="https://x.example/9" rel="alternate"/><summary>s</summary><updated>2024-01-05T00:00:00Z</updated></entry></feed>'
    )
    assert rows(files.feed(spark, f"{tmp_path}/a.xml", "r", AT, atom=True), "title", "url", "description") == [("Dev", "https://x.example/9", "s")]


def test_cards(spark):
    html = """<ul><li class="job-card x"><a class="job-link" href="/jobs/1"><h2>Dev &amp; Ops</h2></a><span class="loc"> Oslo </span></li>
<li class="job-card"><a class="job-link" href="https://y.example/2"><h2>Lead</h2></a></li><li class="job-card"><a class="job-link"><h2>No link</h2></a></li><li><h2>Other</h2></li></ul>"""
    df = spark.createDataFrame([("https://x.example/list", html), ("https://x.example/none", None)], "url string, html string")
    got = cards.html_cards(df, {"list": "li.job-card", "title": "h2", "link": "a.job-link[href]", "location": ".loc"}, "h", AT)
    assert rows(got, "title", "url", "location", "posted_at") == [("Dev & Ops", "https://x.example/jobs/1", "Oslo", None), ("Lead", "https://y.example/2", None, None)]
    own = spark.createDataFrame([("https://x.example/", '<a class="c" href="/1">One</a>')], "url string, html string")
    assert rows(cards.html_cards(own, {"list": "a.c", "title": ":scope", "link": ":scope"}, "h", AT), "title", "url") == [("One", "https://x.example/1")]


def test_postings(spark):
    ld = {"@type": "JobPosting", "title": "Dev", "description": "&lt;p&gt;Hi&lt;/p&gt;", "datePosted": "2024-01-03", "identifier": {"value": "77"}, "hiringOrganization": {"name": "Acme"}, "jobLocation": [{"address": {"addressLocality": "Aarhus", "addressCountry": "dk"}}]}
    html = f'<script type="application/ld+json">{{"@type":"BreadcrumbList"}}</script><script type="application/ld+json">not json</script><script type=\'application/ld+json\'>{json.dumps(ld)}</script>'
    df = spark.createDataFrame([("https://x.example/jobs/1", html), ("https://x.example/jobs/2", "<p>none</p>")], "url string, html string")
    assert rows(pages.json_ld_postings(df, "t", AT), "title", "company", "location", "description") == [("Dev", "Acme", "Aarhus, Denmark", "Hi")]
    site = "<urlset><url><loc>https://x.example/jobs/1-dev</loc></url><url><loc> https://x.example/jobs/1-dev </loc></url><url><loc>https://x.example/about</loc></url></urlset>"
    assert spark.createDataFrame([(site,)], "s string").select(pages.sitemap_urls(F.col("s"))).first()[0] == ["https://x.example/jobs/1-dev"]


def test_form(spark):
    data = {"CustomerAlias": "DR", "PositionList": {"Items": [
        {"Id": 5, "Name": "Dev", "AdvertisementUrl": "https://x.example/5", "DepartmentTree": {"City": "Aarhus", "Country": "Danmark"}, "Published": "/Date(1704067200000)/", "ShortDescription": "d"},
        {"Id": 6, "Name": "Ops", "AdvertisementUrlSecure": "https://x.example/6", "Department": {"City": "", "Country": "Norge", "Name": "D"}, "Published": "/Date(-1)/"},
        {"Id": 7, "Name": "Hall", "AdvertisementUrl": "https://x.example/7", "WorkPlace": "House"}, {"Id": 8, "Name": "none"}]}}
    html = '<input type="hidden" id="HiddenField_PositionList" value="' + json.dumps(data).replace('"', "&quot;") + '"/>'
    df = spark.createDataFrame([("u", html), ("v", "<p/>")], "url string, html string")
    got = pages.form_positions(df, "h", AT)
    assert rows(got, "title", "company", "location") == [("Dev", "DR", "Aarhus, Denmark"), ("Ops", "DR", "Norge"), ("Hall", "DR", "House")]
    assert [str(r["posted_at"]) for r in got.orderBy("item_ord").collect()] == ["2024-01-01 00:00:00", "None", "None"]


def test_gather_keeps_the_order_of_sources_at_any_partition_count(spark):
    frames, want = [], []
    for k, parts in enumerate((200, 3, 200)):
        rows = spark.range(0, 800, 1, parts).selectExpr(f"concat('s{k}-', id) url", "cast(id as string) id")
        frames.append(rows.withColumn("item_ord", item_order(F.monotonically_increasing_id(), F.lit(70_000))))
        want += [f"s{k}-{i}" for i in range(800)]
    got = gather(frames).orderBy("seq").collect()
    assert [r["url"] for r in got] == want and len({r["seq"] for r in got}) == len(want)


def test_gather_and_enrich(spark):
    base = spark.createDataFrame([("u1", "d", 0), ("u2", "", 1), ("u3", "x", 2)], "url string, description string, item_ord long")
    both = gather([base, base])
    assert [r["seq"] for r in both.orderBy("source_ord", "item_ord").collect()] == sorted(r["seq"] for r in both.collect())
    fetched = spark.createDataFrame([("u1", "<p>b</p>"), ("u2", "<p>c</p>"), ("u3", None)], "url string, html string")
    assert sorted(r["description"] for r in enrich(base, fetched).collect()) == ["c", "d b", "x"]


def test_settings(spark, tmp_path):
    p = settings.parse_profile("---\nname: Ann\nlocation: Oslo, Norway\nexperience_years: 7\nremote_preference: Hybrid\nseniority: senior\nmetro: [Asker]\n---\n# x\n## Primary stack\n- C#\n* Go\n- \ntext\n## Domains\n  - fintech\n")
    assert (p.primary_stack, p.domains, p.metro, p.remote_preference, p.employment_types) == (("C#", "Go"), ("fintech",), ("Asker",), "hybrid", ("full-time",))
    for bad in ("name: x", "---\nname: A\nlocation: B\nexperience_years: x\n---\n", "---\nname: A\nlocation: B\nexperience_years: 1\nremote_preference: moon\nseniority: mid\n---\n"):
        with pytest.raises(settings.SettingsError):
            settings.parse_profile(bad)
    r = settings.parse_ranking("weights: {primary_stack: 0.4, secondary_stack: 0.15, seniority: 0.15, location_remote: 0.15, domain: 0.1, freshness: 0.05}\nlocation_tier_weights: {else: 0.2}\nllm: {enabled: true, weight: 0.25}\n")
    assert (r.top_n, r.tiers.other, r.judge.enabled, r.judge.weight, r.problems()) == (10, 0.2, True, 0.25, [])
    with pytest.raises(settings.SettingsError):
        settings.parse_ranking("top_n: 5")
    (tmp_path / "c.json").write_text('[{"id": 1, "name": "a"}, /* note */ {"id": 2, "name": "b"}]')
    assert settings.read_catalogue(spark, f"{tmp_path}/c.json").count() == 2
    (tmp_path / "d.json").write_text('[{"id": 1}, {"id": 1}]')
    with pytest.raises(Exception, match="duplicate source id"):
        settings.read_catalogue(spark, f"{tmp_path}/d.json").collect()
    numbered = settings.with_ids(spark.createDataFrame([(None, 0), (5, 1), (None, 2)], "id int, ord int"))
    assert sorted((r["ord"], r["id"]) for r in numbered.collect()) == [(0, 6), (1, 5), (2, 7)]
    (tmp_path / "e.md").write_text("---\npolarity: liked\ntitle: Dev\ncompany: A\nprimary_stack: [C#]\n---\n" + "why " * 100)
    e = settings.read_examples(spark, f"{tmp_path}/e.md").first()
    assert e["title"] == "Dev" and len(e["note"]) == 241 and e["primary_stack"] == ["C#"]


def test_detect(spark):
    urls = ["https://boards.greenhouse.io/acme", "https://x.teamtailor.com/jobs", "https://www.teamtailor.com", "https://example.org/rss", "https://example.org"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = [r["s"]["kind"] if r["s"] else None for r in df.select("i", detect.detect_source(F.col("url")).alias("s")).orderBy("i").collect()]
    assert got == ["greenhouse", "teamtailor", None, "rss", None]


def test_overrides(spark):
    ok = spark.createDataFrame([(1, 5, 20, 1.0)], "id int, max_pages int, page_size int, rate_limit double")
    assert providers.checked_overrides(ok).count() == 1
    with pytest.raises(Exception, match="max_pages"):
        providers.checked_overrides(ok.withColumn("max_pages", F.lit(51))).collect()
    state = spark.createDataFrame([(1, False, True), (2, True, False)], "id int, opted_in boolean, opted_out boolean")
    changed = providers.upsert_state(state, spark.createDataFrame([(1, True), (3, False)], "id int, enabled boolean"))
    assert sorted(tuple(r) for r in changed.collect()) == [(1, True, False), (2, True, False), (3, False, True)]
    shown = spark.createDataFrame([("a", "Ann", "X", True, "failing"), ("b", "Bob", "Y", False, "working")], "id string, name string, display_name string, enabled boolean, health string")
    assert [providers.filter_providers(shown, s, t).count() for s, t in (("all", ""), ("on", ""), ("off", ""), ("failing", ""), ("all", "bo"))] == [2, 1, 1, 1, 1]
    assert tuple(providers.provider_counts(shown).first()) == (2, 1, 1, 1)


def test_every_page_and_whole_texts_are_joined(spark, tmp_path):
    from listwright.queries import QUERIES

    n = 410
    spark.createDataFrame([(i, f"{'word ' * 40}end{i}") for i in range(n)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"<p>page{i}</p>") for i in range(n)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["id"]: r["chars"] for r in QUERIES["lookup_enrich_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: len(" ".join(([f"{'word ' * 40}end{i}"] if i % 3 else []) + ([f"page{i}"] if i % 9 else []))) for i in range(n)}


def test_text_files_stand_in_one_folder(spark):
    """One file a row, and no folder for each of them."""
    import os
    from urllib.parse import urlparse

    from listwright.queries import _text_files

    rows = spark.range(300).selectExpr("id AS file", "concat('a', id, '\n\nb') AS value")
    path = _text_files(rows, "imports")
    folder = urlparse(path).path
    assert [d for _, found, _ in os.walk(folder) for d in found] == []
    assert sorted(r["value"] for r in spark.read.text(path, wholetext=True).collect()) == sorted(f"a{i}\n\nb\n" for i in range(300))
