"""Markup, structured data, snapshots, crawling, key files."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import crawl
from corpusloom.sources import html, settings, snapshot, structured


def test_markup_with_missing_ends():
    got = html.extract("<title> A &amp; B </title><body><h1>Heading one</h1><p>A first paragraph of text<p>A second <b>paragraph of text<ul><li>First list item<li>Second list item</ul><script>var x = '</p>';</script>", "https://e.com/")
    assert got["title"] == "A & B"
    texts = [b["text"] for b in got["blocks"]]
    assert texts[:5] == ["Heading one", "A first paragraph of text", "A second paragraph of text", "First list item", "Second list item"]


def test_links_of_a_page():
    markup = '<a href="/x?utm_source=a#f">1</a><a href="y">2</a><a href="/x?utm_source=a">3</a><a href="f.pdf">4</a><noscript><a href="/z">5</a></noscript><a>6</a><a href="mailto:a@b">7</a>'
    assert html.extract(markup, "https://e.com/d/")["links"] == ["https://e.com/x?utm_source=a", "https://e.com/d/y"]


def test_client_rendered_page_is_kept():
    node = json.dumps({"@type": "Person", "name": "Ann", "jobTitle": "Engineer"})
    got = html.extract(f'<meta name="description" content="A page about Ann"><body><div id="root"></div><script type="application/ld+json">{node}</script>', "https://e.com/")
    assert got["text"].split("\n")[:3] == ["A page about Ann", "Ann", "Engineer"]
    assert html.extract(None, "x") is None and html.extract("", None)["text"] == ""


@pytest.mark.parametrize(
    ("node", "want"),
    [
        ([{"@type": "Person", "name": "Ann"}], []), ({"@graph": [{"@type": "Person", "name": "Ann"}]}, ["Ann"]), ({"name": "Ann"}, []), ({"@type": "X", "keywords": ["a", "https://b", "c"]}, ["keywords: a, c"] * 2),
        ({"@type": "X", "sameAs": ["https://a.example/x", "b"]}, ["sameAs: b", "Profiles: https://a.example/x"]), ({"@type": "X", "address": {"streetAddress": "1 Way", "postalCode": "Z1"}}, ["Address: 1 Way, Z1"]),
        ({"@type": "X", "hasCredential": [{"name": "Degree"}, {}]}, ["Certifications: Degree"]),
        ({"@type": "X", "alumniOf": [{"name": "A"}, {"name": "B"}]}, ["Past Company Affiliations: A, B (listed in order: A → B). Based on the site, the person has worked at these companies."]),
        ({"@type": "X", "employer": [{"name": "Co"}]}, ["employer: Co"]), ({"@type": "X", "educationRequirements": [{"name": "School"}]}, ["Education: School"]),
        ({"@type": "X", "experience": [{"jobTitle": "Dev", "organization": {"name": "Co"}, "startDate": "2020", "endDate": "2021"}]}, ["Employment History: Dev at Co (from 2020 to 2021)"]),
        ({"@type": "X", "workHistory": [{"position": "Dev", "employer": {"name": "Co"}}]}, ["Work History: Dev at Co"]), ({"@type": "X", "currentPosition": {"title": "Dev", "company": "Co"}}, ["Current Position: Dev at Co"]),
        ({"@type": "X", "review": [{"reviewBody": f"Good {i}", "ratingValue": i} for i in range(4)]}, ["Reviews: Good 0 (Rating: 0); Good 1 (Rating: 1); Good 2 (Rating: 2)"]),
        ({"@type": "X", "blogUrl": "https://b.example"}, ["Social: https://b.example"]),
    ],
)
def test_linked_data(node, want):
    assert structured.json_ld_strings(json.dumps(node)) == want


def test_embedded_data():
    a, b = "a" * 40, "b" * 40
    assert structured.embedded_strings([json.dumps({"b": b, "a": a})]) == [a, b]
    assert structured.embedded_strings([json.dumps({"x": a, "10": b, "9": "c" * 40})]) == [a, b, "c" * 40]
    assert structured.embedded_strings(["{bad", "[NaN]", json.dumps([a, a.upper(), "https://" + a, {"slug": b}, "short"])]) == [a]
    assert structured.embedded_strings([json.dumps("x" * 700)]) == ["x" * 600 + "..."]
    deep = json.dumps([[[[[[[[a]]]]]]]])
    assert structured.embedded_strings([deep]) == []


def test_sitemaps_and_robots(spark):
    df = spark.createDataFrame([("<loc> http://a/x </loc><LOC>http://b</LOC><loc>a&amp;b</loc>", "x\nSitemap: https://a/s.xml\nsitemap:  https://b/s.xml \n")], "x string, r string")
    row = df.select(snapshot.sitemap_locs(F.col("x")).alias("a"), snapshot.robots_sitemaps(F.col("r")).alias("b")).first()
    assert row["a"] == ["http://a/x", "http://b", "a&amp;b"] and row["b"] == ["https://a/s.xml", "https://b/s.xml"]


def page(*links):
    return "<title>T</title><body><main>" + "A page with enough text to be kept. " * 3 + "".join(f'<a href="{x}">x</a>' for x in links) + "</main>"


def site(spark):
    rows = [
        ("https://e.com/", "html", 200, "text/html", page("/a", "/wp-admin/x", "https://other.example/")), ("https://e.com/a", "html", 200, None, page("/b", "/")), ("https://e.com/b", "html", 200, "text/html", page("/c", "/gone")),
        ("https://e.com/c", "html", 200, "text/html", page("/d")), ("https://e.com/d", "html", 200, "text/html", page()), ("https://e.com/gone", "html", 404, "text/html", "x"), ("https://e.com/about", "html", 200, "image/png", "x"),
        ("https://e.com/empty", "html", 200, "text/html", ""), ("https://e.com/robots.txt", "text", 200, None, "Sitemap: https://e.com/index.xml"),
        ("https://e.com/index.xml", "text", 200, None, "<sitemapindex><loc>https://e.com/one.xml</loc></sitemapindex>"), ("https://e.com/one.xml", "text", 200, None, "<loc>https://e.com/empty</loc><loc>https://x.example/</loc><loc>https://e.com/d?utm_id=1</loc>"),
    ]
    return spark.createDataFrame(rows, "url string, kind string, status int, content_type string, body string")


def test_crawl(spark):
    got = crawl.crawl(site(spark), "https://e.com", use_sitemaps=False).orderBy("page_ord").collect()
    assert [(r["url"], r["depth"]) for r in got] == [("https://e.com/", 0), ("https://e.com/a", 1), ("https://e.com/b", 2), ("https://e.com/c", 3)]
    assert crawl.crawl(site(spark), "https://e.com", max_pages=2, use_sitemaps=False).count() == 2
    assert crawl.discover_sitemaps(site(spark), "https://e.com/") == ["https://e.com/empty", "https://e.com/d"]
    with_maps = {r["url"]: r["depth"] for r in crawl.crawl(site(spark), "https://e.com").collect()}
    assert with_maps["https://e.com/d"] == 1 and "https://e.com/empty" not in with_maps


def test_reach_is_least_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    got = {r["url"]: r["depth"] for r in crawl.reach(edges, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_data_source(spark, tmp_path):
    site(spark).coalesce(1).write.parquet(str(tmp_path / "s"))
    snapshot.register(spark)
    got = spark.read.format("site_snapshot").option("path", str(tmp_path / "s")).load()
    want = snapshot.fetched(site(spark))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_settings_and_keys(spark, tmp_path):
    assert settings.Settings.of({"max_pages": "7"}).max_pages == 7 and settings.Settings().max_depth == 3
    with pytest.raises(ValueError):
        settings.Settings.of({"max_depth": "0"})
    (tmp_path / "keys.txt").write_text("Gemini - k1\nunknown - z\ngoogle - k2\ngroq-nospace\n")
    assert {tuple(r) for r in settings.read_keys(spark, str(tmp_path / "keys.txt")).collect()} == {("google", "k2")}
