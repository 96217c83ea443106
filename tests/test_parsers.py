"""Payload parsers: what they accept, what they drop, what they report."""

import base64
import json
import time

from pyspark.sql import functions as F

from feedledger.sources.adapters import AdapterRegistry, BUILT_IN, Adapter, parse_payloads
from feedledger.sources.entries import entry, parsed
from feedledger.sources.feeds import feed_format
from feedledger.sources.sections import stage_entries
from helpers import column_values, payloads, rss

URL = "https://example.com/blog/feed"


def parse(spark, adapter, body, filters=None, status=200, url=URL, prerelease=False):
    """``(entries, error)`` of one payload."""
    landed = payloads(spark, ("s", body, status, url)).select(
        "*", F.lit(adapter).alias("adapter"), F.lit(filters).cast("string").alias("filters"),
        F.struct(F.lit(prerelease).alias("include_prerelease")).alias("release_policy"))
    registry = AdapterRegistry(a for a in BUILT_IN if a.name == adapter)
    row = parse_payloads(landed, registry).select("entries", "error").first()
    return row["entries"], row["error"]


def test_rss_drops_incomplete_and_resolves_links(spark):
    body = rss(("Kept", "/a/", "1 Jan 2026 10:00:00 GMT"), ("", "/b", None), ("Undated", "//cdn.org/c", None))
    entries, error = parse(spark, "feed", body)
    assert error is None
    assert [(e["heading"], e["link"]) for e in entries] == [
        ("Kept", "https://example.com/a"), ("Undated", "https://cdn.org/c")]
    assert entries[1]["published"] is None


def test_rss_categories_and_cdata(spark):
    body = ('<rss><channel><item><title><![CDATA[A & b]]></title><link>/x</link>'
            '<category domain="d">one</category><category/><category>two</category></item></channel></rss>')
    entries, _ = parse(spark, "feed", body)
    assert entries[0]["heading"] == "A & b" and entries[0]["tags"] == ["one", "two"]


def test_atom_prefers_alternate_and_ignores_updated(spark):
    body = ('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title>'
            '<updated>2026-01-06T00:00:00Z</updated><link rel="self" href="/self"/><link href="/real"/>'
            '<category term="t" label="L"/><category label="only"/></entry>'
            '<entry><title>U</title><link rel="enclosure" href="/first"/></entry></feed>')
    entries, _ = parse(spark, "feed", body)
    assert [(e["link"], e["published"], e["tags"]) for e in entries] == [
        ("https://example.com/real", None, ["t", "only"]), ("https://example.com/first", None, [])]


def test_json_feed(spark):
    body = json.dumps({"items": [{"url": "/a", "title": "A", "date_modified": "2026-01-01"},
                                 {"url": "/b"}, {"url": "/c", "title": "C", "date_published": "2026-01-02"}]})
    entries, _ = parse(spark, "feed", body)
    assert [(e["heading"], e["published"]) for e in entries] == [("A", None), ("C", "2026-01-02")]


def test_feed_errors(spark):
    assert "Unsupported feed format" in parse(spark, "feed", "<html></html>")[1]
    assert "Unsupported feed format" in parse(spark, "feed", "<rdf:RDF></rdf:RDF>")[1]
    assert "Malformed" in parse(spark, "feed", "<rss><channel>")[1]
    assert "zero entries" in parse(spark, "feed", "<rss><channel></channel></rss>")[1]
    assert parse(spark, "feed", "x", status=503)[1] == f"HTTP 503 for {URL}"
    assert parse(spark, "feed", "", status=304) == ([], None)
    assert "Invalid URL" in parse(spark, "feed", rss(("A", "http://", None)))[1]
    assert column_values(spark, ["<?xml version='1.0'?>\n<!-- c --><rss>", " {", "<feed/>", "[]"], feed_format) == [
        "rss", "json", "atom", None]


def test_releases(spark):
    rows = [dict(tag_name="v1", name="", html_url="https://h.org/1", published_at="2026-01-01T00:00:00Z", draft=False, prerelease=False),
            dict(tag_name="v2", name="Two", html_url="https://h.org/2", published_at=None, draft=False, prerelease=True),
            dict(tag_name="v3", name="Three", html_url="https://h.org/3", published_at=None, draft=True, prerelease=True)]
    entries, _ = parse(spark, "github-release", json.dumps(rows))
    assert [e["heading"] for e in entries] == ["v1"]
    entries, _ = parse(spark, "github-release", json.dumps(rows), prerelease=True)
    assert [e["heading"] for e in entries] == ["v1", "Two"]
    assert parse(spark, "github-release", "[]") == ([], None)
    assert "Malformed" in parse(spark, "github-release", "oops")[1]


def test_json_api(spark):
    body = json.dumps({"data": {"list": [{"t": "A", "u": "https://h.org/a", "d": "2026-01-01"}, {"t": "B", "u": "https://h.org/b"}]}})
    options = '{"itemsPath":"data.list","headingField":"t","linkField":"u","dateField":"d"}'
    entries, error = parse(spark, "official-api", body, options)
    assert error is None and [(e["heading"], e["published"]) for e in entries] == [("A", "2026-01-01"), ("B", None)]
    assert 'array of items at "nope"' in parse(spark, "official-api", body, '{"itemsPath":"nope"}')[1]
    assert 'items at "(root)"' in parse(spark, "official-api", body)[1]
    assert "zero items" in parse(spark, "official-api", "[]")[1]
    bad = json.dumps([{"title": "A", "url": "https://h.org/a"}, {"title": 5, "url": "https://h.org/b"}])
    assert 'item 1 is missing a valid "title" field' in parse(spark, "official-api", bad)[1]


def test_item_list_beats_tags_and_survives_bad_blocks(spark):
    good = {"@type": "ItemList", "itemListElement": [
        {"item": {"headline": "H", "name": "N", "url": "/n", "datePublished": "2026-03-01"}},
        {"url": "/u", "name": "U"}, {"name": "no link"}]}
    body = ('<script type="application/ld+json">{</script>'
            f'<script type="application/ld+json">{json.dumps([{"@type": "ItemList", "itemListElement": []}, good])}</script>'
            "<h1><a href='/tag'>Tag</a></h1>")
    entries, _ = parse(spark, "generic-html-json-ld", body)
    assert [(e["heading"], e["link"]) for e in entries] == [("N", "https://example.com/n"), ("U", "https://example.com/u")]


def test_one_malformed_element_disqualifies_its_list(spark):
    broken = {"@type": "ItemList", "itemListElement": [{"url": "/a", "name": "A"}, {"url": 5, "name": "B"}]}
    body = (f'<script type="application/ld+json">{json.dumps(broken)}</script><h1><a href="/tag">Tag</a></h1>')
    entries, _ = parse(spark, "generic-html-json-ld", body)
    assert [e["heading"] for e in entries] == ["Tag"]


def test_tag_tier(spark):
    body = """<div class="wide post"><h2><a href="/one">First &amp; best</a></h2>
        <time class="date" datetime="2026-02-10">February 11, 2026</time></div>
        <div class="postscript"><h2><a href="/no">no</a></h2></div>
        <div class='post'><a href="/two"><h2>Second</h2></a></div><div class="post"><h2>No link</h2></div>"""
    options = {"itemSelector": ".post", "headingSelector": "h2", "dateSelector": "time.date"}
    entries, _ = parse(spark, "generic-html-json-ld", body, json.dumps(options))
    assert [(e["heading"], e["link"], e["published"]) for e in entries][:2] == [
        ("First & best", "https://example.com/one", "February 11, 2026"), ("Second", "https://example.com/two", "")]
    assert len(entries) == 2
    entries, _ = parse(spark, "generic-html-json-ld", body, json.dumps({**options, "dateAttr": "datetime"}))
    assert entries[0]["published"] == "2026-02-10"
    assert "page structure" in parse(spark, "generic-html-json-ld", "<p>gone</p>", json.dumps(options))[1]


def test_stage_document(spark):
    text = ("intro [a](https://github.com/tc39/a)\n##Stage 2\n[b](https://github.com/tc39/b/)\n"
            "### stage 3 things\n[c c](https://github.com/tc39/x/c) and [d](https://github.com/tc39/d)\n[e](https://else.org/e)\n"
            "#### Stage 1\n[f](https://github.com/tc39/f)\n# Other\n[g](https://github.com/tc39/g)\n## Withdrawn\n[h](https://github.com/tc39/h)")
    got = column_values(spark, [text], stage_entries)[0]
    assert [(e["heading"], e["slug"], e["stage"]) for e in got] == [
        ("b", "b", "2"), ("c c", "c", "3"), ("d", "d", "3"), ("f", "f", "3"), ("h", "h", "withdrawn")]
    envelope = json.dumps({"content": base64.encodebytes(text.encode()).decode(), "encoding": "base64"})
    entries, error = parse(spark, "tc39-proposal-lifecycle", envelope)
    assert error is None and len(entries) == 5
    assert "zero proposals" in parse(spark, "tc39-proposal-lifecycle", "# nothing")[1]


def test_a_custom_adapter_is_one_more_branch(spark):
    def lines(body, url, filters, policy):
        return parsed(F.transform(F.split(body, "\n"), lambda x: entry(x, F.concat(F.lit("/"), x))))

    landed = payloads(spark, ("s", "a\nb", 200, URL)).select(
        "*", F.lit("lines").alias("adapter"), F.lit(None).cast("string").alias("filters"),
        F.struct(F.lit(False).alias("include_prerelease")).alias("release_policy"))
    row = parse_payloads(landed, AdapterRegistry([Adapter("lines", "announcement", lines)])).first()
    assert [e["link"] for e in row["entries"]] == ["https://example.com/a", "https://example.com/b"]


def test_a_bad_document_fails_alone(spark):
    for content in ("abcde", base64.b64encode(b"\xff\xfe## Stage 1").decode()):
        lifecycle = next(a.name for a in BUILT_IN if a.name.endswith("lifecycle"))
        entries, error = parse(spark, lifecycle, json.dumps({"content": content}))
        assert not entries and error


def test_long_prologs_and_pages_are_quick(spark):
    start = time.perf_counter()
    for prolog in (" " * 100_000, "<!-- x -->" * 20_000, "<?xml version='1.0'?>" + "\n" * 50_000):
        body = prolog + "<rss></rss>"
        assert column_values(spark, [body], feed_format) == ["rss"]
    assert time.perf_counter() - start < 20
