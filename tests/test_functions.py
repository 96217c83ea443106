"""Column functions on their edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedledger.functions import dates, text, urls
from helpers import column_values


@pytest.mark.parametrize("raw, expected", [
    ("https://site.example/posts/item-7", "https://site.example/posts/item-7"),
    ("HTTPS://Site.example/posts/item-7", "https://site.example/posts/item-7"),
    ("https://www.site.example/posts/item-7", "https://site.example/posts/item-7"),
    ("https://site.example/posts/item-7/", "https://site.example/posts/item-7"),
    ("https://site.example/", "https://site.example/"),
    ("https://site.example", "https://site.example/"),
    ("https://site.example/posts/item-7#part", "https://site.example/posts/item-7"),
    ("https://site.example:443/posts/item-7", "https://site.example/posts/item-7"),
    ("http://site.example:443/a", "http://site.example:443/a"),
    ("https://site.example/a?utm_source=n&ref=w&z=1&a=2", "https://site.example/a?a=2&z=1"),
    ("https://site.example/a?REF=w&UTM_X=1&refs=2", "https://site.example/a?refs=2"),
    ("https://h.org/Owner/Repo?Q=Upper", "https://h.org/Owner/Repo?Q=Upper"),
    ("http://h.org/x/../y/./z", "http://h.org/y/z"),
    ("http://h.org/a b/é", "http://h.org/a%20b/%C3%A9"),
    ("http://h.org/?b=2&a=x%20y&B=3", "http://h.org/?a=x+y&b=2&B=3"),
    ("http://u:p@h.org:8080/a", "http://u:p@h.org:8080/a"),
    ("  https://h.org/a\n", "https://h.org/a"),
    ("/only/a/path", None), ("not a url", None), ("", None), (None, None),
])
def test_canonical_url(spark, raw, expected):
    assert column_values(spark, [raw], urls.canonical_url) == [expected]


def test_canonical_url_is_idempotent(spark):
    raw = ["http://www.A.org/x/../é y/?b=%41&utm_a=1&a=%2F", "https://b.org:443//x/"]
    once = column_values(spark, raw, urls.canonical_url)
    assert column_values(spark, once, urls.canonical_url) == once


@pytest.mark.parametrize("link, expected", [
    ("/a/b", "https://h.org:8443/a/b"), ("//cdn.org/y", "https://cdn.org/y"),
    ("rel", "https://h.org:8443/blog/rel"), ("?q=1", "https://h.org:8443/blog/feed.xml?q=1"),
    ("#f", "https://h.org:8443/blog/feed.xml?a=b#f"), ("http://o.org/", "http://o.org/"),
    ("../up", "https://h.org:8443/blog/../up"),
])
def test_resolve_link(spark, link, expected):
    base = F.lit("https://h.org:8443/blog/feed.xml?a=b#top")
    assert column_values(spark, [link], lambda c: urls.resolve_link(c, base)) == [expected]


def test_url_parts(spark):
    given = ["https://h.org/owner/repo/tree/main", "https://h.org/owner", "https://h.org"]
    assert column_values(spark, given, urls.last_segment) == ["main", "owner", "https://h.org"]
    pairs = column_values(spark, given, urls.owner_and_repo)
    assert tuple(pairs[0]) == ("owner", "repo") and pairs[1:] == [None, None]


@pytest.mark.parametrize("written, expected", [
    ("Thu, 02 Jan 2026 10:00:00 GMT", dt.datetime(2026, 1, 2, 10)),  # the weekday is wrong
    ("2 Jan 2026 10:00 +0130", dt.datetime(2026, 1, 2, 8, 30)),
    ("2026-01-05T09:00:00Z", dt.datetime(2026, 1, 5, 9)),
    ("2026-01-05T09:00:00.5-02:00", dt.datetime(2026, 1, 5, 11, 0, 0, 500000)),
    ("2026-01-05", dt.datetime(2026, 1, 5)),
    ("February 10, 2026", dt.datetime(2026, 2, 10)),
    ("Tue Feb 10 2026 10:00:00 GMT+0200 (CEST)", dt.datetime(2026, 2, 10, 8)),
    ("10 Feb 2026 10:00:00 PST", dt.datetime(2026, 2, 10, 18)),
    ("2026-02-31", dt.datetime(2026, 3, 3)),
    ("2026-13-01", None), ("soon", None), ("", None), (None, None), ("2026-01-05T09:61:00Z", None),
])
def test_trustworthy_timestamp(spark, written, expected):
    assert column_values(spark, [written], dates.trustworthy_timestamp) == [expected]


@pytest.mark.parametrize("start, expected", [
    ("2025-12-31 00:00:00", "2026-02-28 00:00:00"), ("2027-12-31 00:00:00", "2028-02-29 00:00:00"),
    ("2026-01-31 00:00:00", "2026-03-31 00:00:00"), ("2026-11-15 12:00:00", "2027-01-15 12:00:00"),
    ("2026-03-15 08:30:45.123", "2026-05-15 08:30:45.123"),
])
def test_calendar_months_clamp_and_keep_the_time(spark, start, expected):
    got = column_values(spark, [start], lambda c: dates.add_calendar_months(c.cast("timestamp"), 2))
    assert got == [dt.datetime.fromisoformat(expected)]


def test_expiry_boundaries(spark):
    def live(at):
        return dates.is_live_tombstone(F.lit("ignored"), at.cast("timestamp"), "2026-01-03 00:00:00")

    assert column_values(spark, ["2026-01-01 00:00:00", "2026-01-01 00:00:00.001", None], live) == [
        False, True, False]

    def expired(at):
        return dates.is_read_expired(F.lit("read"), at.cast("timestamp"), "2026-03-01 00:00:00")

    assert column_values(spark, ["2026-01-01 00:00:00", "2026-01-01 00:00:00.001", None], expired) == [
        True, False, False]
    assert column_values(spark, ["2026-01-01 12:00:00", "2026-01-01 11:59:59.999"], lambda c: dates.is_stale(
        c.cast("timestamp"), "2026-01-03 00:00:00")) == [False, True]


def test_window_start(spark):
    def start(last):
        return dates.window_start(last.cast("timestamp"), F.lit("2025-01-01").cast("date"), "2026-02-01 00:00:00")

    assert column_values(spark, [None, "2026-01-31 12:00:00", "2026-01-22 00:00:00"], start) == [
        dt.datetime(2025, 1, 1), dt.datetime(2026, 1, 30, 12), dt.datetime(2026, 1, 22)]


def test_text_functions(spark):
    assert column_values(spark, ['{"a":1,"b":{"c":2}}', "{}", None], text.specificity) == [2, 0, 0]
    assert column_values(spark, ["<b>A &amp;lt; B</b>  "], text.markup_text) == ["A &lt; B"]
    tags = column_values(spark, ["b"], lambda c: text.tag_union(F.array(c, F.lit("a")), F.array(F.lit("b"), F.lit("C"))))
    assert tags == [["C", "a", "b"]]
    assert column_values(spark, ["withdrawn", "3"], lambda c: text.lifecycle_heading(F.lit("X"), c)) == [
        "X — withdrawn", "X — Stage 3"]
    assert column_values(spark, [1, 2], lambda c: text.plural(c, "source"), "int") == ["1 source", "2 sources"]
    assert column_values(spark, ["tc39-withdrawal", "unheard-of"], text.label_for) == ["Retired", None]
