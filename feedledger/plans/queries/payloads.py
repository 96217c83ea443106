"""Payload parsers, each over payload text built from one table row."""

from pyspark.sql import Column, DataFrame, functions as F

from . import query, table, wall
from ...functions.dates import date_basis, trustworthy_timestamp
from ...functions.text import tag_union
from ...functions.urls import let
from ...operators import lifecycle
from ...operators.outcomes import source_outcomes
from ...session import evenly_parallel
from ...sources.adapters import AdapterRegistry, BUILT_IN, parse_payloads
from ...sources.entries import with_canonical_links
from ...sources.feeds import parse_feed
from ...sources.json_api import parse_json_api
from ...sources.repositories import (
    parse_pulls, parse_releases, pulls_adding_files, with_added_files,
)
from ...sources.sections import parse_stage_document, split_before
from ...sources.web_pages import parse_web_page


def _entries(rows: DataFrame, key: str, parse, filters: Column | None = None,
             prerelease: Column | None = None, canonical: bool = True) -> DataFrame:
    """Parse ``body`` of every row and explode the entries."""
    policy = F.struct((F.lit(False) if prerelease is None else prerelease).alias("include_prerelease"))
    result = parse(F.col("body"), F.col("url"),
                   F.lit(None).cast("string") if filters is None else filters, policy)
    if canonical:
        result = with_canonical_links(result, F.col("url"))
    # A filter on the error would be pushed below the parser and run it a second time.
    usable = F.when(F.col("r.error").isNull(), F.col("r.entries"))
    return evenly_parallel(rows).withColumn("r", result).select(key, F.posexplode(usable).alias("at", "e"))


def _tags() -> Column:
    return F.array_join(tag_union(F.array().cast("array<string>"), F.col("e.tags")), "|").alias("tags")


def _published() -> list[Column]:
    at = trustworthy_timestamp(F.col("e.published"))
    return [wall(at).alias("published"), date_basis(at).alias("date_basis")]


_FEED_COLUMNS = """
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS published,
  CASE WHEN o_orderstatus = 'P' THEN 'discovered' ELSE 'published' END AS date_basis"""


@query(f"""
  SELECT o_orderkey, 0 AS at, 'Order ' || o_orderkey || ' & more' AS heading,
         'https://shop.example.com/orders/' || o_orderkey AS link,
         o_orderpriority AS tags, {_FEED_COLUMNS} FROM orders
  UNION ALL
  SELECT o_orderkey, 1, 'Customer ' || o_custkey, 'https://cdn.example.com/c/' || o_custkey, '', NULL, 'discovered'
  FROM orders""")
def feed_rss(spark, folder):
    """Three entries per document, one of them without a title."""
    dated = F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.concat(
        F.lit("<pubDate>"), F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>")))
    body = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>Orders</title><item><title>Order '),
        F.col("o_orderkey"), F.lit(" &amp; more</title><link>/orders/"), F.col("o_orderkey"),
        F.lit("?utm_source=rss</link><category domain=\"p\">"), F.col("o_orderpriority"), F.lit("</category>"),
        dated, F.lit("</item><item><link>/untitled</link></item><item><title>Customer "), F.col("o_custkey"),
        F.lit("</title><link>//cdn.example.com/c/"), F.col("o_custkey"),
        F.lit("</link></item></channel></rss>"))
    rows = table(spark, folder, "orders").select(
        "o_orderkey", body.alias("body"), F.lit("https://www.shop.example.com/feeds/rss.xml").alias("url"))
    return _entries(rows, "o_orderkey", parse_feed).select(
        "o_orderkey", "at", "e.heading", "e.link", _tags(), *_published())


@query(f"""
  SELECT o_orderkey, 'Order ' || o_orderkey AS heading,
         'https://example.com/blog/orders/' || o_orderkey AS link,
         array_to_string(list_sort(list_distinct([o_orderpriority, o_orderstatus])), '|') AS tags,
         {_FEED_COLUMNS} FROM orders""")
def feed_atom(spark, folder):
    """``updated`` is always there and never a publication date."""
    dated = F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.concat(
        F.lit("<published>"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published>")))
    body = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Order '), F.col("o_orderkey"),
        F.lit('</title><updated>2020-01-01T00:00:00Z</updated>'), dated,
        F.lit('<link rel="self" href="/self"/><link rel="alternate" href="orders/'), F.col("o_orderkey"),
        F.lit('"/><category term="'), F.col("o_orderpriority"), F.lit('"/><category label="'),
        F.col("o_orderstatus"), F.lit('"/></entry></feed>'))
    rows = table(spark, folder, "orders").select(
        "o_orderkey", body.alias("body"), F.lit("https://example.com/blog/atom.xml").alias("url"))
    return _entries(rows, "o_orderkey", parse_feed).select(
        "o_orderkey", "e.heading", "e.link", _tags(), *_published())


@query("""
  SELECT p_partkey, p_name AS heading, 'https://example.com/parts/' || p_partkey AS link,
         array_to_string(list_sort([p_brand, p_type]), '|') AS tags,
         CAST(NULL AS TIMESTAMP) AS published, 'discovered' AS date_basis
  FROM part WHERE p_name <> ''""")
def feed_json(spark, folder):
    body = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("https://example.com/parts/"), "p_partkey", F.lit("/#top")).alias("url"),
        F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("tags"),
        F.lit("2024-01-01T00:00:00Z").alias("date_modified"))).alias("items")))
    rows = table(spark, folder, "part").select(
        "p_partkey", body.alias("body"), F.lit("https://example.com/feed.json").alias("url"))
    return _entries(rows, "p_partkey", parse_feed).select(
        "p_partkey", "e.heading", "e.link", _tags(), *_published())


@query("""
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Release ' || o_orderkey ELSE 'v' || o_orderkey END AS heading,
         'https://example.com/o/r/releases/tag/v' || o_orderkey AS link,
         CAST(o_orderdate AS TIMESTAMP) AS published
  FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')""")
def releases(spark, folder):
    """One release per payload, as an object rather than an array."""
    body = F.to_json(F.struct(
        F.concat(F.lit("v"), "o_orderkey").alias("tag_name"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Release "), "o_orderkey"))
        .when(F.col("o_orderkey") % 3 == 1, F.lit("")).alias("name"),
        F.concat(F.lit("https://www.example.com/o/r/releases/tag/v"), "o_orderkey").alias("html_url"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        (F.col("o_orderstatus") == "F").alias("draft"), (F.col("o_orderstatus") == "P").alias("prerelease")))
    rows = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderpriority") == "1-URGENT").alias("pre"), body.alias("body"),
        F.lit("https://example.com/o/r").alias("url"))
    return _entries(rows, "o_orderkey", parse_releases, prerelease=F.col("pre")).select(
        "o_orderkey", "e.heading", "e.link", _published()[0])


@query("""
  SELECT event_id, event_type AS heading, 'https://example.com/e/' || event_id AS link,
         CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) END AS published
  FROM events WHERE event_id % 5 <> 0""")
def api_items(spark, folder):
    """Item path and field names come from options; every fifth payload lacks a heading."""
    row = F.struct(
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("what"),
        F.concat(F.lit("https://example.com/e/"), "event_id").alias("where"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    body = F.to_json(F.struct(F.struct(F.array(row).alias("entries")).alias("data")))
    options = F.when(F.col("event_id") % 2 == 0, F.lit(
        '{"itemsPath":"data.entries","headingField":"what","linkField":"where","dateField":"at"}')).otherwise(
        F.lit('{"itemsPath":"data.entries","headingField":"what","linkField":"where"}'))
    rows = table(spark, folder, "events").select(
        "event_id", body.alias("body"), options.alias("filters"), F.lit("https://example.com/api").alias("url"))
    return _entries(rows, "event_id", parse_json_api, filters=F.col("filters")).select(
        "event_id", "e.heading", "e.link", _published()[0])


@query("""
  SELECT event_id, 'API response from "https://example.com/api" item 0 is missing a valid "what" field' AS error
  FROM events WHERE event_id % 5 = 0""")
def api_failures(spark, folder):
    row = F.struct(F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("what"),
                   F.concat(F.lit("https://example.com/e/"), "event_id").alias("url"))
    result = parse_json_api(F.to_json(F.array(row)), F.lit("https://example.com/api"),
                            F.lit('{"headingField":"what"}'), F.lit(None))
    return (table(spark, folder, "events").select("event_id", result["error"].alias("error"))
            .where("error IS NOT NULL"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def event_props(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("""
  SELECT page_id, 0 AS at, 'Page ' || page_id AS heading, 'https://example.com/p/' || page_id AS link,
         TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 28 AS INTEGER)) AS published FROM pages
  UNION ALL
  SELECT page_id, 1, 'Also ' || page_id, 'https://example.com/q/' || page_id, NULL FROM pages""")
def page_item_lists(spark, folder):
    """Pages with a broken block, an unusable list and a good list in front of the html."""
    day = F.date_format(F.expr("date_add(DATE'2024-01-01', CAST(page_id % 28 AS INT))"), "yyyy-MM-dd")
    block = '<script type="application/ld+json">'
    body = F.concat(
        F.lit(f'{block}{{broken</script>{block}[{{"@type":"Thing"}},{{"@type":"ItemList","itemListElement":[]}}]'
              f'</script>{block}{{"@type":"ItemList","itemListElement":[{{"item":{{"headline":"Page '),
        F.col("page_id"), F.lit('","url":"/p/'), F.col("page_id"), F.lit('","datePublished":"'), day,
        F.lit('"}},{"item":{"headline":"No link"}},{"url":"/q/'), F.col("page_id"),
        F.lit('","name":"Also '), F.col("page_id"), F.lit('","headline":"unused"}]}</script>'), F.col("html"))
    rows = table(spark, folder, "pages").select(
        "page_id", body.alias("body"), F.lit("https://example.com/list").alias("url"))
    return _entries(rows, "page_id", parse_web_page).select(
        "page_id", "at", "e.heading", "e.link", _published()[0])


@query(r"""
  SELECT page_id, trim(replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS heading,
    regexp_extract(url, '^([a-z]+)://', 1) || '://'
      || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')
      || array_to_string(list_transform(string_split(regexp_extract(html, '(?i)<a href="([^"]+)"', 1), ''),
           lambda c: CASE WHEN regexp_matches(c, '[^\x21-\x7e]') THEN url_encode(c) ELSE c END), '') AS link
  FROM pages""")
def page_entries(spark, folder):
    """Pages hold no item list, so tag names decide: a heading and the first link."""
    rows = table(spark, folder, "pages").select("page_id", F.col("html").alias("body"), "url")
    options = F.lit('{"headingSelector":"h1","linkSelector":"a"}')
    return _entries(rows, "page_id", parse_web_page, filters=options).select(
        "page_id", "e.heading", "e.link")


@query(r"""
  SELECT page_id, CAST(pos - 1 AS INTEGER) AS at, heading, 'https://example.com' || href AS link
  FROM (SELECT page_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS pos,
               regexp_extract(unnest(ms), '>([^<]+)</a>', 1) AS heading,
               array_to_string(list_transform(string_split(regexp_extract(unnest(ms), 'href="([^"]+)"', 1), ''),
                 lambda c: CASE WHEN regexp_matches(c, '[^\x21-\x7e]') THEN url_encode(c) ELSE c END), '') AS href
        FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]+">[^<]+</a></li>') AS ms FROM pages))""")
def page_containers(spark, folder):
    """Every list item is a container whose heading is the link itself."""
    rows = table(spark, folder, "pages").select(
        "page_id", F.col("html").alias("body"), F.lit("https://example.com/").alias("url"))
    options = F.lit('{"itemSelector":"li","headingSelector":"a"}')
    return _entries(rows, "page_id", parse_web_page, filters=options).select(
        "page_id", "at", "e.heading", "e.link")


def _order_pulls(spark, folder) -> DataFrame:
    body = F.to_json(F.array(F.struct(
        F.col("o_orderkey").alias("number"), F.concat(F.lit("Pull "), "o_orderkey").alias("title"),
        F.concat(F.lit("https://example.com/o/r/pull/"), "o_orderkey").alias("html_url"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'23:30:00-05:00").alias("created_at"))))
    return table(spark, folder, "orders").select(
        F.lit("s").alias("source_id"), body.alias("body"), F.lit("https://api.example.com/pulls").alias("url"))


@query("""
  SELECT CAST(o_orderkey AS VARCHAR) AS number, 'Pull ' || o_orderkey AS heading,
         CAST(o_orderdate AS TIMESTAMP) AS published FROM orders""")
def pull_requests(spark, folder):
    """The date part counts as written, whatever its offset."""
    return _entries(_order_pulls(spark, folder), "source_id", parse_pulls).select(
        F.col("e.slug").alias("number"), "e.heading", _published()[0])


@query("""
  SELECT CAST(o_orderkey AS VARCHAR) AS number FROM orders
  WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = 'F')""")
def proposal_pulls(spark, folder):
    """Pull requests that add a file below the folder; one files payload per line item."""
    files = F.to_json(F.array(F.struct(
        F.concat(F.when(F.col("l_linestatus") == "F", F.lit("proposals/")).otherwise(F.lit("docs/")),
                 F.col("l_linenumber")).alias("filename"),
        F.when(F.col("l_returnflag") == "R", F.lit("added")).otherwise(F.lit("modified")).alias("status"))))
    changed = table(spark, folder, "lineitem").select(
        F.lit("s").alias("source_id"), files.alias("body"),
        F.concat(F.lit("https://api.example.com/pulls/"), "l_orderkey", F.lit("/files")).alias("url"))
    pulls = _entries(_order_pulls(spark, folder), "source_id", parse_pulls).select(
        "source_id", F.col("e.slug").alias("slug"))
    return with_added_files(pulls, pulls_adding_files(changed)).select(F.col("slug").alias("number"))


_STAGE = "CASE WHEN p_size % 5 = 0 THEN 'withdrawn' ELSE CAST(p_size % 5 AS VARCHAR) END"


def _part_snapshot(spark, folder) -> DataFrame:
    """A document per part, base64 in a JSON envelope, with an unrelated section first."""
    section = F.when(F.col("p_size") % 5 == 0, F.lit("Withdrawn Things")).otherwise(
        F.concat(F.lit("stage "), F.col("p_size") % 5, F.lit(" (of four)")))
    markdown = F.concat(
        F.lit("# Notes\n[x](https://github.com/tc39/notes)\n## "), section, F.lit("\n\n| a | b |\n| ["),
        F.col("p_name"), F.lit("](https://github.com/tc39/part-"), F.col("p_partkey"),
        F.lit(") | [elsewhere](https://example.com/) |\n### Other\n[y](https://github.com/tc39/other)\n"))
    envelope = F.to_json(F.struct(F.base64(markdown.cast("binary")).alias("content"),
                                  F.lit("base64").alias("encoding")))
    rows = table(spark, folder, "part").select(
        "p_partkey", "p_brand", envelope.alias("body"), F.lit("https://example.com/readme").alias("url"))
    return _entries(rows, "p_partkey", parse_stage_document, canonical=False)


@query(f"""
  SELECT p_partkey, p_name AS heading, 'part-' || p_partkey AS slug, {_STAGE} AS stage FROM part""")
def stage_documents(spark, folder):
    return _part_snapshot(spark, folder).select("p_partkey", "e.heading", "e.slug", "e.stage")


@query(f"""
  SELECT slug, CASE WHEN before IS NULL THEN 'new:' || stage WHEN stage = 'withdrawn' THEN 'withdrawn'
                    ELSE 'transition:' || stage END AS event,
         CASE WHEN before IS NULL THEN 'RFC/Proposal' WHEN stage = 'withdrawn' THEN 'Retired'
              ELSE 'Improvement' END AS label
  FROM (SELECT 'part-' || p_partkey AS slug, {_STAGE} AS stage,
               CASE WHEN p_partkey % 3 <> 0 THEN CAST(1 + p_partkey % 4 AS VARCHAR) END AS before FROM part)
  WHERE before IS DISTINCT FROM stage""")
def stage_changes(spark, folder):
    """Snapshot from the documents against stages known for two parts out of three."""
    snapshot = _part_snapshot(spark, folder).select(
        F.lit("s").alias("source_id"), F.col("e.slug").alias("slug"), F.col("e.stage").alias("stage"))
    known = table(spark, folder, "part").where("p_partkey % 3 <> 0").select(
        F.lit("s").alias("source_id"), F.concat(F.lit("part-"), "p_partkey").alias("slug"),
        (1 + F.col("p_partkey") % 4).cast("string").alias("stage"))
    moved = lifecycle.stage_events(snapshot, known)
    return moved.select("slug", "event", lifecycle.event_label(F.col("event")).alias("label"))


@query(r"""
  SELECT doc_id, mark, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars
  FROM (SELECT doc_id, line, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS mark
        FROM (SELECT doc_id, line, pos,
                     CASE WHEN regexp_matches(line, '^[A-Z][a-z]*[.]') THEN regexp_extract(line, '^[A-Z][a-z]*[.]') END AS own
              FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
                    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))))
  GROUP BY doc_id, mark""")
def section_fill(spark, folder):
    """Lines of documents carry the mark of the last marked line above them."""
    cut = split_before(F.col("text"), r"(?md)^(?=[A-Z][a-z]*[.])")
    # A piece that another one follows ends with the newline in front of that one.
    pieces = let(cut, lambda ps: F.transform(ps, lambda p, i: F.when(
        i < F.size(ps) - 1, F.regexp_replace(p, r"\n\z", "")).otherwise(p)))
    sections = table(spark, folder, "documents").select("doc_id", F.explode(pieces).alias("piece"))
    own = F.regexp_extract("piece", r"^[A-Z][a-z]*[.]", 0)
    lines = F.split("piece", "\n")
    counted = sections.select(
        "doc_id", F.when(own != "", own).alias("mark"),
        F.size(lines).cast("long").alias("lines"),
        F.aggregate(lines, F.lit(0).cast("long"), lambda a, s: a + F.length(s)).alias("chars"))
    return counted.groupBy("doc_id", "mark").agg(F.sum("lines").alias("lines"), F.sum("chars").alias("chars"))


@query("""
  WITH landed AS (
    SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 503 WHEN event_type = 'signup' THEN 304
                                   WHEN event_type = 'view' THEN 204 ELSE 200 END AS status FROM events)
  SELECT CAST(user_id AS VARCHAR) AS source_id,
         CASE WHEN user_id % 9 = 0 THEN 'planned' WHEN count(*) FILTER (WHERE status IN (200, 304)) > 0 THEN 'succeeded'
              ELSE 'failed' END AS outcome,
         CASE WHEN user_id % 9 <> 0 AND count(*) FILTER (WHERE status IN (200, 304)) > 0
              THEN count(*) FILTER (WHERE status = 200) END AS items
  FROM landed GROUP BY user_id""")
def landed_fetch(spark, folder):
    """Events as landed fetches of a source per user: 304 is success, 503 and empty are not."""
    kind = F.col("event_type")
    status = F.expr("CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 304 WHEN 'view' THEN 204 ELSE 200 END")
    body = F.when(kind == "view", F.lit("[]")).otherwise(F.to_json(F.array(F.struct(
        kind.alias("title"), F.concat(F.lit("https://example.com/"), "event_id").alias("url")))))
    events = table(spark, folder, "events")
    landed = events.select(
        F.col("user_id").cast("string").alias("source_id"), F.lit("https://example.com/api").alias("url"),
        status.alias("http_status"), F.col("ts").cast("timestamp").alias("fetched_at"), body.alias("body"),
        F.col("event_id").alias("seq"), F.lit("official-api").alias("adapter"),
        F.lit(None).cast("string").alias("filters"),
        F.lit(None).cast("struct<include_prerelease:boolean>").alias("release_policy"))
    registry = AdapterRegistry(a for a in BUILT_IN if a.name == "official-api")
    parsed = parse_payloads(evenly_parallel(landed), registry)
    found = parsed.where("error IS NULL").select("source_id", F.explode("entries"))
    sources = events.select("user_id").distinct().select(
        F.col("user_id").cast("string").alias("id"), F.col("user_id").alias("pos"),
        F.when(F.col("user_id") % 9 == 0, F.lit("planned")).otherwise(F.lit("active")).alias("status"))
    return source_outcomes(sources, parsed, found, "2024-01-31 00:00:00").select("source_id", "outcome", "items")
