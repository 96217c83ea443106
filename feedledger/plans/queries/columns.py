"""Column functions and row filters."""

from pyspark.sql import functions as F

from . import query, table, wall
from .inputs import LABEL_STATES, LABELS_NOW, ORDERS_NOW, label_states
from ...functions import dates, text, urls
from ...operators.checks import ID_FORMAT
from ...operators.scope import in_scope
from ...sources.repositories import releasable

_CANONICAL = r"""
  SELECT page_id, url,
         lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://'
         || regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '')
         || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE '/' END
         || CASE WHEN len(params) = 0 THEN '' ELSE '?' || array_to_string(list_sort(params), '&') END AS link
  FROM (
    SELECT page_id, url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
           list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p:
             p <> '' AND NOT lower(p) LIKE 'utm\_%' ESCAPE '\'
             AND NOT regexp_extract(lower(p), '^([^=]*)', 1) IN
               ('fbclid', 'gclid', 'msclkid', 'mc_cid', 'mc_eid', 'igshid', 'ref', 'ref_src', 'source')) AS params
    FROM pages)"""


@query(f"SELECT page_id, link FROM ({_CANONICAL})")
def canonical_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("link"))


@query(f"SELECT page_id, substr(sha256(link), 1, 16) AS id FROM ({_CANONICAL})")
def page_ids(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", text.item_id(urls.canonical_url(F.col("url"))).alias("id"))


@query(r"""
  SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'),
                              lambda s: s <> '')[-1] AS slug,
         list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')[1] AS owner,
         list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')[2] AS repo
  FROM pages""")
def page_slugs(spark, folder):
    pair = urls.owner_and_repo(F.col("url"))
    return table(spark, folder, "pages").select(
        "page_id", urls.last_segment(F.col("url")).alias("slug"),
        pair["owner"].alias("owner"), pair["repo"].alias("repo"))


_TEXT = r"""trim(replace(replace(replace(replace(replace(replace(
  regexp_replace(h, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'))"""


@query(rf"""SELECT page_id, {_TEXT} AS heading
  FROM (SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages)""")
def page_headings(spark, folder):
    heading = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return table(spark, folder, "pages").select("page_id", text.markup_text(heading).alias("heading"))


@query(r"""
  SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, href,
         regexp_extract(url, '^([a-z]+)://', 1) || '://'
         || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')
         || array_to_string(list_transform(string_split(href, ''),
              lambda c: CASE WHEN regexp_matches(c, '[^\x21-\x7e]') THEN url_encode(c) ELSE c END), '') AS link
  FROM (SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos
        FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a href="(/[^"]+)"', 1) AS hrefs FROM pages))""")
def page_links(spark, folder):
    hrefs = F.regexp_extract_all("html", F.lit(r'(?i)<a href="(/[^"]+)"'), F.lit(1))
    return (table(spark, folder, "pages").select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))
            .select("page_id", "pos", "href",
                    urls.canonical_url(urls.resolve_link(F.col("href"), F.col("url"))).alias("link")))


@query(r"""
  SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 2 THEN o_orderdate + INTERVAL 5 HOUR
                                      WHEN 4 THEN NULL ELSE o_orderdate END AS TIMESTAMP) AS published,
         CASE WHEN o_orderkey % 5 = 4 THEN 'discovered' ELSE 'published' END AS date_basis,
         CAST(CASE WHEN o_orderkey % 5 = 4 THEN TIMESTAMP '2001-08-02' ELSE o_orderdate END AS DATE) AS date
  FROM orders""")
def written_dates(spark, folder):
    """Order dates written in several forms, weekday included, and read back."""
    at = F.col("o_orderdate")
    form = F.col("o_orderkey") % 5
    written = (F.when(form == 0, F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
               .when(form == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
               .when(form == 2, F.concat(F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit(" EST")))
               .when(form == 3, F.date_format(at, "MMMM d, yyyy"))
               .otherwise(F.lit("some day soon")))
    return (table(spark, folder, "orders").select("o_orderkey", dates.trustworthy_timestamp(written).alias("p"))
            .select("o_orderkey", wall("p").alias("published"), dates.date_basis(F.col("p")).alias("date_basis"),
                    dates.item_date(F.col("p"), ORDERS_NOW).alias("date")))


@query("""
  SELECT event_id, CASE event_type WHEN 'view' THEN 'Engineering Article' WHEN 'click' THEN 'Announcement'
         WHEN 'purchase' THEN 'Release' WHEN 'error' THEN 'Security Advisory' ELSE 'RFC/Proposal' END AS label,
         CASE WHEN value > 50 THEN 'Deprecation' WHEN event_type = 'view' THEN 'Engineering Article'
              WHEN event_type = 'click' THEN 'Announcement' WHEN event_type = 'purchase' THEN 'Release'
              WHEN event_type = 'error' THEN 'Security Advisory' ELSE 'RFC/Proposal' END AS shown_label
  FROM events""")
def event_labels(spark, folder):
    from ...sources.feeds import label_override
    kind = F.expr("CASE event_type WHEN 'view' THEN 'feed-entry' WHEN 'click' THEN 'api-item' "
                  "WHEN 'purchase' THEN 'github-stable-release' WHEN 'error' THEN 'github-security-advisory' "
                  "ELSE 'rfc-proposal-opened' END")
    options = F.when(F.col("value") > 50, F.lit('{"label":"Deprecation"}')).otherwise(F.lit("{}"))
    return table(spark, folder, "events").select(
        "event_id", text.label_for(kind).alias("label"),
        F.coalesce(label_override(options), text.label_for(kind)).alias("shown_label"))


@query("""
  SELECT p_partkey, array_to_string(list_sort(list_distinct(
           list_concat([p_type, p_brand], string_split(p_name, ' ')))), '|') AS tags FROM part""")
def tag_union(spark, folder):
    tags = text.tag_union(F.array("p_type", "p_brand"), F.split("p_name", " "))
    return table(spark, folder, "part").select("p_partkey", F.array_join(tags, "|").alias("tags"))


@query("SELECT event_id, len(json_keys(props)) AS specificity FROM events")
def option_counts(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", text.specificity(F.col("props")).cast("long").alias("specificity"))


@query("""
  SELECT p_partkey, substr(sha256('tc39:' || p_name || ':' || e), 1, 16) AS id,
         p_name || ' — ' || CASE WHEN p_size % 5 = 0 THEN 'withdrawn' ELSE 'Stage ' || (p_size % 5) END AS heading
  FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN 'withdrawn' ELSE 'transition:' || (p_size % 5) END AS e FROM part)""")
def lifecycle_names(spark, folder):
    stage = F.expr("CASE WHEN p_size % 5 = 0 THEN 'withdrawn' ELSE CAST(p_size % 5 AS STRING) END")
    event = F.when(stage == "withdrawn", stage).otherwise(F.concat(F.lit("transition:"), stage))
    return table(spark, folder, "part").select(
        "p_partkey", text.item_id(text.lifecycle_key(F.col("p_name"), event)).alias("id"),
        text.lifecycle_heading(F.col("p_name"), stage).alias("heading"))


@query("""
  SELECT o_orderkey, o_orderdate + INTERVAL 2 MONTH AS expires_at,
         o_orderstatus = 'F' AND TIMESTAMP '2001-08-02' >= o_orderdate + INTERVAL 2 MONTH AS expired
  FROM orders""")
def read_expiry(spark, folder):
    at = F.col("o_orderdate").cast("timestamp")
    state = F.when(F.col("o_orderstatus") == "F", F.lit("read")).otherwise(F.lit("unread"))
    return table(spark, folder, "orders").select(
        "o_orderkey", wall(dates.add_calendar_months(at, 2)).alias("expires_at"),
        dates.is_read_expired(state, at, ORDERS_NOW).alias("expired"))


@query("""
  SELECT event_id, event_type = 'error' AND TIMESTAMP '2024-01-30' - ts < INTERVAL 48 HOUR AS live,
         TIMESTAMP '2024-01-30' - ts > INTERVAL 36 HOUR AS stale FROM events""")
def tombstones(spark, folder):
    at = F.col("ts").cast("timestamp")
    state = F.when(F.col("event_type") == "error", F.lit("ignored")).otherwise(F.lit("read"))
    return table(spark, folder, "events").select(
        "event_id", dates.is_live_tombstone(state, at, "2024-01-30 00:00:00").alias("live"),
        dates.is_stale(at, "2024-01-30 00:00:00").alias("stale"))


@query(r"""
  SELECT page_id, url FROM pages
  WHERE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) LIKE '/en/%'""")
def scoped_pages(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.where(in_scope(F.lit(""), F.col("url"), path_prefix=F.lit("/en/"))).select("page_id", "url")


@query("""
  SELECT p_partkey, p_name FROM part
  WHERE lower(p_name) LIKE '%ring%' AND NOT lower(p_name) LIKE '%small%'""")
def scoped_parts(spark, folder):
    parts = table(spark, folder, "part")
    return parts.where(in_scope(F.col("p_name"), F.lit(None), contains=F.lit("RING"),
                                excludes=F.lit("Small"))).select("p_partkey", "p_name")


@query("""
  SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F')
    AND (NOT (o_orderstatus = 'P') OR o_orderpriority IN ('1-URGENT', '2-HIGH'))""")
def release_policy(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.where(releasable(
        F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P",
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))).select("o_orderkey")


@query(f"""
  SELECT id, regexp_matches(substr(sha256(id), 1, CASE WHEN state = 'ignored' THEN 15 ELSE 16 END),
                            '^[0-9a-f]{{16}}$') AS well_formed FROM ({LABEL_STATES})""")
def id_format(spark, folder):
    given = F.when(F.col("state") == "ignored", F.substring(text.item_id(F.col("id")), 1, 15)).otherwise(
        text.item_id(F.col("id")))
    return label_states(spark, folder).select("id", given.rlike(ID_FORMAT).alias("well_formed"))


@query(f"""
  SELECT id, CASE WHEN state = 'ignored' AND TIMESTAMP '{LABELS_NOW}' - ignored_at >= INTERVAL 48 HOUR THEN 'pruned'
                  WHEN state = 'ignored' THEN 'ignored'
                  WHEN state = 'read' AND TIMESTAMP '{LABELS_NOW}' >= read_at + INTERVAL 2 MONTH THEN 'expired'
                  ELSE 'kept' END AS fate
  FROM ({LABEL_STATES})""")
def state_fates(spark, folder):
    from ...operators.states import with_fate
    return with_fate(label_states(spark, folder), LABELS_NOW).select("id", "fate")
