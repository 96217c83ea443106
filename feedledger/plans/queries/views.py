"""Read views."""

from pyspark.sql import functions as F

from . import query, table, wall
from .inputs import (
    DOCUMENT_ITEMS, LABEL_STATES, SUPPLIER_MONITORED, document_items, label_states,
    region_categories, supplier_sources, supplier_status,
)
from .runs import OUTCOMES, user_outcomes
from ...operators.outcomes import run_coverage
from .. import views

_SHOWN = f"""
  SELECT i.*, CASE WHEN s.state = 'read' THEN 'read' ELSE 'unread' END AS state
  FROM ({DOCUMENT_ITEMS}) i LEFT JOIN ({LABEL_STATES}) s USING (id)"""


@query(f"SELECT id, source_id, date, state FROM ({_SHOWN}) WHERE category = 'en' ORDER BY date DESC, seq, id LIMIT 50 OFFSET 50")
def item_page(spark, folder):
    """Second page of a category."""
    return views.item_page(document_items(spark, folder), label_states(spark, folder), "en", page=2
                           ).select("id", "source_id", "date", "state")


@query(f"SELECT id, date, state FROM ({_SHOWN}) WHERE state = 'unread' ORDER BY date DESC, seq, id LIMIT 50")
def unread_page(spark, folder):
    return views.item_page(document_items(spark, folder), label_states(spark, folder), state="unread"
                           ).select("id", "date", "state")


@query(f"""
  SELECT id, date FROM ({_SHOWN}) WHERE category = 'en' AND state = 'read' AND (date < DATE '2024-07-01'
    OR (date = DATE '2024-07-01' AND seq > 100)) ORDER BY date DESC, seq, id LIMIT 50""")
def page_after(spark, folder):
    """The page behind a given row, without counting from the top."""
    return views.items_after(document_items(spark, folder), label_states(spark, folder), "2024-07-01", 100,
                             "100", category="en", state="read").select("id", "date")


@query(f"""
  SELECT count(*) AS all_items, count(*) FILTER (WHERE state = 'unread') AS unread,
         count(*) FILTER (WHERE state = 'read') AS read,
         CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS all_items_pages,
         CAST(greatest(1, ceil(count(*) FILTER (WHERE state = 'unread') / 50.0)) AS BIGINT) AS unread_pages,
         CAST(greatest(1, ceil(count(*) FILTER (WHERE state = 'read') / 50.0)) AS BIGINT) AS read_pages
  FROM ({_SHOWN}) WHERE category = 'fr'""")
def item_counts(spark, folder):
    return views.item_counts(document_items(spark, folder), label_states(spark, folder), "fr")


def _monitored(spark, folder):
    return views.monitored_sources(supplier_sources(spark, folder), supplier_status(spark, folder))


@query(f"""
  SELECT r_name AS category, count(m.id) FILTER (WHERE status = 'active') AS active,
         count(m.id) FILTER (WHERE status = 'failing') AS failing,
         count(m.id) FILTER (WHERE status = 'planned') AS planned, count(m.id) AS total
  FROM (SELECT r_name FROM region UNION ALL SELECT 'NOWHERE') LEFT JOIN ({SUPPLIER_MONITORED}) m ON m.category = r_name
  GROUP BY r_name""")
def coverage_by_region(spark, folder):
    """One category more than there are regions has no sources and is still listed."""
    nowhere = spark.range(1).select(F.lit(99).alias("ord"), *[F.lit("NOWHERE").alias(c) for c in ("category", "title")])
    regions = region_categories(spark, folder).unionByName(nowhere)
    return views.category_coverage(regions, _monitored(spark, folder)).select(
        "category", "active", "failing", "planned", "total")


@query(f"""
  WITH m AS ({SUPPLIER_MONITORED}),
  c AS (SELECT r_regionkey AS ord, r_name AS category, count(m.id) AS total,
               count(m.id) FILTER (WHERE status = 'failing') AS failing
        FROM region LEFT JOIN m ON m.category = r_name GROUP BY ALL)
  SELECT c.category, c.failing, c.total, m.id, m.status, CASE WHEN m.id IS NOT NULL THEN TRUE END AS monitored
  FROM c LEFT JOIN m ON m.category = c.category
  UNION ALL SELECT c.category, c.failing, c.total, n_name, NULL, FALSE
  FROM c JOIN region ON r_name = c.category JOIN nation ON n_regionkey = r_regionkey
  """)
def sources_listing(spark, folder):
    """Suppliers as monitored and nations as reference-only sources."""
    nations, regions = table(spark, folder, "nation"), table(spark, folder, "region")
    references = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select(
        F.col("r_name").alias("category"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("id"),
        F.col("n_name").alias("name"), F.lit("https://example.com/").alias("url"),
        F.lit(None).cast("string").alias("note"))
    rows = views.sources_listing(region_categories(spark, folder), _monitored(spark, folder), references)
    return rows.select("category", F.col("coverage.failing").alias("failing"),
                       F.col("coverage.total").alias("total"), "id", "status", "monitored")


def _runs(spark, folder):
    """A run per day of events: errors are failures, signups planned."""
    day = F.to_date("ts")
    kind = F.col("event_type")
    return table(spark, folder, "events").groupBy(day.alias("day")).agg(
        F.count_if(kind.isin("view", "click", "purchase")).alias("succeeded"),
        F.count_if(kind == "error").alias("failed"), F.count_if(kind == "signup").alias("planned"),
        F.lit(0).cast("long").alias("added"), F.count("*").alias("total")).select(
        F.unix_date("day").cast("long").alias("run_id"), F.col("day").cast("timestamp").alias("last_run_at"),
        F.struct("succeeded", "failed", "planned", "added", "total").alias("coverage"),
        F.when(F.day("day") % 7 == 0, F.struct(F.lit("volume-guard").alias("reason"),
                                               F.concat(F.lit("day "), F.day("day")).alias("detail"))
               ).alias("rejected"))


@query("""
  SELECT CAST(max(CAST(ts AS DATE)) AS TIMESTAMP) AS last_run_at, TRUE AS stale,
         count(*) FILTER (WHERE event_type = 'error' AND CAST(ts AS DATE) = d) AS failed,
         count(*) FILTER (WHERE CAST(ts AS DATE) = d) AS total,
         CASE WHEN day(any_value(d)) % 7 = 0 THEN 'volume-guard' END AS reason
  FROM events, (SELECT max(CAST(ts AS DATE)) AS d FROM events)""")
def run_status(spark, folder):
    status = views.run_status(_runs(spark, folder), "2024-02-01 00:00:00")
    return status.select(wall("last_run_at").alias("last_run_at"), "stale",
                         F.col("coverage.failed").alias("failed"), F.col("coverage.total").alias("total"),
                         F.col("rejected.reason").alias("reason"))


_DAYS = """SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error' AND user_id % 30 = 0) AS failed,
  count(*) FILTER (WHERE event_type = 'signup' AND user_id % 20 = 0) AS planned FROM events GROUP BY 1"""


@query(f"""
  SELECT day, CASE WHEN day(day) % 7 = 0 OR failed > 0 THEN 'red' WHEN planned > 0 OR day < DATE '2024-01-05' THEN 'orange'
                   ELSE 'green' END AS severity,
         CASE WHEN day(day) % 7 = 0 THEN 'Collection rejected — Validation: day ' || day(day)
              WHEN failed > 0 THEN failed || CASE WHEN failed = 1 THEN ' source' ELSE ' sources' END || ' failing'
              WHEN planned > 0 AND day < DATE '2024-01-05' THEN planned || CASE WHEN planned = 1 THEN ' source' ELSE ' sources' END || ' planned, collection is stale'
              WHEN planned > 0 THEN planned || CASE WHEN planned = 1 THEN ' source' ELSE ' sources' END || ' planned'
              WHEN day < DATE '2024-01-05' THEN 'collection is stale'
              ELSE 'All sources collecting successfully' END AS title
  FROM ({_DAYS})""")
def severity(spark, folder):
    days = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if((F.col("event_type") == "error") & (F.col("user_id") % 30 == 0)).alias("failed"),
        F.count_if((F.col("event_type") == "signup") & (F.col("user_id") % 20 == 0)).alias("planned"))
    stale = F.col("day") < F.lit("2024-01-05").cast("date")
    rejected = F.day("day") % 7 == 0
    reason = F.when(rejected, F.lit("validation-failed"))
    detail = F.concat(F.lit("day "), F.day("day"))
    return days.select("day", views.severity(F.col("failed"), F.col("planned"), stale, rejected).alias("severity"),
                       views.alert_title(F.col("failed"), F.col("planned"), stale, reason, detail).alias("title"))


@query(f"""
  SELECT category, id AS source_id FROM ({SUPPLIER_MONITORED}) WHERE status = 'failing' ORDER BY ord, pos LIMIT 1""")
def deep_link(spark, folder):
    return views.deep_link(_monitored(spark, folder), region_categories(spark, folder), "failing")


@query(f"""WITH {OUTCOMES}, m AS ({SUPPLIER_MONITORED}),
  n AS (SELECT count(*) FILTER (WHERE outcome = 'failed') AS failed FROM outcomes)
  SELECT 'red' AS severity, failed || ' sources failing' AS title, category, id AS source_id
  FROM n LEFT JOIN (SELECT category, id FROM m WHERE status = 'failing' ORDER BY ord, pos LIMIT 1) ON TRUE""")
def alert(spark, folder):
    counts = run_coverage(user_outcomes(spark, folder)).select(
        F.struct("succeeded", "failed", "planned", F.lit(0).cast("long").alias("added"), "total").alias("coverage"),
        F.lit(False).alias("stale"),
        F.lit(None).cast("struct<reason:string,detail:string>").alias("rejected"))
    return views.alert(counts, _monitored(spark, folder), region_categories(spark, folder))
