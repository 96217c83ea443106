"""Outcomes, guards and whole gated runs."""

import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import query, table, wall
from .inputs import EVENTS_NOW, ORDERS_NOW, order_items, supplier_sources
from ...functions.dates import window_start
from ...operators import checks
from ...operators.outcomes import ordered_outcomes, run_coverage as coverage, source_status
from ...schemas import REFERENCE_SOURCE
from ...session import work_folder
from ...sources.adapters import Adapter, AdapterRegistry, Fragment, default_registry
from ...sources.feeds import parse_feed
from ...sources.landing import Landing
from ...sources.registry import registry_issues, unsupported_adapters
from ..collect import collect_run
from ..store import Store
from ..summary import canonical_json, failure_lines


def user_outcomes(spark, folder) -> DataFrame:
    """Users as sources; a user's last event of the month decides the outcome."""
    last = table(spark, folder, "events").groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"),
        F.max("ts").alias("at"), F.count("*").alias("n"))
    outcome = F.expr("CASE kind WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'planned' ELSE 'succeeded' END")
    return last.select(
        F.concat(F.lit("u"), "user_id").alias("source_id"), F.col("user_id").alias("pos"),
        outcome.alias("outcome"), F.when(outcome == "succeeded", F.col("n")).alias("items"),
        F.when(outcome == "failed", F.concat(F.lit("HTTP 503 after "), "n")).alias("reason"),
        F.when(outcome != "planned", F.col("at").cast("timestamp")).alias("attempted_at"))


OUTCOMES = """
  outcomes AS (
    SELECT 'u' || user_id AS source_id, user_id AS pos, n,
           CASE kind WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'planned' ELSE 'succeeded' END AS outcome, attempted
    FROM (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS kind, max(ts) AS attempted, count(*) AS n
          FROM events GROUP BY user_id))"""


@query(f"""WITH {OUTCOMES}
  SELECT count(*) FILTER (WHERE outcome = 'succeeded') AS succeeded, count(*) FILTER (WHERE outcome = 'failed') AS failed,
         count(*) FILTER (WHERE outcome = 'planned') AS planned, count(*) AS total,
         CAST(coalesce(sum(n) FILTER (WHERE outcome = 'succeeded'), 0) AS BIGINT) AS raw_items FROM outcomes""")
def run_coverage(spark, folder):
    return coverage(user_outcomes(spark, folder))


@query(f"""WITH {OUTCOMES}
  SELECT pos, '  FAILED  ' || source_id || ': HTTP 503 after ' || n AS line FROM outcomes WHERE outcome = 'failed'""")
def failure_list(spark, folder):
    return failure_lines(user_outcomes(spark, folder)).select("pos", "line")


@query(f"""WITH {OUTCOMES} SELECT source_id, outcome FROM outcomes ORDER BY outcome <> 'planned', pos""")
def outcome_order(spark, folder):
    return ordered_outcomes(user_outcomes(spark, folder)).select("source_id", "outcome")


@query(f"""WITH {OUTCOMES}
  SELECT source_id, CASE outcome WHEN 'succeeded' THEN 'active' WHEN 'failed' THEN 'failing' ELSE 'planned' END AS status,
         CASE WHEN outcome = 'succeeded' THEN attempted WHEN outcome = 'failed' AND pos % 2 = 0 THEN TIMESTAMP '2023-12-31' END AS last_success_at,
         CASE WHEN outcome <> 'planned' THEN attempted END AS last_attempt_at,
         CASE WHEN outcome = 'failed' THEN 'runtime-failing' END AS failure_class,
         CASE WHEN outcome = 'failed' THEN 'HTTP 503 after ' || n END AS reason FROM outcomes""")
def source_statuses(spark, folder):
    """Every second user succeeded before."""
    before = table(spark, folder, "events").where("user_id % 2 = 0").select(
        F.concat(F.lit("u"), "user_id").alias("source_id")).distinct().withColumn(
        "last_success_at", F.lit("2023-12-31 00:00:00").cast("timestamp"))
    status = source_status(user_outcomes(spark, folder), before)
    return status.select("source_id", "status", wall("last_success_at").alias("last_success_at"),
                         wall("last_attempt_at").alias("last_attempt_at"), "failure_class", "reason")


@query("""
  WITH n AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS added,
                    min(CAST(o_orderkey AS VARCHAR)) FILTER (WHERE o_orderkey % 23 = 0) AS first_changed FROM orders)
  SELECT CASE WHEN added > 200 THEN 'volume-guard' WHEN first_changed IS NOT NULL THEN 'active-item-mutation' END AS reason,
         CASE WHEN added > 200 THEN added || ' items added, exceeds threshold of 200'
              WHEN first_changed IS NOT NULL THEN 'Active item "' || first_changed || '" was modified; item metadata is append-only' END AS detail
  FROM n""")
def guard_decision(spark, folder):
    """All guards look; the first in order of precedence decides."""
    return _guards(spark, folder, waived=False)


@query("""
  SELECT 'active-item-mutation' AS reason, 'Active item "' || min(CAST(o_orderkey AS VARCHAR))
         || '" was modified; item metadata is append-only' AS detail
  FROM orders WHERE o_orderkey % 23 = 0""")
def guard_decision_waived(spark, folder):
    """Waiving the volume guard leaves the others in force."""
    return _guards(spark, folder, waived=True)


def _guards(spark, folder, waived: bool) -> DataFrame:
    items = order_items(spark, folder)
    edited = items.withColumn("date", F.when(
        F.col("seq") % 23 == 0, F.date_add("date", 1)).otherwise(F.col("date")))
    changes = checks.append_only_diff(items, edited, items.limit(0).select("id"))
    issues = checks.item_issues(items)
    guards = checks.append_only_guard(changes).unionByName(checks.validation_guard(issues))
    if not waived:
        added = table(spark, folder, "orders").where("o_orderstatus = 'O'")
        guards = guards.unionByName(checks.volume_guard(added))
    return checks.first_rejection(guards)


@query("""
  SELECT 'source-category' AS "check", 'Source "' || s_name || '" declares category "web-core" but is listed in the "'
         || 'ai-engineering" file' AS message FROM supplier WHERE s_suppkey % 11 = 0 AND s_suppkey % 13 <> 0
  UNION ALL
  SELECT 'source-shape', 'Invalid source config in "' || CASE WHEN s_suppkey % 11 = 0 THEN 'ai-engineering' ELSE 'web-core' END
         || '" for id "' || s_name || '"' FROM supplier WHERE s_suppkey % 13 = 0
  UNION ALL
  SELECT 'source-duplicate-id', 'Duplicate source id "' || s_name || '": declared in both "'
         || CASE WHEN s_suppkey % 11 = 0 THEN 'ai-engineering' ELSE 'web-core' END || '" and "mobile-development"'
  FROM supplier WHERE s_suppkey % 9 = 0
  UNION ALL
  SELECT 'source-adapter', 'Unsupported adapter configuration: "' || s_name || '" (adapter "carrier-pigeon")'
  FROM supplier WHERE s_suppkey % 17 = 0 AND s_suppkey % 10 <> 0""")
def registry_check(spark, folder):
    """Suppliers as a registry with each kind of fault planted at its own interval."""
    key = F.col("s_suppkey")
    rows = supplier_sources(spark, folder).withColumns({
        "category": F.lit("web-core"),
        "declared_in": F.when(key % 11 == 0, F.lit("ai-engineering")).otherwise(F.lit("web-core")),
        "kind": F.when(key % 13 == 0, F.lit("telegram")).otherwise(F.lit("feed")),
        "adapter": F.when(key % 17 == 0, F.lit("carrier-pigeon")).otherwise(F.lit("feed")),
        "initial_sync_from": F.lit("2024-01-01").cast("date"), "filters": F.lit(None).cast("string"),
        "release_policy": F.lit(None).cast("struct<include_prerelease:boolean,include_draft:boolean>")})
    references = rows.where(key % 9 == 0).select(
        "pos", "id", "name",
        F.lit("mobile-development").alias("category"), "url", F.lit(None).cast("string").alias("note"),
        F.lit("mobile-development").alias("declared_in"))
    return registry_issues(rows, references).unionByName(unsupported_adapters(rows, default_registry()))


@query("""
  SELECT c_custkey, '{"c_acct":' || CAST(round(c_acctbal * 100) AS BIGINT) || ',"c_custkey":' || c_custkey
         || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}' AS json FROM customer""")
def canonical_export(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_name", F.round(F.col("c_acctbal") * 100).cast("long").alias("c_acct"), "c_mktsegment", "c_custkey")
    return rows.select("c_custkey", canonical_json(rows).alias("json"))


def order_payloads(spark, folder) -> DataFrame:
    return payload_columns(table(spark, folder, "orders"))


def payload_columns(orders: DataFrame) -> DataFrame:
    """One small feed per order, landed in order of the key."""
    dated = F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.concat(
        F.lit("<pubDate>"), F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate>")))
    body = F.concat(F.lit("<rss><channel><item><title>Order "), F.col("o_orderkey"),
                    F.lit("</title><link>/orders/"), F.col("o_orderkey"), F.lit("/</link>"), dated,
                    F.lit("</item></channel></rss>"))
    return orders.select(
        F.col("o_orderpriority").alias("source_id"), F.lit("https://www.example.com/rss").alias("url"),
        F.lit(200).alias("http_status"), F.lit("2001-08-02 00:00:00").cast("timestamp").alias("fetched_at"),
        body.alias("body"), F.col("o_orderkey").alias("seq"))


def order_sources(spark, folder) -> DataFrame:
    return (table(spark, folder, "orders").select(F.col("o_orderpriority").alias("id")).distinct()
            .select(F.substring("id", 1, 1).cast("int").alias("pos"), "id", F.col("id").alias("name"),
                    F.lit("web-core").alias("category"), F.lit("feed").alias("kind"),
                    F.lit("https://www.example.com/rss").alias("url"), F.lit("feed").alias("adapter"),
                    F.lit("2000-01-01").cast("date").alias("initial_sync_from"),
                    F.lit("active").alias("status"),
                    F.when(F.col("id") == "5-LOW", F.lit('{"label":"Announcement"}')).alias("filters"),
                    F.lit(None).cast("struct<include_prerelease:boolean,include_draft:boolean>").alias("release_policy"),
                    F.array(F.lit("orders")).alias("tags"), F.lit("web-core").alias("declared_in")))


COLLECTED = """
  SELECT substr(sha256('https://example.com/orders/' || o_orderkey), 1, 16) AS id, o_orderpriority AS source_id,
         'Order ' || o_orderkey AS heading,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'Announcement' ELSE 'Engineering Article' END AS label,
         CAST(CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '2001-08-03' ELSE o_orderdate END AS DATE) AS date,
         CASE WHEN o_orderstatus = 'P' THEN 'discovered' ELSE 'published' END AS date_basis, 'unread' AS state
  FROM orders
  WHERE (o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderkey % 2 = 0)
     OR (o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '2001-08-01' AND o_orderkey % 2 = 1)
     OR (o_orderstatus = 'P' AND o_orderkey % 2 = 1)"""


@query(COLLECTED)
def collect_orders(spark, folder):
    """Two gated runs: the even orders first, then all of them a day later."""
    store = Store(spark, f"{work_folder(spark)}/collect-{uuid.uuid4().hex}")
    payloads, sources = order_payloads(spark, folder), order_sources(spark, folder)
    none = spark.createDataFrame([], REFERENCE_SOURCE)
    for landed, now in ((payloads.where("seq % 2 = 0"), ORDERS_NOW), (payloads, "2001-08-03 00:00:00")):
        collect_run(store, landed, sources, none, now, allow_large_change=True)
    return store.items().join(store.read("states"), "id").select(
        "id", "source_id", "heading", "label", "date", "date_basis", "state")


@query(f"""
  WITH even AS (SELECT count(*) AS n FROM orders
                WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderkey % 2 = 0),
  wanted AS (SELECT count(*) AS n FROM ({COLLECTED}))
  SELECT 'rejection' AS fact, 'volume-guard: ' || (wanted.n - even.n) || ' items added, exceeds threshold of 0' AS value
  FROM wanted, even
  UNION ALL SELECT 'items', CAST(n AS VARCHAR) FROM even
  UNION ALL SELECT 'active', CAST(count(DISTINCT o_orderpriority) AS VARCHAR) FROM orders""")
def rejected_run(spark, folder):
    """A second run that may add nothing: its rejection and status are published, no items."""
    store = Store(spark, f"{work_folder(spark)}/rejected-{uuid.uuid4().hex}")
    payloads, sources = order_payloads(spark, folder), order_sources(spark, folder)
    none = spark.createDataFrame([], REFERENCE_SOURCE)
    collect_run(store, payloads.where("seq % 2 = 0"), sources, none, ORDERS_NOW, allow_large_change=True)
    collect_run(store, payloads, sources, none, "2001-08-03 00:00:00", volume_limit=0)
    newest = store.read("runs").agg(F.max_by("rejected", "run_id").alias("r"))
    n = F.count("*").cast("string").alias("value")
    return (newest.select(F.lit("rejection").alias("fact"), F.concat_ws(": ", "r.reason", "r.detail").alias("value"))
            .unionByName(store.items().agg(n).select(F.lit("items").alias("fact"), "value"))
            .unionByName(store.read("source_status").groupBy(F.col("status").alias("fact")).agg(n)))


def _above_mark(entries, marks):
    """Entries numbered above the highest number that their source had before."""
    return entries.join(marks, "source_id", "left").where(
        F.coalesce(F.regexp_extract("entry.link", r"(\d+)/?$", 1).cast("long") > F.col("mark"), F.lit(True))).drop("mark")


def _marks(entries, marks):
    seen = entries.groupBy("source_id").agg(F.max(F.regexp_extract("entry.link", r"(\d+)/?$", 1).cast("long")).alias("mark"))
    return seen.unionByName(marks).groupBy("source_id").agg(F.max("mark").alias("mark"))


NUMBERED = Adapter("numbered", "feed-entry", parse_feed, fragment=Fragment(
    "numbered_marks", StructType([StructField("source_id", StringType()), StructField("mark", LongType())]), _marks, _above_mark))


@query("""
  WITH half AS (SELECT (min(o_orderkey) + max(o_orderkey)) // 2 AS key FROM orders),
  marks AS (SELECT o_orderpriority AS source_id, max(o_orderkey) FILTER (WHERE o_orderkey <= half.key AND o_orderkey % 2 = 0) AS first,
                   max(o_orderkey) AS mark FROM orders, half GROUP BY ALL)
  SELECT substr(sha256('https://example.com/orders/' || o_orderkey), 1, 16) AS id, o_orderpriority AS source_id, marks.mark
  FROM orders JOIN marks ON o_orderpriority = source_id, half
  WHERE (o_orderkey <= half.key AND o_orderkey % 2 = 0) OR coalesce(o_orderkey > marks.first, true)""")
def adapter_state(spark, folder):
    """Feeds whose adapter keeps each source's highest order number: half of the even orders,
    a run that is rejected, then all orders, of which those above the number count."""
    store = Store(spark, f"{work_folder(spark)}/adapter-{uuid.uuid4().hex}")
    orders = table(spark, folder, "orders").withColumns({
        "o_orderstatus": F.lit("O"), "o_orderdate": F.lit("2001-08-01 12:00:00").cast("timestamp")})
    payloads, sources = payload_columns(orders), order_sources(spark, folder).withColumn("adapter", F.lit(NUMBERED.name))
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    half = payloads.where((F.col("seq") <= (low + high) // 2) & (F.col("seq") % 2 == 0))
    none = spark.createDataFrame([], REFERENCE_SOURCE)
    for landed, options in ((half, {"allow_large_change": True}), (payloads, {"volume_limit": 0}),
                            (payloads, {"allow_large_change": True})):
        collect_run(store, landed, sources, none, ORDERS_NOW, AdapterRegistry([NUMBERED]), **options)
    return store.items().join(store.read("numbered_marks"), "source_id").select("id", "source_id", "mark")


def _event_bounds(events: DataFrame) -> DataFrame:
    """Event types as sources: errors were never collected, the others up to some day each."""
    kinds = events.select(F.col("source_id")).distinct()
    return kinds.select(
        "source_id", F.lit("2024-01-20").cast("date").alias("initial_sync_from"),
        F.when(F.col("source_id") != "error", F.to_timestamp(F.concat(
            F.lit("2024-01-"), F.lpad((F.length("source_id") + 20).cast("string"), 2, "0"), F.lit(" 06:00:00")))).alias("last_run_at"))


@query("""
  WITH b AS (SELECT DISTINCT event_type, CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-01-20'
                    ELSE least(TIMESTAMP '2024-01-01 06:00:00' + to_days(CAST(length(event_type) + 19 AS INTEGER)),
                               TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR) END AS start FROM events)
  SELECT event_id AS seq, event_type AS source_id FROM events JOIN b USING (event_type) WHERE ts >= b.start""")
def landed_window(spark, folder):
    """A month of events as an archive of payloads that landed in three parts; of its files
    only those from the earliest window on are opened, then each source's window counts."""
    landing = Landing(spark, f"{work_folder(spark)}/landing-{uuid.uuid4().hex}")
    events = table(spark, folder, "events").select(
        F.col("event_type").alias("source_id"), F.lit("https://example.com/feed").alias("url"), F.lit(200).alias("http_status"),
        F.col("ts").cast("timestamp").alias("fetched_at"), F.col("props").alias("body"), F.col("event_id").alias("seq"))
    for i in range(3):
        landing.land(events.where(F.col("seq") % 3 == i))
    bounds = _event_bounds(events)
    starts = bounds.withColumn("start", window_start(F.col("last_run_at"), F.col("initial_sync_from"), EVENTS_NOW))
    earliest = starts.agg(F.min("start")).first()[0]
    return (landing.since(earliest).join(starts.select("source_id", "start"), "source_id")
            .where(F.col("fetched_at") >= F.col("start")).select("seq", "source_id"))
