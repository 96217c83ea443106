"""Table rows in the roles operators expect: items, states, transitions, sources."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import table

EVENTS_NOW = "2024-01-31 00:00:00"
ORDERS_NOW = "2001-08-02 00:00:00"
LABELS_NOW = "2024-03-05 00:00:00"


def document_items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as items: language is the category, the date follows from the length."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"),
        F.expr("date_add(DATE'2024-01-01', CAST(n_chars % 365 AS INT))").alias("date"),
        F.col("lang").alias("category"), F.col("doc_id").alias("seq"))


DOCUMENT_ITEMS = """
  SELECT CAST(doc_id AS VARCHAR) AS id, source AS source_id,
         DATE '2024-01-01' + CAST(n_chars % 365 AS INTEGER) AS date,
         lang AS category, doc_id AS seq
  FROM documents"""


def label_states(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as reading states; every hour of the year is some state's time."""
    at = F.expr("TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id * 7 % 1536 AS INT))")
    state = F.expr("CASE WHEN toxic = 1 THEN 'ignored' WHEN quality = 1 THEN 'read' ELSE 'unread' END")
    return (table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"),
                                                  state.alias("state"), at.alias("updated_at"))
            .withColumn("read_at", F.when(F.col("state") == "read", F.col("updated_at")))
            .withColumn("ignored_at", F.when(F.col("state") == "ignored", F.col("updated_at"))))


LABEL_STATES = """
  SELECT CAST(doc_id AS VARCHAR) AS id,
         CASE WHEN toxic = 1 THEN 'ignored' WHEN quality = 1 THEN 'read' ELSE 'unread' END AS state,
         TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 7 % 1536 AS INTEGER)) AS updated_at,
         CASE WHEN toxic <> 1 AND quality = 1
              THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 7 % 1536 AS INTEGER)) END AS read_at,
         CASE WHEN toxic = 1
              THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 7 % 1536 AS INTEGER)) END AS ignored_at
  FROM labels"""


def event_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a reading-state transition of an item per user and day of the month.

    An error ends the item of its day: clicks and purchases read it, the others unread it.
    """
    return as_transitions(table(spark, folder, "events"))


def as_transitions(events: DataFrame) -> DataFrame:
    state = F.expr("CASE WHEN event_type = 'error' THEN 'ignored' "
                   "WHEN event_type IN ('click', 'purchase') THEN 'read' ELSE 'unread' END")
    return events.select(user_day().alias("id"), state.alias("state"),
                         F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def user_day() -> Column:
    return F.expr("CAST(user_id * 31 + day(ts) - 1 AS STRING)")


EVENT_TRANSITIONS = """
  SELECT CAST(user_id * 31 + day(ts) - 1 AS VARCHAR) AS id,
         CASE WHEN event_type = 'error' THEN 'ignored' WHEN event_type IN ('click', 'purchase') THEN 'read'
              ELSE 'unread' END AS state,
         ts, event_id AS seq
  FROM events"""


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as dated items of a source per priority; status P is undated."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("source_id"),
        F.to_date("o_orderdate").alias("date"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN 'discovered' ELSE 'published' END").alias("date_basis"),
        F.length("o_orderpriority").alias("pos"), F.col("o_orderkey").alias("seq"))


ORDER_ITEMS = """
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS source_id,
         CAST(o_orderdate AS DATE) AS date,
         CASE WHEN o_orderstatus = 'P' THEN 'discovered' ELSE 'published' END AS date_basis,
         o_orderkey AS seq
  FROM orders"""


def order_cursors(spark: SparkSession, folder: str) -> DataFrame:
    """A cursor for every priority but the lowest, each at its own point in time."""
    return (table(spark, folder, "orders").where("o_orderpriority <> '5-LOW'")
            .groupBy(F.col("o_orderpriority").alias("source_id"))
            .agg((F.lit("2001-08-01 00:00:00").cast("timestamp")
                  - F.make_dt_interval(F.substring("source_id", 1, 1).cast("int") * 400))
                 .alias("last_run_at"))
            .select("source_id", "last_run_at", F.lit(None).cast("date").alias("last_item_date"),
                    F.lit(None).cast("string").alias("last_item_id")))


ORDER_CURSORS = """
  SELECT DISTINCT o_orderpriority AS source_id,
         TIMESTAMP '2001-08-01' - to_days(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 400) AS last_run_at
  FROM orders WHERE o_orderpriority <> '5-LOW'"""


def order_bounds(spark: SparkSession, folder: str) -> DataFrame:
    sources = (table(spark, folder, "orders").select(F.col("o_orderpriority").alias("source_id"))
               .distinct().withColumn("initial_sync_from", F.lit("1998-01-01").cast("date")))
    return sources.join(order_cursors(spark, folder).select("source_id", "last_run_at"), "source_id", "left")


ORDER_WINDOW = f"""
  cursors AS ({ORDER_CURSORS}),
  bounds AS (
    SELECT s.source_id, c.last_run_at IS NULL AS is_initial,
           CAST(CASE WHEN c.last_run_at IS NULL THEN TIMESTAMP '1998-01-01'
                     ELSE least(c.last_run_at, TIMESTAMP '2001-08-02' - INTERVAL 36 HOUR) END AS DATE) AS from_day
    FROM (SELECT DISTINCT o_orderpriority AS source_id FROM orders) s LEFT JOIN cursors c USING (source_id)),
  windowed AS (
    SELECT i.*, b.is_initial FROM ({ORDER_ITEMS}) i JOIN bounds b USING (source_id)
    WHERE i.date >= b.from_day)"""


def order_known(spark: SparkSession, folder: str) -> DataFrame:
    """Undated orders decided on earlier: those with an even key."""
    return (table(spark, folder, "orders").where("o_orderstatus = 'P' AND o_orderkey % 2 = 0")
            .select(F.col("o_orderpriority").alias("source_id"),
                    F.col("o_orderkey").cast("string").alias("id")))


def supplier_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as monitored sources, their region as the category."""
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region")
    places = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"])
    suppliers = table(spark, folder, "supplier")
    return (suppliers.join(places, suppliers["s_nationkey"] == places["n_nationkey"])
            .select(F.col("s_suppkey").cast("int").alias("pos"), F.col("s_name").alias("id"),
                    F.col("s_name").alias("name"), F.col("r_name").alias("category"),
                    F.lit("feed").alias("kind"),
                    F.concat(F.lit("https://example.com/"), "s_suppkey").alias("url"),
                    F.expr("CASE WHEN s_suppkey % 10 = 0 THEN 'planned' ELSE 'active' END").alias("status"),
                    F.array("n_name").alias("tags"), "s_suppkey", "s_acctbal"))


def supplier_status(spark: SparkSession, folder: str) -> DataFrame:
    """Runtime status of suppliers: in debt means failing; every seventh has none yet."""
    return table(spark, folder, "supplier").where("s_suppkey % 7 <> 0").select(
        F.col("s_name").alias("source_id"),
        F.expr("CASE WHEN s_acctbal < 0 THEN 'failing' WHEN s_suppkey % 10 = 0 THEN 'planned' "
               "ELSE 'active' END").alias("status"),
        F.lit(None).cast("timestamp").alias("last_success_at"),
        F.lit("2024-01-30 00:00:00").cast("timestamp").alias("last_attempt_at"),
        F.expr("CASE WHEN s_acctbal < 0 THEN 'balance ' || CAST(CAST(s_acctbal AS INT) AS STRING) END").alias("reason"))


SUPPLIER_MONITORED = """
  SELECT s_suppkey AS pos, s_name AS id, r_name AS category, r_regionkey AS ord,
         CASE WHEN s_suppkey % 7 <> 0 AND s_acctbal < 0 THEN 'failing'
              WHEN s_suppkey % 10 = 0 THEN 'planned' ELSE 'active' END AS status
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def region_categories(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(
        F.col("r_regionkey").alias("ord"), F.col("r_name").alias("category"),
        F.col("r_name").alias("title"))
