"""Files in the forms that are read and written, the nested view, cleanup and a run of broken
payloads, each over what Spark derives from the shared tables."""

import uuid

from pyspark.sql import functions as F

from . import query, table, wall
from .inputs import (
    LABELS_NOW, SUPPLIER_MONITORED, document_items, label_states, region_categories,
    supplier_sources, supplier_status,
)
from .reading import _CLEANUP
from .. import views
from ..collect import collect_run, landed_payloads
from ..reading import clean_store
from ..store import Store
from ..summary import canonical_json
from ...schemas import REFERENCE_SOURCE, SOURCE
from ...session import work_folder
from ...sources import tables as files
from ...sources.adapters import BUILT_IN
from ...sources.registry import read_sources


def _folder(spark, name):
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Records in one exported file; a larger table is more files.
RECORDS = 5000


def _exported(spark, records, key, document, name):
    """One file for each ``RECORDS`` keys, holding the JSON text that ``document`` makes of them."""
    path = _folder(spark, name)
    texts = records.groupBy(F.expr(f"{key} div {RECORDS}").alias("part")).agg(document.alias("value"))
    texts.repartition("part").write.partitionBy("part").text(path)
    return f"{path}/*"


@query("""
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS source_id, 'Order ' || o_orderkey AS heading,
         CAST(o_orderdate AS DATE) AS date, o_orderstatus || ',' || o_orderpriority AS tags FROM orders""")
def json_items(spark, folder):
    """Items from JSON arrays, one file for every few thousand."""
    orders = table(spark, folder, "orders")
    record = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("sourceId"),
        F.concat(F.lit("Order "), "o_orderkey").alias("heading"), F.lit("Release").alias("label"),
        F.lit("https://example.com/").alias("link"), F.to_date("o_orderdate").alias("date"),
        F.lit("published").alias("dateBasis"), F.lit("web-core").alias("category"),
        F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    path = _exported(spark, orders, "o_orderkey", F.to_json(F.collect_list(record)), "items")
    return files.read_items_json(spark, path).select("id", "source_id", "heading", "date", F.array_join("tags", ",").alias("tags"))


@query("""
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'ignored' WHEN quality = 1 THEN 'read' ELSE 'unread' END AS state,
         CASE WHEN toxic = 1 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 7 % 1536 AS INTEGER)) END AS ignored_at FROM labels""")
def json_states(spark, folder):
    """Reading states from JSON objects keyed by id."""
    states = label_states(spark, folder).withColumn("key", F.col("id").cast("long"))
    one = F.struct("state", F.col("updated_at").alias("updatedAt"), F.col("read_at").alias("readAt"), F.col("ignored_at").alias("ignoredAt"))
    document = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.map_from_entries(
        F.collect_list(F.struct(F.col("id"), one))).alias("items")))
    read = files.read_states_json(spark, _exported(spark, states, "key", document, "states"))
    return read.select("id", "state", wall("ignored_at").alias("ignored_at"))


@query(f"SELECT pos, id, category, status FROM ({SUPPLIER_MONITORED.replace('WHEN s_suppkey % 7 <> 0 AND s_acctbal < 0', 'WHEN FALSE')})")
def registry_file(spark, folder):
    """The registry from JSON lines, one folder of files per category."""
    rows = supplier_sources(spark, folder)
    full = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in SOURCE.fields], F.col("category").alias("declared"))
    path = _folder(spark, "registry")
    full.write.partitionBy("declared").json(path)
    return read_sources(spark, f"{path}/*").select("pos", "id", "category", "status")


@query("""
  SELECT event_id AS seq, 'u' || user_id AS source_id, user_id % 4 AS pos FROM events WHERE user_id % 10 <> 0""")
def collectible_payloads(spark, folder):
    """Events as payloads of their users, of whom every tenth is only planned."""
    events = table(spark, folder, "events")
    user = F.concat(F.lit("u"), "user_id")
    sources = events.select("user_id").distinct().select(
        user.alias("id"), (F.col("user_id") % 4).alias("pos"), F.lit("feed").alias("adapter"), F.lit("web-core").alias("category"),
        F.lit(None).cast("string").alias("filters"), F.lit(None).cast("string").alias("release_policy"),
        F.array().cast("array<string>").alias("tags"), F.expr("IF(user_id % 10 = 0, 'planned', 'active')").alias("status"))
    payloads = events.select(F.col("event_id").alias("seq"), user.alias("source_id"), F.col("props").alias("body"))
    return landed_payloads(payloads, sources).select("seq", "source_id", "pos")


@query("""
  SELECT c_custkey, '{"nested":[{"a":' || c_custkey || ',"z":"' || c_mktsegment || '"}],"places":{"here":{"b":1,"c":"'
         || c_name || '"},"there":null}}' AS json FROM customer""")
def canonical_nested(spark, folder):
    """Keys sorted in structs of arrays and in maps of structs."""
    rows = table(spark, folder, "customer").select("c_custkey", F.create_map(
        F.lit("there"), F.lit(None).cast("struct<c:string,b:int>"), F.lit("here"),
        F.struct(F.col("c_name").alias("c"), F.lit(1).alias("b"))).alias("places"),
        F.array(F.struct(F.col("c_mktsegment").alias("z"), F.col("c_custkey").alias("a"))).alias("nested"))
    return rows.select("c_custkey", canonical_json(rows.drop("c_custkey")).alias("json"))


@query(f"""
  WITH m AS ({SUPPLIER_MONITORED}),
  parts AS (SELECT ord, category, pos // {views.NESTED} AS part, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids,
                   string_agg('ref-' || pos, ',' ORDER BY pos) FILTER (WHERE pos % 4 = 0) AS refs FROM m GROUP BY ALL)
  SELECT r_regionkey AS ord, r_name AS category, CAST(coalesce(part, 0) AS BIGINT) AS part, coalesce(ids, '') AS ids,
         coalesce(refs, '') AS refs,
         CAST(coalesce((SELECT count(*) FROM m WHERE m.category = r_name AND status = 'failing'), 0) AS BIGINT) AS failing
  FROM region LEFT JOIN parts ON r_name = category""")
def nested_sources(spark, folder):
    """Sources and reference-only ones under their category, in registry order."""
    sources = supplier_sources(spark, folder)
    monitored = views.monitored_sources(sources, supplier_status(spark, folder))
    references = sources.where("pos % 4 = 0").select(
        "pos", F.concat(F.lit("ref-"), "pos").alias("id"), "name", "category", "url", F.lit("see").alias("note"))
    nested = views.sources_by_category(region_categories(spark, folder), monitored, references)
    return nested.select("ord", "category", "part", *[
        F.array_join(F.transform(c, lambda s: s["id"]), ",").alias(n) for c, n in (("monitored", "ids"), ("reference_only", "refs"))],
        F.col("coverage.failing").alias("failing"))


@query(f"""WITH {_CLEANUP}, left_items AS (SELECT id FROM items ANTI JOIN (SELECT id FROM fated WHERE fate IN ('ignored', 'expired')) USING (id))
  SELECT coalesce(i.id, s.id) AS id, i.id IS NOT NULL AS listed, s.state
  FROM left_items i FULL JOIN (SELECT id, state FROM fated WHERE fate IN ('ignored', 'kept')) s ON i.id = s.id""")
def stored_cleanup(spark, folder):
    """Cleanup on its own over a store; a second one finds nothing to do."""
    store = Store(spark, _folder(spark, "cleanup"))
    store.bootstrap()
    items = document_items(spark, folder)
    store.publish({"items": store.write("items", items, "run_id=0"),
                   "states": store.write("states", label_states(spark, folder), "version=2")})
    clean_store(store, LABELS_NOW)
    version = store.version
    clean_store(store, LABELS_NOW)
    assert store.version == version
    listed = store.items().select("id", F.lit(True).alias("listed"))
    return listed.join(store.read("states").select("id", "state"), "id", "full").select(
        "id", F.coalesce("listed", F.lit(False)).alias("listed"), "state")


#: Formats in the order of their names; the first reads feeds.
FORMATS = [a.name for a in BUILT_IN]


@query(f"""
  SELECT s_name AS source_id, CASE WHEN s_suppkey % 10 = 0 THEN 'planned'
                                   WHEN s_suppkey % {len(FORMATS)} = 0 AND s_suppkey % 3 <> 0 THEN 'active' ELSE 'failing' END AS status,
         CASE WHEN s_suppkey % 10 <> 0 AND s_suppkey % {len(FORMATS)} = 0 AND s_suppkey % 3 <> 0
              THEN substr(sha256('https://example.com/from/' || s_suppkey), 1, 16) END AS item
  FROM supplier""")
def isolated_failures(spark, folder):
    """A run over suppliers whose payloads are broken, whatever their format, but for some feeds:
    each fails alone, and what is whole is published."""
    store = Store(spark, _folder(spark, "isolated"))
    number, kind = F.col("s_suppkey"), F.col("s_suppkey") % len(FORMATS)
    rows = supplier_sources(spark, folder)
    sources = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns and f.name not in ("category", "status") else
                            F.lit(None).cast(f.dataType).alias(f.name) for f in SOURCE.fields], "s_suppkey").withColumns({
        "category": F.lit("web-core"), "declared_in": F.lit("web-core"), "status": F.expr("IF(s_suppkey % 10 = 0, 'planned', 'active')"),
        "adapter": F.element_at(F.array(*map(F.lit, FORMATS)), (kind + 1).cast("int")),
        "initial_sync_from": F.lit("2024-01-01").cast("date")})
    whole = F.concat(F.lit("<rss><channel><item><title>T</title><link>/from/"), number,
                     F.lit("/</link><pubDate>02 Mar 2024 10:00:00 GMT</pubDate></item></channel></rss>"))
    broken = F.element_at(F.array(F.lit("<rss><channel>"), F.lit("[{"), F.lit('{"items":'), F.lit(""), F.lit("\u0000"), F.lit("]")),
                          (number % 6 + 1).cast("int"))
    payloads = sources.select(
        F.col("id").alias("source_id"), F.lit("https://example.com/feed").alias("url"),
        F.when(number % 5 == 3, F.lit(503)).otherwise(200).alias("http_status"),
        F.lit(LABELS_NOW).cast("timestamp").alias("fetched_at"),
        F.when((kind == 0) & (number % 3 != 0), whole).otherwise(broken).alias("body"), number.cast("long").alias("seq"))
    payloads = payloads.withColumn("http_status", F.when(F.col("body").startswith("<rss><channel><item>"), 200).otherwise(F.col("http_status")))
    collect_run(store, payloads, sources.drop("s_suppkey"), spark.createDataFrame([], REFERENCE_SOURCE), LABELS_NOW, allow_large_change=True)
    return store.read("source_status").select("source_id", "status").join(
        store.items().select("source_id", F.col("id").alias("item")), "source_id", "left")
