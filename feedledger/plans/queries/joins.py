"""Increment, de-duplication and merge operators."""

from pyspark.sql import functions as F

from . import query, table, wall
from .inputs import (
    DOCUMENT_ITEMS, LABEL_STATES, LABELS_NOW, ORDER_CURSORS, ORDER_WINDOW, ORDERS_NOW,
    document_items, label_states, order_bounds, order_cursors, order_items, order_known,
)
from ...operators import checks, dedup, increment, merge
from ...operators.lifecycle import observed_stages, stage_event, upsert_stages


def _documents_by_text(spark, folder):
    """Documents with a digest of the whole text as the key; the text itself stays behind."""
    specificity = F.expr("CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END")
    return table(spark, folder, "documents").select(
        "doc_id", "source", F.sha2("text", 256).alias("key"), specificity.alias("specificity"),
        (F.col("doc_id") % 10 == 0).alias("skip"))


_BY_TEXT = """SELECT doc_id, source, sha256(text) AS key, doc_id % 10 = 0 AS skip,
  CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS specificity FROM documents"""


@query(f"""SELECT doc_id, key FROM ({_BY_TEXT})
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY specificity DESC, source, doc_id) = 1""")
def document_survivors(spark, folder):
    rows = _documents_by_text(spark, folder)
    return dedup.most_specific(rows, F.col("key"), F.col("specificity"), F.col("source"),
                               F.col("doc_id")).select("doc_id", "key")


@query(f"""
  SELECT doc_id FROM (SELECT * FROM ({_BY_TEXT}) WHERE NOT skip
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY specificity DESC, source, doc_id) = 1)
  UNION ALL SELECT doc_id FROM ({_BY_TEXT}) WHERE skip""")
def document_survivors_with_bypass(spark, folder):
    rows = _documents_by_text(spark, folder)
    return dedup.most_specific(rows, F.col("key"), F.col("specificity"), F.col("source"),
                               F.col("doc_id"), F.col("skip")).select("doc_id")


@query("SELECT sha256(text) AS key, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def document_first_seen(spark, folder):
    rows = _documents_by_text(spark, folder).select("key", "doc_id", "source")
    return dedup.first_seen(rows, ["key"], ["doc_id"])


@query("SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, folder):
    return dedup.duplicate_keys(_documents_by_text(spark, folder), ["key"])


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, source AS source_id FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def new_documents(spark, folder):
    """Labelled documents are already imported; the rest is new."""
    batch = document_items(spark, folder)
    existing = label_states(spark, folder).select("id")
    return merge.new_items(batch, existing, ["seq"]).select("id", "source_id")


@query("""
  SELECT category, count(*) AS items, CAST(sum(seq) AS BIGINT) AS total
  FROM (SELECT lang AS category, doc_id AS seq FROM documents WHERE doc_id % 3 = 0
        UNION ALL SELECT lang, doc_id FROM documents WHERE doc_id % 3 <> 0) GROUP BY category""")
def merged_documents(spark, folder):
    """An overlapping batch merged into a third of the documents."""
    everything = document_items(spark, folder)
    existing = everything.where("seq % 3 = 0")
    batch = everything.where("seq % 3 <> 0 OR seq % 2 = 0")
    merged = merge.merge_items(existing, merge.new_items(batch, existing, ["seq"]))
    return merged.groupBy("category").agg(F.count("*").alias("items"), F.sum("seq").alias("total"))


@query(f"""SELECT i.id, i.source_id FROM ({DOCUMENT_ITEMS}) i ANTI JOIN ({LABEL_STATES}) s USING (id)""")
def missing_state(spark, folder):
    return checks.missing_states(document_items(spark, folder), label_states(spark, folder)).select("id", "source_id")


@query(f"""
  SELECT s.id, s.state FROM ({LABEL_STATES}) s
  ANTI JOIN (SELECT CAST(page_id AS VARCHAR) AS id FROM pages) i USING (id)
  WHERE NOT (s.state = 'ignored' AND TIMESTAMP '{LABELS_NOW}' - s.ignored_at < INTERVAL 48 HOUR)""")
def orphan_state(spark, folder):
    """Pages are the items; labels of other numbers are orphans."""
    items = table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("id"))
    return checks.orphan_states(items, label_states(spark, folder), LABELS_NOW).select("id", "state")


@query(f"""
  SELECT id, state, updated_at FROM ({LABEL_STATES})
  UNION ALL
  SELECT id, 'unread', TIMESTAMP '{LABELS_NOW}' FROM ({DOCUMENT_ITEMS}) ANTI JOIN ({LABEL_STATES}) USING (id)""")
def synced_states(spark, folder):
    synced = merge.sync_states(label_states(spark, folder), document_items(spark, folder), LABELS_NOW)
    return synced.select("id", "state", wall("updated_at").alias("updated_at"))


@query(f"WITH {ORDER_WINDOW} SELECT id, source_id, date, is_initial FROM windowed")
def orders_in_window(spark, folder):
    return increment.within_window(
        order_items(spark, folder), order_bounds(spark, folder), ORDERS_NOW,
    ).select("id", "source_id", "date", "is_initial")


@query(f"""
  WITH {ORDER_WINDOW},
  undated AS (SELECT * FROM windowed WHERE date_basis = 'discovered' AND CAST(id AS BIGINT) % 2 = 1)
  SELECT id, source_id, TRUE AS imported, date_basis = 'discovered' AS recorded FROM windowed WHERE date_basis <> 'discovered'
  UNION ALL SELECT id, source_id, NOT is_initial, TRUE FROM undated""")
def undated_baseline(spark, folder):
    windowed = increment.within_window(order_items(spark, folder), order_bounds(spark, folder), ORDERS_NOW)
    return increment.decide_undated(windowed, order_known(spark, folder)).select(
        "id", "source_id", "imported", "recorded")


@query(f"""
  WITH {ORDER_WINDOW},
  latest AS (SELECT source_id, max(date) AS d, arg_max(id, row(date, seq)) AS i FROM windowed
             WHERE date_basis <> 'discovered' GROUP BY source_id)
  SELECT coalesce(c.source_id, b.source_id) AS source_id,
         CASE WHEN b.source_id <> '2-HIGH' THEN TIMESTAMP '2001-08-02' ELSE c.last_run_at END AS last_run_at,
         CASE WHEN b.source_id <> '2-HIGH' THEN l.d END AS last_item_date,
         CASE WHEN b.source_id <> '2-HIGH' THEN l.i END AS last_item_id
  FROM bounds b LEFT JOIN ({ORDER_CURSORS}) c USING (source_id) LEFT JOIN latest l USING (source_id)""")
def cursor_advance(spark, folder):
    """One source failed in this run and keeps its cursor."""
    bounds = order_bounds(spark, folder)
    imported = increment.within_window(order_items(spark, folder), bounds, ORDERS_NOW).where(
        "date_basis <> 'discovered' AND source_id <> '2-HIGH'")
    succeeded = bounds.where("source_id <> '2-HIGH'").select("source_id")
    moved = increment.advance_cursors(order_cursors(spark, folder), imported, succeeded, ORDERS_NOW)
    return moved.select("source_id", wall("last_run_at").alias("last_run_at"), "last_item_date", "last_item_id")


@query("""
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
         CASE WHEN o_orderkey % 17 = 0 THEN 'deleted' ELSE 'modified' END AS change
  FROM orders WHERE (o_orderkey % 17 = 0 AND o_orderkey % 34 <> 0) OR (o_orderkey % 17 <> 0 AND o_orderkey % 23 = 0)""")
def append_only_diff(spark, folder):
    """Orders against a copy in which some were edited and some dropped, half of those rightly."""
    before = order_items(spark, folder)
    after = before.where("seq % 17 <> 0").withColumn("date", F.when(
        F.col("seq") % 23 == 0, F.date_add("date", 1)).otherwise(F.col("date")))
    removed = before.where("seq % 34 = 0").select("id")
    return checks.append_only_diff(before, after, removed)


@query(f"""
  SELECT source_id FROM ({ORDER_CURSORS}) WHERE TIMESTAMP '2000-06-01' < last_run_at""")
def cursor_regressions(spark, folder):
    before = order_cursors(spark, folder)
    after = before.withColumn("last_run_at", F.lit("2000-06-01 00:00:00").cast("timestamp"))
    return checks.cursor_regressions(before, after).select("source_id")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_files(spark, folder):
    """Orders with a returned line; children are reduced to their keys before the join."""
    returned = (table(spark, folder, "lineitem").where("l_returnflag = 'R'")
                .select(F.col("l_orderkey").alias("o_orderkey")).distinct())
    return table(spark, folder, "orders").select("o_orderkey").join(returned, "o_orderkey", "left_semi")


@query("""
  WITH old AS (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS stage FROM events
               WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id),
       new AS (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS stage FROM events
               WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id)
  SELECT CAST(user_id AS VARCHAR) AS slug, CASE WHEN old.stage IS NULL THEN 'new:' || new.stage
         WHEN new.stage = 'withdrawn' THEN 'withdrawn' ELSE 'transition:' || new.stage END AS event
  FROM new LEFT JOIN old USING (user_id) WHERE old.stage IS DISTINCT FROM new.stage""")
def lifecycle_transitions(spark, folder):
    """A user's last event type in each half of the month, compared as two snapshots."""
    events = table(spark, folder, "events").select(
        F.lit("s").alias("source_id"), F.col("user_id").cast("string").alias("slug"),
        F.col("event_type").alias("stage"), F.struct("ts", "event_id").alias("seq"))
    first, second = (observed_stages(events.where(c)) for c in (
        F.col("seq.ts") < F.lit("2024-01-16").cast("timestamp_ntz"),
        F.col("seq.ts") >= F.lit("2024-01-16").cast("timestamp_ntz")))
    before = first.select("slug", F.col("stage").alias("before"))
    return (second.join(before, "slug", "left")
            .select("slug", stage_event(F.col("before"), F.col("stage")).alias("event"))
            .where("event IS NOT NULL"))


@query("""
  SELECT p_brand AS source_id, p_name AS slug, CAST(CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN max(p_size) ELSE min(p_size) END AS VARCHAR) AS stage
  FROM part GROUP BY p_brand, p_name""")
def upserted_stages(spark, folder):
    """Two brands were seen in this run and replace their stages."""
    rows = table(spark, folder, "part").select(
        F.col("p_brand").alias("source_id"), F.col("p_name").alias("slug"), "p_size")
    by_slug = rows.groupBy("source_id", "slug")
    known = by_slug.agg(F.min("p_size").cast("string").alias("stage"))
    seen = rows.where(F.col("source_id").isin("Brand#1", "Brand#2")).select(
        "source_id", "slug", F.col("p_size").cast("string").alias("stage"), F.col("p_size").alias("seq"))
    return upsert_stages(known, observed_stages(seen))
