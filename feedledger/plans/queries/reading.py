"""Reading-state transitions, cleanup, and the data checks."""

import uuid

from pyspark.sql import functions as F

from . import query, table, wall
from .inputs import (
    DOCUMENT_ITEMS, EVENT_TRANSITIONS, LABEL_STATES, LABELS_NOW, document_items,
    event_transitions, label_states, user_day,
)
from ...operators import checks
from ...operators.states import apply_transitions, clean_up, fold_transitions
from ...schemas import STATE
from ...session import work_folder
from ..reading import change_states
from ..store import Store

_FOLD = f"""
  t AS ({EVENT_TRANSITIONS}),
  live AS (SELECT *, count(*) FILTER (WHERE state = 'ignored') OVER (
             PARTITION BY id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM t),
  folded AS (SELECT id, arg_max(state, row(ts, seq)) AS state, arg_max(ts, row(ts, seq)) AS updated_at,
                    max(ts) FILTER (WHERE state = 'read') AS read_at,
                    max(ts) FILTER (WHERE state = 'ignored') AS ignored_at
             FROM live WHERE ended = 0 GROUP BY id)"""


def _times(df):
    return df.select("id", "state", *[wall(c).alias(c) for c in ("updated_at", "read_at", "ignored_at")])


@query(f"WITH {_FOLD} SELECT * FROM folded")
def state_fold(spark, folder):
    return _times(fold_transitions(event_transitions(spark, folder)))


def _bought_items(spark, folder):
    """User-days with a purchase are active items; labels of the same number are earlier states."""
    return (table(spark, folder, "events").where("event_type = 'purchase'").select(
        user_day().alias("id")).distinct())


_APPLIED = f"""{_FOLD},
  active AS (SELECT DISTINCT CAST(user_id * 31 + day(ts) - 1 AS VARCHAR) AS id FROM events WHERE event_type = 'purchase'),
  old AS ({LABEL_STATES}),
  hit AS (SELECT * FROM folded WHERE id IN (SELECT id FROM active)
          OR id IN (SELECT id FROM old WHERE state = 'ignored')),
  merged AS (
    SELECT coalesce(o.id, h.id) AS id, o.state AS o_state, h.state AS h_state,
           h.id IS NULL OR coalesce(o.updated_at > h.updated_at, FALSE) AS keeps, o.updated_at AS o_at, h.updated_at AS h_at,
           least(o.ignored_at, h.ignored_at) AS cut, o.read_at AS o_read, h.read_at AS h_read
    FROM old o FULL JOIN hit h ON o.id = h.id)"""


_APPLIED_STATES = f"""WITH {_APPLIED}
  SELECT id, CASE WHEN cut IS NOT NULL THEN 'ignored' WHEN keeps THEN o_state ELSE h_state END AS state,
         CASE WHEN cut IS NOT NULL THEN cut WHEN keeps THEN o_at ELSE h_at END AS updated_at,
         greatest(CASE WHEN cut IS NULL OR o_read <= cut THEN o_read END,
                  CASE WHEN cut IS NULL OR h_read <= cut THEN h_read END) AS read_at,
         cut AS ignored_at FROM merged"""


@query(_APPLIED_STATES)
def applied_states(spark, folder):
    _, states = apply_transitions(_bought_items(spark, folder), label_states(spark, folder),
                                  event_transitions(spark, folder))
    return _times(states)


@query(_APPLIED_STATES)
def stored_state_changes(spark, folder):
    """The same against a store: a segment of changed states over the earlier ones."""
    store = Store(spark, f"{work_folder(spark)}/changes-{uuid.uuid4().hex}")
    store.bootstrap()
    items = _bought_items(spark, folder).withColumn("category", F.lit("all"))
    earlier = label_states(spark, folder)
    earlier = earlier.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STATE if f.name in earlier.columns])
    store.publish({"items": store.write("items", items, "run_id=0"),
                   "states": store.write("states", earlier, "run_id=0")})
    change_states(store, event_transitions(spark, folder))
    return _times(store.read("states"))


@query(f"""WITH {_APPLIED}
  SELECT id FROM active WHERE id NOT IN (SELECT id FROM hit WHERE state = 'ignored')""")
def applied_items(spark, folder):
    items, _ = apply_transitions(_bought_items(spark, folder), label_states(spark, folder),
                                 event_transitions(spark, folder))
    return items


_CLEANUP = f"""
  items AS ({DOCUMENT_ITEMS}),
  fated AS (SELECT *, CASE WHEN state = 'ignored' AND TIMESTAMP '{LABELS_NOW}' - ignored_at >= INTERVAL 48 HOUR THEN 'pruned'
                  WHEN state = 'ignored' THEN 'ignored'
                  WHEN state = 'read' AND TIMESTAMP '{LABELS_NOW}' >= read_at + INTERVAL 2 MONTH THEN 'expired'
                  ELSE 'kept' END AS fate FROM ({LABEL_STATES}))"""


def _cleaned(spark, folder):
    return clean_up(document_items(spark, folder), label_states(spark, folder), LABELS_NOW)


@query(f"""WITH {_CLEANUP}
  SELECT count(*) FILTER (WHERE fate = 'pruned') AS pruned,
         (SELECT count(*) FROM items SEMI JOIN (SELECT id FROM fated WHERE fate = 'ignored') USING (id)) AS scrubbed,
         count(*) FILTER (WHERE fate = 'expired') AS expired FROM fated""")
def cleanup_counts(spark, folder):
    return _cleaned(spark, folder).counts()


@query(f"""WITH {_CLEANUP}
  SELECT id, category FROM items ANTI JOIN (SELECT id FROM fated WHERE fate IN ('ignored', 'expired')) USING (id)""")
def cleaned_items(spark, folder):
    return _cleaned(spark, folder).items.select("id", "category")


@query(f"WITH {_CLEANUP} SELECT id, state FROM fated WHERE fate IN ('ignored', 'kept')")
def cleaned_states(spark, folder):
    return _cleaned(spark, folder).states.select("id", "state")


@query(f"""WITH {_CLEANUP}
  SELECT id FROM items SEMI JOIN (SELECT id FROM fated WHERE fate = 'ignored') USING (id)
  UNION SELECT id FROM fated WHERE fate = 'expired'""")
def removed_ids(spark, folder):
    return _cleaned(spark, folder).removed_ids()


@query(f"""
  WITH docs AS ({DOCUMENT_ITEMS}),
  listed AS (SELECT * FROM docs UNION ALL SELECT * FROM docs WHERE seq % 4 = 0)
  SELECT "check", CAST(sum(times) AS BIGINT) AS n, min(message) AS first FROM (
    SELECT 'news-id-format' AS "check", 1 AS times,
           'Item "' || id || '" (source "' || source_id || '") does not look like a deterministic id' AS message
    FROM listed
    UNION ALL
    SELECT 'state-missing-for-item', 1, 'Active item "' || id || '" has no reading state'
    FROM listed ANTI JOIN ({LABEL_STATES}) USING (id)
    UNION ALL
    SELECT 'news-duplicate-id', count(*) - 1, 'Duplicate active item id "' || id || '"'
    FROM listed GROUP BY id HAVING count(*) > 1
  ) GROUP BY "check" """)
def data_issues(spark, folder):
    """Every fourth document is listed twice and document numbers are no hashes."""
    items = document_items(spark, folder)
    found = checks.data_issues(items.unionByName(items.where("seq % 4 = 0")),
                               label_states(spark, folder), LABELS_NOW)
    return found.groupBy("check").agg(F.sum("times").alias("n"), F.min("message").alias("first"))


@query("""
  SELECT 'id' AS field, count(*) FILTER (WHERE p_name = '') AS violations FROM part
  UNION ALL SELECT 'label', count(*) FILTER (WHERE p_type NOT IN ('ECONOMY', 'STANDARD')) FROM part
  UNION ALL SELECT 'price', count(*) FILTER (WHERE NOT p_retailprice >= 950) FROM part
  UNION ALL SELECT 'size', count(*) FILTER (WHERE p_size IS NULL) FROM part""")
def row_expectations(spark, folder):
    return checks.violations(table(spark, folder, "part"), {
        "id": F.col("p_name") != "", "label": F.col("p_type").isin("ECONOMY", "STANDARD"),
        "price": F.col("p_retailprice") >= 950, "size": F.col("p_size").isNotNull()})
